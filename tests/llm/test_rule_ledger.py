from tenuro.llm.quality_rules import POLICIES, RULES, Policy, ablations, apply_policy, ledger


def repeat_words(text):
    words = text.split(" ")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


def test_measurements(spark):
    text = "a b c a b c\na b c a b c\n#x | $y\n\n \nz"
    (row,) = ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.n_words, row.word_chars, row.n_symbols) == (16, 18, 3)
    assert (row.n_dup_lines, row.n_lines) == (1, 4)
    assert row.n_repeat_words == repeat_words(" ".join(text.split()))


def test_odd_rows_measure_too(odd, nothing):
    rows = ledger(odd).collect()
    assert len(rows) == odd.count()
    empty = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert all(r.n_words == 0 and r.failures & 1 for r in empty)
    long = {r.n_repeat_words for r in rows if r.doc_id in (5, 6)}
    assert long == {6 * 20_000}
    assert ledger(nothing).count() == 0


def test_ablations_count_each_rule(odd, nothing):
    kept = ledger(odd)
    for policy in POLICIES.values():
        rows = kept.collect()
        failed = {name: [bool(r.failures >> i & 1) for r in rows] for i, name in enumerate(RULES)}
        for r in ablations(kept, policy).collect():
            others = [n for n in policy.rules if n != r.rule]
            alone = sum(
                f and not any(failed[n][i] for n in others) for i, f in enumerate(failed[r.rule])
            )
            assert (r.n_failed, r.n_alone) == (sum(failed[r.rule]), alone)
    assert {r.n_failed for r in ablations(ledger(nothing), POLICIES["v2"]).collect()} == {0}


def test_policies_are_masks_over_one_ledger(odd):
    kept = ledger(odd)
    none = apply_policy(kept, Policy("none", ())).where("kept").count()
    assert none == odd.count()
    base = apply_policy(kept, POLICIES["base"]).where("kept").count()
    assert apply_policy(kept, POLICIES["v2"]).where("kept").count() <= base
