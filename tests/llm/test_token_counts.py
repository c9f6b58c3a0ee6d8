import json
import random

import pytest

from tenuro.llm.token_counts import ChunkedCounter, begins_anew, count_tokens
from tests.llm import plain
from tests.llm.conftest import ODD

FILE = open(plain.WORD_VOCABULARY, encoding="utf-8").read()
BYTES = open(plain.VOCABULARY, encoding="utf-8").read()
LETTERS = [
    "a", "B", "é", "é", "́", "İ", "ß", "1", "٣", "!", "<|endoftext|>",
    "<|startoftext|>", "<|endof", "text|>", " ", "\n", "　", "漢", "각", "가",
    "ᆨ", "क़", "🙂", "'s", "'", "ll", "\x00", "Σ", "ς",
]


def library(file):
    return plain.counting_tokenizer() if file is FILE else plain.tokenizer()


@pytest.mark.parametrize("file", [FILE, BYTES])
@pytest.mark.parametrize("chunk,overlap", [(64, 40), (128, 31), (300, 100)])
def test_splices_are_exact(file, chunk, overlap):
    rnd, counter = random.Random(chunk), ChunkedCounter(file, chunk, overlap)
    widened = 0
    for _ in range(300):
        letters = rnd.choice([LETTERS, LETTERS[:4], LETTERS[10:14], LETTERS[17:22], ["a", "́"]])
        text = "".join(rnd.choices(letters, k=rnd.randrange(1, 1500)))
        (count,) = counter.counts([text])
        assert count.n_tokens == len(library(file).encode(text, add_special_tokens=False))
        widened += count.n_widened
    assert widened


@pytest.mark.parametrize("file", [FILE, BYTES])
def test_what_is_remembered_is_exact(file, texts):
    rnd, counter = random.Random(1), ChunkedCounter(file, 2000, 100, held=500)
    texts = [t or "" for _, t in texts]
    texts += ["".join(rnd.choices(LETTERS, k=rnd.randrange(200))) for _ in range(500)]
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        expected = [len(e) for e in library(file).encode_batch(part, add_special_tokens=False)]
        assert [c.n_tokens for c in counter.counts(part)] == expected


@pytest.mark.parametrize("letter", ["a", " ", "\n", "!", "漢", "1", "́", "ab ", "<|endoftext|>"])
def test_long_runs(letter):
    text = letter * 300_000
    (count,) = ChunkedCounter(FILE).counts([text])
    assert count.n_tokens == plain.count_of_tokens(text) and count.n_chunks > 1


def test_long_texts_of_known_words_are_not_encoded_again(monkeypatch):
    rnd, counter = random.Random(5), ChunkedCounter(FILE, 2000, 200)
    words = ["alpha", "Beta", "don't", "\n", "naïve", "", "12,5", "漢字", "<|endoftext|>", "x\ny"]
    texts = [" ".join(rnd.choices(words, k=5000)) for _ in range(3)]
    encoded = []
    whole, part = counter._whole, counter._words
    monkeypatch.setattr(counter, "_whole", lambda t: encoded.extend(t) or whole(t))
    monkeypatch.setattr(counter, "_words", lambda t, a, b: encoded.append(t[a:b]) or part(t, a, b))
    for text, count in zip(texts, counter.counts(texts)):
        expected = len(library(FILE).encode(text, add_special_tokens=False))
        assert count.n_tokens == expected and count.n_chunks > 5
    assert sum(map(len, encoded)) < 0.1 * sum(map(len, texts))


def test_places_after_spaces_splice_exactly():
    """Spaces in runs, and words that begin with marks or line ends."""
    rnd, counter = random.Random(6), ChunkedCounter(FILE, 128, 80)
    assert counter.remembers
    words = ["a", "b́", "́", "\nx", "ᆨ", "가", "", "", "É", "ll", "'s", "🙂", "क़", "<|end"]
    spaced = 0
    for _ in range(300):
        text = " ".join(rnd.choices(words, k=rnd.randrange(1, 600)))
        text += rnd.choice(["", "y" * rnd.randrange(60)])
        (count,) = counter.counts([text])
        assert count.n_tokens == len(library(FILE).encode(text, add_special_tokens=False))
        spaced += count.n_chunks > 1 and counter._spaced(text)
    assert spaced


def test_odd_rows(spark, odd, nothing):
    got = count_tokens(odd, plain.WORD_VOCABULARY, limit=5, chunk=1000, overlap=64).collect()
    expected = [
        (k, len((t or "").encode()), n, n > 5)
        for k, t in ODD
        for n in [plain.count_of_tokens(t)]
    ]
    key = lambda r: (r[0] is not None, r)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(expected, key=key)
    assert count_tokens(nothing, plain.WORD_VOCABULARY).count() == 0


def test_files_that_cannot_be_spliced_are_taken_whole():
    file = json.loads(FILE)
    file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"(?<=a)b|\S+"
    counter = ChunkedCounter(json.dumps(file), 64, 40)
    (count,) = counter.counts(["ab" * 500])
    assert not counter.splices and count.n_chunks == 1


def test_overlap_holds_the_margins():
    with pytest.raises(ValueError, match="overlap"):
        ChunkedCounter(FILE, 64, 20)


def test_what_composes_does_not_begin_anew():
    assert all(map(begins_anew, "a é漢각🙂"))
    assert not any(map(begins_anew, "́ᅡᆨ़͸"))
