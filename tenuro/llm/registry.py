"""The queries of this subpackage and, where SQL can express them, their SQL."""

import corpus_pipeline
from tenuro.llm import (
    bpe,
    decontamination,
    fill_in_middle,
    jaccard_join,
    language_id,
    pii,
    quality_classifier,
    quality_rules,
    secrets,
    spelling,
    token_counts,
    token_files,
    url_filters,
)


def queries() -> dict:
    return {
        "op1_rule_ensemble": quality_classifier.op1_rule_ensemble,
        "op2_language_filters": language_id.op2_language_filters,
        "op3_token_files": token_files.op3_token_files,
        "op4_prefix_join": decontamination.op4_prefix_join,
        "op5_rule_ledger": quality_rules.op5_rule_ledger,
        "op6_url_rules": url_filters.op6_url_rules,
        "op7_shingle_product": jaccard_join.op7_shingle_product,
        "op8_novel_secrets": secrets.op8_novel_secrets,
        "op9_bpe_transducer": bpe.op9_bpe_transducer,
        "op10_deobfuscated_pii": pii.op10_deobfuscated_pii,
        "op11_spelling_groups": spelling.op11_spelling_groups,
        "op12_resynchronised": token_counts.op12_resynchronised,
        "op13_piece_table": fill_in_middle.op13_piece_table,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_prefix_join": decontamination.OP4_SQL,
        "op5_rule_ledger": quality_rules.OP5_SQL,
        "op6_url_rules": url_filters.OP6_SQL,
        "op13_piece_table": fill_in_middle.OP13_SQL,
    }
