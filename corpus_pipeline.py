"""From raw documents to token ids, in five stages.

Each stage takes the documents that its predecessor kept and returns those that it keeps
or changes, with the columns of ``documents``; the last returns what it has encoded.
Between stages the documents are written as Parquet and read again, so that a lost
executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenuro.functions.lineage import discard, written
from tenuro.llm import bpe, decontamination, jaccard_join, language_id, pii


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones of ``docs`` have; others go.

    So do null and empty texts and those without letters, which have no language. Repeated
    rows stay or go together, and a document of any length is judged by all of it.
    """
    return language_id.with_known_language(docs, language_id.fit_language_filters(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share three quarters of their 5-word shingles, the first.

    That is the one of least id, a null id first; of rows with one id and text, any one.
    Texts without words, if any, are linked with nothing and stay.
    """
    return jaccard_join.one_of_each_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item, or a shorter item.

    Null and empty texts have no words and stay, and so do all documents if no item has any.
    Repeated rows stay or go together.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.without_benchmark_passages(docs, benchmark)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, and their new lengths.

    A null text stays null, an empty one empty; every row stays, repeated ones too.
    """
    return pii.mask_pii(docs, length="n_chars" if "n_chars" in docs.columns else None)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    A null text counts as empty and has no ids. One row for each, repeated ones too.
    """
    import public_tokenizers

    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminated),
    ("PII", masked),
    ("BPE", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` in ``sf_dir``.

    What a stage has read is deleted once its result is written; an empty table gives an
    empty result.
    """
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "documents")
        discard(*kept)
        kept = [docs]
    _, last = STAGES[-1]
    return last(spark, docs, sf_dir)


#: SQL can't express the transducers and the encoder; tests hold the rows against a plain
#: Python version of the stages.
ORACLE_SQL = None
