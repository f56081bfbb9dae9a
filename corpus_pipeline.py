"""Documents to token files: five stages, each written as Parquet and reread.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept. All but the last return the columns of ``documents``; the last
returns the index of the token files it wrote. Other columns pass through whatever
their names. An empty table passes through every stage; its token files are none.
SQL can express neither the classifiers nor the byte-pair encoding, so there is
no ``ORACLE_SQL``; the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import decontaminate, langid, mixing, token_files
from orrery.llm._store import cleared, made, staged, swept
from orrery.llm.ngram_join import drop_near_duplicates

#: Vocabulary of the token files.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tables in the shared folder that stages left behind for their results.
_left: set[str] = set()


def _stage(f):
    """A stage that first deletes what earlier ones left, now that their results are written; what ``docs`` still reads stays."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _left.difference_update(cleared(spark, _left, docs))
        before = made()
        out = f(spark, docs, sf_dir)
        _left.update(made() - before - {getattr(out, "_orrery_path", None)})
        return out

    return run


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is ambiguous go, and so do NULL, empty and letterless texts.

    Rows that repeat an id are judged each; NULL ids stay. Without a row that
    has both text and ``lang`` no language is known and all rows go.
    """
    return langid.drop_ambiguous(docs)


@_stage
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies stays, that of the smallest doc_id.

    NULL ids and NULL or wordless texts stay; rows that repeat an id stay or go together.
    """
    return drop_near_duplicates(docs)


@_stage
def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row for itself.

    NULL ids and texts stay; with an empty benchmark all rows do.
    """
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or dropped by their mixing rates.

    Rows of one id share a draw, and NULL ids have one of their own; NULL and empty texts
    have the rate of their posterior. Without labels all rates are equal.
    """
    return mixing.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left: a row of the index per row, NULL texts with no tokens."""
    return token_files.write_tokens(docs, TOKENIZER)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", deduplicate),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_domains),
    ("token_files", write_token_files),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage's table goes when the next one is written."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
        swept(spark, since, docs)
    return docs
