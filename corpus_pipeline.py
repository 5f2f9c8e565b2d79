"""From raw documents to padded training batches: five stages, each written and read again.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantpulse.llm.common import table, write_shared
from plantpulse.llm.language_id import UNDETERMINED, fit_on, identify
from plantpulse.llm.line_dedup import LINE_COLUMNS, dedup_lines
from plantpulse.llm.minhash import near_duplicates
from plantpulse.llm.packing import n_words, pack
from plantpulse.llm.quality_rules import RULE_COLUMNS, quality_rules

#: A text whose best language is less likely than this is rejected.
LEAST_LANGUAGE_SCORE = 0.4
#: Near copies share so many hundredths of their word shingles at least.
NEAR_PERCENT = 80


def judged(docs: DataFrame, judge, made: tuple[str, ...], keep) -> DataFrame:
    """Rows of ``docs`` for which ``keep`` holds after ``judge`` has added the columns ``made``;
    own columns of these names are set aside meanwhile."""
    aside = {c: f"__own_{c}" for c in docs.columns if c in made}
    found = judge(docs.withColumnsRenamed(aside)).where(keep)
    return found.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a known language (fitted on the labelled texts of the stage's own input).

    Written here, as whole texts then go through the Python workers in small batches."""
    model = fit_on(docs)
    found = judged(docs, lambda d: identify(d, model), ("lang_pred", "score"),
                   (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return write_shared(found, "known-language", texts=True)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that no quality rule fails."""
    return judged(docs, quality_rules, RULE_COLUMNS, F.col("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; removed lines leave ``text``, and ``n_chars`` follows."""
    done = judged(docs, dedup_lines, LINE_COLUMNS, F.lit(True))
    return done.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else done


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Decisions belong to an id and its text together: different texts under one id (or a null id) are judged apart."""
    gone = near_duplicates(docs.select("doc_id", "text"), NEAR_PERCENT).where("not kept")
    gone = write_shared(gone.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).distinct(), "near-copies")
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__h"))
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs.select("doc_id", "text"), n_words(F.col("text")))


STAGES = [("language ID", language_id), ("quality rules", quality), ("line dedup", line_dedup),
          ("MinHash near-dedup", near_dedup), ("packing", packing)]

#: Language identification and packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
