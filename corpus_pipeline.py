"""The training-corpus pipeline: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.decontaminate import leaks
from attestry.llm.neardup import near_copies
from attestry.llm.packing import best_fit_packing
from attestry.llm.pii import redact
from attestry.llm.quality import quality_rules
from attestry.runtime import broadcast_if_small, saved
from attestry.sources.tables import read_table


def _with_text(docs: DataFrame, changed: DataFrame, text: str) -> DataFrame:
    """Columns of ``docs`` from ``changed`` with column ``text`` as the text and its length."""
    sized = F.when(F.col(text).isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)).alias("n_chars") if "n_chars" in docs.columns else None
    new = {"text": F.col(text).alias("text"), "n_chars": sized}
    return changed.select(*[new.get(c, F.col(c)) if new.get(c) is not None else F.col(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines above the limits.

    Null and empty texts fail the rules; repeated rows are judged alike.
    """
    judged = quality_rules(docs).filter("kept")
    return _with_text(docs, judged, "clean_text")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of id and text in ``__key``: ids may be null or repeat with other texts."""
    parts = [F.when(F.col(c).isNotNull(), F.col(c).cast("string")) for c in ("doc_id", "text")]
    return docs.withColumn("__key", F.unhex(F.md5(F.concat_ws("\x1f", *[F.coalesce(F.sha2(c, 256), F.lit("")) for c in parts]))))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id; of rows equal in id and text one.

    Near copies share 80 % of their shingles of five words. A null id comes
    after all others; of several texts under the least id one is kept.
    """
    docs = _keyed(docs)
    found = near_copies(docs, "__key").distinct()
    ids = docs.select("__key", "doc_id").dropDuplicates(["__key"])
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "__key")
    chosen = found.withColumnRenamed("key", "__key").join(ids, "__key").groupBy("component").agg(F.min_by("__key", rank).alias("__key")).select("__key")
    return docs.join(broadcast_if_small(saved(chosen)), "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item; rows are judged by id and text together."""
    docs = _keyed(docs)
    found = leaks(docs, read_table(spark, sf_dir, "benchmark"), "__key").select(F.col("id").alias("__key")).distinct()
    return docs.join(found, "__key", "left_anti").drop("__key")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; null texts stay null and no row goes."""
    changed = redact(docs)
    return _with_text(docs, changed, "text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return best_fit_packing(docs).withColumnsRenamed({"id": "doc_id", "crc": "ids_crc32"})


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_duplicates", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("personal_data", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: Alignment and the tokenizer are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order over the table of documents; each reads what the one before wrote.

    Null ids and texts, repeated rows, empty tables and further columns are as
    the stages say. The rows are the last stage's: one for each piece.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
