"""Hierarchical language identification.

Texts become vectors of hashed letter grams. Linear support vector machines
first tell the language family, one against one; then, within the family, one
against one, its languages. The machines are trained by Spark on a bounded
sample of labelled documents; every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.text import ASCII_LOWER, slices
from attestry.runtime import saved
from attestry.sources.tables import read_table

#: Families of language codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "de en nl sv da no nb nn is af lb fy yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "baltic": ["lt", "lv"],
    "uralic": ["fi", "et", "hu"],
    "turkic": "tr az kk uz ky tk".split(),
}
#: Dimensions of the hashed vectors, and labelled documents sampled for each language.
DIMENSIONS, SAMPLE = 2048, 600
ROUNDS, REGULARISATION = 40, 1e-4
UNKNOWN = "und"

_MARK = np.frombuffer(bytes(0 if c < 128 and not (65 <= c <= 90 or 97 <= c <= 122) else 1 for c in range(256)), np.uint8)


def vector(text: str | None) -> np.ndarray | None:
    """Square-rooted, normalised counts of hashed grams of 1 to 4 bytes of words; None without letters.

    Bytes of other than ASCII letters and of non-ASCII characters part words.
    """
    if not text or not any(map(str.isalpha, text)):
        return None
    raw = np.frombuffer(b"\x00" + text.encode().translate(ASCII_LOWER) + b"\x00", np.uint8)
    data = np.where(_MARK[raw] == 1, raw, np.uint8(32)).astype(np.uint32)
    repeat = (data[1:] == 32) & (data[:-1] == 32)
    data = data[np.r_[True, ~repeat]]
    counts = np.zeros(DIMENSIONS)
    gram = np.zeros(len(data), np.uint32)
    for k in range(1, 5):
        if len(data) < k:
            break
        gram = gram[: len(data) - k + 1] * np.uint32(257) + data[k - 1 :]
        mixed = (gram + np.uint32(k)) * np.uint32(2654435761)
        counts += np.bincount(mixed >> np.uint32(21), minlength=DIMENSIONS)
    counts = np.sqrt(counts)
    return counts / np.linalg.norm(counts)


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [vector(x) for x in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array([None if v is None else v.tolist() for v in found], pa.list_(pa.float64()))], names=["lang", "vector"])


class Machines:
    """One-against-one machines over named classes."""

    def __init__(self, names: list[str], pairs: dict[tuple[str, str], tuple[np.ndarray, float]]):
        self.names, self.pairs = names, pairs
        if pairs:
            self.weights = np.stack([w for w, _ in pairs.values()], axis=1)
            self.offsets = np.array([b for _, b in pairs.values()])

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class index of each row by votes, then margins; and a confidence of 0 to 1."""
        if not self.pairs:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margins = x @ self.weights + self.offsets
        votes = np.zeros((len(x), len(self.names)))
        for k, (a, b) in enumerate(self.pairs):
            soft = 1 / (1 + np.exp(-2 * margins[:, k].clip(-30, 30)))
            votes[:, self.names.index(b)] += (margins[:, k] > 0) + soft * 1e-3
            votes[:, self.names.index(a)] += (margins[:, k] <= 0) + (1 - soft) * 1e-3
        best = votes.argmax(axis=1)
        sure = np.ones(len(x))
        for k, (a, b) in enumerate(self.pairs):
            soft = 1 / (1 + np.exp(-2 * margins[:, k].clip(-30, 30)))
            sure = np.where(best == self.names.index(b), np.minimum(sure, soft), sure)
            sure = np.where(best == self.names.index(a), np.minimum(sure, 1 - soft), sure)
        return best, sure


def _train_pairs(rows: DataFrame, names: list[str], label: str) -> Machines:
    pairs = {}
    for a, b in combinations(names, 2):
        both = rows.filter(F.col(label).isin(a, b)).select((F.col(label) == b).cast("double").alias("label"), "features")
        model = LinearSVC(maxIter=ROUNDS, regParam=REGULARISATION, aggregationDepth=2).fit(both)
        pairs[a, b] = (model.coefficients.toArray(), float(model.intercept))
    return Machines(names, pairs)


def train(labelled: DataFrame, sample: int = SAMPLE) -> tuple[Machines, dict[str, Machines]]:
    """Machines of families and of each family's languages from (lang, text).

    At most ``sample`` distinct texts of each language are used, those of least
    hash; rows that repeat a text count once. Texts are read whole, however
    long. Without labelled texts nothing is learnt.
    """
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # Of the distinct texts a share of each language by hash, then exactly the least: bounded before it is sorted.
    known = known.withColumn("h", F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)))
    distinct = saved(known.select("lang", "h").distinct())
    sizes = {r["lang"]: r["n"] for r in distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1 << 62, int((1 << 62) * 3 * sample / n))).otherwise(share)
    some = distinct.filter(F.col("h") < share).withColumn("r", F.expr("row_number() OVER (PARTITION BY lang ORDER BY h)")).filter(F.col("r") <= sample)
    picked = known.join(F.broadcast(some.drop("r")), ["lang", "h"]).dropDuplicates(["lang", "h"])
    rows = picked.select("lang", "text").mapInArrow(_vectors, "lang string, vector array<double>").filter("vector IS NOT NULL")
    rows = saved(rows)
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    families = sorted({family_of(x) for x in langs})
    family = F.lit(None).cast("string")
    for x in langs:
        family = F.when(F.col("lang") == x, family_of(x)).otherwise(family)
    rows = rows.select("lang", family.alias("family"), array_to_vector("vector").alias("features")).coalesce(4).cache()
    try:
        within = {f: _train_pairs(rows, [x for x in langs if family_of(x) == f], "lang") for f in families}
        return _train_pairs(rows, families, "family"), within
    finally:
        rows.unpersist()


def predict_language(docs: DataFrame, models: tuple[Machines, dict[str, Machines]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row.

    Texts that are null or have no letters, and all texts if nothing was
    learnt, get ``und`` with score 0. The score is the smallest confidence of
    the machines that chose the family and the language. Of classes with equal
    votes the first by name is taken. Repeated rows repeat, texts are read
    whole, columns other than the two named are not read, and an empty table
    gives no rows.
    """
    top, within = models
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [vector(x) for x in batch.column(1).to_pylist()]
            at = [i for i, v in enumerate(found) if v is not None]
            pred = np.full(len(found), UNKNOWN, object)
            score = np.zeros(len(found))
            if at and top.names:
                x = np.stack([found[i] for i in at])
                family, sure = top.predict(x)
                for k, name in enumerate(top.names):
                    rows = np.flatnonzero(family == k)
                    if len(rows):
                        lang, own = within[name].predict(x[rows])
                        where = np.array(at)[rows]
                        pred[where] = np.array(within[name].names, object)[lang]
                        score[where] = np.minimum(sure[rows], own)
            yield pa.record_batch([batch.column(0), pa.array(pred.tolist(), pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document of the table, learnt from four of five; a null doc_id is not learnt from and not held out."""
    docs = read_table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    models = train(docs.filter(fold != 0).select("lang", "text"))
    found = predict_language(docs, models)
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_id": op6_language_id}
ORACLE_SQL: dict[str, str] = {}
