"""Merkle fixity audit of WARC replicas.

A WARC file is an ordered run of records, each at its byte offset. The leaves
of a file's tree are its records' hashes; a node covers a fixed range of
offsets and hashes its children in order, and ranges widen by the fan-out from
level to level up to the root of the file. An audit compares the roots of two
replicas first and descends only below nodes that differ, to the records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.runtime import saved
from attestry.sources.tables import read_table

#: Bytes that a node above the leaves covers, and children of a node above it.
RANGE_BYTES, FANOUT = 1 << 16, 16
FILE_BYTES = 1 << 24
CRLF = "\r\n"


def warc_bodies(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(id, url, record): pages as WARC records, not yet placed in files."""
    url, body = F.col(url_col), F.coalesce(F.col(body_col), F.lit(""))
    header = F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: resource{CRLF}"), F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit(CRLF)), F.lit("")), F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2))
    return pages.select(F.col(id_col).alias("id"), url.alias("url"), F.concat(header, body, F.lit(CRLF * 2)).alias("record"))


def digests(records: DataFrame, record: str = "record", digest: str = "digest", length: str = "length") -> DataFrame:
    """``records`` with the digest and the length of a record: all that trees need, so that no payload is shuffled."""
    return records.withColumn(digest, F.sha2(record, 256)).withColumn(length, F.octet_length(record).cast("long"))


def placed(records: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Records (id, url, digest, length and more) with ``file`` and ``offset``.

    They are dealt to as many files as their size asks for and stand in a file
    by id, url and digest, so repeated rows have a place each.
    """
    total = records.agg(F.sum("length")).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    dealt = records.withColumn("file", F.pmod(F.xxhash64("id", "url", "digest"), F.lit(files)).cast("int"))
    before = Window.partitionBy("file").orderBy("id", "url", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """(file, offset, length, id, record): pages as WARC resource records in files.

    A null url is left out of the header, a null body is empty. Repeated rows
    have a record each. Columns other than the three named are not read. An
    empty table gives no rows. Bodies are hashed whole, however long.
    """
    made = digests(warc_bodies(pages, id_col, url_col, body_col))
    return placed(made, file_bytes).select("file", "offset", "length", "id", "record")


def leaves_of(places: DataFrame, digest: str = "digest", length: str = "length") -> DataFrame:
    """(file, offset, length, id, hash) of placed digests; the hash covers place and bytes."""
    place = F.concat_ws(":", F.col("offset").cast("string"), F.col(length).cast("string"), F.col(digest))
    return places.select("file", "offset", "length", "id", F.sha2(place, 256).alias("hash"))


def leaves(records: DataFrame) -> DataFrame:
    """(file, offset, length, id, hash) of records; the hash covers place and bytes."""
    return leaves_of(digests(records, length="held"), length="held")


def tree(leaf: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels (file, node, first, last, hash) from the ranges above the leaves to the roots.

    ``first`` and ``last`` bound the offsets of the records below. Levels are
    written; their number follows the longest file.
    """
    node = F.col("offset").cast("long")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "hash"))), lambda x: x["hash"]), "")
    level = leaf.groupBy("file", F.floor(node / range_bytes).alias("node")).agg(F.sha2(ordered, 256).alias("hash"), F.min("offset").alias("first"), F.max("offset").alias("last"))
    levels = [saved(level)]
    while not levels[-1].filter(F.col("node") > 0).isEmpty():
        ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"]), "")
        up = levels[-1].groupBy("file", F.floor(F.col("node") / fanout).alias("parent")).agg(F.sha2(ordered, 256).alias("hash"), F.min("first").alias("first"), F.max("last").alias("last"))
        levels.append(saved(up.withColumnRenamed("parent", "node")))
    return levels


def _pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys, F.col("hash").alias("other")), keys, "full").filter(~F.col("hash").eqNullSafe(F.col("other")))


def audit(a: DataFrame, b: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(file, offset, length, id, status) of records that differ between two sets of leaves.

    ``status`` is changed, missing (only in ``a``) or extra (only in ``b``).
    Equal replicas, and two empty ones, give no rows. Several records at one
    offset of a file are each compared by their hash.
    """
    left, right = tree(a, range_bytes, fanout), tree(b, range_bytes, fanout)
    while len(left) != len(right):  # a lone node 0 is its own parent
        short = left if len(left) < len(right) else right
        up = short[-1].groupBy("file", F.lit(0).cast("long").alias("node")).agg(F.sha2(F.max("hash"), 256).alias("hash"), F.min("first").alias("first"), F.max("last").alias("last"))
        short.append(up)
    open_nodes = _pairs(left[-1], right[-1], ["file", "node"]).select("file", "node")
    for x, y in zip(left[-2::-1], right[-2::-1], strict=True):
        below = lambda level, open_=open_nodes: level.withColumn("up", F.floor(F.col("node") / fanout)).join(open_.withColumnRenamed("node", "up"), ["file", "up"], "left_semi")
        open_nodes = saved(_pairs(below(x), below(y), ["file", "node"]).select("file", "node"))
    under = lambda leaf: leaf.withColumn("node", F.floor(F.col("offset") / range_bytes)).join(open_nodes, ["file", "node"], "left_semi").drop("node")
    odd = lambda x, y: x.join(y.select("file", "offset", "hash").distinct(), ["file", "offset", "hash"], "left_anti")
    left, right = under(a), under(b)
    lost, new = odd(left, right), odd(right, left)
    places = new.select("file", "offset").distinct().withColumn("there", F.lit(True))
    gone = lost.join(places, ["file", "offset"], "left").withColumn("status", F.when(F.col("there"), "changed").otherwise("missing"))
    extra = new.join(lost.select("file", "offset").distinct(), ["file", "offset"], "left_anti").withColumn("status", F.lit("extra"))
    columns = ["file", "offset", "length", "id", "status"]
    return gone.select(columns).unionByName(extra.select(columns))


def _damage(record: str = "record", id_col: str = "id"):
    """What a damaged replica holds of a record (null: nothing): by id some have a byte changed, some are cut short, some are gone."""
    k = F.pmod(F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(211))
    n = F.char_length(record)
    at = F.pmod(F.crc32(F.col(record)), n) + 1
    flipped = F.concat(F.substring(record, F.lit(1), (at - 1).cast("int")), F.lit("\x7f"), F.substring(record, (at + 1).cast("int"), n))
    return F.when(k == 5, flipped).when(k == 17, F.substring(record, F.lit(1), (n / 2).cast("int"))).when(k == 101, None).otherwise(F.col(record))


def damaged_copy(records: DataFrame) -> DataFrame:
    """A replica of the records to audit, see :func:`_damage`."""
    return records.withColumn("record", _damage()).filter(F.col("record").isNotNull())


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the pages' WARC files that a damaged replica no longer holds as they were."""
    made = digests(warc_bodies(read_table(spark, sf_dir, "pages"))).withColumn("copy", _damage())
    places = saved(placed(saved(digests(made, "copy", "copy_digest", "copy_length").drop("record", "copy"))))
    replica = places.filter(F.col("copy_digest").isNotNull())
    found = audit(leaves_of(places), leaves_of(replica, "copy_digest", "copy_length"))
    return found.select(F.col("id").alias("page_id"), "length", "status")


_RECORD = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || coalesce('WARC-Target-URI: ' || url || chr(13) || chr(10), '') || 'Content-Length: ' || strlen(coalesce(html, '')) || repeat(chr(13) || chr(10), 2) || coalesce(html, '') || repeat(chr(13) || chr(10), 2)"

ORACLE_SQL = {
    "op10_warc_fixity": f"""
SELECT page_id, length, CASE k WHEN 101 THEN 'missing' ELSE 'changed' END AS status
FROM (SELECT page_id, strlen({_RECORD}) AS length, ('0x' || md5(CAST(page_id AS VARCHAR))[1:8])::BIGINT % 211 AS k FROM pages)
WHERE k IN (5, 17, 101)
""",
}
QUERIES = {"op10_warc_fixity": op10_warc_fixity}
