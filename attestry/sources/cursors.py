"""A source that is read on from a cursor, which moves only after what was read is kept."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.sources.manifests import Manifests


class Cursor:
    """The pulls of one source into ``path``: a folder of rows each, and how far the last committed one came.

    A pull reads the rows after the cursor less an overlap for late changes,
    without those that committed pulls hold, writes them to a new folder and
    then commits folder and cursor by a file that only one writer can create.
    What broke before the commit is in no commit and is read again, so nothing
    is lost and nothing is there twice.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, at: str, overlap_s: int):
        self.spark, self.path, self.schema, self.key, self.at, self.overlap_s = spark, path.rstrip("/"), schema, key, at, overlap_s
        self.commits = Manifests(spark, f"{self.path}/commits")

    def state(self) -> dict:
        """The last committed pull: its number and the cursor after it (null before the first)."""
        return self.commits.read() or {"number": 0, "cursor": None, "folders": []}

    def committed(self) -> DataFrame:
        """The rows of all committed pulls with the number of the ``pull``."""
        folders = self.state()["folders"]
        if not folders:
            return self.spark.createDataFrame([], f"{self.schema}, pull int")
        return self.spark.read.schema(f"{self.schema}, pull int").option("basePath", f"{self.path}/pulls").parquet(*[f"{self.path}/pulls/{f}" for f in folders])

    def fresh(self, source: DataFrame) -> DataFrame:
        """Rows of ``source`` that the next pull takes. ``at`` is a timestamp without a zone; a null key or time is never taken."""
        cursor = self.state()["cursor"]
        if cursor is None:
            return source.filter(F.col(self.at).isNotNull() & F.col(self.key).isNotNull())
        low = F.lit(cursor).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(self.overlap_s))
        seen = self.committed().filter(F.col(self.at) > low).select(self.key)
        return source.filter((F.col(self.at) > low) & F.col(self.key).isNotNull()).join(seen, self.key, "left_anti")

    def write(self, source: DataFrame) -> dict:
        """Writes the next pull and gives the commit that would make it count."""
        head = self.state()
        number = head["number"] + 1
        name = f"pull={number}/{uuid.uuid4().hex}"
        folder = f"{self.path}/pulls/{name}"
        self.fresh(source).select(*[c.split()[0] for c in self.schema.split(", ")]).write.parquet(folder)
        last = self.spark.read.schema(self.schema).parquet(folder).agg(F.max(F.col(self.at)).cast("string")).first()[0]
        moved = max((x for x in (head["cursor"], last) if x is not None), key=datetime.datetime.fromisoformat, default=None)
        return {"number": number, "cursor": moved, "folders": [*head["folders"], name]}

    def pull(self, source: DataFrame) -> int:
        """Takes in what is new; the number of the pull. Of two writers at once the second is an error and commits nothing."""
        commit = self.write(source)
        if not self.commits.create(commit["number"], commit):
            raise RuntimeError(f"pull {commit['number']} of {self.path} was committed by another writer")
        return commit["number"]
