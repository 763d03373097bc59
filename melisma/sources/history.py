"""A history of playlists: saved, listed newest first without their contents, read one by one, deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.feedback import current, upsert

COLUMNS = ["id", "created", "title", "payload"]
SUMMARY = ["id", "created", "title"]


class History:
    """A table of records (id, created, title, payload) in a folder. A save or a deletion rewrites only the parts that its ids fall into; of one id the highest revision counts, so that one that comes late or twice changes nothing."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64) -> None:
        self.spark, self.path, self.parts = spark, path, parts

    def save(self, records: DataFrame, revision: int) -> None:
        upsert(records.select(*COLUMNS, F.lit(revision).cast("long").alias("revision"), F.lit(False).alias("deleted")), self.path, ["id"], "revision", self.parts)

    def delete(self, ids: DataFrame, revision: int) -> None:
        """Records with these ids go, and their contents with them; ids that aren't there change nothing that is seen."""
        kinds = dict(self._all().dtypes)
        gone = ids.select(F.col("id").cast(kinds["id"]).alias("id"), *(F.lit(None).cast(kinds[c]).alias(c) for c in COLUMNS[1:]), F.lit(revision).cast("long").alias("revision"), F.lit(True).alias("deleted"))
        upsert(gone, self.path, ["id"], "revision", self.parts)

    def _all(self) -> DataFrame:
        return current(self.spark, self.path)

    def page(self, size: int, before: tuple | None = None) -> DataFrame:
        """The newest `size` summaries, or those that follow the one with (created, id) `before`. Contents are not read."""
        rows = self._all().filter("not deleted").select(*SUMMARY)
        if before is not None:
            created, key = map(F.lit, before)
            older: Column = (F.col("created") < created) | ((F.col("created") == created) & (F.col("id") < key))
            rows = rows.filter(older)
        return rows.orderBy(F.desc("created"), F.desc("id")).limit(size)

    def get(self, ids: DataFrame) -> DataFrame:
        """Whole records of ids that are there."""
        return self._all().filter("not deleted").join(ids.select("id").distinct(), "id", "left_semi").select(*COLUMNS)
