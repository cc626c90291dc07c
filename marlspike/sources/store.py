"""The monitoring store: an append-only item log, targets, snapshots and traces as Parquet tables in one folder."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.text import redact, truncate
from marlspike.functions.url import fingerprint
from marlspike.operators.merge import keep_first
from marlspike.operators.monitor import latest_view

ITEM = "id string, target_id string, url string, kind string, title string, found_at timestamp, published_at timestamp, published_at_from string, status string, triaged boolean, source string, meta map<string,string>, seq bigint"
TRACE = "at timestamp, tool string, query string, params string, ok boolean, results int, channel string, elapsed_ms bigint, error string"


def normalized_items(candidates: DataFrame) -> DataFrame:
    """Candidates as items: id and url are the fingerprint, the origin of a time only with a time, status new by default."""
    key = fingerprint(F.col("url"))
    return candidates.withColumn("id", key).withColumn("url", key).withColumn("published_at_from", F.when(F.col("published_at").isNotNull(), F.col("published_at_from"))).withColumn("status", F.coalesce("status", F.lit("new")))


class Store:
    """Appends are new files, so two writers never rewrite each other's rows; whole tables are replaced by
    writing a new version and naming it, so a reader sees the old or the new one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    # items
    def append_items(self, items: DataFrame) -> None:
        """Rows get seq numbers beyond all that the log holds, in the order of `ord` or of nothing."""
        last = self._read("items", ITEM).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        numbered = items.withColumn("seq", F.lit(last) + F.monotonically_increasing_id() + 1)
        columns = [c.split()[0] for c in ITEM.split(", ")]
        for name, kind in (c.split(maxsplit=1) for c in ITEM.split(", ")):
            if name not in numbered.columns:
                numbered = numbered.withColumn(name, F.lit(None).cast(kind))
        numbered.select(columns).write.mode("append").parquet(f"{self.folder}/items")

    def log(self) -> DataFrame:
        return self._read("items", ITEM)

    def items(self) -> DataFrame:
        return latest_view(self.log())

    def update_status(self, ids: DataFrame, status: str) -> None:
        """Append the latest row of each id with another status."""
        self.append_items(self.items().join(ids.select("id").distinct(), "id", "left_semi").withColumn("status", F.lit(status)).drop("seq"))

    # snapshots
    def known(self, target_id: str | None = None) -> DataFrame:
        rows = self._read("snapshots", "target_id string, id string")
        return (rows.filter(F.col("target_id") == target_id) if target_id else rows).distinct()

    def remember(self, rows: DataFrame) -> None:
        rows.select("target_id", "id").distinct().write.mode("append").parquet(f"{self.folder}/snapshots")

    # targets: small settings, last write of a field wins
    def targets(self) -> DataFrame:
        log = self._read("targets", "id string, field string, value string, at bigint")
        last = log.groupBy("id", "field").agg(F.max_by("value", "at").alias("value"))
        whole = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
        return whole.filter("fields['removed'] IS NULL OR fields['removed'] = 'false'")

    def patch_target(self, target_id: str, at: int, **fields: str) -> None:
        rows = [(target_id, k, v, at) for k, v in fields.items()]
        self.spark.createDataFrame(rows, "id string, field string, value string, at bigint").write.mode("append").parquet(f"{self.folder}/targets")

    def remove_target(self, target_id: str, at: int) -> None:
        self.patch_target(target_id, at, removed="true")

    # traces and diagnostics
    def append_trace(self, rows: DataFrame) -> None:
        """Credentials are erased before the cut, so none survives by being cut in two."""
        safe = rows.withColumn("query", truncate(redact(F.col("query")))).withColumn("params", truncate(redact(F.col("params"))))
        safe.select([c.split()[0] for c in TRACE.split(", ")]).write.mode("append").parquet(f"{self.folder}/trace")

    def trace(self) -> DataFrame:
        return self._read("trace", TRACE)

    # whole tables
    def replace(self, name: str, rows: DataFrame) -> str:
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self.patch_target("\x00" + name, int(__import__("time").time() * 1000), path=path)
        return path

    def current(self, name: str) -> DataFrame:
        row = self.targets().filter(F.col("id") == "\x00" + name).select(F.col("fields")["path"].alias("path")).first()
        return self.spark.read.parquet(row["path"])


def cached(rows: DataFrame, now: Column) -> DataFrame:
    """Entries of a cache (key, value, expires_at) that still hold, the last of each key."""
    return keep_first(rows.filter(F.col("expires_at") > now), [F.col("key")], [F.col("expires_at").desc()])


def digest_of_parameters(parameters: Column, allowed: list[str]) -> Column:
    """`key=value` of the allowed parameters in their given order, credentials erased, then cut to 200."""
    parts = F.array(*[F.when(parameters[k].isNotNull(), F.concat(F.lit(k + "="), redact(parameters[k]))) for k in allowed])
    return truncate(F.array_join(F.array_compact(parts), " "))
