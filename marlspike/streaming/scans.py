"""Monitoring as a stream: batches of candidates against what is known, and stateful deduplication.

A batch (`scan_batch`) does what a scan does: worthy filter, new ones only, bursts of one template set
aside, append, times filled in later, everything found remembered. It is idempotent: a batch that is
delivered twice adds nothing, as its ids are known by then.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlspike.functions import url as U
from marlspike.operators import monitor
from marlspike.operators.merge import keep_first
from marlspike.sources.store import Store, normalized_items
from marlspike.session import staged


def scan_batch(store: Store, candidates: DataFrame, min_owners: int = 5, hours: float = 24) -> dict[str, int]:
    """One scan over candidates (target_id, url, title, source, mime, found_at, published_at, published_at_from, meta, ord).

    The first scan of a target keeps only what is of high value; everything it found is remembered all the
    same. Returns counts: found, new, suppressed.
    """
    rows = candidates.withColumn("status", F.lit(None).cast("string"))
    rows = normalized_items(rows).withColumn("kind", U.item_kind(F.col("url"), F.col("mime"), F.col("source")))
    rows = staged(keep_first(rows, [F.col("target_id"), F.col("id")], [F.col("ord")]), "scan")
    known = store.known()
    seen_targets = known.select("target_id").distinct().withColumn("seen", F.lit(True))
    marked = rows.join(seen_targets, "target_id", "left").withColumn("baseline", F.col("seen").isNull())
    worthy = marked.filter(U.is_worthy(F.col("url"), F.col("source"), F.col("baseline"), F.col("mime")))
    fresh = worthy.join(known, ["target_id", "id"], "left_anti").join(store.log().select("id").distinct(), "id", "left_anti")
    fresh = staged(fresh.drop("seen", "baseline"), "scan-new")
    pending = store.items().filter("status = 'new'").select("id", "target_id", "url", "title", "status", F.col("found_at").alias("found_ts"), F.col("published_at").alias("published_ts"))
    pool = fresh.select("id", "target_id", "url", "title", "status", F.col("found_at").alias("found_ts"), F.col("published_at").alias("published_ts")).unionByName(pending)
    kept, burst = monitor.suppress(fresh, monitor.template_batches(pool, min_owners, hours))
    counts = {"found": rows.count(), "new": kept.count(), "suppressed": burst.count()}
    late = monitor.pick_backfill(rows.select("id", "published_at", F.col("ord").alias("seq")), store.items())
    filled = store.items().drop("published_at", "published_at_from", "seq").join(late, "id").withColumn("published_at_from", F.lit("page"))
    filled = staged(filled, "scan-late")
    store.append_items(kept.drop("mime", "ord"))
    if not filled.isEmpty():
        store.append_items(filled)
    store.remember(rows)
    return counts


def watch(candidates: DataFrame, store: Store, checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """A streaming query that scans every micro-batch of a candidate stream."""

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            scan_batch(store, batch)

    return candidates.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def first_sightings(items: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a stream whose key was never seen before: state is one flag a key and only grows."""
    schema = items.schema

    def emit(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = None
        for batch in batches:
            if first is None and len(batch):
                first = batch.iloc[:1]
        if not state.exists and first is not None:
            state.update((True,))
            yield first

    return items.groupBy(key).applyInPandasWithState(emit, schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def late_tolerant(items: DataFrame, time: str, key: str = "id", lateness: str = "24 hours") -> DataFrame:
    """Rows of a stream without repeats that come within `lateness` of each other; state older than that is dropped."""
    return items.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def window_counts(items: DataFrame, time: str, width: str = "1 hour", lateness: str = "24 hours") -> DataFrame:
    return items.withWatermark(time, lateness).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n"))
