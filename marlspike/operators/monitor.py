"""Incremental monitoring on an append-only item log, where the last write of an id wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.functions import url as U
from marlspike.functions.text import repo_key
from marlspike.operators.merge import keep_first, top_per_group


def latest_view(log: DataFrame) -> DataFrame:
    """The last row of each id; select the columns that are wanted before, as rows travel whole. An aggregation with map-side combine: an id that holds a third of the log is no single task."""
    columns = [c for c in log.columns if c != "id"]
    packed = log.groupBy("id").agg(F.max_by(F.struct(*columns), "seq").alias("row"))
    return packed.select("id", *[F.col(f"row.{c}").alias(c) for c in columns]).select(*log.columns)


def diff_new(found: DataFrame, known: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Rows of `found` whose key is not in `known`, the first of each key."""
    return keep_first(found.join(known.select(key).distinct(), key, "left_anti"), [F.col(key)], [F.col(order)])


def suppress(candidates: DataFrame, batches: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed): candidates whose key is in no batch, and the others."""
    keys = batches.select(F.explode("ids").alias(key)).distinct()
    return candidates.join(keys, key, "left_anti"), candidates.join(keys, key, "left_semi")


def pick_backfill(found: DataFrame, known: DataFrame) -> DataFrame:
    """id, published_at: times that a later find has and the known item lacks; the first find wins."""
    lacking = known.filter("published_at IS NULL").select("id").distinct()
    with_time = found.filter("published_at IS NOT NULL").groupBy("id").agg(F.min_by("published_at", "seq").alias("published_at"))
    return with_time.join(lacking, "id", "left_semi")


def snapshot_union(*sets: DataFrame, key: str = "id") -> DataFrame:
    out = sets[0].select(key)
    for s in sets[1:]:
        out = out.union(s.select(key))
    return out.distinct()


def due_targets(targets: DataFrame, now: Column, every_minutes: float) -> DataFrame:
    """Targets whose period has passed: their own if above 0, else the general one; never scanned ones are due."""
    period = F.when(F.col("scan_minutes") > 0, F.col("scan_minutes")).otherwise(F.lit(every_minutes))
    waited = (F.unix_micros(now) - F.unix_micros(F.col("last_scan_at").cast("timestamp"))) / 60_000_000
    return targets.filter(F.col("last_scan_at").isNull() | (waited >= period))


def list_items(view: DataFrame, target_id: str | None = None, status: str | None = None, since: Column | None = None, limit: int = 0, include_triaged: bool = False) -> DataFrame:
    """Items by target, status and time, newest first; asking for new ones hides what is triaged; unusable
    times are out as soon as `since` is given; `limit` 0 gives all. `filtered` counts before the limit."""
    rows = view
    if target_id is not None:
        rows = rows.filter(F.col("target_id") == target_id)
    if status is not None:
        rows = rows.filter(F.coalesce("status", F.lit("new")) == status)
        if status == "new" and not include_triaged:
            rows = rows.filter(~F.coalesce("triaged", F.lit(False)))
    if since is not None:
        rows = rows.filter(F.col("found_ts") >= since)
    if not limit:
        return rows
    filtered = rows.agg(F.count(F.lit(1)).alias("filtered"))
    return rows.orderBy(F.col("found_ts").desc_nulls_last(), F.col("seq").desc()).limit(limit).crossJoin(F.broadcast(filtered))  # one row


def digest_view(view: DataFrame, per_target: int) -> DataFrame:
    """Per target the items of most value, then newest: high-value kinds, pages, others; with rank and the target's total."""
    level = F.when(U.is_high_value(F.col("kind")), 0).when(F.col("kind") == "page", 1).otherwise(2)
    totals = view.groupBy(F.col("target_id").alias("_target")).agg(F.count(F.lit(1)).alias("total"))
    top = top_per_group(view.withColumn("level", level), [F.col("target_id")], [F.col("level"), F.coalesce("published_ts", "found_ts").desc_nulls_last(), F.col("seq").desc()], per_target)
    # the totals come from an aggregation, as a window over whole targets would sort a hot one in one task
    return top.join(totals, F.col("target_id").eqNullSafe(F.col("_target"))).drop("_target")


def template_batches(view: DataFrame, min_owners: int = 5, hours: float = 24) -> DataFrame:
    """Bursts of one template: unread repositories of one target that differ only in spelling or word order,
    of `min_owners` owners or more, found within `hours`. Columns: target_id, repo, owners, ids, span_hours."""
    parts = F.split(F.regexp_replace(F.col("url"), r"/+$", ""), "/")
    # a title names owner and repository only if that is all it says
    pair = r"^\s*([^/\s]+)/([^/\s]+)\s*$"
    named = F.coalesce(F.col("title").rlike(pair), F.lit(False))
    owner = F.when(named, F.regexp_extract("title", pair, 1)).otherwise(F.try_element_at(parts, F.lit(-2)))
    repo = F.when(named, F.regexp_extract("title", pair, 2)).otherwise(F.try_element_at(parts, F.lit(-1)))
    rows = view.filter("coalesce(status, 'new') = 'new'").select("target_id", "id", F.lower(owner).alias("owner"), repo_key(repo).alias("repo"), F.unix_micros(F.coalesce("published_ts", "found_ts")).alias("at"))
    grouped = rows.filter("owner <> '' AND repo <> ''").groupBy("target_id", "repo").agg(
        F.array_sort(F.collect_set("owner")).alias("owners"), F.array_sort(F.collect_set("id")).alias("ids"), ((F.max("at") - F.min("at")) / 3_600_000_000).alias("span_hours"), F.count("at").alias("timed")
    )
    return grouped.filter((F.size("owners") >= min_owners) & (F.col("timed") >= 2) & (F.col("span_hours") <= hours)).drop("timed")


def stats(view: DataFrame) -> DataFrame:
    """dimension, value, n: by status, kind and target, and totals of read and triaged, in one pass."""
    status = F.coalesce("status", F.lit("new"))
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value")) for d, v in (
        ("status", status), ("kind", F.col("kind")), ("target", F.col("target_id")), ("read", F.when(status != "new", "yes").otherwise("no")), ("triaged", F.when(F.coalesce("triaged", F.lit(False)), "yes").otherwise("no")),
    )])
    return view.select(F.explode(pairs).alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def unread_breakdown(view: DataFrame) -> DataFrame:
    """One row: unread papers, interface items, other items of high value, the rest."""
    unread = view.filter("coalesce(status, 'new') = 'new' AND NOT coalesce(triaged, false)")
    kind = F.when(F.col("kind") == "paper", "paper").when(F.col("kind") == "api", "api").when(U.is_high_value(F.col("kind")), "other_high").otherwise("other_low")
    names = ("paper", "api", "other_high", "other_low")
    return unread.agg(*[F.count_if(kind == n).alias(n) for n in names])


def scan_summary(outcomes: DataFrame) -> DataFrame:
    """ok, failed, partial and the sums over the scans that went well (state, partial, found, new_count)."""
    ok = F.col("state") == "ok"
    return outcomes.agg(F.count_if(ok).alias("ok"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("partial")).alias("partial"), F.sum(F.when(ok, F.col("found"))).alias("found"), F.sum(F.when(ok, F.col("new_count"))).alias("new_count"))



def ranked_batches(batches: DataFrame) -> DataFrame:
    """Bursts with their place, the largest first."""
    return batches.withColumn("place", F.row_number().over(Window.orderBy(F.size("ids").desc(), F.col("target_id"), F.col("repo"))))


def backfill_papers(view: DataFrame, papers: DataFrame) -> DataFrame:
    """id, published_at: times from papers that were looked up (url, extra) for items (id, published_at) without one."""
    times = papers.select(U.fingerprint(F.col("url")).alias("id"), F.nullif(F.col("extra")["published"], F.lit("")).alias("published_at")).filter("published_at IS NOT NULL")
    first = times.groupBy("id").agg(F.min("published_at").alias("published_at"))
    return first.join(view.filter("published_at IS NULL").select("id").distinct(), "id", "left_semi")


#: What each kind of target must name, and the channel it is scanned by (fixed values).
KINDS = {"site": ("spec.url", "crawl"), "domain": ("spec.domain", "index"), "arxiv": ("spec.query", "arxiv"), "api": ("spec.url", "api")}


def scan_plan(targets: DataFrame) -> DataFrame:
    """id, channel, subject, error: by which channel each target is scanned, or what it lacks; an unknown kind is an error."""
    kind, rows = F.col("kind"), []
    for name, (member, by) in KINDS.items():
        needed = [member, "spec.items_path"] if name == "api" else [member]
        lacks = F.coalesce(*[F.when(F.coalesce(F.trim(F.col(m)), F.lit("")) == "", F.lit(f"{name} target lacks {m}")) for m in needed])
        rows.append(F.when(kind == name, F.struct(F.lit(by).alias("channel"), F.col(member).alias("subject"), lacks.alias("error"))))
    unknown = F.struct(F.lit(None).cast("string").alias("channel"), F.lit(None).cast("string").alias("subject"), F.concat(F.lit("unknown kind "), F.coalesce(kind, F.lit("null"))).alias("error"))
    plan = targets.select("id", F.coalesce(*rows, unknown).alias("p")).select("id", "p.*")
    return plan.select("id", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("channel", "subject")], "error")


def result_state(results: DataFrame) -> DataFrame:
    """id, last_scan_state, last_scan_error of scans (id, found, error, source_errors): failed where nothing came and something went
    wrong, partial where something came nevertheless, else ok, which clears an old error; the error is cut to 200."""
    detail = F.coalesce(F.nullif(F.col("error"), F.lit("")), F.nullif(F.array_join("source_errors", " | "), F.lit("")))
    state = F.when(detail.isNull(), "ok").when(F.coalesce("found", F.lit(0)) > 0, "partial").otherwise("failed")
    return results.select("id", state.alias("last_scan_state"), F.when(state == "failed", F.left(detail, F.lit(200))).alias("last_scan_error"))
