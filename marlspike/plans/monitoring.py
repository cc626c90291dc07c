"""Queries over the item log, its targets and captured interface records, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions import url as U
from marlspike.functions.instants import with_instants
from marlspike.functions.text import repo_key
from marlspike.operators import monitor
from marlspike.operators.instants import json_path, json_scalar
from marlspike.session import staged, table

#: The time against which queries measure age; a parameter of the operators.
NOW = "2026-09-01 00:00:00"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item log with `found_ts` and `published_ts`: only texts in plain ISO form, which both engines read alike.
    The queries on it are the part that SQL can repeat; `whole_...` are the same over every text that names an instant."""
    iso = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?Z$"
    log = table(spark, sf_dir, "intel_item")
    for field, out in (("found_at", "found_ts"), ("published_at", "published_ts")):
        log = log.withColumn(out, F.when(F.col(field).rlike(iso), F.try_to_timestamp(F.col(field))))
    return log


def _timed(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The latest view with `found_ts` and `published_ts` of every text that names an instant, read as p2 does: in the
    target's zone and order of the date's parts. SQL cannot repeat this, so the queries on it (`whole_...`) have none."""
    return _instants(monitor.latest_view(table(spark, sf_dir, "intel_item").select("id", "seq", "target_id", "found_at", "published_at", *columns)), _targets(spark, sf_dir)).transform(staged, "timed-view")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "intel_target").select(F.col("id").alias("target_id"), "zone", F.coalesce(F.col("locale").rlike(r"[-_]US$"), F.lit(False)).alias("month_first"))


def _instants(rows: DataFrame, targets: DataFrame) -> DataFrame:
    rows = rows.join(targets, "target_id", "left").withColumn("month_first", F.coalesce("month_first", F.lit(False)))
    for field, out in (("found_at", "found_ts"), ("published_at", "published_ts")):
        rows = with_instants(rows, field, "zone", "month_first", out)
    return rows.drop("zone", "month_first", "found_at", "published_at")


def item_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.coalesce("url", "id")
    return table(spark, sf_dir, "intel_item").select("seq", U.item_kind(u, None, F.col("source")).alias("kind"), U.is_structural(u).alias("structural"), U.is_worthy(u, F.coalesce("source", F.lit("")), F.col("batch_no") == 0).alias("worthy"), U.fingerprint(u).alias("fingerprint"))


def latest_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.latest_view(table(spark, sf_dir, "intel_item").select("id", "seq", "status", "triaged", "title"))


def delta_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "intel_item")
    return monitor.diff_new(log.filter("batch_no > 0"), log.filter("batch_no = 0")).select("id", "seq", "batch_no")


def second_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeated scan brings nothing: everything found is in the snapshot."""
    log = table(spark, sf_dir, "intel_item")
    known = monitor.snapshot_union(log.filter("batch_no = 0"), log.filter("batch_no > 0"))
    return monitor.diff_new(log.filter("batch_no > 0"), known).agg(F.count(F.lit(1)).alias("new"))


def list_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = monitor.latest_view(_log(spark, sf_dir).select("id", "seq", "target_id", "status", "triaged", "found_ts"))
    return monitor.list_items(view, status="new", since=F.to_timestamp(F.lit("2026-01-01 00:00:00")), limit=50).select("id", "seq", "filtered")


def item_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.stats(monitor.latest_view(table(spark, sf_dir, "intel_item").select("id", "seq", "target_id", "kind", "status", "triaged")))


def unread_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.unread_breakdown(monitor.latest_view(table(spark, sf_dir, "intel_item").select("id", "seq", "kind", "status", "triaged")))


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = monitor.latest_view(_log(spark, sf_dir).select("id", "seq", "target_id", "kind", "found_ts", "published_ts"))
    return monitor.digest_view(view, 10).select("target_id", "id", "rank", "level", "total")


def template_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the operator's own bounds, five owners within a day. The log has few such bursts, so to each target's items some of
    six owners are added: five within a day of the first, and of the targets of odd length a day too late."""
    view = monitor.latest_view(_log(spark, sf_dir).select("id", "seq", "target_id", "url", "title", "status", "found_ts", "published_ts"))
    late = F.expr("timestamp '2026-08-01 00:00:00' + make_interval(0, 0, 0, 0, if(length(target_id) % 2 = 0, 5, 7) * CAST(k AS int))")
    added = table(spark, sf_dir, "intel_target").select(F.col("id").alias("target_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    added = added.select(F.concat_ws("#", "target_id", "k").alias("id"), F.lit(-1).cast("bigint").alias("seq"), "target_id", F.lit(None).cast("string").alias("url"), F.concat(F.lit("Owner"), F.col("k").cast("string"), F.expr("if(k % 2 = 0, '/Burst_Tool', '/tool-burst')")).alias("title"), F.lit("new").alias("status"), late.alias("found_ts"), F.lit(None).cast("timestamp").alias("published_ts"))
    found = monitor.template_batches(view.select(*added.columns).unionByName(added))
    return found.select("target_id", "repo", F.array_join("owners", ",").alias("owners"), F.size("ids").alias("items"), "span_hours")


def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = monitor.latest_view(_log(spark, sf_dir).select("id", "seq", "target_id", "url", "title", "status", "found_ts", "published_ts"))
    kept, out = monitor.suppress(view, monitor.template_batches(view, min_owners=2, hours=24 * 90))
    return _kept_and_out(kept, out)


def _kept_and_out(kept: DataFrame, out: DataFrame) -> DataFrame:
    return kept.groupBy("target_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.lit(True)).unionByName(out.groupBy("target_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.lit(False)))


def due_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.due_targets(table(spark, sf_dir, "intel_target"), F.to_timestamp(F.lit(NOW)), 60.0).select("id")


def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "intel_item")
    return monitor.pick_backfill(log.filter("batch_no > 0"), log.filter("batch_no = 0"))


def scan_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "intel_item").filter("batch_no > 0").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("new_count"))
    outcomes = table(spark, sf_dir, "intel_target").join(new, "id", "left").select(F.col("last_scan_state").alias("state"), F.col("last_scan_error").isNotNull().alias("partial"), F.col("found_total").alias("found"), F.coalesce("new_count", F.lit(0)).alias("new_count"))
    return monitor.scan_summary(outcomes)


def auto_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of targets that are watched by a paper query."""
    papers = table(spark, sf_dir, "intel_target").filter("kind = 'arxiv'").select(F.col("id").alias("target_id"))
    return table(spark, sf_dir, "intel_item").join(papers, "target_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def api_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, title of every record with a title at its target's path (default: title)."""
    targets = table(spark, sf_dir, "intel_target").select(F.col("id").alias("target_id"), F.coalesce("spec.title_path", F.lit("title")).alias("title_path"))
    rows = table(spark, sf_dir, "api_record").join(targets, "target_id")
    return rows.select("record_id", json_scalar(F.col("payload"), json_path(F.col("title_path"))).alias("title")).filter("title IS NOT NULL")


def api_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, ms: times given as numbers or digit strings, by their size seconds or milliseconds."""
    targets = table(spark, sf_dir, "intel_target").filter("spec.time_path IS NOT NULL").select(F.col("id").alias("target_id"), "spec.time_path")
    rows = table(spark, sf_dir, "api_record").join(targets, "target_id").select("record_id", json_scalar(F.col("payload"), json_path(F.col("time_path"))).alias("raw"))
    value = F.when(F.col("raw").rlike(r"^\d{10,13}$"), F.col("raw").cast("bigint"))
    ms = F.when(value >= 10**12, value).when(value >= 10**9, value * 1000)
    return rows.select("record_id", ms.alias("ms")).filter("ms IS NOT NULL")


def iso_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, us of the times in ISO form with Z: the part of the parser that SQL can repeat."""
    rows = table(spark, sf_dir, "intel_item").filter(F.col("found_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$")).select("seq", "found_at", F.lit("UTC").alias("zone"), F.lit(False).alias("month_first"))
    return with_instants(rows, "found_at", "zone", "month_first", "at").filter("at IS NOT NULL").select("seq", F.unix_micros("at").alias("us"))


def repo_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "intel_item").filter("title IS NOT NULL").groupBy(repo_key(F.col("title")).alias("repo")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target_id").alias("targets"))


def age_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target: youngest and oldest item in hours, and how many name no time."""
    return _ages(_log(spark, sf_dir))


def _ages(log: DataFrame) -> DataFrame:
    age = (F.unix_micros(F.to_timestamp(F.lit(NOW))) - F.unix_micros(F.coalesce("published_ts", "found_ts"))) / 3_600_000_000
    return log.select("target_id", age.alias("age")).groupBy("target_id").agg(F.min("age").alias("youngest"), F.max("age").alias("oldest"), F.count_if(F.col("age").isNull()).alias("unknown"))


def whole_list_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _timed(spark, sf_dir, "status", "triaged")
    return monitor.list_items(view, status="new", since=F.to_timestamp(F.lit("2026-01-01 00:00:00")), limit=50).select("id", "seq", "filtered")


def whole_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.digest_view(_timed(spark, sf_dir, "kind"), 10).select("target_id", "id", "rank", "level", "total")


def whole_template_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = monitor.template_batches(_timed(spark, sf_dir, "url", "title", "status"), min_owners=2, hours=24 * 90)
    return found.select("target_id", "repo", F.array_join("owners", ",").alias("owners"), F.size("ids").alias("items"), "span_hours")


def whole_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _timed(spark, sf_dir, "url", "title", "status")
    return _kept_and_out(*monitor.suppress(view, monitor.template_batches(view, min_owners=2, hours=24 * 90)))


def whole_age_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ages(_instants(table(spark, sf_dir, "intel_item").select("target_id", "found_at", "published_at"), _targets(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (
    item_kinds, latest_view, delta_new, second_scan, list_recent, item_stats, unread_breakdown, digest, template_batches, suppressed, due_targets, backfill, scan_outcomes, auto_count, api_items, api_epochs,
    iso_instants, repo_words, age_stats, whole_list_recent, whole_digest, whole_template_batches, whole_suppressed, whole_age_stats,
)}

_U = "coalesce(url, id)"
_PATH = f"regexp_extract(regexp_replace({_U}, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$', 1)"
_EXT = f"lower(regexp_extract(string_split(regexp_replace({_U}, '[?#].*$', ''), '/')[-1], '^.+\\.([A-Za-z0-9]{{1,8}})$', 1))"
_LAST = f"lower(string_split(regexp_replace({_U}, '[?#].*$', ''), '/')[-1])"
_META = f"{_LAST} IN ('robots.txt','sitemap.xml','sitemap.txt','sitemap.xml.gz','security.txt','humans.txt','ads.txt','llms.txt','manifest.json')"
_ATTACHMENT = f"(NOT {_META} AND {_EXT} IN ('pdf','doc','docx','xls','xlsx','ppt','pptx','csv','txt','rtf','odt','ods','odp','zip','rar','7z','epub','wps','et','dps'))"
_VIEW = "WITH view AS (SELECT * FROM intel_item QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"
_TIMED = r""", timed AS (SELECT *, CASE WHEN regexp_matches(found_at, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?Z$') THEN try_cast(replace(found_at, 'Z', '') AS TIMESTAMP) END AS found_ts,
 CASE WHEN regexp_matches(published_at, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?Z$') THEN try_cast(replace(published_at, 'Z', '') AS TIMESTAMP) END AS published_ts FROM view)"""
_BATCHES = r""", parts AS (SELECT target_id, id, seq, lower(CASE WHEN regexp_matches(title, '^\s*([^/\s]+)/([^/\s]+)\s*$') THEN regexp_extract(title, '^\s*([^/\s]+)/([^/\s]+)\s*$', 1) ELSE p[-2] END) AS owner,
 array_to_string(list_sort(list_filter(string_split_regex(lower(CASE WHEN regexp_matches(title, '^\s*([^/\s]+)/([^/\s]+)\s*$') THEN regexp_extract(title, '^\s*([^/\s]+)/([^/\s]+)\s*$', 2) ELSE p[-1] END), '[-_\s]+'), lambda w: w <> '')), '-') AS repo,
 epoch_us(coalesce(published_ts, found_ts)) AS moment FROM (SELECT *, string_split(regexp_replace(url, '/+$', ''), '/') AS p FROM timed WHERE coalesce(status, 'new') = 'new')),
batches AS (SELECT target_id, repo, list_sort(list(DISTINCT owner)) AS owners, list_sort(list(DISTINCT id)) AS ids, (max(moment) - min(moment)) / 3600000000 AS span_hours FROM parts WHERE owner <> '' AND repo <> ''
 GROUP BY 1, 2 HAVING count(DISTINCT owner) >= 2 AND count(moment) >= 2 AND (max(moment) - min(moment)) / 3600000000 <= 2160)"""
_PLANTED = """ UNION ALL SELECT id, id || '#' || k, -1, NULL, 'Owner' || k || CASE WHEN k % 2 = 0 THEN '/Burst_Tool' ELSE '/tool-burst' END, 'new', (TIMESTAMP '2026-08-01 00:00:00' + to_hours(CASE WHEN length(id) % 2 = 0 THEN 5 ELSE 7 END * k)), NULL FROM intel_target, (SELECT unnest([0, 1, 2, 3, 4]) AS k)"""
ORACLES = {
    "item_kinds": f"""SELECT seq, sort AS kind, structural,
 CASE WHEN NOT regexp_matches({_U}, '^(?i)https?://') THEN false WHEN {_META} THEN false WHEN structural THEN false WHEN src = 'api' THEN true WHEN batch_no = 0 THEN sort IN ('attachment','paper','api') ELSE true END AS worthy,
 CASE WHEN regexp_matches(trim({_U}), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]+') THEN regexp_replace(lower(regexp_extract(trim({_U}), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)), '^http://', 'https://')
   || substr(regexp_replace(trim({_U}), '#.*$', ''), length(regexp_extract(trim({_U}), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) + 1) ELSE trim({_U}) END AS fingerprint
FROM (SELECT *, coalesce(source, '') AS src, CASE WHEN {_ATTACHMENT} THEN 'attachment' WHEN source = 'arxiv' THEN 'paper' WHEN source = 'api' THEN 'api' WHEN regexp_matches({_U}, '^(?i)https?://') THEN 'page' ELSE 'unknown' END AS sort,
 regexp_matches({_U}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\s]+') AND ({_PATH} = '' OR ends_with({_PATH}, '/') OR regexp_matches({_PATH}, '(?i)/(list|index|default|more|search|column|category|tag|nav|menu)[\\d_-]*(\\.[a-z0-9]{{1,6}})?$')) AS structural FROM intel_item)""",
    "latest_view": _VIEW + "SELECT id, seq, status, triaged, title FROM view",
    "delta_new": "SELECT id, min(seq) AS seq, arg_min(batch_no, seq) AS batch_no FROM intel_item WHERE batch_no > 0 AND id NOT IN (SELECT id FROM intel_item WHERE batch_no = 0 AND id IS NOT NULL) GROUP BY id",
    "second_scan": "SELECT count(*) AS new FROM intel_item a WHERE batch_no > 0 AND NOT EXISTS (SELECT 1 FROM intel_item b WHERE a.id = b.id)",
    "list_recent": _VIEW + _TIMED + ", f AS (SELECT *, count(*) OVER () AS filtered FROM timed WHERE coalesce(status, 'new') = 'new' AND NOT coalesce(triaged, false) AND found_ts >= TIMESTAMP '2026-01-01') SELECT id, seq, filtered FROM f ORDER BY found_ts DESC, seq DESC LIMIT 50",
    "item_stats": _VIEW
    + """, s AS (SELECT coalesce(status, 'new') AS status, kind, target_id, coalesce(triaged, false) AS triaged FROM view)
SELECT 'status' AS dimension, status AS value, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'target', target_id, count(*) FROM s GROUP BY 2
UNION ALL SELECT 'read', CASE WHEN status <> 'new' THEN 'yes' ELSE 'no' END, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'triaged', CASE WHEN triaged THEN 'yes' ELSE 'no' END, count(*) FROM s GROUP BY 2""",
    "unread_breakdown": _VIEW + "SELECT count(*) FILTER (WHERE kind = 'paper') AS paper, count(*) FILTER (WHERE kind = 'api') AS api, count(*) FILTER (WHERE kind = 'attachment') AS other_high, count(*) FILTER (WHERE coalesce(kind, '') NOT IN ('paper','api','attachment')) AS other_low FROM view WHERE coalesce(status, 'new') = 'new' AND NOT coalesce(triaged, false)",
    "digest": _VIEW
    + _TIMED
    + """, l AS (SELECT *, CASE WHEN kind IN ('attachment','paper','api') THEN 0 WHEN kind = 'page' THEN 1 ELSE 2 END AS level, count(*) OVER (PARTITION BY target_id) AS total FROM timed)
SELECT target_id, id, row_number() OVER (PARTITION BY target_id ORDER BY level, coalesce(published_ts, found_ts) DESC NULLS LAST, seq DESC)::INTEGER AS rank, level::INTEGER AS level, total FROM l QUALIFY rank <= 10""",
    "template_batches": _VIEW + _TIMED + _BATCHES.replace("FROM timed WHERE", "FROM (SELECT target_id, id, seq, url, title, status, found_ts, published_ts FROM timed" + _PLANTED + ") WHERE").replace(">= 2 AND count(moment)", ">= 5 AND count(moment)").replace("<= 2160", "<= 24") + "SELECT target_id, repo, array_to_string(owners, ',') AS owners, len(ids)::INTEGER AS items, span_hours FROM batches",
    "suppressed": _VIEW + _TIMED + _BATCHES + ", out AS (SELECT DISTINCT unnest(ids) AS id FROM batches) SELECT target_id, count(*) AS n, v.id NOT IN (SELECT id FROM out) AS kept FROM view v GROUP BY 1, 3",
    "due_targets": f"SELECT id FROM intel_target WHERE last_scan_at IS NULL OR (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_scan_at)) / 60000000 >= CASE WHEN scan_minutes > 0 THEN scan_minutes ELSE 60 END",
    "backfill": "SELECT id, arg_min(published_at, seq) AS published_at FROM intel_item WHERE batch_no > 0 AND published_at IS NOT NULL AND id IN (SELECT id FROM intel_item WHERE batch_no = 0 AND published_at IS NULL) GROUP BY id",
    "scan_outcomes": "SELECT count(*) FILTER (WHERE last_scan_state = 'ok') AS ok, count(*) FILTER (WHERE last_scan_state = 'failed') AS failed, count(*) FILTER (WHERE last_scan_error IS NOT NULL) AS partial, sum(found_total) FILTER (WHERE last_scan_state = 'ok')::BIGINT AS found, sum(coalesce(n, 0)) FILTER (WHERE last_scan_state = 'ok')::BIGINT AS new_count FROM intel_target LEFT JOIN (SELECT target_id, count(*) AS n FROM intel_item WHERE batch_no > 0 GROUP BY 1) ON id = target_id",
    "auto_count": "SELECT count(*) AS n FROM intel_item WHERE target_id IN (SELECT id FROM intel_target WHERE kind = 'arxiv')",
    "api_items": "SELECT record_id, title FROM (SELECT record_id, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.' || coalesce(t.spec.title_path, 'title')) END AS title FROM api_record r JOIN intel_target t ON r.target_id = t.id) WHERE title IS NOT NULL",
    "api_epochs": r"""WITH raw AS (SELECT record_id, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.' || regexp_replace(t.spec.time_path, '\.(\d+)', '[\1]', 'g')) END AS raw FROM api_record r JOIN intel_target t ON r.target_id = t.id WHERE t.spec.time_path IS NOT NULL)
SELECT record_id, ms FROM (SELECT record_id, CASE WHEN regexp_matches(raw, '^\d{10,13}$') THEN CASE WHEN raw::BIGINT >= 1000000000000 THEN raw::BIGINT WHEN raw::BIGINT >= 1000000000 THEN raw::BIGINT * 1000 END END AS ms FROM raw) WHERE ms IS NOT NULL""",
    "iso_instants": r"SELECT seq, epoch_us(t) AS us FROM (SELECT seq, try_cast(replace(found_at, 'Z', '') AS TIMESTAMP) AS t FROM intel_item WHERE regexp_matches(found_at, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$')) WHERE year(t) BETWEEN 2010 AND 2100",
    "repo_words": r"SELECT array_to_string(list_sort(list_filter(string_split_regex(lower(title), '[-_\s]+'), lambda w: w <> '')), '-') AS repo, count(*) AS n, count(DISTINCT target_id) AS targets FROM intel_item WHERE title IS NOT NULL GROUP BY 1",
    "age_stats": "WITH view AS (SELECT * FROM intel_item)" + _TIMED + f", a AS (SELECT target_id, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(coalesce(published_ts, found_ts))) / 3600000000 AS age FROM timed) SELECT target_id, min(age) AS youngest, max(age) AS oldest, count(*) FILTER (WHERE age IS NULL) AS unknown FROM a GROUP BY 1",
}
