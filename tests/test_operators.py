"""Operators on small tables: ties, nulls, empty inputs, hot keys."""

import datetime as dt

from pyspark.sql import functions as F

from marlspike.operators import crawl, evaluate, instants, merge, monitor
from marlspike.operators.skew import join_dictionary
from marlspike.session import scratch, staged


def test_join_dictionary(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id")
    words = staged(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.length("k")), "t")
    joined = join_dictionary(rows.unionByName(spark.createDataFrame([(None, 1)], "k string, id bigint")), words, ["k"], "n", 0.01)
    assert joined.count() == 3000 and joined.filter("v <> length(k)").isEmpty()
    assert join_dictionary(rows, words.filter("false"), ["k"], "n").isEmpty()


def test_dictionary_grows(spark):
    d = instants.InstantDictionary(spark, scratch(spark, "d"))
    rows = spark.createDataFrame([(1, "2025-01-01", "UTC", False), (2, "2025-01-01", "UTC", False), (3, "x", None, None), (4, None, "UTC", False), (5, " ", "UTC", False)], "id int, raw string, zone string, month_first boolean")
    assert sorted(r.id for r in instants.normalise(rows, d).collect()) == [1, 2]
    assert d.read().count() == 2
    more = spark.createDataFrame([(6, "2025-01-01", "UTC", False), (7, "2025-01-02", "UTC", False)], rows.schema)
    assert sorted(r.id for r in instants.normalise(more, d).collect()) == [6, 7] and d.read().count() == 3
    assert instants.normalise(rows.filter("false"), d).isEmpty()


def test_json_values(spark):
    rows = spark.createDataFrame([('{"a":[{"b":1740718029334}]}', "a.0.b"), ('{"a":"x', "a"), ('{"a":true}', "a"), ('{"a":null}', "a"), ('{"a":{}}', "a"), ('{"a":"t"}', "a"), ('{"a":1.5}', "a"), ("", "a"), (None, "a"), ('{"a":1}', None), ('{"a":"t"}}', "a"), ('{"a":"t"} x', "a"), ('{"a":"t"},{}', "a"), (' {"a":"t"}\n', "a")], "p string, path string")
    assert [r[0] for r in rows.select(instants.json_scalar(F.col("p"), instants.json_path(F.col("path")))).collect()] == ["1740718029334", None, None, None, None, "t", "1.5", None, None, None, None, None, None, "t"]


def results(spark, *rows):
    return spark.createDataFrame(rows, "query string, ord int, result_id bigint, title string, url string, snippet string, source string")


def test_merge_and_rank(spark):
    rows = results(spark, ("spark", 2, 2, "B", "https://a.test/x?utm_source=1", "long " * 50, "e2"), ("spark", 1, 1, "A", "https://a.test/x", "s", "e1"), ("spark", 3, 3, "spark", "https://a.test/y", None, "e1"), ("spark", 4, 4, None, "https://a.test/z", "s", "e1"), ("spark", 5, 5, "t", None, "s", "e1"))
    merged = merge.merge_results(rows)
    top = {r.key: r for r in merged.collect()}
    assert len(top) == 3 and top["https://a.test/x"].title == "A" and top["https://a.test/x"].engines == ["e1", "e2"] and top["https://a.test/x"].snippet.startswith("long")
    ranked = merge.ranked_with_domain_cap(merged, per_domain=2).orderBy("rank").collect()
    assert [r.key[-1] for r in ranked] == ["x", "y"]
    assert merge.ranked_with_domain_cap(merge.merge_results(rows.filter("false"))).isEmpty()


def log(spark, *rows):
    base = dict(id="i", target_id="t", url="u", kind="page", title=None, status="new", triaged=None, found_ts=dt.datetime(2025, 1, 1), published_ts=None, seq=1)
    schema = "id string, target_id string, url string, kind string, title string, status string, triaged boolean, found_ts timestamp, published_ts timestamp, seq bigint"
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], schema)


def test_monitor(spark):
    view = monitor.latest_view(log(spark, dict(status="new", seq=1), dict(status="seen", seq=2), dict(id="j", seq=3)))
    assert {r.id: r.status for r in view.collect()} == {"i": "seen", "j": "new"}
    owners = [dict(id=f"{i}", url=f"https://c.test/o{i}/{n}", seq=i) for i, n in enumerate(["ai-manus", "manus-ai", "AI_manus", "ai--manus", "ai-manus"])]
    assert monitor.template_batches(log(spark, *owners)).first().owners == ["o0", "o1", "o2", "o3", "o4"]
    wide = [r | dict(found_ts=dt.datetime(2025, 1, 1 + (r["seq"] > 3) * 2)) for r in owners]
    assert monitor.template_batches(log(spark, *wide)).isEmpty() and monitor.template_batches(log(spark, *owners[:4])).isEmpty()
    same = [r | dict(url="https://c.test/o/ai-manus") for r in owners]
    assert monitor.template_batches(log(spark, *same)).isEmpty()
    many = log(spark, *[dict(id=f"a{i}", target_id="A", seq=i) for i in range(90)], dict(id="b", target_id="B", kind="paper"), dict(id="n", target_id=None))
    shown = monitor.digest_view(many, 10).collect()
    assert sum(r.target_id == "A" for r in shown) == 10 and {r.total for r in shown if r.target_id == "A"} == {90} and any(r.target_id is None for r in shown)
    t = spark.createDataFrame([("never", None, None), ("own", dt.datetime(2025, 1, 1), 10.0), ("general", dt.datetime(2025, 1, 1), 0.0)], "id string, last_scan_at timestamp, scan_minutes double")
    assert sorted(r.id for r in monitor.due_targets(t, F.lit(dt.datetime(2025, 1, 1, 0, 10)), 60).collect()) == ["never", "own"]


def test_crawl_and_coverage(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a"), (None, "x"), ("a", None)], "src string, dst string")
    seeds = spark.createDataFrame([("a",), (None,)], "node string")
    assert {(r.node, r.depth) for r in crawl.crawl(edges, seeds, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    sites = spark.createDataFrame([(0, 0, True, True, 1, 3, 0), (9, 1, True, True, 1, 3, 5), (9, 1, False, True, 3, 3, 0), (5, 5, True, True, 1, 1, 0), (9, 0, False, False, 1, 3, 2)], "fetched int, failed int, sitemap boolean, robots boolean, depth int, max_depth int, queued int")
    assert [r.confidence for r in crawl.coverage(sites).collect()] == ["low", "high", "high", "low", "medium"]
    pages = spark.createDataFrame([(f"https://a.test/list{i}.htm", "a.test", i) for i in range(5)] + [("https://a.test/x.htm", "a.test", 9)], "url string, host string, ord int")
    assert crawl.column_budget(pages, 3, 1).count() == 3


def test_hits(spark):
    ranked = spark.createDataFrame([("q", "x.test", 1), ("q", "www.a.test", 4), ("r", "b.test", 1)], "query string, domain string, rank int")
    labels = spark.createDataFrame([("q", "a.test"), ("r", "b.test"), ("s", "c.test")], "query string, expected string")
    r = evaluate.hit_metrics(ranked, labels).first()
    assert (r.queries, round(r.hit_at_3, 3), round(r.hit_at_5, 3), round(r.mrr, 4)) == (3, 0.333, 0.667, 0.4167)
