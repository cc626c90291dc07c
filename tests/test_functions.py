"""Scalar functions against hand-made cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlspike.functions import html as H
from marlspike.functions import text as T
from marlspike.functions import url as U
from marlspike.functions.instants import with_instants
from marlspike.operators import classify


def apply(spark, build, *values):
    """build(column) of each value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_urls(spark):
    assert apply(spark, U.normalize_url, "HTTPS://A.Test/p?utm_source=x&b=1#t", "https://a.test", "not an url", None, "") == ["https://a.test/p?b=1", "https://a.test/", "not an url", None, ""]
    assert apply(spark, U.fingerprint, " http://A.Test/P?ref=1#x", "bad", None) == ["https://a.test/P?ref=1", "bad", None]
    assert apply(spark, U.extension, "https://a.test/x.PDF?y", "https://a.test/.htaccess", "https://a.test/x.", "https://a.test/a.b/c") == ["pdf", "", "", ""]
    assert apply(spark, U.is_attachment, "https://a.test/robots.txt", "https://a.test/x.txt", "https://a.test/x.htm") == [False, True, False]
    assert apply(spark, U.is_structural, "https://a.test", "https://a.test/x/", "https://a.test/list222.psp", "https://a.test/index-2026-report", "nope") == [True, True, True, False, False]
    assert apply(spark, U.site_root, "https://a.b.c.test/x", "https://test/", "x") == ["c.test", "test", ""]
    assert apply(spark, U.normalize_domain, " HTTPS://A.test:8080/x?y", "A.test") == ["a.test", "a.test"]
    assert apply(spark, U.column_key, "https://a.test/list12.htm") == ["https://a.test/list.htm"]
    assert apply(spark, U.paper_id, "https://p.test/abs/1612.05413v1", "https://p.test/pdf/1") == ["1612.05413v1", None]
    assert apply(spark, lambda c: U.decode_redirect(c, "uddg"), "/l/?uddg=https%3A%2F%2Fa.test%2F%2B&x", "/l/?x=1") == ["https://a.test/+", None]
    assert apply(spark, lambda c: U.render_template("https://a.test/{v}", {"v": c}), "1", "", None) == ["https://a.test/1", None, None]
    assert apply(spark, U.encode_paper_query, 'a+b "c d"') == ["a%2Bb+%22c+d%22"]


def test_markup(spark):
    assert apply(spark, H.strip_tags, "<script>x</script><p>A &amp;lt; <b>b</b>&nbsp;c</p>", None) == ["A < b c", None]
    assert apply(spark, lambda c: H.main_text(c, 5), "<body>x<main>hello world</main></body>", "<p>ab</p>") == ["hello…", "ab"]
    page = '<a href="/x.pdf">d</a><a href="feed.xml">f</a><img src="//b.test/i.png"><a href="mailto:x">m</a>'
    assert [tuple(x) for x in apply(spark, lambda c: H.links(c, F.lit("https://a.test/p/q.htm")), page)[0]] == [("https://a.test/x.pdf", "attachment"), ("https://a.test/p/feed.xml", "feed"), ("https://b.test/i.png", "page")]
    form = '<form action="/s" method="post"><input type="hidden" name="h"><input name="q"></form><form><input type="submit"></form>'
    assert [(f.action, f.method, f.inputs) for f in apply(spark, H.search_forms, form)[0]] == [("/s", "POST", ["q"])]
    times = '<meta name="date" content="2020-01-02"><meta property="article:published_time" content="2021-02-03"><time datetime="2022-03-04">'
    assert [x.raw for x in apply(spark, H.published_raw, times)[0]] == ["2021-02-03", "2020-01-02", "2022-03-04"]


def test_text(spark):
    assert apply(spark, T.redact, "Bearer abc token=xyz sk-12345678 ghp_0123456789abcdef0", "monkey=1") == ["Bearer [redacted] token=[redacted] [redacted] [redacted]", "monkey=1"]
    assert apply(spark, T.terms, "The spark 数据湖") == [["数据", "据湖", "数据湖", "spark"]]
    assert apply(spark, T.query_variants, "how to spark", "", "数据 湖")[0] == ["how to spark", '"how to spark"', "spark", "what is how to spark", "how to spark tutorial guide"]
    assert apply(spark, T.simplify_query, "one two three four five", "one two") == ["one two three four", ""]
    assert apply(spark, T.paper_query, "deep web deep", "ti:x", "one") == ["all:deep AND all:web", "ti:x", "one"]
    assert apply(spark, T.repo_key, "ai--manus", "Manus_AI") == ["ai-manus", "ai-manus"]
    assert apply(spark, T.route, "github paper", "论文", "weather") == ["code+academic", "academic", "general"]


def test_classifiers(spark):
    assert apply(spark, lambda c: classify.challenge(c, F.lit(200)), "<title>Just a moment...</title>", "fine", "Our systems have detected unusual traffic") == ["js-challenge", "none", "ip-block"]
    assert apply(spark, lambda c: classify.challenge(c, F.lit(403)), "x" * 9000 + " access denied", "access denied") == ["unknown", "waf"]
    assert apply(spark, lambda c: classify.zero_shape(c, F.lit(0)), "anomaly.js no results", "no results", "x", '<div class="result">', '<div class="result"><a class="result__a">') == ["anomaly", "no-results-text", "no-blocks", "blocks-no-anchors", "all-ads-filtered"]


INSTANTS = [
    ("2025-03-30 02:33:00", "Europe/Berlin", False, "2025-03-30 01:33:00"),  # skipped: moves on by the gap
    ("2024-10-27 02:30:00", "Europe/Berlin", False, "2024-10-27 00:30:00"),  # twice: the first
    ("03/04/2025 14:54", "America/New_York", True, "2025-03-04 19:54:00"),
    ("03/04/2025 14:54", "Asia/Tokyo", False, "2025-04-03 05:54:00"),
    ("20250304191301", "UTC", False, "2025-03-04 19:13:01"),
    ("1741087144", "Asia/Tokyo", False, "2025-03-04 11:19:04"),
    ("1740965591.611", "UTC", False, "2025-03-03 01:33:11.611"),
    ("2025-02-28T23:34:54.243494317+00:00", "UTC", False, "2025-02-28 23:34:54.243494"),
    ("2025-04-06 08:04:26 CEST", "UTC", False, "2025-04-06 06:04:26"),
    ("2025-03-04T07:43:47+00:00[Europe/Berlin]", "Asia/Tokyo", False, "2025-03-04 07:43:47"),
    ("2025-03-02 05:48:32 Europe/Berlin", "UTC", False, "2025-03-02 04:48:32"),
    ("15. April 2025, 19:06 Uhr", "Europe/Berlin", False, "2025-04-15 17:06:00"),
    ("2025年3月17日 02:15", "Asia/Shanghai", False, "2025-03-16 18:15:00"),
    ("March 15, 2025 12:27 AM", "UTC", False, "2025-03-15 00:27:00"),
    ("Sat, 01 Mar 2025 22:04:10 +1100", "UTC", False, "2025-03-01 11:04:10"),
    ("\t2025-02-15 17:31:44 +12:45 ", "UTC", False, "2025-02-15 04:46:44"),
    ("2025-01-02", None, False, "2025-01-02 00:00:00"),
    ("31/31/2025", "UTC", False, None), ("0000-00-00", "UTC", False, None), ("2024-06-01T25:61:00Z", "UTC", False, None), ("123", "UTC", False, None), ("0", "UTC", False, None),
    ("yesterday?", "UTC", False, None), ("", "UTC", False, None), (None, "UTC", False, None), ("2025-02-30", "UTC", False, None), ("1999-01-01", "UTC", False, None), ("2101-01-01", "UTC", False, None),
    ("2025-01-01 00:00 XYZ", "UTC", False, None), ("2025-01-02 03:04", "No/Where", False, "2025-01-02 03:04:00"),
]


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_instants(spark, session_zone):
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        df = spark.createDataFrame([(i, r, z, m) for i, (r, z, m, _) in enumerate(INSTANTS)], "i int, raw string, zone string, month_first boolean")
        clash = df.withColumnRenamed("i", "_text")
        got = [r.us for r in with_instants(clash, "raw", "zone", "month_first", "at").filter("true").orderBy("_text").select(F.unix_micros("at").alias("us")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    epoch = dt.datetime(1970, 1, 1)
    wanted = [None if w is None else (dt.datetime.fromisoformat(w) - epoch) // dt.timedelta(microseconds=1) for *_, w in INSTANTS]
    assert got == wanted, [(x[0], g, w) for x, g, w in zip(INSTANTS, got, wanted) if g != w]
