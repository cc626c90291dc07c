"""The `whole_...` queries against brute force: times in every form that names an instant, which SQL cannot repeat."""

import datetime as dt

import pytest

from marlspike.plans import catalog

UTC = dt.timezone.utc
NOW = dt.datetime(2026, 9, 1, tzinfo=UTC)
ITEM = "seq bigint, batch_no int, id string, target_id string, url string, kind string, title string, found_at string, published_at string, status string, triaged boolean, source string"


def at(*parts):
    return dt.datetime(*parts, tzinfo=UTC)


#: (target, found_at, its instant, published_at, its instant); target c has clocks at +8 hours, u writes the month first.
TIMES = [
    ("c", "2026-02-03 10:04:05", at(2026, 2, 3, 2, 4, 5), None, None),
    ("c", "2026-02-04T00:00:00.000Z", at(2026, 2, 4), "Mon, 02 Feb 2026 03:04:05 GMT", at(2026, 2, 2, 3, 4, 5)),
    ("c", "2026-01-05T01:00:00+02:00", at(2026, 1, 4, 23), "nothing", None),
    ("c", "20260203T040506Z", at(2026, 2, 3, 4, 5, 6), "", None),
    ("c", "1770000000", at(2026, 2, 2, 2, 40), "1770000000000", at(2026, 2, 2, 2, 40)),
    ("c", "2025-12-31T23:59:59Z", at(2025, 12, 31, 23, 59, 59), "2026年2月5日", at(2026, 2, 4, 16)),
    ("u", "03/04/2026", at(2026, 3, 4), None, None),
    ("u", "2026-02-30", None, "5 March 2026", at(2026, 3, 5)),
    ("u", None, None, "unknown", None),
    ("u", "2026-01-01 00:00", at(2026, 1, 1), "2026-01-01", at(2026, 1, 1)),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("times"))
    rows = [(n, 1, f"i{n}", t, f"https://code.test/o{n}/tool", "page", None, f, p, "new", None, "crawl") for n, (t, f, _, p, _) in enumerate(TIMES)]
    # a former write of an id, which the view leaves out
    rows.append((-1, 0, "i0", "c", "https://code.test/o0/tool", "page", None, "2026-08-01 00:00:00", None, "new", None, "crawl"))
    spark.createDataFrame(rows, ITEM).write.parquet(f"{path}/intel_item.parquet")
    spark.createDataFrame([("c", "Asia/Shanghai", "zh-CN"), ("u", "UTC", "en-US")], "id string, zone string, locale string").write.parquet(f"{path}/intel_target.parquet")
    return path


def got(spark, folder, name):
    return sorted(tuple(r) for r in catalog.queries()[name](spark, folder).collect())


def of(target):
    """(seq, published or found instant) of a target's items."""
    return [(n, p or f) for n, (t, _, f, _, p) in enumerate(TIMES) if t == target]


def hours(times):
    return (max(times) - min(times)).total_seconds() / 3600


def test_recent(spark, folder):
    wanted = [n for n, (_, _, f, _, _) in enumerate(TIMES) if f and f >= at(2026, 1, 1)]
    assert got(spark, folder, "whole_list_recent") == sorted((f"i{n}", n, len(wanted)) for n in wanted)


def test_digest(spark, folder):
    wanted = []
    for target in "cu":
        ranked = sorted(of(target), key=lambda x: (x[1] is None, -(x[1] or NOW).timestamp(), -x[0]))
        wanted += [(target, f"i{n}", rank, 1, len(ranked)) for rank, (n, _) in enumerate(ranked, 1)]
    assert got(spark, folder, "whole_digest") == sorted(wanted)


def test_bursts(spark, folder):
    wanted = []
    for target in "cu":
        items = of(target)
        wanted.append((target, "tool", ",".join(sorted(f"o{n}" for n, _ in items)), len(items), pytest.approx(hours([t for _, t in items if t]))))
    assert got(spark, folder, "whole_template_batches") == wanted
    assert got(spark, folder, "whole_suppressed") == [("c", 6, False), ("u", 4, False)]


def test_ages(spark, folder):
    by = {r[0]: r[1:] for r in got(spark, folder, "whole_age_stats")}
    # the log's former write of i0 counts here: 2026-08-01 at +8 hours
    for target, more in (("c", [at(2026, 7, 31, 16)]), ("u", [])):
        ages = [(NOW - t).total_seconds() / 3600 for t in [t for _, t in of(target) if t] + more]
        assert by[target] == (pytest.approx(min(ages)), pytest.approx(max(ages)), sum(t is None for _, t in of(target)))
