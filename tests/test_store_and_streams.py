"""Store, scans and streams on small tables."""

import datetime as dt
import io
import json
import zipfile

from pyspark.sql import functions as F

from marlspike.sources.documents import extract, read_documents
from marlspike.sources.store import Store, cached, digest_of_parameters
from marlspike.streaming.scans import first_sightings, late_tolerant, scan_batch, watch

CANDIDATE = "target_id string, url string, title string, source string, mime string, found_at timestamp, published_at timestamp, published_at_from string, meta map<string,string>, ord bigint"
T = dt.datetime(2025, 1, 1)


def candidates(spark, *urls, target="t", published=None):
    return spark.createDataFrame([(target, u, None, "crawl", None, T, published, None, {}, i) for i, u in enumerate(urls)], CANDIDATE)


def test_scan_twice_adds_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    first = candidates(spark, "https://a.test/x.pdf", "https://a.test/page.htm", "https://a.test/list2.htm", "http://A.test/x.pdf#top")
    assert scan_batch(store, first) == {"found": 3, "new": 1, "suppressed": 0}  # a first scan keeps documents only
    assert scan_batch(store, first) == {"found": 3, "new": 0, "suppressed": 0}
    assert scan_batch(store, candidates(spark, "https://a.test/new.htm", "https://a.test/page.htm"))["new"] == 1
    assert store.items().count() == 2
    store.update_status(spark.createDataFrame([("https://a.test/x.pdf",)], "id string"), "seen")
    assert {r.id: r.status for r in store.items().collect()}["https://a.test/x.pdf"] == "seen"


def test_backfill_and_bursts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    scan_batch(store, candidates(spark, "https://a.test/x.pdf"))
    scan_batch(store, candidates(spark, "https://a.test/x.pdf", published=T))
    assert store.items().first().published_at == T
    burst = candidates(spark, *[f"https://code.test/o{i}/{n}" for i, n in enumerate(["ai-manus", "manus_ai", "AI--manus", "ai manus", "ai-manus"])])
    assert scan_batch(store, burst)["suppressed"] == 5


def test_targets_and_traces(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.patch_target("a", 1, url="x", kind="site")
    store.patch_target("a", 2, url="y")
    assert store.targets().first().fields == {"url": "y", "kind": "site"}
    store.remove_target("a", 3)
    assert store.targets().count() == 0
    rows = spark.createDataFrame([(T, "search", "token=abc123 x", "p", True, 1, "c", 5, None)], "at timestamp, tool string, query string, params string, ok boolean, results int, channel string, elapsed_ms bigint, error string")
    store.append_trace(rows)
    assert store.trace().first().query == "token=[redacted] x"
    cache = spark.createDataFrame([("k", "old", T), ("k", "new", T + dt.timedelta(days=2))], "key string, value string, expires_at timestamp")
    assert cached(cache, F.lit(T + dt.timedelta(days=1))).first().value == "new"
    p = spark.createDataFrame([({"q": "Bearer abcd", "secret": "s"},)], "p map<string,string>")
    assert p.select(digest_of_parameters(F.col("p"), ["q", "n"]).alias("d")).first().d == "q=Bearer [redacted]"


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    frame = spark.createDataFrame([("a", T), ("a", T), ("b", T)], "id string, at timestamp")
    frame.coalesce(1).write.parquet(source)
    for name, build in (("one", lambda s: first_sightings(s)), ("two", lambda s: late_tolerant(s, "at"))):
        stream = spark.readStream.schema(frame.schema).parquet(source)
        build(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
        assert sorted(r.id for r in spark.table(name).collect()) == ["a", "b"]
    store = Store(spark, str(tmp_path / "store"))
    candidates(spark, "https://a.test/x.pdf").write.parquet(str(tmp_path / "c"))
    for _ in range(2):
        watch(spark.readStream.schema(CANDIDATE).parquet(str(tmp_path / "c")), store, str(tmp_path / "cp")).awaitTermination()
    assert store.items().count() == 1


def test_documents(spark, tmp_path):
    def archive(**members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, content in members.items():
                z.writestr(name.replace("__", "/").replace("_xml", ".xml"), content)
        return out.getvalue()

    docx = archive(word__document_xml="<d><p><t>Hello</t></p><tbl><tr><tc><p><t>a</t></p></tc><tc><p><t>b</t></p></tc></tr></tbl></d>")
    assert extract(docx, "x.bin")[:3] == ("docx", "Hello", [{"sheet": "", "rows": [["a", "b"]]}])
    xlsx = archive(xl__workbook_xml='<w><sheet name="S"/></w>', xl__sharedStrings_xml="<s><si><t>x</t></si></s>", xl__worksheets__sheet1_xml='<w><row><c t="s"><v>0</v></c><c><v>7</v></c></row></w>')
    assert extract(xlsx, "x")[2] == [{"sheet": "S", "rows": [["x", "7"]]}]
    assert extract(b"a\tb\n", "x.tsv")[2][0]["rows"] == [["a", "b"]]
    assert extract("é,b\n".encode("gbk"), "x.csv")[1] == "é,b\n"
    assert extract(b"a\n" * 5, "x.csv", 2)[3] == ["3 rows beyond 2 left out"]
    assert extract(b"%PDF-1.4", "x")[3] == ["unsupported format: pdf"]
    assert extract(b"PK\x03\x04broken", "x.docx")[3] and extract(None, "x")[3] and extract(b"", "x.txt")[1] == ""
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "p.html").write_text("<html><script>x</script><p>A &amp; B</p><table><tr><td>1</td></tr></table></html>")
    row = read_documents(spark, str(tmp_path / "d")).first()
    assert row.kind == "html" and row.text.split("\n")[0] == "A & B" and json.loads(row.tables)[0]["rows"] == [["1"]]
