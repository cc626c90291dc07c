"""Cases in which an operator did less than its whole job."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

import pytest

from marlspike.llm import batches, mainbody, residue, truncation
from marlspike.session import scratch

# 6


def _batch(spark, *rows):
    return batches.keyed(spark.createDataFrame([(1, seq, url, url) for seq, url in rows], "batch_no int, seq bigint, id string, url string"))


def test_an_index_is_opened_again(spark):
    folder = scratch(spark, "reopened")
    first = batches.BatchIndex(spark, folder, keys_per_shard=10)
    first.accept(_batch(spark, *[(i, f"https://a.test/paper/{i * i}") for i in range(1, 60)]))
    # of the same session or a later one: only the folder is handed on
    second = batches.BatchIndex(spark, folder, keys_per_shard=10)
    got = {r.key: r.first_seq for r in second.accept(_batch(spark, (100, "http://www.a.test/paper/49/"), (101, "https://a.test/other"), (102, "https://a.test/other?utm_x=1"))).collect()}
    assert got == {"a.test\tpaper/49\t": 7, "a.test\tother\t": 101}
    third = batches.BatchIndex(spark, folder, keys_per_shard=10)
    assert [r.first_seq for r in third.accept(_batch(spark, (200, "https://a.test/other#x"))).collect()] == [101]
    name = third.segments[0][0]
    files, _ = third._files()
    files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
    with pytest.raises(FileNotFoundError):
        batches.BatchIndex(spark, folder)


def test_near_duplicates_by_coverage(spark):
    index = batches.BatchIndex(spark, scratch(spark, "near"), keys_per_shard=10)
    index.accept(_batch(spark, *[(i, f"https://a.test/notices/of/the/harbour/office/2024/{i:03}-tariff-{i * 7919 % 1000}") for i in range(40)], (90, "https://b.test/x")))
    got = {r.key.split("\t")[1][-9:]: (r.near, round(r.coverage, 2)) for r in index.accept(_batch(spark, (100, "https://a.test/notices/of/the/harbour/office/2024/007-tariff-433/print"), (101, "https://a.test/notices/of/the/harbour/office/2024/009-tariff-271.html"), (102, "https://a.test/quite/another"), (103, "https://b.test/y"))).collect()}
    assert got["433/print"][0] == 7 and got["-271.html"][0] == 9 and got["433/print"][1] >= 0.8
    assert got["e/another"][0] is None and got["y"] == (None, 0.0)


def test_coverage_against_brute_force():
    draw = random.Random(12)
    keys = ["".join(draw.choice("ab") for _ in range(draw.randrange(1, 60))) for _ in range(40)]
    segment = batches.Segment.of([k.encode() for k in sorted(set(keys))], list(range(len(set(keys)))))
    new = [k[:20] + "c" + k[21:] for k in keys if len(k) > 30]
    text = b"".join(b"\n" + k.encode() + b"\n" for k in new)
    symbols = np.frombuffer(text, np.uint8)
    begins, ends, owner, at = [], [], [], 0
    for i, k in enumerate(new):
        size = len(k) + 2
        for b in range(max(0, size - batches.LEAST_MATCH + 1)):
            begins.append(at + b)
            ends.append(at + size)
            owner.append(i)
        at += size
    got = dict(((int(w), int(r)), int(n)) for w, r, n in zip(*segment.covered(symbols, np.array(owner), np.array(begins), np.array(ends))))
    whole = segment.text
    for i in range(len(new)):
        pattern = ("\n" + new[i] + "\n").encode()
        longest = [max(n for n in range(len(pattern) - b + 1) if pattern[b : b + n] in whole) for b in range(len(pattern))]
        if max(longest) >= batches.LEAST_MATCH:
            assert max(n for (w, _), n in got.items() if w == i) >= max(longest)
        else:
            assert not any(w == i for w, _ in got)


def _coverage(key: str, record: str) -> float:
    pattern, whole = f"\n{key}\n", f"\n{record}\n"
    covered = {p + k for p in range(len(pattern) - batches.LEAST_MATCH + 1) if pattern[p : p + batches.LEAST_MATCH] in whole for k in range(batches.LEAST_MATCH)}
    return len(covered) / len(pattern)


def test_near_duplicates_by_brute_force():
    draw = random.Random(13)
    words = ["harbour", "office", "tariff", "notice", "a", "2024", "quay", "/"]
    keys = sorted({"-".join(draw.choice(words) for _ in range(draw.randrange(1, 14))) for _ in range(150)})
    text = b"\n" + b"".join(k.encode() + b"\n" for k in keys)
    sizes = np.array([len(k) + 1 for k in keys])
    new = ["".join(draw.choice(["x", "yy", ""]) if draw.random() < 0.02 else c for c in draw.choice(keys) + draw.choice(["", "-end", draw.choice(keys)])) for _ in range(150)]
    near, share = batches.covering(new, batches.Records(text, np.cumsum(sizes) - sizes, np.arange(len(keys))))
    for key, got, part in zip(new, near.tolist(), share.tolist()):
        top, first = min((-_coverage(key, k), i) for i, k in enumerate(keys))
        assert (got, part) == ((first, -top) if -top >= batches.NEAR else (-1, 0.0))
    assert 20 < (near >= 0).sum() < 130


def test_near_duplicates_that_differ_at_their_beginning(spark):
    index = batches.BatchIndex(spark, scratch(spark, "near-begin"), keys_per_shard=10)
    tail = "notices/of/the/harbour/office/2024"
    index.accept(_batch(spark, *[(i, f"https://{'abcdefgh'[i % 8]}.test/{tail}/{i:03}-tariff-{i * 7919 % 1000}") for i in range(80)]))
    assert len(index.bounds) > 3
    got = {r.key: r.near for r in index.accept(_batch(spark, (100, f"https://z.test/{tail}/072-tariff-168"), (101, f"https://0.test/{tail}/007-tariff-433"), (102, "https://z.test/quite/another/page/of/this/office"))).collect()}
    assert got == {f"z.test\t{tail}/072-tariff-168\t": 72, f"0.test\t{tail}/007-tariff-433\t": 7, "z.test\tquite/another/page/of/this/office\t": None}


# 4


def test_every_line_counts_in_the_prose_model(spark):
    draw = random.Random(4)
    words = "harbour ledger winter copper meadow signal carpet lantern orchard kettle bridge market".split()
    lines = [" ".join(draw.choices(words, k=7)) + "." for _ in range(9000)]
    # made-up words, each in one line only; the last line is longer than any sentence
    rare = ["".join(draw.choices("qxzjvwk", k=9)) for _ in range(30)]
    lines += [" ".join(draw.choices(words, k=9)) + f" {word}." for word in rare[:-1]] + [" ".join(draw.choices(words, k=500)) + f" {rare[-1]}."]
    pages = spark.createDataFrame([("\n".join(lines[i : i + 10]),) for i in range(0, len(lines), 10)], "content string")
    ratios = residue.train(pages.repartition(1), "content")
    seen = {b for line in lines[:9000] for b in residue.grams(line)} | {b for group in (residue.CICERO, residue.FILLER, residue.ERRORS, residue.NOTICES, residue.ABOUT) for t in group for b in residue.grams(t)}
    # what neither side has seen counts 0
    assert [w for w in rare if any(ratios[b] == 0 for b in residue.grams(f"{w}.") if b not in seen)] == []
    assert (residue.train(pages.repartition(7), "content") == ratios).all()


# 7


def test_runs_against_brute_force():
    draw = random.Random(6)
    for _ in range(40):
        pages = [[draw.randrange(5) for _ in range(draw.randrange(1, 12))] for _ in range(draw.randrange(1, 8))]
        page = np.concatenate([np.full(len(p), 100 + i) for i, p in enumerate(pages)])
        key = np.concatenate([np.array(p, np.int64) * 7919 for p in pages])
        stream = mainbody.Stream(page, key, key % 13)
        got = {(lines, run): (k, words, n) for k, run, lines, words, n in stream.repeated()}
        holders: dict = {}
        for i, p in enumerate(pages):
            for b in range(len(p)):
                for e in range(b + 1, len(p) + 1):
                    holders.setdefault(tuple(p[b:e]), []).append(i)
        # runs of several lines only where no further line would keep all occurrences
        wanted = {}
        for run, on in holders.items():
            longest = not any(len(o) == len(run) + 1 and o[:-1] == run and len(holders[o]) == len(on) for o in holders)
            if len(set(on)) > 1 and (len(run) == 1 or longest):
                wanted[run] = (run[0] * 7919 if len(run) == 1 else 0, sum(v * 7919 % 13 for v in run), len(set(on)))
        assert sorted((len(r), *v) for r, v in wanted.items()) == sorted((lines, *v) for (lines, _), v in got.items())
        for lines, at, hashed in stream.found(np.array([r for _, r in got]), np.array([n for n, _ in got])):
            for value in set(hashed.tolist()):
                assert len(set(stream.owner[at[hashed == value]])) == got[lines, value][2]


def test_a_block_of_lines_is_covered_though_its_lines_are_not(spark, monkeypatch):
    draw = random.Random(2)
    block = ["Read the terms of use of this desk", "Write to the editor of this page", "Printed in the old harbour hall"]
    pages = []
    for i in range(60):
        body = [f"The {draw.choice('red green blue old new'.split())} desk {chr(97 + i % 26)}{chr(97 + i // 26)} counted pages {'of ' * (k + 1)}the archive." for k in range(3)]
        pages.append(("t", i, "h.test", None, "\n".join(body + (block if i < 4 else block[i % 3 : i % 3 + 1] if i < 7 else [])), False))
    lines = mainbody.lines_of(spark.createDataFrame(pages, "tbl string, rec bigint, host string, title string, content string, markup boolean")).cache()

    def covered():
        stream = mainbody.streams(lines).cache()
        return {(r.rec, r.no) for r in lines.join(mainbody.covered_lines(stream, mainbody.runs_of(stream)), ["tbl", "host", "page", "no"]).collect()}

    # four pages in sixty are few for a line, not for a run of twenty words; a line of it alone is not covered
    wanted = {(i, n) for i in range(4) for n in (3, 4, 5)}
    assert covered() == wanted
    monkeypatch.setattr(mainbody, "PAGES_PER_CHUNK", 25)
    assert covered() == wanted


def test_chunks_of_a_host_change_nothing(spark, monkeypatch):
    rows = [("t", i, "h.test", None, "\n".join(["on all pages", f"on page {chr(97 + i)}", *(["on a third"] if i % 3 == 0 else []), *(["on three"] if i in (1, 8, 20) else []), *(["on two"] if i in (2, 9) else [])]), False) for i in range(24)]
    lines = mainbody.lines_of(spark.createDataFrame(rows, "tbl string, rec bigint, host string, title string, content string, markup boolean")).cache()

    def shares():
        return {r.key: round(r.share * 24) for r in mainbody.supports(lines).filter("share IS NOT NULL").collect()}

    wanted = {mainbody._key("on all pages"): 24, mainbody._key("on a third"): 8, mainbody._key("on three"): 3}
    assert shares() == wanted
    monkeypatch.setattr(mainbody, "PAGES_PER_CHUNK", 2)
    assert shares() == wanted


def test_no_text_is_shuffled_and_chunks_and_copies_change_nothing(spark, monkeypatch):
    draw = random.Random(7)
    words = "harbour ledger winter copper meadow signal carpet lantern orchard kettle bridge market".split()
    pages = []
    for i in range(60):
        body = [f"The {draw.choice(words)} of the {draw.choice(words)} was counted {chr(97 + i % 26)}{chr(97 + i // 26)} times in the {draw.choice(words)} {k}." for k in range(3)]
        lines = ["Home | News | Contact us", f"Title {i}", *body, "We use cookies to improve your visit."]
        markup = f"<header>\n<p>{lines[0]}</p>\n</header>\n<article>\n" + "\n".join(f"<p>{b}</p>" for b in lines[1:5]) + f"\n</article>\n<footer>\n<p>{lines[5]}</p>\n</footer>"
        pages.append(("t", i, f"h{i % 2}.test", f"Title {i}", markup if i % 3 == 0 else "\n".join(lines), i % 3 == 0))
    pages += [(t, rec + 100, *rest) for t, rec, *rest in pages[:7]]
    df = spark.createDataFrame(pages, "tbl string, rec bigint, host string, title string, content string, markup boolean")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = mainbody.furniture(df)
        plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[(.*?)\]", plan)
        assert moved and not any("text#" in columns for columns in moved)
        found = {(r.rec, r.no) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found == {(rec, n) for _, rec, _, _, _, markup in pages for n in ((1, 10) if markup else (0, 5))}
    monkeypatch.setattr(mainbody, "PAGES_PER_CHUNK", 7)
    assert {(r.rec, r.no) for r in mainbody.furniture(df).collect()} == found


def test_a_line_scores_the_sum_of_its_features():
    weights = np.random.default_rng(5).normal(size=mainbody.BUCKETS + 1).astype(np.float32)
    tool = mainbody.Judge(weights)
    for text in ("Share: this page with your friends", "12. Of 7 days and 8 nights", "联系我们：电话 123", "One two one two one", "…", "By A. Writer | 3 min"):
        words = mainbody._words(text)
        found = mainbody.features(text)
        found = sorted(set(found[: len(words)])) + found[len(words) :]
        assert tool.odds(text) == tool.odds(text) == pytest.approx((weights[found].sum() + weights[-1]) * (len(found) + 1) ** -0.5, rel=1e-4)


# 10


def test_a_cut_text_is_no_evidence_for_itself(spark):
    rows = [(i, "a", f"The review desk counted {i} pages.\n- the audit trail\nIt was sent in round {i}.") for i in range(5)]
    whole = [(10, "a", "All is set.\n- the audit trail")]
    # what goes on elsewhere was cut, also if it comes twice under another id, or if one other text ends in the same way
    rows += [(15, "b", "A desk separates a list of nine ports.\nIt is read again in the morning.")]
    cut = [(20, "a", "It was read.\nThe desk separates a list of"), (21, "b", "It was read.\nThe desk separates a list of")]
    cut += [(30 + i, "a", f"Round {'one two'.split()[i]} ended.\nread again in the") for i in range(2)]
    # what nothing else goes on from is no case, however often it comes
    whole += [(22, "a", "A note.\nseen by the\nseen by the\nand so on.\nseen by the")]
    whole += [(40 + i, "a", f"Round {'one two three'.split()[i]} ended.\nkept on shelf") for i in range(3)]
    df = spark.createDataFrame(rows + whole + cut, "doc bigint, source string, text string")
    assert {r.doc for r in truncation.cut_off(df, "doc", "text", "source").collect()} == {d for d, *_ in cut}


def test_many_texts_cut_inside_the_same_word(spark):
    # in a large corpus several texts are cut at one place, which does not make the place an end
    whole = [(i, "a", f"Round {i} began.\nThe review desk counted {i} pages before noon.") for i in range(90)]
    cut = [(100 + i, "a", f"Table {i} is new.\nThe review desk coun") for i in range(4)]
    # a word that ends lines often is whole, though a longer one begins with it
    whole += [(200 + i, "a", f"Note {i} is new.\nkept by the port") for i in range(9)] + [(220 + i, "a", f"Note {i} is old.\nkept by the ports of call") for i in range(20)]
    df = spark.createDataFrame(whole + cut, "doc bigint, source string, text string").repartition(3)
    assert {r.doc for r in truncation.cut_off(df, "doc", "text", "source").collect()} == {d for d, *_ in cut}


def test_longer_words_against_brute_force(spark):
    draw = random.Random(5)
    rows = {(draw.randrange(3), "".join(draw.choice("ab") for _ in range(draw.randrange(1, 6)))): draw.randrange(1, 9) for _ in range(150)}
    df = spark.createDataFrame([(c, w, n, 1, 0, 0, 0) for (c, w), n in rows.items()], "context bigint, word string, on bigint, ending bigint, inside bigint, low bigint, high bigint").repartition(5)
    got = {(r.context, r.word): r.longer for r in truncation.with_longer(df).collect()}
    assert got == {(c, w): sum(n + 1 for (d, v), n in rows.items() if d == c and v != w and v.startswith(w)) for c, w in rows}


def test_complete_texts_unlike_any_other(spark):
    ends = ["— Ann Other, editor", "Opening hours and fees", "Phone: +49 30 5550 17", "#harbour #survey", "- two spare lamps"]
    whole = [(i, "a", f"The desk counted {i} pages.\n{e}") for i, e in enumerate(ends)]
    rows = [(10 + i, "a", f"A reader found line {i} twice.") for i in range(5)]
    df = spark.createDataFrame(whole + rows, "doc bigint, source string, text string")
    assert truncation.cut_off(df, "doc", "text", "source").count() == 0


def test_prefixes_of_every_length(spark):
    draw = random.Random(8)
    texts = ["".join(draw.choice("ab \n") for _ in range(draw.choice([1, 2, 3, 5, 9, 17, 40, 63, 64, 65, 130]))) for _ in range(300)]
    texts += [t[: draw.randrange(1, len(t) + 1)] for t in texts for _ in range(2)] + ["The desk counted", "The desk counted ten pages.", "head\nmore", "head", "head of it", None, "", " "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string").repartition(5)
    ids = {r.h: r.text for r in df.selectExpr("xxhash64(text) AS h", "text").collect()}
    got = {ids[r.whole]: r.goes_on for r in truncation.copies_continue(df, "text").collect()}
    solid = {t for t in texts if t and t.rstrip(truncation.BLANKS)}
    wanted = {t: int(any(u[len(t)] not in "\n\r" for u in solid if u.startswith(t) and u != t)) for t in solid if any(u.startswith(t) and u != t for u in solid)}
    assert got == wanted and got["The desk counted"] == 1 and got["head"] == 1


def test_windows_against_brute_force(spark):
    draw = random.Random(9)
    texts = ["\n".join(" ".join(draw.choice(["red", "re", "sea", "Ann", "7", "of", "中文"]) for _ in range(draw.randrange(1, 9))) for _ in range(draw.randrange(1, 4))) for _ in range(120)]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts + texts[:5])], "doc bigint, source string, text string").repartition(3)
    found = truncation.ends(df, "doc", "text", "source")
    keys = found.filter("open").select("doc", "word", F.posexplode("contexts").alias("level", "context")).filter("context <> 0")
    got = {(r.doc, r.level): (r.on, r.ending, r.inside) for r in keys.join(truncation.window_counts(df, "text", keys.select("context")), ["context", "word"]).collect()}

    def streams(text):
        for line in text.split("\n"):
            yield ["^", *map(truncation.kind, truncation.words_of(line))]

    distinct, wanted = set(texts), {}
    for doc, text in enumerate(texts + texts[:5]):
        tail = list(streams(text))[-1]
        for level, width in enumerate([*truncation.WINDOWS, len(tail)]):
            if width > len(tail):
                continue
            on = ending = inside = 0
            for other in distinct:
                ways = set()
                lines = list(streams(other))
                for no, words in enumerate(lines):
                    for i in range(len(words) - width + 1):
                        if words[i : i + width] == tail[-width:] and (level < len(truncation.WINDOWS) or (i == 0 and width == len(words))):
                            ways.add("on" if i + width < len(words) else "last" if no == len(lines) - 1 else "inside")
                on, ending, inside = on + ("on" in ways), ending + bool(ways & {"last", "inside"}), inside + ("inside" in ways)
            wanted[doc, level] = (on, ending, inside)
    assert got == wanted


def test_a_limit_of_the_null_source(spark):
    rows = [(i, None, f"Page {i} of the report was counted.") for i in range(4)] + [(8, None, "A clerk sends the whole list of ports to the harbour.")]
    cut = [(10, None, "Nothing was lost. A clerk sends the whole l"), (11, None, "It came too late. Zwei Tage danach brachten")]
    df = spark.createDataFrame([(d, s, t) for d, s, t in rows[:4]] + [(8, "x", rows[4][2])] + cut, "doc bigint, source string, text string")
    assert {r.doc: r.reason for r in truncation.cut_off(df, "doc", "text", "source").collect()} == {10: "prefix", 11: "at the limit"}


# 3


def test_languages_without_a_list():
    from marlspike.llm import encodings

    texts = ["Το γραφείο άνοιξε χθες.", "사무소가 문을 열었다.", "Їх опубліковано вчора, є перелік.", "نشر المكتب قائمة جديدة.", "המשרד נפתח אתמול.", "कार्यालय खुला है।"]
    for text in texts:
        for chain in (("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp1252", 2), ("utf-8", "mac_roman", 1)):
            garbled = encodings.misread(text, *chain)
            assert encodings.repair(garbled, chain) == text, (text, chain)


def test_share_of_repaired_texts_that_are_right(spark):
    """Lines of the corpus garbled by each chain: what the classifier and the inverse give back, counted per chain."""
    from marlspike.llm import encodings

    rows = spark.read.parquet("/root/testdata/sf0.001/doc_extract.parquet").select("text").collect()
    lines = sorted({x for r in rows for x in (r.text or "").split("\n") if not x.isascii() and len(x) > 30 and encodings._seems_sound(x)})
    model = encodings.train(spark.createDataFrame([(x,) for x in lines], "line string"))
    right, all_of = 0, 0
    for line in lines:
        for chain in encodings.CHAINS:
            garbled = encodings.misread(line, *chain)
            # strict inversion is possible and the damage is more than a sign or two
            if chain[0] == "utf-8" and garbled and garbled != line and encodings.LOST not in garbled:
                all_of += 1
                right += encodings.judge(garbled, model)[1] == line
    print("repaired right", right, "of", all_of)
    assert right / all_of >= 0.95


# 9


def test_neighbours_share_a_shard(spark):
    from pyspark.sql import functions as F

    from marlspike.llm import packing, tokens

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("length(text) > 0")
    copies = spark.range(400).select((F.col("id") + 10_000).alias("doc_id"), F.lit("The harbour office counts the same crane twice, twice.").alias("text"))
    encoded = tokens.encoded(rows.unionByName(copies), "text", "doc_id").cache()
    ids = {r.doc_id: np.array(r.ids) for r in encoded.collect()}
    order = sorted(ids)
    size = max(int(x.max()) for x in ids.values()) + 1
    df = np.zeros(size)
    for x in ids.values():
        df[np.unique(x)] += 1
    mean = float(np.mean([len(x) for x in ids.values()]))
    idf = np.log(1 + (len(ids) - df + 0.5) / (df + 0.5)).astype(np.float32)
    total = sum(map(len, ids.values()))
    shard = {r.doc_id: r.shard for r in packing.sharded(encoded, idf, packing.wide_enough(df, mean, total // 6), mean, total // 6).collect()}
    held: dict = {}
    for d, s in shard.items():
        held[s] = held.get(s, 0) + len(ids[d])
    longest = max(map(len, ids.values()))
    # no shard is much larger than asked for, not even that of the copies
    assert len(held) > 4 and max(held.values()) <= total // 6 * 1.3 + longest
    index = packing.Index([ids[d] for d in order], idf, mean)
    near = 0
    for i, d in enumerate(order[:100]):
        scores = index.scores(i).copy()
        scores[i] = -1
        near += shard[order[int(scores.argmax())]] == shard[d]
    print("nearest neighbour in the same shard", near / 100)
    # by chance it would be a sixth
    assert near / 100 > 0.3


def test_other_vocabularies(spark):
    from marlspike.llm import packing

    df = spark.createDataFrame([(i, "Harbour dues rise again. " * (i + 1)) for i in range(20)], "doc_id bigint, text string")
    for vocabulary in ("byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"):
        rows = packing.containers(df, [(1, 64)], "doc_id", "text", vocabulary).toPandas()
        assert set(rows.doc_id) == set(range(20)) and rows.groupby("container_id").tokens.sum().max() <= 64


def test_a_sound_line_is_not_read_as_another_script(spark):
    from marlspike.llm import encodings

    lines = ["La fonction «âge» accepte ±0,5 °C, soit ½ point.", "Größe: 5 µm × 3 µm", "Реестр объявлений описывает полный перечень."] * 3
    model = encodings.train(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert [encodings.judge(x, model)[0] for x in lines[:3]] == [None] * 3
    garbled = encodings.misread(lines[2], "cp1251", "latin-1")
    assert encodings.judge(garbled, model)[1] == lines[2]
