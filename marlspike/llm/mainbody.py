"""Main body of web pages, without the furniture around and inside it (problem 7).

Method: the pages of a host are concatenated as a stream of line tokens. A suffix array over it and its common prefixes
give every line and every run of lines that recurs in distinct pages, with its words and the share of the host's pages that
hold it. A run of several lines that is long enough for its share, and a single line of a share that is high enough, is
boilerplate; the lines that it covers go. Hosts are split into chunks of at most `PAGES_PER_CHUNK` pages, so no host,
however large, is one task; the runs of a host of more than one chunk are counted in all its chunks before any threshold.

That leaves what a host shows on few pages (bylines, teasers, counters), so there is a second stage: a logistic model over
words and line ends, fitted on covered lines, on the containers of marked-up pages (header, footer, aside, nav
against article, main) and on lines that do not recur. It decides the lines that no run covers, and keeps headings
and list items that recur by chance.

Defined cases: null and empty contents have no lines; lines without visible text count neither way; a
line equal to the page's title is its headline; a null url or domain is a host of its own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.llm.sampling import least_hashed
from marlspike.llm.suffix import common_prefixes, suffix_array
from marlspike.session import ship, staged, table

PAGES_PER_CHUNK = 4000
#: A line recurs once it is on so many pages of a host.
MIN_PAGES = 3
#: Share of a host's pages from which a recurring line speaks for furniture, and from which it also teaches.
MIN_SHARE, TEACHING_SHARE = 0.07, 0.15
#: A run of several lines covers them from so many words on, and from this product of its words and the share of pages
#: that hold it: the longer a run, the fewer pages prove it.
LEAST_WORDS, RUN_WEIGHT = 6, 0.12
#: and from this share of the pages, whatever its length; more than one page in half a chunk.
RUN_SHARE = 0.001
BUCKETS = 1 << 17
#: Upper bound of the examples of each label that the model is fitted on, and passes over them.
TRAINING_LINES = 15_000
EPOCHS = 6
#: The log odds a line needs: by its share of the host's pages (teaching, minimum, less), and against its container
#: or that of the same line on other hosts (with which it needs as much less).
NEEDED = (-4.0, -1.0, 0.0, 3.0)

_TAG = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|</?[A-Za-z!][^<>]*>", re.S | re.I)
_CONTAINER = re.compile(r"<(/?)(header|footer|aside|nav|article|main|section)\b", re.I)
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[^\W\d_]+|[一-鿿]|\d+|[^\w\s]")
_LEAD = re.compile(r"\s*(?:(\d{1,4})[.)]\s|([^\d\W][^:：.|]{0,30}?)\s*[:：])")
_FURNITURE, _BODY = ("header", "footer", "aside", "nav"), ("article", "main")
#: `site` stands for tbl and host; `exact` is null where it is the key, as in lines without digits.
LINES = "tbl string, rec bigint, no bigint, page bigint, host string, site bigint, key bigint, exact bigint, label int, headline boolean, sentence boolean, words int, text string"
#: Texts of so many characters at most, and so many of them, are remembered by a worker with what was worked out.
MEMO_LENGTH, MEMO_TEXTS = 400, 50_000


def _key(text: str) -> int:
    """A line's token: its letters and signs without white space, case and digits."""
    return hash_text(_DIGITS.sub("0", "".join(text.lower().split())))


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def page_lines(content: str, markup: bool) -> Iterator[tuple[int, str, int]]:
    """(line number, visible text, label) of the lines with visible text; label 1 furniture, 0 body, -1 unknown."""
    inside: list[str] = []
    for no, line in enumerate(content.split("\n")):
        label = -1
        if markup:
            for close, name in _CONTAINER.findall(line):
                name = name.lower()
                if not close:
                    inside.append(name)
                elif name in inside:
                    while inside.pop() != name:
                        pass
            for name in reversed(inside):
                if name in _FURNITURE or name in _BODY:
                    label = int(name in _FURNITURE)
                    break
            line = html.unescape(_TAG.sub(" ", line))
        text = line.strip()
        if text:
            yield no, text, label


def lines_of(pages: DataFrame) -> DataFrame:
    """The lines with visible text of pages (tbl, rec, host, title, content, markup)."""

    def worked_out(text: str) -> tuple[int, int | None, bool, int]:
        plain = "".join(text.lower().split())
        masked = _DIGITS.sub("0", plain)
        key = hash_text(masked)
        size = len(text.split()) if text.isascii() else len(_WORD.findall(text))
        return key, None if masked == plain else hash_text(plain), len(text) > 30 and text.rstrip("\"”’)")[-1:] in ".!?。！？", size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            of, numbers, labels, heads, texts, found = [], [], [], [], [], []
            rows = {c: batch.column(c).to_pylist() for c in ("tbl", "host", "title", "content", "markup")}
            # copies of a page count once
            pages_of = [hash_text(c) for c in rows["content"]]
            sites = [hash_text(f"{tbl}\n{host}") for tbl, host in zip(rows["tbl"], rows["host"])]
            for i, (title, content, markup) in enumerate(zip(rows["title"], rows["content"], rows["markup"])):
                head = _key(title) if title and title.strip() else None
                if len(known) > MEMO_TEXTS:
                    known.clear()
                for no, text, label in page_lines(content, markup):
                    facts = known.get(text)
                    if facts is None:
                        facts = worked_out(text)
                        if len(text) <= MEMO_LENGTH:
                            known[text] = facts
                    of.append(i)
                    numbers.append(no)
                    labels.append(label)
                    heads.append(facts[0] == head)
                    texts.append(text)
                    found.append(facts)
            place = pa.array(of, pa.int64())
            taken = [batch.column(c).take(place) for c in ("tbl", "rec", "host")]
            keys, exacts, sentences, sizes = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [taken[0], taken[1], pa.array(numbers, pa.int64()), pa.array(pages_of, pa.int64()).take(place), taken[2], pa.array(sites, pa.int64()).take(place), pa.array(keys, pa.int64()), pa.array(exacts, pa.int64()), pa.array(labels, pa.int32()), pa.array(heads, pa.bool_()), pa.array(sentences, pa.bool_()), pa.array(sizes, pa.int32()), pa.array(texts, pa.string())],
                names=["tbl", "rec", "no", "page", "host", "site", "key", "exact", "label", "headline", "sentence", "words", "text"],
            )

    ship(pages.sparkSession)
    return pages.mapInArrow(run, LINES)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Stream:
    """A chunk's pages as one stream of line tokens, each page ended by a token of its own, so that no run crosses pages."""

    def __init__(self, page: np.ndarray, key: np.ndarray, words: np.ndarray):
        """The rows are ordered by page and line."""
        number = np.unique(page, return_inverse=True)[1]
        stops = np.append(np.flatnonzero(np.diff(number) != 0) + 1, len(number))
        self.tokens, symbols = np.unique(key, return_inverse=True)
        self.place = np.arange(len(key)) + number  # of each row in the stream
        size = len(key) + len(stops)
        self.symbols = np.zeros(size, np.int64)
        self.symbols[self.place] = symbols + 1
        ends = stops + np.arange(len(stops))
        self.symbols[ends] = len(self.tokens) + 1 + np.arange(len(stops))
        self.owner = np.repeat(np.arange(len(stops)), np.diff(np.append(-1, ends)))
        self.room = np.repeat(ends, np.diff(np.append(-1, ends))) - np.arange(size)  # lines to the page's end
        self.words = np.zeros(size + 1, np.int64)
        self.words[1:][self.place] = words
        self.words = np.cumsum(self.words)
        hashed = np.zeros(size + 1, np.uint64)
        hashed[1:][self.place] = key.view(np.uint64) | np.uint64(1)
        self.sums = np.cumsum(hashed * _powers(_BASE, size + 1))
        self.back = _powers(_INVERSE, size + 1)

    def hashes(self, at: np.ndarray, lines: np.ndarray | int) -> np.ndarray:
        """A hash of the run of `lines` lines at each place, the same wherever the run stands."""
        return ((self.sums[at + lines] - self.sums[at]) * self.back[at]).view(np.int64)

    def repeated(self) -> list[tuple[int, int, int, int, int]]:
        """(key or 0, hash, lines, words, distinct pages) of each line, and of each run of lines that no further line could
        lengthen without loss of an occurrence, that is on two pages or more."""
        order = suffix_array(self.symbols)
        shared = common_prefixes(self.symbols, order)
        owner = self.owner[order]
        # the place in the order where the same page stood last: a page counts in an interval if that lies before it
        by_page = np.lexsort((np.arange(len(owner)), owner))
        before = np.full(len(owner), -1, np.int64)
        again = owner[by_page[1:]] == owner[by_page[:-1]]
        before[by_page[1:][again]] = by_page[:-1][again]
        out, open_runs = [], []
        for i, size in enumerate(np.append(shared[1:], 0).tolist()):
            start = i
            while open_runs and open_runs[-1][0] > size:
                lines, start = open_runs.pop()
                pages = int(np.count_nonzero(before[start : i + 1] < start))
                if pages > 1:
                    at = int(order[start])
                    outer = max(size, open_runs[-1][0] if open_runs else 0)
                    for n in {lines, 1} if outer == 0 else {lines}:
                        out.append((int(self.tokens[self.symbols[at] - 1]) if n == 1 else 0, int(self.hashes(np.array([at]), n)[0]), n, int(self.words[at + n] - self.words[at]), pages))
            if size and (not open_runs or open_runs[-1][0] < size):
                open_runs.append((size, start))
        return out

    def found(self, runs: np.ndarray, lines: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(lines, places, hashes) of the occurrences of the given runs."""
        for n in np.unique(lines):
            at = np.flatnonzero(self.room >= n)
            hashed = self.hashes(at, int(n))
            hit = np.isin(hashed, runs[lines == n])
            yield int(n), at[hit], hashed[hit]


def _stream(rows: pd.DataFrame) -> tuple[pd.DataFrame, Stream]:
    """Of copies of a page one."""
    page, rec, no = (rows[c].to_numpy() for c in ("page", "rec", "no"))
    order = np.lexsort((no, rec, page))
    page, rec = page[order], rec[order]
    starts = np.flatnonzero(np.append(True, page[1:] != page[:-1]))
    first = np.repeat(rec[starts], np.diff(np.append(starts, len(page))))
    rows = rows.take(order[rec == first])
    return rows, Stream(rows["page"].to_numpy(), rows["exact"].to_numpy(), rows["words"].to_numpy())


RUNS = "site bigint, chunk int, key bigint, run bigint, lines int, words int, pages bigint"
_COLUMNS = ["site", "chunk", "key", "run", "lines", "words", "pages"]


def _counts(*columns: np.ndarray) -> dict[tuple, int]:
    """How many distinct rows there are for each value of all columns but the last."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    if not len(order):
        return {}
    fresh = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    pairs = [c[np.append(True, fresh)] for c in columns]
    starts = np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in pairs[:-1]])))
    return dict(zip(zip(*[c[starts].tolist() for c in pairs[:-1]]), np.diff(np.append(starts, len(pairs[0]))).tolist()))


def _chunk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The lines (numbers masked) and the runs of several lines (word for word) that are on two pages or more; of a host of
    several chunks all lines, as their pages are added up."""
    rows, stream = _stream(rows)
    lines = _counts(rows["key"].to_numpy(), rows["page"].to_numpy())
    least = 2 if rows["chunks"].iloc[0] == 1 else 1
    found = [(key[0], key[1], k, 0, 1, 0, n) for (k,), n in lines.items() if n >= least]
    found += [(key[0], key[1], 0, run, size, words, n) for _, run, size, words, n in stream.repeated() if size > 1]
    return pd.DataFrame(found, columns=_COLUMNS)


def _count(key: tuple, rows: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    if not len(rows) or not len(runs):
        return pd.DataFrame(columns=_COLUMNS)
    _, stream = _stream(rows)
    values = {c: runs[c].to_numpy() for c in _COLUMNS[2:6]}
    counted = {}
    for lines, at, hashed in stream.found(values["run"], values["lines"]):
        if len(at):
            counted |= {(run, lines): n for (run,), n in _counts(hashed, stream.owner[at]).items()}
    on = [counted.get(x, 0) for x in zip(values["run"].tolist(), values["lines"].tolist())]
    return pd.DataFrame({"site": key[0], "chunk": key[1], **values, "pages": on})


def sites_of(lines: DataFrame) -> DataFrame:
    """site, tbl, host, total (distinct pages of the host)."""
    return lines.groupBy("site", "tbl", "host").agg(F.count_distinct("page").alias("total"))


def streams(lines: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """The lines without their texts, with the host's total, chunk and chunks: only numbers are grouped, by page into chunks,
    so no host is one task."""
    chunks = F.ceil(F.col("total") / PAGES_PER_CHUNK).cast("int")
    joined = lines.select("site", "page", "rec", "no", "key", F.coalesce("exact", "key").alias("exact"), "words", "label", "headline", "sentence")
    joined = joined.join(sites_of(lines) if sites is None else sites, "site").withColumn("chunks", chunks)
    return joined.withColumn("chunk", F.pmod(F.xxhash64("page"), F.col("chunks")).cast("int"))


_COUNTED = ["site", "chunk", "chunks", "page", "rec", "no", "key", "exact", "words"]


def runs_of(stream: DataFrame) -> DataFrame:
    """site, key (0 for more than one line), run, lines, words, pages, held (chunks that have it), share: lines and runs of lines
    with the pages of the host that hold them. Of a host of several chunks the lines are added up, and each run that any chunk
    has twice is counted in all of them; a run that no chunk has twice is on less than `RUN_SHARE` of the pages, too few for any length."""
    counted = stream.select(*_COUNTED)
    found = staged(counted.groupBy("site", "chunk").applyInPandas(_chunk, RUNS), "runs")
    sites = stream.select("site", "total", "chunks").distinct()
    placed = found.join(sites, "site")
    what = ["site", "key", "run", "lines", "words"]
    whole = placed.filter("chunks = 1").select(*what, "pages", F.array("chunk").alias("held"), "total")
    wanted = placed.filter("chunks > 1 AND lines > 1").select(*what, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).distinct()
    large = counted.filter("chunks > 1").groupBy("site", "chunk").cogroup(wanted.groupBy("site", "chunk")).applyInPandas(_count, RUNS).filter("pages > 0")
    parts = placed.filter("chunks > 1 AND lines = 1").select(*found.columns).unionByName(large)
    summed = parts.groupBy(*what).agg(F.sum("pages").alias("pages"), F.collect_list("chunk").alias("held")).join(sites, "site")
    both = whole.unionByName(summed.select(*whole.columns)).filter(F.col("pages") >= MIN_PAGES)
    return both.select(*what, "pages", "held", (F.col("pages") / F.col("total")).alias("share"))


def supports(lines: DataFrame) -> DataFrame:
    """tbl, host, key, share: the lines that recur on each host and the share of its pages that hold them."""
    sites = sites_of(lines)
    return runs_of(streams(lines, sites)).filter("lines = 1").join(sites, "site").select("tbl", "host", "key", "share")


EVIDENCE = "site bigint, rec bigint, no bigint, key bigint, teaches int, level int, covered boolean"


def evidence(stream: DataFrame, runs: DataFrame) -> DataFrame:
    """Every line of every page, copies too: site, rec, no, key; whether a run of several lines, long enough for the pages that
    hold it, covers the line; level (2 covered or on TEACHING_SHARE of the pages, 1 on MIN_SHARE, 0 less); teaches (1 furniture, 0 body, -1 neither)."""
    enough = (F.col("lines") > 1) & (F.col("share") >= RUN_SHARE) & (F.col("words") >= LEAST_WORDS) & (F.col("share") * F.col("words") >= RUN_WEIGHT)
    # a chunk is told of its own runs and lines only
    placed = runs.filter((F.col("lines") == 1) | enough).select("site", F.explode("held").alias("chunk"), "key", "run", "lines", "share")

    def judge(key: tuple, rows: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["site", "rec", "no", "key", "teaches", "level", "covered"])
        rows = rows.take(np.lexsort((rows["no"].to_numpy(), rows["rec"].to_numpy())))
        values = {c: rows[c].to_numpy() for c in ("rec", "no", "key", "label", "headline", "sentence")}
        many = runs["lines"].to_numpy() > 1
        covered = np.zeros(len(rows), bool)
        if many.any():
            s = Stream(values["rec"], rows["exact"].to_numpy(), np.zeros(len(rows), np.int64))
            edge = np.zeros(len(s.symbols) + 1, np.int64)
            for lines, at, _ in s.found(runs["run"].to_numpy()[many], runs["lines"].to_numpy()[many]):
                edge[at] += 1
                edge[at + lines] -= 1
            covered = np.cumsum(edge)[s.place] > 0
        one = np.argsort(runs["key"].to_numpy()[~many])
        known, shares = runs["key"].to_numpy()[~many][one], runs["share"].to_numpy()[~many][one]
        share = np.full(len(rows), -1.0)
        if len(known):
            at = np.minimum(np.searchsorted(known, values["key"]), len(known) - 1)
            share = np.where(known[at] == values["key"], shares[at], -1.0)
        strong = covered | (share >= TEACHING_SHARE)
        teaches = np.select([values["headline"].astype(bool), values["label"] >= 0, strong, (share < 0) & values["sentence"].astype(bool)], [0, values["label"], 1, 0], -1)
        level = np.select([strong, share >= MIN_SHARE], [2, 1], 0)
        return pd.DataFrame({"site": key[0], "rec": values["rec"], "no": values["no"], "key": values["key"], "teaches": teaches, "level": level, "covered": covered})

    lines = stream.select("site", "chunk", "rec", "no", "key", "exact", "label", "headline", "sentence")
    return lines.groupBy("site", "chunk").cogroup(placed.groupBy("site", "chunk")).applyInPandas(judge, EVIDENCE)


def covered_lines(stream: DataFrame, runs: DataFrame) -> DataFrame:
    """tbl, host, page, no of the lines that a run of several lines covers, long enough for the pages that hold it."""
    pages = stream.select("site", "rec", "page", "tbl", "host").distinct()
    return evidence(stream, runs).filter("covered").join(pages, ["site", "rec"]).select("tbl", "host", "page", "no").distinct()


def _words(text: str) -> list[str]:
    return ["0" if w[0] in "0123456789" else w for w in _WORD.findall(text.lower())]


def _frame(text: str, words: list[str]) -> list[str]:
    """A line's begin, end, length and lead: what stands before a colon or a running number tells teasers
    and bylines from headings."""
    parts = ["first\x1f" + words[0], "last\x1f" + words[-1], "begin\x1f" + " ".join(words[:2]), "end\x1f" + " ".join(words[-2:])] if words else []
    parts.append(f"length\x1f{min(8, len(words) // 3)}")
    if lead := _LEAD.match(text):
        kind = "number" if lead[1] else lead[2].lower()
        parts += [f"lead{k}\x1f{kind}" for k in range(12)]
    return parts


def features(text: str) -> list[int]:
    """Buckets of a line's words and of its frame; a checksum, as Python's own hash differs between workers."""
    words = _words(text)
    return [crc32(p.encode()) % BUCKETS for p in ["w\x1f" + w for w in words] + _frame(text, words)]


def sampled(labelled: DataFrame, lines: DataFrame, bound: int = TRAINING_LINES) -> pd.DataFrame:
    """text, label of at most `bound` examples of each label, those of least hash; a host's line counts once, or the most
    frequent lines would be all there is to learn. They are drawn from numbers (tbl, host, site, key, label); only then are texts read."""
    drawn = staged(least_hashed(labelled.select("tbl", "host", "site", "key", "label"), ["tbl", "host", "key"], bound, "label").select("site", "key", "label"), "sample")
    # twice the bound at most
    texts = lines.select("site", "key", "text").join(F.broadcast(drawn), ["site", "key"])
    return texts.groupBy("site", "key", "label").agg(F.min("text").alias("text")).select("text", "label").distinct().toPandas().sort_values(["label", "text"])


def fit(rows: pd.DataFrame) -> np.ndarray:
    """Weights of a logistic model (furniture against body) per bucket, and the bias at the end, fitted on examples (text, label)."""
    found = [np.unique(features(t)) for t in rows["text"]]
    labels = rows["label"].to_numpy(float)
    weights, squares = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(found)):
            x = np.append(found[i], BUCKETS)
            size = len(x) ** -0.5
            error = 1.0 / (1.0 + np.exp(-weights[x].sum() * size)) - labels[i]
            step = error * size + 1e-6 * weights[x]
            squares[x] += step * step
            weights[x] -= 0.4 * step / np.sqrt(squares[x])
    return weights.astype(np.float32)


class _Known(dict):
    """Weights of parts by their text, hashed when they are first met."""

    def __init__(self, weights: list[float], lead: str):
        self.weights, self.lead = weights, lead

    def __missing__(self, part: str) -> float:
        if len(self) > 100_000:
            self.clear()
        value = self[part] = self.weights[crc32((self.lead + part).encode()) % BUCKETS]
        return value


class Judge:
    """Scores lines; weights are remembered, so each part is hashed once per worker, and so are the scores of texts."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.tolist()
        self.word, self.first, self.last, self.begin, self.end, self.length = (_Known(self.weights, f"{x}\x1f") for x in ("w", "first", "last", "begin", "end", "length"))
        self.leads = [_Known(self.weights, f"lead{k}\x1f") for k in range(12)]
        self.texts: dict[str, float] = {}

    def odds(self, text: str) -> float:
        value = self.texts.get(text)
        if value is None:
            value = self.score(text)
            if len(text) <= MEMO_LENGTH:
                if len(self.texts) > MEMO_TEXTS:
                    self.texts.clear()
                self.texts[text] = value
        return value

    def score(self, text: str) -> float:
        """The sum of the weights of `features`, over the root of their number."""
        words = _words(text)
        parts = set(words)
        total, n = self.weights[-1] + sum(map(self.word.__getitem__, parts)), len(parts) + 2
        if words:
            total += self.first[words[0]] + self.last[words[-1]] + self.begin[" ".join(words[:2])] + self.end[" ".join(words[-2:])]
            n += 4
        total += self.length[str(min(8, len(words) // 3))]
        if lead := _LEAD.match(text):
            kind = "number" if lead[1] else lead[2].lower()
            total += sum(known[kind] for known in self.leads)
            n += 12
        return total * n**-0.5


def furniture(pages: DataFrame) -> DataFrame:
    """tbl, rec, no of every line with visible text that is no part of the main body."""
    lines = staged(lines_of(pages), "page-lines")
    # what containers of any host say of a recurring line: 1 furniture, 0 body
    contained = lines.filter("label >= 0").groupBy("key").agg(F.max("label").alias("high"), F.min("label").alias("low"), F.count(F.lit(1)).alias("times")).filter("high = low")
    # a line that containers of other hosts hold as body, time and again, is none on the model's word alone
    contained = staged(contained.select("key", F.col("high").alias("verdict"), ((F.col("high") == 0) & (F.col("times") >= MIN_PAGES)).alias("held")), "line-verdicts")
    sites = staged(sites_of(lines), "sites")
    stream = streams(lines, sites)
    facts = staged(evidence(stream, runs_of(stream)).drop("covered"), "line-facts")
    weights = fit(sampled(facts.filter("teaches >= 0").join(sites, "site").withColumn("label", F.col("teaches")), lines))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Judge(weights)
        for batch in batches:
            odds = np.fromiter(map(tool.odds, batch.column("text").to_pylist()), float, batch.num_rows)
            # no line needs less
            place = pa.array(np.flatnonzero(odds > NEEDED[0]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(place) for c in ("tbl", "site", "rec", "no", "key", "label")], pa.array(odds).take(place)], names=["tbl", "site", "rec", "no", "key", "label", "odds"])

    # texts are scored where they lie; evidence meets numbers only
    scored = lines.filter("NOT headline").select("tbl", "site", "rec", "no", "key", "label", "text").mapInArrow(score, "tbl string, site bigint, rec bigint, no bigint, key bigint, label int, odds double")
    known = scored.join(contained, "key", "left").join(facts.filter("level > 0").select("site", "rec", "no", "level"), ["site", "rec", "no"], "left")
    strong, recurs, least, against = map(F.lit, NEEDED)
    base = F.when(F.col("level") == 2, strong).when(F.col("level") == 1, recurs).otherwise(least)
    needed = F.when((F.col("label") == 0) | ((F.col("verdict") == 0) & (base > strong)), against).when(F.col("verdict") == 1, -against).otherwise(base)
    spared = F.coalesce("held", F.lit(False)) & (F.col("label") != 1) & (needed != strong)
    return known.filter((F.col("odds") > needed) & ~spared).select("tbl", "rec", "no")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched, deep = table(spark, sf_dir, "fetch_result"), table(spark, sf_dir, "deep_source")
    host = F.lower(F.regexp_replace(F.coalesce(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#:]+)", 1), F.lit("")), r"^(www|m)\.", ""))
    a = fetched.select(F.lit("fetch_result").alias("tbl"), F.col("fetch_id").alias("rec"), host.alias("host"), "title", "content", F.coalesce(F.col("mode") == "raw", F.lit(False)).alias("markup"))
    b = deep.select(F.lit("deep_source").alias("tbl"), F.col("source_id").alias("rec"), F.coalesce("domain", F.lit("")).alias("host"), "title", "content", F.lit(False).alias("markup"))
    return a.unionByName(b).filter("content IS NOT NULL AND content <> ''")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture(_pages(spark, sf_dir)).select("tbl", F.col("rec").alias("rec_id"), F.col("no").alias("line_no"))


def p7_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, rec_id, body: the main body of each page."""
    pages = _pages(spark, sf_dir).select("tbl", "rec", "title", "content", "markup", "host")
    out = furniture(pages).groupBy("tbl", "rec").agg(F.collect_set("no").alias("out"))
    joined = pages.join(out, ["tbl", "rec"], "left").select("tbl", "rec", "content", "markup", "out")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            bodies = []
            for content, markup, cut in zip(rows["content"], rows["markup"], rows["out"]):
                gone = set(cut or ())
                bodies.append("\n".join(text for no, text, _ in page_lines(content, markup) if no not in gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bodies, pa.string())], names=["tbl", "rec_id", "body"])

    return joined.mapInArrow(run, "tbl string, rec_id bigint, body string")


ORACLES: dict[str, str] = {}
