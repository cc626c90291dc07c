"""Deduplicating new batches against all history (problem 6).

Method: each batch leaves an immutable segment. A segment holds, per shard, the page keys that the batch brought as
one concatenated text, the suffix array of that text and the first seq of each key. A new batch is reduced to its
distinct keys; each shard binary-searches them in the suffix arrays of the segments. A match from delimiter to
delimiter is the same page. A key is a near-duplicate of the record of the history that covers it best, by `NEAR` or more,
with the substrings of `LEAST_MATCH` bytes or more that they share. Segments are merged with their elder neighbour once that
is no more than twice as large, so there are logarithmically many.

Shards are ranges of keys, so a host, however hot, is many shards, and a key is the same as one in its own shard only. What
covers a new key may differ from it at any place, so every new key is held against every shard (see `covering`, which skips
the shards and records that cannot reach `NEAR`); where only known pages are asked for, this is left out. Bounds are drawn anew once
the index has grown fourfold.

The index is a folder on any file system that Spark writes: bucketed Parquet tables, one a segment, and a manifest that
names them with their sizes. A later session opens it again; a segment that is missing or short is an error. A batch
reads the segments as stored; the history is never canonicalised, sorted or shuffled anew for it.

A page is the canonical address (see `page_key`). Rows with equal ids and different canonical addresses are one page
too: their keys are linked within a batch and entered with the same first seq, in a later batch with the least that
any of its keys has.

Defined cases: a null url counts as its id; with both null a row is a page of its own kind `\\x00` and repeats of it
are duplicates; repeats inside the first batch are no case, nor is a row whose seq is not larger than that of the
page's first row; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.llm.suffix import longest_matches, suffix_array, words_of_eight
from marlspike.session import scratch, ship, staged, table

#: Parameters that say how a reader came, not which page it is; names ending in `_` are prefixes.
TRACKING = "utm_ pk_ mc_ _ga mtm_ hsa_ ref from spm fbclid gclid yclid dclid msclkid igshid jsessionid phpsessid sessionid amp"
#: Host labels of the same site in another dress.
HOST_LABELS = "www m mobile amp"
KEYS_PER_SHARD = 20_000
#: Sampled keys for each shard from which its bounds are drawn.
SAMPLED_KEYS = 50
#: A match counts from so many bytes on; a key that one record covers by so much is a near-duplicate.
LEAST_MATCH, NEAR = 12, 0.8


def _tracking() -> str:
    names = [n + ".*" if n.endswith("_") else n for n in TRACKING.split()]
    return "^(?i:" + "|".join(names) + ")(=|$)"


def page_key(url: Column) -> Column:
    """The address without scheme, default port, anchor, host label, empty and dotted path steps, final
    slash, a last step that names the folder's own page (index.html) or its light version (amp), and tracking parameters; host in lower case, escapes decoded, parameters in sorted order."""
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*:/*|^//", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r"(:443|:80|\.)$", "")
    host = F.regexp_replace(host, r"^((" + HOST_LABELS.replace(" ", "|") + r")\.)+(?=[^.]+\.)", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(path, r"(?i);jsessionid=[^/]*", "")
    path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    steps = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda seen, step: F.when(step == "..", F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0)))).when(step.isin("", "."), seen).otherwise(F.concat(seen, F.array(step))),
    )
    # the step that only names a folder's own page or its light version, when it comes last
    path = F.regexp_replace(F.array_join(steps, "/"), r"(?i)(?:(?:^|/)(?:index|default)\.(?:x?html?|php|aspx?|jsp)|/amp)+$", "")
    query = F.when(plain.contains("?"), F.regexp_extract(plain, r"\?(.*)$", 1)).otherwise("")
    parameters = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(_tracking()))
    parameters = F.array_sort(F.transform(parameters, lambda p: F.coalesce(F.try_url_decode(p), p)))
    # line feeds delimit keys in a segment's text
    return F.replace(F.concat_ws("\t", host, path, F.array_join(parameters, "&")), F.lit("\n"), F.lit(" "))


def keyed(items: DataFrame) -> DataFrame:
    """batch, seq, key, id_key of each row of an item log (batch_no, seq, id, url)."""
    id_key = page_key(F.col("id"))
    key = F.coalesce(page_key(F.coalesce("url", "id")), F.lit("\x00"))
    return items.select(F.col("batch_no").alias("batch"), "seq", key.alias("key"), F.coalesce(id_key, key).alias("id_key"))


def _least_alias(pairs: DataFrame) -> DataFrame:
    """key, least: the least key that each key is linked with, through any number of links."""
    both = staged(pairs.select(F.col("key").alias("a"), F.col("id_key").alias("b")).unionByName(pairs.select(F.col("id_key").alias("a"), F.col("key").alias("b"))).distinct(), "alias-links")
    labels = staged(both.select(F.col("a").alias("key")).distinct().withColumn("least", F.col("key")), "alias")
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "least"), "b").groupBy(F.col("a").alias("key")).agg(F.min("least").alias("near"))
        moved = staged(labels.join(near, "key", "left").select("key", F.least("least", "near").alias("least"), (F.col("near") < F.col("least")).alias("moved")), "alias")
        labels = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return labels


SEGMENT = "shard int, text binary, suffixes binary, starts binary, firsts binary"
CHECKED = "key string, known bigint"
COVERED = "key string, near bigint, coverage double"
MANIFEST = "name string, size bigint, shards int, kind string, bound string, place int"


class Segment:
    """A shard's keys as one text, its suffix array, and of each key the delimiter's place and the first seq."""

    def __init__(self, text: bytes, suffixes: np.ndarray, starts: np.ndarray, firsts: np.ndarray):
        self.text, self.suffixes, self.starts, self.firsts = text, suffixes, starts, firsts
        self.symbols = np.frombuffer(text, np.uint8)

    @classmethod
    def of(cls, keys: list[bytes], firsts: list[int]) -> Segment:
        order = sorted(range(len(keys)), key=keys.__getitem__)
        text = b"\n" + b"".join(keys[i] + b"\n" for i in order)
        lengths = np.array([len(keys[i]) + 1 for i in order], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        return cls(text, suffix_array(np.frombuffer(text, np.uint8)).astype(np.int32), starts, np.array([firsts[i] for i in order], np.int64))

    @classmethod
    def stored(cls, rows: pd.DataFrame) -> list[Segment]:
        return [cls(bytes(t), np.frombuffer(a, np.int32), np.frombuffer(b, np.int64), np.frombuffer(c, np.int64)) for t, a, b, c in zip(rows["text"], rows["suffixes"], rows["starts"], rows["firsts"])]

    def row(self, shard: int) -> pd.DataFrame:
        return pd.DataFrame({"shard": [shard], "text": [self.text], "suffixes": [self.suffixes.tobytes()], "starts": [self.starts.tobytes()], "firsts": [self.firsts.tobytes()]})

    def record(self, at: np.ndarray) -> np.ndarray:
        """The key in whose text a place lies (its delimiter in front belongs to it)."""
        return np.searchsorted(self.starts, at, "right") - 1

    def exact(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """First seq of each pattern text[start:end] (with both delimiters), or -1."""
        at, shared = longest_matches(self.symbols, self.suffixes, text, starts, ends)
        whole = shared[0] >= ends - starts
        return np.where(whole, self.firsts[self.record(at[0])], -1)

    def covered(self, text: np.ndarray, owner: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, record, bytes): what the matches of `LEAST_MATCH` or more of each owner's positions cover, by record."""
        at, shared = longest_matches(self.symbols, self.suffixes, text, begins, ends)
        who, begin, record, size = np.tile(owner, 2), np.tile(begins, 2), self.record(at.ravel()), shared.ravel()
        long = size >= LEAST_MATCH
        who, begin, record, size = who[long], begin[long], record[long], size[long]
        order = np.lexsort((begin, record, who))
        who, begin, record, stop = who[order], begin[order], record[order], (begin + size)[order]
        if not len(who):
            return who, record, size
        fresh = np.append(True, (who[1:] != who[:-1]) | (record[1:] != record[:-1]))
        group = np.cumsum(fresh) - 1
        # intervals of a group in order of their begin: each adds what lies beyond the furthest end before it
        lift = group * np.int64(len(text) + 1)
        furthest = np.maximum.accumulate(np.append(0, (stop + lift)[:-1]))
        added = np.maximum(0, stop + lift - np.maximum(begin + lift, furthest))
        return who[fresh], record[fresh], np.bincount(group, added).astype(np.int64)


def _grams(text: np.ndarray) -> np.ndarray:
    """A hash of the `LEAST_MATCH` bytes (8 to 16) from each place on."""
    words, n = words_of_eight(text), max(len(text) - LEAST_MATCH + 1, 0)
    first = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    first = (first ^ (first >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return first ^ (first >> np.uint64(29)) ^ words[LEAST_MATCH - 8 : LEAST_MATCH - 8 + n]


def _pattern(keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, starts and sizes of the keys with a delimiter on both sides."""
    raw = [k.encode() for k in keys]
    sizes = np.array([len(k) + 2 for k in raw], np.int64)
    return np.frombuffer(b"".join(b"\n" + k + b"\n" for k in raw), np.uint8), np.cumsum(sizes) - sizes, sizes


def sought(keys: list[str], segments: list[Segment]) -> pd.DataFrame:
    """key, known (least first seq of the same key)."""
    if not keys:
        return pd.DataFrame({"key": [], "known": []}).astype({"key": str, "known": "Int64"})
    text, starts, sizes = _pattern(keys)
    known = np.full(len(keys), np.iinfo(np.int64).max)
    for s in segments:
        found = s.exact(text, starts, starts + sizes)
        known = np.where(found >= 0, np.minimum(known, found), known)
    return pd.DataFrame({"key": keys, "known": pd.array(known, "Int64").copy()}).assign(known=lambda d: d["known"].mask(known == np.iinfo(np.int64).max))


class Records:
    """The records of a shard's text by the `LEAST_MATCH` bytes from each of their places on."""

    def __init__(self, text: bytes, starts: np.ndarray, firsts: np.ndarray):
        self.grams = _grams(np.frombuffer(text, np.uint8))
        self.order = np.argsort(self.grams, kind="stable")
        self.sorted = self.grams[self.order]
        self.starts, self.firsts, self.ends = starts, firsts, np.append(starts[1:], len(text))

    def shared(self, own: np.ndarray, records: np.ndarray) -> np.ndarray:
        """How many bytes of a key, whose grams are `own`, each of the records covers."""
        begin, end = np.minimum(self.starts[records], len(self.grams)), np.minimum(self.ends[records], len(self.grams))
        size = end - begin
        row = np.repeat(np.arange(len(records)), size)
        theirs = self.grams[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)]
        kinds, place = np.unique(own, return_inverse=True)
        at = np.minimum(np.searchsorted(kinds, theirs), len(kinds) - 1)
        same = kinds[at] == theirs
        has = np.zeros((len(records), len(kinds)), bool)
        has[row[same], at[same]] = True
        # a byte is covered if one of the grams that end with it or later, and begin with it or before, is shared
        hits = np.zeros((len(records), len(own) + 2 * LEAST_MATCH - 1), np.int32)
        hits[:, LEAST_MATCH : LEAST_MATCH + len(own)] = has[:, place]
        until = hits.cumsum(axis=1)
        return (until[:, LEAST_MATCH:] > until[:, :-LEAST_MATCH]).sum(axis=1)


def covering(keys: list[str], records: Records) -> tuple[np.ndarray, np.ndarray]:
    """(near, coverage) of each key: first seq of the record that covers most of it, if that is `NEAR` or more, else -1 and 0.

    Exact: a key of which all records together cover less than `NEAR` is left; of the others a stretch of bytes is chosen that
    is so long that a record must cover one of them, where the fewest places match, and all records of these places are compared."""
    near, share = np.full(len(keys), -1, np.int64), np.zeros(len(keys))
    text, starts, sizes = _pattern(keys)
    own = _grams(text)
    if not len(own) or not len(records.sorted):
        return near, share
    kinds, place = np.unique(own, return_inverse=True)
    low, high = np.searchsorted(records.sorted, kinds, "left")[place], np.searchsorted(records.sorted, kinds, "right")[place]
    inside = (np.arange(len(text)) - np.repeat(starts, sizes) <= np.repeat(sizes, sizes) - LEAST_MATCH)[: len(own)]
    matches = np.where(inside, high - low, 0)
    hit = np.flatnonzero(matches)
    covered = np.cumsum(np.bincount(hit, minlength=len(text)) - np.bincount(hit + LEAST_MATCH, minlength=len(text) + 1)[: len(text)]) > 0
    least = np.ceil(NEAR * sizes - 1e-9).astype(np.int64)
    for i in np.flatnonzero(np.add.reduceat(covered.astype(np.int64), starts) >= least):
        at, size, room = starts[i], sizes[i], sizes[i] - LEAST_MATCH + 1
        stretch = size - least[i] + 1
        until = np.append(0, np.cumsum(matches[at : at + room]))
        begin = np.arange(size - stretch + 1)
        first, last = np.maximum(begin - LEAST_MATCH + 1, 0), np.minimum(begin + stretch, room)
        best = int(np.argmin(until[last] - until[first]))
        places = [records.order[low[p] : high[p]] for p in range(at + first[best], at + last[best]) if matches[p]]
        if not places:
            continue
        found = np.unique(np.searchsorted(records.starts, np.concatenate(places), "right") - 1)
        size_of = records.shared(own[at : at + room], found)
        top = int(size_of.max())
        if top >= least[i]:
            near[i], share[i] = records.firsts[found[size_of == top]].min(), top / size
    return near, share


def _merged(segments: list[Segment]) -> Segment:
    """The keys of all segments, each with its least first seq."""
    firsts: dict[bytes, int] = {}
    for s in segments:
        for key, first in zip(s.text[1:-1].split(b"\n"), s.firsts.tolist()):
            firsts[key] = min(first, firsts.get(key, first))
    return Segment.of(list(firsts), list(firsts.values()))


class BatchIndex:
    """The accepted history: segments that are never changed once written, and their manifest."""

    def __init__(self, spark: SparkSession, folder: str, keys_per_shard: int = KEYS_PER_SHARD, near: bool = True):
        """Opens the index in `folder`, or starts one there if it holds none. `near`: whether near-duplicates are sought."""
        self.near = near
        self.spark, self.folder, self.keys_per_shard = spark, folder.rstrip("/"), keys_per_shard
        ship(spark)
        self.segments: list[tuple[str, int, DataFrame]] = []
        self.bounds: list[str] = []
        self.drawn_at = 0
        self.version = self._latest()
        if self.version:
            self._open()

    # what lies in the folder

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _latest(self) -> int:
        files, path = self._files()
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return max([int(n.split("-")[1]) for n in names if n.startswith("manifest-")], default=0)

    def _open(self) -> None:
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest-{self.version}").collect()  # a row a segment and a bound
        self.bounds = [r["bound"] for r in sorted((r for r in rows if r["kind"] == "bound"), key=lambda r: r["place"])]
        self.drawn_at = next(r["size"] for r in rows if r["kind"] == "drawn")
        for r in sorted((r for r in rows if r["kind"] == "segment"), key=lambda r: r["place"]):
            files, _ = self._files()
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{r['name']}")
            if not files.exists(at):
                raise FileNotFoundError(f"segment {r['name']} of the index in {self.folder} is missing")
            stored = self._table(r["name"])
            if (n := stored.count()) != r["shards"]:
                raise OSError(f"segment {r['name']} of the index in {self.folder} has {n} shards where {r['shards']} were written")
            self.segments.append((r["name"], r["size"], stored))

    def _save(self) -> None:
        rows = [(name, size, stored.count(), "segment", None, i) for i, (name, size, stored) in enumerate(self.segments)]
        rows += [(None, None, None, "bound", b, i) for i, b in enumerate(self.bounds)] + [(None, self.drawn_at, None, "drawn", None, 0)]
        self.version += 1
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.folder}/manifest-{self.version}")

    def _buckets(self) -> int:
        return min(len(self.bounds) + 1, 4096)

    def _table(self, name: str) -> DataFrame:
        known = "s" + uuid.uuid4().hex
        self.spark.sql(f"CREATE TABLE {known} ({SEGMENT}) USING parquet CLUSTERED BY (shard) INTO {self._buckets()} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(known)

    def _store(self, rows: DataFrame) -> tuple[str, DataFrame]:
        name, known = f"segment-{uuid.uuid4().hex}", "s" + uuid.uuid4().hex
        rows.write.format("parquet").bucketBy(self._buckets(), "shard").option("path", f"{self.folder}/{name}").saveAsTable(known)
        return name, self.spark.table(known)

    # shards

    def _draw(self, keys: DataFrame, size: int) -> None:
        """Bounds of the key ranges, from a bounded sample of keys: those of least hash."""
        shards = max(1, -(-size // self.keys_per_shard), min(24, size // 1000))
        share = min(1.0, SAMPLED_KEYS * shards / max(size, 1))
        sample = sorted(r["key"].encode() for r in keys.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("key").collect())
        self.bounds = [b.decode() for b in sorted({sample[len(sample) * i // shards] for i in range(1, shards)})] if sample else []
        self.drawn_at = size

    def _shards(self, keys: DataFrame) -> DataFrame:
        """`keys` with their shard."""
        bounds = [b.encode() for b in self.bounds]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from bisect import bisect_right

            for batch in batches:
                yield batch.assign(shard=np.array([bisect_right(bounds, key.encode()) for key in batch["key"]], np.int32))

        return keys.mapInPandas(run, f"{', '.join(f'{n} {t}' for n, t in keys.dtypes)}, shard int")

    # batches

    def search(self, keys: DataFrame) -> DataFrame:
        """key, known, near, coverage of distinct `keys` (key): the history's first seq of each, and what covers the new ones."""
        if not self.segments:
            return keys.select("key", F.lit(None).cast("bigint").alias("known"), F.lit(None).cast("bigint").alias("near"), F.lit(0.0).alias("coverage"))
        found = None
        # one segment after the other, as bucketed tables are joined where they lie
        placed = self._shards(keys)
        if len(self.segments) > 1:
            placed = staged(placed, "placed")
        for _, _, stored in self.segments:

            def run(key: tuple, batch: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
                return sought(batch["key"].tolist(), Segment.stored(rows))

            part = placed.groupBy("shard").cogroup(stored.groupBy("shard")).applyInPandas(run, CHECKED)
            found = part if found is None else found.unionByName(part)
        known = found.groupBy("key").agg(F.min("known").alias("known"))
        if not self.near:
            return known.select("key", "known", F.lit(None).cast("bigint").alias("near"), F.lit(0.0).alias("coverage"))
        known = staged(known, "known")
        covered = self._covered(known.filter("known IS NULL").select("key"))
        return known.join(covered, "key", "left").select("key", "known", "near", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))

    def _covered(self, keys: DataFrame) -> DataFrame:
        """key, near, coverage of the `keys` that a record of any shard covers by `NEAR` or more."""

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield pd.DataFrame({"keys": ["\n".join(batch["key"])]})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, records = None, None
            for batch in batches:
                for text, starts, firsts, packed in batch.itertuples(index=False):
                    if text != last:
                        last, records = text, Records(bytes(text), np.frombuffer(starts, np.int64), np.frombuffer(firsts, np.int64))
                    names = packed.split("\n")
                    near, share = covering(names, records)
                    yield pd.DataFrame({"key": names, "near": near, "coverage": share})[near >= 0]

        # every packet of new keys meets every shard; neither is shuffled
        packets = staged(keys.mapInPandas(pack, "keys string"), "near-keys")
        found = None
        for _, _, stored in self.segments:
            part = stored.select("text", "starts", "firsts").crossJoin(packets).mapInPandas(run, COVERED)
            found = part if found is None else found.unionByName(part)
        best = F.max(F.struct("coverage", (-F.col("near")).alias("order")))
        return found.groupBy("key").agg(best.alias("best")).select("key", (-F.col("best.order")).alias("near"), F.col("best.coverage").alias("coverage"))

    def _segment(self, entries: DataFrame, size: int) -> None:
        """Append a segment of entries (key, first), then merge while the elder neighbour is small."""
        if not size:
            return
        shards = self._shards(entries.select("key", "first")).repartition(self._buckets(), "shard")
        rows = shards.groupBy("shard").applyInPandas(lambda key, rows: Segment.of([k.encode() for k in rows["key"]], rows["first"].tolist()).row(int(key[0])), SEGMENT)
        name, stored = self._store(rows)
        self.segments.append((name, size, stored))
        merging = 1
        while len(self.segments) > merging and self.segments[-merging - 1][1] <= 2 * sum(n for _, n, _ in self.segments[-merging:]):
            merging += 1
        if merging > 1:
            # all that are to be merged in one pass
            rows = self.segments[-merging][2]
            for _, _, other in self.segments[-merging + 1 :]:
                rows = rows.unionByName(other)
            name, stored = self._store(rows.groupBy("shard").applyInPandas(lambda key, rows: _merged(Segment.stored(rows)).row(int(key[0])), SEGMENT))
            self.segments[-merging:] = [(name, sum(n for _, n, _ in self.segments[-merging:]), stored)]

    def _entries(self) -> DataFrame:
        """key, first of the whole index, for drawing its bounds anew."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for s in Segment.stored(batch):
                    yield pd.DataFrame({"key": [k.decode() for k in s.text[1:-1].split(b"\n")], "first": s.firsts})

        rows = self.segments[0][2]
        for _, _, other in self.segments[1:]:
            rows = rows.unionByName(other)
        return rows.mapInPandas(run, "key string, first bigint").groupBy("key").agg(F.min("first").alias("first"))

    def accept(self, batch: DataFrame, linked: bool = True) -> DataFrame:
        """Checks a batch (seq, key, id_key) and adds its new keys; gives key, first_seq (the page's), near, coverage of each key.
        `linked`: whether a row may have an id_key that differs from its key."""
        firsts = batch.groupBy("key").agg(F.min("seq").alias("seq"))
        links = staged(batch.filter("id_key <> key").select("key", "id_key").distinct(), "links") if linked else None
        if links is not None and not links.isEmpty():
            firsts = firsts.unionByName(batch.filter("id_key <> key").select(F.col("id_key").alias("key"), "seq")).groupBy("key").agg(F.min("seq").alias("seq"))
            alias = _least_alias(links)
            firsts = firsts.join(alias, "key", "left").select("key", "seq", F.coalesce("least", "key").alias("page"))
            checked = firsts.join(self.search(firsts.select("key")), "key")
            pages = checked.groupBy("page").agg(F.min(F.least("seq", "known")).alias("first_seq"))
            checked = checked.join(pages, "page")
        else:
            checked = self.search(firsts.select("key")).join(firsts, "key").withColumn("first_seq", F.coalesce("known", "seq"))
        checked = staged(checked.select("key", "known", "first_seq", "near", "coverage"), "checked")
        fresh = checked.filter("known IS NULL OR first_seq < known").select("key", F.col("first_seq").alias("first"))
        size = fresh.count()
        total = size + sum(n for _, n, _ in self.segments)
        if total > 4 * self.drawn_at:
            entries = fresh
            if self.segments:
                entries = staged(self._entries().unionByName(fresh).groupBy("key").agg(F.min("first").alias("first")), "entries")
                self.segments = []
            self._draw(entries, total)
            self._segment(entries, total)
        else:
            self._segment(fresh, size)
        self._save()
        return checked.select("key", "first_seq", F.when(F.col("known").isNull() & (F.col("coverage") >= NEAR), F.col("near")).alias("near"), "coverage")


def against_history(items: DataFrame, keys_per_shard: int = KEYS_PER_SHARD, folder: str | None = None, near: bool = True) -> DataFrame:
    """first_seq, dup_seq, near_seq, coverage, batch of each row after the first batch whose page occurs in a row before it
    (first_seq), or, where its page is new, of which a page of the history is a near-duplicate (near_seq, if `near`)."""
    spark = items.sparkSession
    rows = staged(keyed(items), "batches", "batch")
    odd = {r["batch"]: r["odd"] for r in rows.groupBy("batch").agg(F.max((F.col("id_key") != F.col("key")).cast("int")).alias("odd")).collect()}  # one row a batch
    index = BatchIndex(spark, folder or scratch(spark, "history"), keys_per_shard, near)
    found = None
    for number, batch in enumerate(sorted(odd)):
        current = rows.filter(F.col("batch") == batch).select("key", "seq", "id_key")
        firsts = index.accept(current, bool(odd[batch]))
        if number == 0:
            continue
        # a hot page is one row of `firsts`, so its rows are split by AQE's skew join where they are many
        hits = current.join(firsts, "key").filter("first_seq < seq OR near IS NOT NULL").select(F.when(F.col("first_seq") < F.col("seq"), F.col("first_seq")).alias("first_seq"), F.col("seq").alias("dup_seq"), F.when(F.col("first_seq") >= F.col("seq"), F.col("near")).alias("near_seq"), "coverage", F.lit(batch).alias("batch"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "first_seq bigint, dup_seq bigint, near_seq bigint, coverage double, batch int")
    return found


_PAGES_SQL = r"""
WITH plain AS (SELECT batch_no, seq, regexp_replace(trim(coalesce(url, id)), '#.*$', '') AS p FROM intel_item),
rest AS (SELECT *, regexp_replace(p, '^[A-Za-z][A-Za-z0-9+.-]*:/*|^//', '') AS r FROM plain),
parts AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(r, '^([^/?]*)', 1)), '^[^@]*@', ''), '(:443|:80|\.)$', ''), '^(?:(?:www|m|mobile|amp)\.)+([^.]+\.)', '\1') AS host,
  '/' || url_decode(regexp_replace(regexp_extract(r, '^[^/?]*([^?]*)', 1), '(?i);jsessionid=[^/]*', '', 'g')) || '/' AS path, CASE WHEN contains(p, '?') THEN regexp_extract(p, '\?(.*)$', 1) ELSE '' END AS query FROM rest),
flat AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/(\./)+', '/', 'g'), '/[^/]+/\.\./', '/'), '/[^/]+/\.\./', '/'), '/[^/]+/\.\./', '/') AS steps FROM parts),
keyed AS (SELECT batch_no, seq, coalesce(concat_ws(chr(9), host, regexp_replace(trim(steps, '/'), '(?i)(?:(?:^|/)(?:index|default)\.(?:x?html?|php|aspx?|jsp)|/amp)+$', ''),
  array_to_string(list_sort(list_transform(list_filter(string_split(query, '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(?i:utm_.*|pk_.*|mc_.*|_ga|mtm_.*|hsa_.*|ref|from|spm|fbclid|gclid|yclid|dclid|msclkid|igshid|jsessionid|phpsessid|sessionid|amp)(=|$)')), lambda q: url_decode(replace(q, '+', ' ')))), '&')), chr(0)) AS key FROM flat),
found AS (SELECT batch_no, seq, min(seq) OVER (PARTITION BY key) AS first_seq FROM keyed)
"""
ORACLES = {
    "p6_found": _PAGES_SQL + "SELECT first_seq, seq AS dup_seq FROM found WHERE batch_no > 0 AND first_seq < seq",
    "p6_accepted": _PAGES_SQL + "SELECT batch_no, count(*) AS offered, count(*) FILTER (WHERE first_seq >= seq) AS accepted FROM found WHERE batch_no > 0 GROUP BY 1",
}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_history(table(spark, sf_dir, "intel_item"), near=False).filter("first_seq IS NOT NULL").select("first_seq", "dup_seq")


def p6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, near_seq, coverage: rows whose page is new but whose address one accepted before covers by `NEAR`."""
    return against_history(table(spark, sf_dir, "intel_item")).filter("near_seq IS NOT NULL").select(F.col("dup_seq").alias("seq"), "near_seq", "coverage")


def p6_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch_no, offered, accepted: what each later batch brought and what of it was new."""
    items = table(spark, sf_dir, "intel_item")
    dups = against_history(items, near=False).filter("first_seq IS NOT NULL").groupBy(F.col("batch").alias("batch_no")).agg(F.count(F.lit(1)).alias("dups"))
    offered = items.filter("batch_no > 0").groupBy("batch_no").agg(F.count(F.lit(1)).alias("offered"))
    return offered.join(dups, "batch_no", "left").select("batch_no", "offered", (F.col("offered") - F.coalesce("dups", F.lit(0))).alias("accepted"))
