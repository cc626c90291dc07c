"""Filling fixed-capacity containers with documents (problem 9).

Method: lexical retrieval packing. Documents are sharded by their content: by the term that weighs most in them (of those
that another document has as well), so the neighbours of a document, its copies above all, lie in its shard. A shard holds at
most about `TOKENS_PER_SHARD`: rarer terms share one, a hot term is split by the terms that weigh next, and what is then
still too large (many copies) by id. Each shard holds a BM25 inverted index over token ids (document frequencies are those
of the whole corpus). The largest document left seeds a container; its nearest neighbours that are unused and still fit
fill it in order of their score, and what shares no term with the seed follows by size. A container closes only when
nothing left in the shard fits; those that a shard cannot fill are packed again, together with those of other shards.

Defined cases: null and empty texts are left out; a document larger than the capacity is cut into full
containers of its own, and only its last piece is packed with others; ties go to the larger, then to the
smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.llm.tokens import TOKENIZERS, encoded
from marlspike.session import staged, table

TOKENS_PER_SHARD = 700_000
K1, B = 1.2, 0.75
#: A container filled to less than this share is packed again with those of other shards.
LOOSE = 0.9
CONTAINERS = "spec_id int, container_id bigint, doc_id bigint, piece int, tokens int"


class Index:
    """BM25 postings of one shard."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float):
        lengths = np.array([len(x) for x in ids], float)
        terms, counts, documents = [], [], []
        for d, tokens in enumerate(ids):
            term, n = np.unique(tokens, return_counts=True)
            terms.append(term)
            counts.append(n)
            documents.append(np.full(len(term), d))
        self.own = terms
        term, n, document = np.concatenate(terms), np.concatenate(counts).astype(float), np.concatenate(documents)
        norm = K1 * (1 - B + B * lengths[document] / mean_length)
        weight = (idf[term] * n * (K1 + 1) / (n + norm)).astype(np.float32)
        order = np.argsort(term, kind="stable")
        self.documents, self.weights = document[order], weight[order]
        self.vocabulary, self.starts = np.unique(term[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.size = len(ids)
        self.known: dict[int, np.ndarray] = {}

    def scores(self, document: int) -> np.ndarray:
        """Nearness of every document of the shard, remembered as most seeds serve several capacities."""
        if document not in self.known:
            self.known[document] = self._scores(document).astype(np.float32)
        return self.known[document]

    def _scores(self, document: int) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, self.own[document])
        starts, lengths = self.starts[at], self.ends[at] - self.starts[at]
        # all postings of the query's terms in one gather
        total = int(lengths.sum())
        offsets = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
        return np.bincount(self.documents[offsets], weights=self.weights[offsets], minlength=self.size)


def pack(sizes: np.ndarray, scores, capacity: int) -> list[list[int]]:
    """Items (all at most `capacity`) into containers; `scores(i)` gives every item's nearness to item i."""
    unused = np.ones(len(sizes), bool)
    by_size = np.lexsort((np.arange(len(sizes)), -sizes))
    containers = []
    for seed in by_size:
        if not unused[seed]:
            continue
        unused[seed] = False
        members, room = [int(seed)], capacity - int(sizes[seed])
        fits = by_size[unused[by_size] & (sizes[by_size] <= room)]
        if len(fits):
            # stable: equal scores keep the order by size
            fits = fits[np.argsort(-scores(int(seed))[fits], kind="stable")]
            while len(fits):
                taken = fits[0]
                members.append(int(taken))
                unused[taken] = False
                room -= int(sizes[taken])
                fits = fits[1:]
                fits = fits[sizes[fits] <= room]
        containers.append(members)
    return containers


def leading_terms(ids: np.ndarray, idf: np.ndarray, shared: np.ndarray, mean_length: float, n: int = 3) -> list[int]:
    """The `n` terms that weigh most in a document, of those that another document has (`shared`); -1 where there are fewer."""
    term, count = np.unique(ids, return_counts=True)
    weight = np.where(shared[term], idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * len(ids) / mean_length)), -1.0)
    best = term[np.lexsort((term, -weight))[:n]]
    return [int(t) if shared[t] else -1 for t in best] + [-1] * (n - len(best))


def wide_enough(df: np.ndarray, mean_length: float, per_shard: int) -> np.ndarray:
    """Which terms so many documents hold that these fill a shard: rarer ones would join documents that have one name in common."""
    return df >= max(2.0, min(per_shard / mean_length, df.max(initial=0) / 2))


def sharded(tokens: DataFrame, idf: np.ndarray, shared: np.ndarray, mean_length: float, per_shard: int) -> DataFrame:
    """`tokens` (doc_id, ids) with their shard."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            leads = [leading_terms(np.asarray(x, np.int64), idf, shared, mean_length) for x in batch["ids"]]
            yield pd.DataFrame({"term": [t[0] for t in leads], "next": [(t[1] * 50_021 + t[2]) % 1_000_003 for t in leads], "n": [len(x) for x in batch["ids"]]}).astype({"term": "int32", "next": "int32", "n": "int64"})

    sizes = staged(tokens.select("ids").mapInPandas(cells, "term int, next int, n bigint").groupBy("term", "next").agg(F.sum("n").alias("n")), "leading-terms")
    # at most as many rows as the vocabulary has tokens
    by_term = dict(sizes.groupBy("term").agg(F.sum("n").alias("n")).toPandas().sort_values("term").itertuples(index=False, name=None))
    ways = {t: 2 * -(-n // per_shard) for t, n in by_term.items() if n > per_shard}
    # in proportion to the shards: a row a part of a hot term
    hot = spark_map(ways)
    parts = sizes.select("term", F.pmod("next", hot[F.col("term")]).alias("part"), "n").filter("part IS NOT NULL").groupBy("term", "part").agg(F.sum("n").alias("n")).toPandas() if ways else pd.DataFrame({"term": [], "part": [], "n": []})
    cell_sizes = {(t, 0): n for t, n in by_term.items() if t not in ways} | {(int(t), int(p)): int(n) for t, p, n in parts.itertuples(index=False, name=None)}
    place: dict[tuple[int, int], tuple[int, int]] = {}
    shard, filled = 0, 0
    for cell, n in sorted(cell_sizes.items()):
        split = -(-n // per_shard)
        if filled and filled + n > per_shard:
            shard, filled = shard + 1, 0
        place[cell] = (shard, split)
        if split > 1:
            shard, filled = shard + split, 0
        else:
            filled += n

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, x in zip(batch["doc_id"], batch["ids"]):
                lead = leading_terms(np.asarray(x, np.int64), idf, shared, mean_length)
                first, split = place[lead[0], (lead[1] * 50_021 + lead[2]) % 1_000_003 % ways.get(lead[0], 1)]
                out.append(first + (int(doc_id) * 0x9E3779B1 >> 7) % split)
            yield batch.assign(shard=np.array(out, np.int32))

    return tokens.mapInPandas(assign, f"{', '.join(f'{n} {t}' for n, t in tokens.dtypes)}, shard int")


def spark_map(values: dict[int, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair]) if values else F.create_map().cast("map<int,int>")


def containers(documents: DataFrame, specs: list[tuple[int, int]], id_col: str, text_col: str, vocabulary: str, folder: str = TOKENIZERS, per_shard: int = TOKENS_PER_SHARD) -> DataFrame:
    """spec_id, container_id, doc_id, piece, tokens: one row a document and container. `specs`: (spec_id, capacity)."""
    tokens = staged(encoded(documents.filter(F.length(text_col) > 0), text_col, id_col, vocabulary=vocabulary, folder=folder).withColumnRenamed(id_col, "doc_id"), "tokens")
    sized = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("ids")).alias("mean")).first()
    total, mean = sized["n"], sized["mean"] or 1.0
    # at most as many rows as the vocabulary has tokens
    frequency = tokens.select(F.explode(F.array_distinct("ids")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).toPandas()
    size = int(frequency["term"].max()) + 1 if len(frequency) else 1
    df = np.zeros(size)
    df[frequency["term"].to_numpy(int)] = frequency["n"]
    idf = np.log(1 + (total - df + 0.5) / (df + 0.5)).astype(np.float32)

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        doc_ids = rows["doc_id"].to_numpy()
        ids = [np.asarray(x, np.int64) for x in rows["ids"]]
        lengths = np.array([len(x) for x in ids], np.int64)
        index = Index(ids, idf, mean)
        out = []
        for spec_id, capacity in specs:
            number = int(key[0]) << 32
            rest = (lengths - 1) % capacity + 1
            for d in np.flatnonzero(lengths > capacity):
                for piece in range(int((lengths[d] - 1) // capacity)):
                    out.append((spec_id, number, doc_ids[d], piece, capacity))
                    number += 1
            for members in pack(rest, index.scores, capacity):
                for d in members:
                    out.append((spec_id, number, doc_ids[d], int((lengths[d] - 1) // capacity), rest[d]))
                number += 1
        return pd.DataFrame(out, columns=["spec_id", "container_id", "doc_id", "piece", "tokens"])

    packed = sharded(tokens, idf, wide_enough(df, mean, per_shard), mean, per_shard).groupBy("shard").applyInPandas(fill, CONTAINERS)
    return _tails_together(staged(packed, "containers"), dict(specs), per_shard)


def _tails_together(packed: DataFrame, capacities: dict[int, int], per_shard: int) -> DataFrame:
    """The containers that a shard could not fill, a few each, are emptied and their documents packed together by size."""
    room = spark_map(capacities)[F.col("spec_id")]
    loose = packed.groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("filled")).filter(F.col("filled") < LOOSE * room)
    loose = staged(loose.select("spec_id", "container_id", "filled"), "loose")
    groups = {r["spec_id"]: -(-r["n"] // per_shard) for r in loose.groupBy("spec_id").agg(F.sum("filled").alias("n")).collect()}  # a row a capacity
    if not groups:
        return packed
    rows = packed.join(loose.drop("filled"), ["spec_id", "container_id"]).withColumn("group", F.pmod(F.xxhash64("container_id"), spark_map(groups)[F.col("spec_id")]).cast("int"))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable")
        capacity, rooms, out = capacities[key[0]], [], []
        for n in rows["tokens"]:
            # the fullest container that it fits into
            at = min((i for i, r in enumerate(rooms) if r >= n), key=rooms.__getitem__, default=len(rooms))
            if at == len(rooms):
                rooms.append(capacity)
            rooms[at] -= n
            out.append((1 << 61) + (int(key[1]) << 32) + at)
        return rows.assign(container_id=out)[["spec_id", "container_id", "doc_id", "piece", "tokens"]]

    return packed.join(loose, ["spec_id", "container_id"], "left_anti").unionByName(rows.groupBy("spec_id", "group").applyInPandas(fill, CONTAINERS))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in the containers of every capacity (the capacities are a table of settings, a few rows;
    rows without capacity or tokenizer are passed over)."""
    specs: dict[str, list[tuple[int, int]]] = {}
    for row in table(spark, sf_dir, "container_spec").collect():
        if row["tokenizer"] and row["capacity"] and row["capacity"] > 0:
            specs.setdefault(row["tokenizer"], []).append((row["spec_id"], row["capacity"]))
    documents = table(spark, sf_dir, "documents")
    parts = [containers(documents, s, "doc_id", "text", vocabulary) for vocabulary, s in sorted(specs.items())]
    out = parts[0] if parts else spark.createDataFrame([], CONTAINERS)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spec_id, capacity, containers, documents, tokens, unused (share of the room that stays empty)."""
    packed = p9_containers(spark, sf_dir).groupBy("spec_id").agg(F.countDistinct("container_id").alias("containers"), F.countDistinct("doc_id").alias("documents"), F.sum("tokens").alias("tokens"))
    specs = table(spark, sf_dir, "container_spec").select("spec_id", "capacity")
    return packed.join(specs, "spec_id").select("spec_id", "capacity", "containers", "documents", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused"))


ORACLES: dict[str, str] = {}
