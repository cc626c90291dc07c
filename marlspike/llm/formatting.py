"""Duplicates hidden by formatting differences (problem 1).

Method: canonical records are range-partitioned by (key, id) and sorted within partitions (Spark's sort
spills to disk), then one pass over each partition compares full keys of neighbours. Because the id is
part of the range key, a group that holds a third of all rows spreads over many partitions; the runs
that touch a partition's start are stitched by a table of at most two rows a partition.

Defined cases: null title or url equal only null; texts without any letter or digit equal the empty
text; an empty table gives no rows; repeated rows with equal ids are no copies of themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.session import staged, table

#: Marks that part a title into site, section and headline when white space stands around them; bars and dots do so anywhere.
TITLE_PARTS = r"[\s\p{Z}\p{Cf}]+(?:[-‐-―−|·•»›/]+|::+)[\s\p{Z}\p{Cf}]+|[|·•]"
NOT_KEPT = r"[^\p{L}\p{N}\p{M}]+"
PART = "\x1f"


def folded(text: Column) -> Column:
    """Case folded: also the letters whose capitals lower to other letters."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def bare(text: Column) -> Column:
    return F.regexp_replace(folded(text), NOT_KEPT, "")


def decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _sorted_parts(parts: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.transform(parts, bare), lambda p: p != "")), PART)


def canonical_title(title: Column) -> Column:
    return _sorted_parts(F.split(title, TITLE_PARTS))


def canonical_url(url: Column) -> Column:
    """Everything before `?` stripped to letters and digits, then the parameters in sorted order, then the anchor."""
    anchor = F.substring_index(url, "#", -1)
    whole = F.when(url.contains("#"), F.left(url, F.length(url) - F.length(anchor) - 1)).otherwise(url)
    path = F.substring_index(whole, "?", 1)
    query = F.when(F.length(whole) > F.length(path), F.right(whole, F.length(whole) - F.length(path) - 1)).otherwise("")
    parameters = F.transform(F.split(query, "&"), decoded)
    return F.concat_ws(PART + PART, bare(decoded(path)), _sorted_parts(parameters), F.when(url.contains("#"), bare(decoded(anchor))).otherwise(""))


def canonical_key(title: Column, url: Column) -> Column:
    """Null is marked by a sign that no canonical text has."""
    return F.concat_ws(PART * 3, F.coalesce(canonical_title(title), F.lit("\x00")), F.coalesce(canonical_url(url), F.lit("\x00")))


SCAN = "kind string, part int, key string, id bigint, first_id bigint, n bigint"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in one sorted partition. Kinds of rows that come out:
    pair: a further copy, whose first_id is known; head: a row of the first run, whose first_id may lie in
    an earlier partition; edge: first and last run with key, least id and length; run: any other run of two or more.
    """
    part = TaskContext.get().partitionId()
    key = None
    first_id = count = 0
    runs = 0

    def rows(kind: str, keys: list, ids, firsts, ns) -> pa.RecordBatch:
        size = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * size, pa.string()), pa.array([part] * size, pa.int32()), pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(firsts, pa.int64()), pa.array(ns, pa.int64())],
            names=["kind", "part", "key", "id", "first_id", "n"],
        )

    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys, ids = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        n = batch.num_rows
        new = np.ones(n, bool)
        new[0] = key is None or keys[0].as_py() != key
        if n > 1:
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        run_of = np.cumsum(new) + runs  # number of the run from 1
        start_ids = ids[starts]
        firsts = np.concatenate([[first_id], start_ids])[np.cumsum(new)]
        head = run_of == 1
        if head.any():
            yield rows("head", [None] * int(head.sum()), ids[head], firsts[head], [None] * int(head.sum()))
        copy = ~new & ~head
        if copy.any():
            yield rows("pair", [None] * int(copy.sum()), ids[copy], firsts[copy], [None] * int(copy.sum()))
        # runs that end inside this batch
        if len(starts):
            ends = np.concatenate([starts, [n]])
            if key is not None:
                count += int(starts[0])
                if runs == 1:
                    yield rows("edge", [key], [first_id], [first_id], [count])
                elif count > 1:
                    yield rows("run", [None], [first_id], [first_id], [count])
            lengths = np.diff(ends)
            closed_ids, closed_n = start_ids[:-1], lengths[:-1]
            if runs == 0 and len(closed_ids):
                yield rows("edge", [keys[int(starts[0])].as_py()], closed_ids[:1], closed_ids[:1], closed_n[:1])
                closed_ids, closed_n = closed_ids[1:], closed_n[1:]
            many = closed_n > 1
            if many.any():
                yield rows("run", [None] * int(many.sum()), closed_ids[many], closed_ids[many], closed_n[many])
            key, first_id, count = keys[int(starts[-1])].as_py(), int(start_ids[-1]), int(lengths[-1])
            runs += len(starts)
        else:
            count += n
    if key is not None:
        yield rows("edge", [key], [first_id], [first_id], [count])


def collapse(rows: DataFrame, id_col: str, key: Column) -> tuple[DataFrame, DataFrame]:
    """(copies, groups): copies has keep_id, copy_id of each further copy; groups has keep_id and the
    exact number of copies of each group of two or more."""
    # stored, as finding the ranges reads the keys once and partitioning reads them again
    keyed = staged(rows.select(key.alias("key"), F.col(id_col).cast("bigint").alias("id")), "canonical")
    ordered = keyed.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    scanned = staged(ordered.mapInArrow(_scan, SCAN), "runs", "kind")
    # at most two rows a partition, so the size of what is broadcast is bounded by the number of partitions
    edges = scanned.filter("kind = 'edge'")
    stitched = edges.groupBy("key").agg(F.min("id").alias("keep_id"), F.sum("n").alias("n"))
    first_of = edges.groupBy("part").agg(F.min_by("key", F.struct("key", "id")).alias("key")).join(stitched.select("key", "keep_id"), "key").select("part", "keep_id")
    heads = scanned.filter("kind = 'head'").join(F.broadcast(first_of), "part").select("keep_id", F.col("id").alias("copy_id")).filter("keep_id <> copy_id")
    pairs = scanned.filter("kind = 'pair' AND first_id <> id").select(F.col("first_id").alias("keep_id"), F.col("id").alias("copy_id"))
    groups = scanned.filter("kind = 'run'").select(F.col("id").alias("keep_id"), F.col("n").alias("copies")).unionByName(stitched.filter("n > 1").select("keep_id", F.col("n").alias("copies")))
    return pairs.unionByName(heads), groups


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return collapse(table(spark, sf_dir, "search_result"), "result_id", canonical_key(F.col("title"), F.col("url")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir)[0]


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir)[1]


_KEYED_SQL = r"""
WITH base AS (
  SELECT result_id, title, url,
         CASE WHEN contains(url, '#') THEN regexp_replace(url, '#[^#]*$', '') ELSE url END AS whole,
         CASE WHEN contains(url, '#') THEN regexp_extract(url, '#([^#]*)$', 1) ELSE '' END AS anchor
  FROM search_result),
cut AS (
  SELECT result_id, title, url, split_part(whole, '?', 1) AS path,
         CASE WHEN contains(whole, '?') THEN substr(whole, length(split_part(whole, '?', 1)) + 2) ELSE '' END AS query, anchor FROM base),
keyed AS (
  SELECT result_id,
    coalesce(array_to_string(list_sort(list_filter(list_transform(string_split_regex(title, '[\s\p{Z}\p{Cf}]+(?:[-‐-―−|·•»›/]+|::+)[\s\p{Z}\p{Cf}]+|[|·•]'),
      lambda p: regexp_replace(replace(replace(lower(p), 'ß', 'ss'), 'ς', 'σ'), '[^\p{L}\p{N}\p{M}]+', '', 'g')), lambda p: p <> '')), chr(31)), chr(0)) AS title_key,
    coalesce(concat_ws(chr(30), regexp_replace(lower(url_decode(replace(path, '+', ' '))), '[^\p{L}\p{N}\p{M}]+', '', 'g'),
      array_to_string(list_sort(list_filter(list_transform(string_split(query, '&'),
        lambda p: regexp_replace(lower(url_decode(replace(p, '+', ' '))), '[^\p{L}\p{N}\p{M}]+', '', 'g')), lambda p: p <> '')), chr(31)),
      regexp_replace(lower(url_decode(anchor)), '[^\p{L}\p{N}\p{M}]+', '', 'g')), chr(0)) AS url_key
  FROM cut)
"""
ORACLES = {
    "p1_found": _KEYED_SQL
    + """, grouped AS (SELECT result_id, min(result_id) OVER (PARTITION BY title_key, url_key) AS keep_id FROM keyed)
SELECT keep_id, result_id AS copy_id FROM grouped WHERE keep_id <> result_id""",
    "p1_groups": _KEYED_SQL + "SELECT min(result_id) AS keep_id, count(*) AS copies FROM keyed GROUP BY title_key, url_key HAVING count(*) > 1",
}
