"""Lines repeated across one site's documents (problem 5).

Method: the lines of each domain form a graph, nodes weighted by the records that hold the line and
edges by the records in which one line follows another. Nodes of high support stay, and edges of high
support between them; connected components are the boilerplate blocks, and every occurrence of a
block's lines is deleted. A line alone in its component is a block of one.

Defined cases: null and empty contents count as records of their domain but hold no line; a null domain
is a domain of its own; lines without a letter are no nodes; a record counts once per line however
often it repeats; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.operators.skew import join_dictionary
from marlspike.session import free_name, staged, table

MIN_RECORDS = 4
MIN_SHARE = 0.2


def line_key(line: Column) -> Column:
    """Lines agree after white space and digits are removed and case is ignored; without a letter: null."""
    key = F.lower(F.regexp_replace(line, r"[\s\p{Z}\p{Nd}]+", ""))
    return F.when(line.rlike(r"\p{L}"), key)


def keyed(records: DataFrame, id_col: str, domain_col: str, content_col: str) -> DataFrame:
    """rec, domain, keys (a hash for each line, null for a line without a letter): each line is put through its pattern once,
    and what follows reads numbers only."""
    keys = F.transform(F.split(content_col, "\n"), lambda line: F.transform(F.array(line_key(line)), lambda k: F.when(k.isNotNull(), F.xxhash64(k)))[0])
    return staged(records.select(F.col(id_col).alias("rec"), F.coalesce(F.col(domain_col), F.lit("\x00")).alias("domain"), F.when(F.col(content_col).isNotNull(), keys).alias("keys")), "line-keys")


def graph(listed: DataFrame, min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """(nodes: domain, key, records, n (occurrences); edges: domain, a, b, records) of high support, from `keyed` lines.

    Supports are counted per record with map-side combine: each record first lists its distinct keys and
    its distinct pairs of neighbours, so no distinct aggregation is shuffled.
    """
    sizes = listed.groupBy("domain").agg(F.count(F.lit(1)).alias("total"))
    present = listed.filter("keys IS NOT NULL").select("domain", F.filter("keys", lambda k: k.isNotNull()).alias("keys"))
    # a record's distinct keys count as records, all its keys as occurrences
    counted = F.concat(
        F.transform(F.array_distinct("keys"), lambda k: F.struct(k.alias("key"), F.lit(1).alias("records"), F.lit(0).alias("n"))),
        F.transform("keys", lambda k: F.struct(k.alias("key"), F.lit(0).alias("records"), F.lit(1).alias("n"))),
    )
    support = present.select("domain", F.explode(counted).alias("x")).groupBy("domain", F.col("x.key").alias("key")).agg(F.sum("x.records").alias("records"), F.sum("x.n").alias("n"))
    enough = (F.col("records") >= min_records) & (F.col("records") >= min_share * F.col("total"))
    nodes = staged(support.filter(F.col("records") >= min_records).join(sizes, "domain").filter(enough).drop("total"), "line-nodes")
    follows = F.array_distinct(F.zip_with("keys", F.slice(F.col("keys"), F.lit(2), F.greatest(F.size("keys") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    pairs = present.filter(F.size("keys") > 1).select("domain", F.explode(follows).alias("x")).select("domain", "x.a", "x.b").filter("b IS NOT NULL AND a <> b")
    # only edges between kept nodes matter, and both ends' own support bounds an edge's
    edge_support = pairs.groupBy("domain", "a", "b").agg(F.count(F.lit(1)).alias("records")).filter(F.col("records") >= min_records)
    ends = nodes.select("domain", F.col("key"), F.col("records").alias("node_records"))
    edges = edge_support.join(ends.select("domain", F.col("key").alias("a"), F.col("node_records").alias("ra")), ["domain", "a"])
    edges = edges.join(ends.select("domain", F.col("key").alias("b"), F.col("node_records").alias("rb")), ["domain", "b"])
    return nodes, staged(edges.filter(F.col("records") >= 0.5 * F.least("ra", "rb")).select("domain", "a", "b", "records"), "line-edges")


def blocks(listed: DataFrame, **limits) -> DataFrame:
    """domain, key, n (occurrences), records, block (least key of its component): the repeated lines of `keyed` ones."""
    nodes, edges = graph(listed, **limits)
    return _components(nodes, edges.select("domain", "a", "b"))


def key_texts(records: DataFrame, domain_col: str, content_col: str, nodes: DataFrame) -> DataFrame:
    """domain, key, text: the lines without white space, digits and case that stand for the keys of `nodes`."""
    lines = records.filter(F.col(content_col).isNotNull()).select(F.coalesce(F.col(domain_col), F.lit("\x00")).alias("domain"), F.explode(F.split(content_col, "\n")).alias("line"))
    texts = lines.select("domain", line_key(F.col("line")).alias("text")).filter("text IS NOT NULL")
    return texts.withColumn("key", F.xxhash64("text")).groupBy("domain", "key").agg(F.min("text").alias("text")).join(nodes.select("domain", "key"), ["domain", "key"], "left_semi")


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Least key of the component as `block`, by label propagation with pointer jumping; each round is a stored table."""
    both = edges.unionByName(edges.select("domain", F.col("b").alias("a"), F.col("a").alias("b")))
    labels = staged(nodes.withColumn("block", F.col("key")), "line-labels")
    if edges.isEmpty():
        return labels
    while True:
        near = both.join(labels.select("domain", F.col("key").alias("b"), "block"), ["domain", "b"]).groupBy("domain", F.col("a").alias("key")).agg(F.min("block").alias("near"))
        lower = labels.join(near, ["domain", "key"], "left").withColumn("low", F.least("block", "near")).drop("near")
        up = lower.select("domain", F.col("key").alias("low"), F.col("low").alias("up"))
        jumped = staged(lower.join(up, ["domain", "low"], "left").withColumn("next", F.least("low", "up")).withColumn("moved", F.col("next") < F.col("block")).select("domain", "key", "records", "n", F.col("next").alias("block"), "moved"), "line-labels")
        labels = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return labels


def occurrences(records: DataFrame, id_col: str, domain_col: str, content_col: str, **limits) -> DataFrame:
    """rec, line_no, block of every occurrence of a repeated line."""
    listed = keyed(records, id_col, domain_col, content_col)
    repeated = blocks(listed, **limits)
    lines = listed.select("rec", "domain", F.posexplode("keys").alias("line_no", "key")).filter("key IS NOT NULL").withColumn("line_no", F.col("line_no").cast("bigint"))
    return join_dictionary(lines, repeated.drop("records"), ["domain", "key"], "n").select("rec", "line_no", "block")


def without_repeated(records: DataFrame, id_col: str, domain_col: str, content_col: str, out: str = "clean", **limits) -> DataFrame:
    """`records` with the column `out`: the content without its repeated lines (null stays null)."""
    gone = free_name(records, "_cut")
    cut = occurrences(records, id_col, domain_col, content_col, **limits).groupBy(F.col("rec").alias(id_col)).agg(F.collect_set("line_no").alias(gone))
    joined = records.join(cut, id_col, "left")
    kept = F.filter(F.split(content_col, "\n"), lambda line, i: ~F.array_contains(F.coalesce(F.col(gone), F.array().cast("array<bigint>")), i.cast("bigint")))
    return joined.withColumn(out, F.array_join(kept, "\n")).drop(gone)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = occurrences(table(spark, sf_dir, "deep_source"), "source_id", "domain", "content")
    return found.select(F.col("rec").alias("source_id"), "line_no")


def named_blocks(records: DataFrame, id_col: str, domain_col: str, content_col: str, **limits) -> DataFrame:
    """domain, key, records, occurrences, block: as `blocks`, with the lines' own text and the least of it for the block."""
    found = blocks(keyed(records, id_col, domain_col, content_col), **limits)
    named = found.join(key_texts(records, domain_col, content_col, found), ["domain", "key"])
    least = named.groupBy("domain", "block").agg(F.min("text").alias("least"))
    return named.join(least, ["domain", "block"]).select("domain", F.col("text").alias("key"), "records", F.col("n").alias("occurrences"), F.col("least").alias("block"))


def p5_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_blocks(table(spark, sf_dir, "deep_source"), "source_id", "domain", "content")


def p5_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """domain, a, b, records: which repeated line follows which, in how many records."""
    records = table(spark, sf_dir, "deep_source")
    nodes, edges = graph(keyed(records, "source_id", "domain", "content"))
    texts = staged(key_texts(records, "domain", "content", nodes), "line-texts")
    first, second = (texts.select("domain", F.col("key").alias(c), F.col("text").alias(f"{c}_text")) for c in ("a", "b"))
    return edges.join(first, ["domain", "a"]).join(second, ["domain", "b"]).select("domain", F.col("a_text").alias("a"), F.col("b_text").alias("b"), "records")


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated(table(spark, sf_dir, "deep_source"), "source_id", "domain", "content").select("source_id", "clean")


_LINES_SQL = r"""
WITH lines AS (
  SELECT source_id, coalesce(domain, chr(0)) AS domain, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no
  FROM deep_source WHERE content IS NOT NULL),
keyed AS (SELECT source_id, domain, line_no, line, lower(regexp_replace(line, '[\s\p{Z}\p{Nd}\x0B]+', '', 'g')) AS key FROM lines WHERE regexp_matches(line, '\p{L}')),
sizes AS (SELECT coalesce(domain, chr(0)) AS domain, count(*) AS total FROM deep_source GROUP BY 1),
nodes AS (SELECT domain, key, count(DISTINCT source_id) AS records, count(*) AS occurrences FROM keyed GROUP BY 1, 2),
kept AS (SELECT nodes.* FROM nodes JOIN sizes USING (domain) WHERE records >= 4 AND records >= 0.2 * total)
"""
_EDGES_SQL = """, follows AS (SELECT source_id, domain, key AS a, lead(key) OVER (PARTITION BY source_id ORDER BY line_no) AS b FROM keyed),
pairs AS (SELECT domain, a, b, count(DISTINCT source_id) AS records FROM follows WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2, 3),
edges AS (SELECT p.* FROM pairs p JOIN kept x ON p.domain = x.domain AND a = x.key JOIN kept y ON p.domain = y.domain AND b = y.key WHERE p.records >= 4 AND p.records >= 0.5 * least(x.records, y.records))
"""
ORACLES = {
    "p5_found": _LINES_SQL + "SELECT source_id, line_no FROM keyed JOIN kept USING (domain, key)",
    "p5_blocks": _LINES_SQL.replace("WITH", "WITH RECURSIVE", 1) + _EDGES_SQL + """, reach AS (SELECT domain, key, key AS block FROM kept UNION SELECT e.domain, e.b, r.block FROM reach r JOIN (SELECT domain, a, b FROM edges UNION ALL SELECT domain, b, a FROM edges) e ON r.domain = e.domain AND r.key = e.a)
SELECT kept.domain, kept.key, records, occurrences, min(block) AS block FROM kept JOIN reach ON kept.domain = reach.domain AND kept.key = reach.key GROUP BY ALL""",
    "p5_edges": _LINES_SQL + _EDGES_SQL + "SELECT domain, a, b, records FROM edges",
    "p5_clean": _LINES_SQL
    + """, cut AS (SELECT source_id, line_no FROM keyed JOIN kept USING (domain, key)),
left_over AS (SELECT l.source_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS clean FROM lines l LEFT JOIN cut c ON l.source_id = c.source_id AND l.line_no = c.line_no WHERE c.line_no IS NULL GROUP BY 1)
SELECT d.source_id, CASE WHEN d.content IS NULL THEN NULL ELSE coalesce(x.clean, '') END AS clean FROM deep_source d LEFT JOIN left_over x USING (source_id)""",
}
