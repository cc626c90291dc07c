"""Mixed timestamp formats and time zones (problem 2): a dictionary of distinct raw values.

Raw strings are reduced to distinct (raw, zone, order of the date parts) triples, each is parsed once,
the parsed triples are appended to a stored dictionary, and rows get their instant by joining it.
A later run parses only triples the stored dictionary lacks.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.instants import with_instants
from marlspike.operators.skew import join_dictionary
from marlspike.session import scratch, table

KEYS = ["raw", "zone", "month_first"]
SCHEMA = "raw string, zone string, month_first boolean, utc timestamp, n bigint"


def blank(raw: Column) -> Column:
    return raw.isNull() | raw.rlike(r"^[\s  -​　﻿]*$")


class InstantDictionary:
    """A stored table of distinct raw values and their instants, grown by appending."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:
            return None

    def update(self, values: DataFrame) -> DataFrame:
        """Parse the triples of `values` (columns KEYS, any number of rows each) that are new; give the dictionary.

        `n` is the number of rows of the first batch that had the triple, so a value that is hot in a
        later batch only is found by its count there (see `normalise`).
        """
        counted = values.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
        known = self.read()
        new = counted if known is None else counted.join(known.select(*KEYS), KEYS, "left_anti")
        parsed = with_instants(new, "raw", "zone", "month_first", "utc").select(*KEYS, "utc", "n")
        parsed.write.mode("append").parquet(self.path)
        return self.read()


def normalise(rows: DataFrame, dictionary: InstantDictionary) -> DataFrame:
    """`rows` (raw, zone, month_first and anything else) with `utc`; rows that name no instant are left out.

    Null and blank raw values never reach the dictionary. Null zones count as UTC. Repeated rows stay repeated.
    """
    usable = rows.filter(~blank(F.col("raw"))).withColumn("zone", F.coalesce("zone", F.lit("UTC"))).withColumn("month_first", F.coalesce("month_first", F.lit(False)))
    stored = dictionary.update(usable.select(*KEYS)).filter(F.col("utc").isNotNull())
    return join_dictionary(usable, stored, KEYS, "n")


def json_path(dotted: Column) -> Column:
    """`a.0.b` as a JSON path: `$['a'][0]['b']`; numbers are array positions."""
    steps = F.transform(F.split(dotted, r"\."), lambda s: F.when(s.rlike(r"^\d+$"), F.concat(F.lit("["), s, F.lit("]"))).otherwise(F.concat(F.lit("['"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("']"))))
    return F.concat(F.lit("$"), F.array_join(steps, ""))


def json_scalar(payload: Column, path: Column) -> Column:
    """The string or number at `path` as text; null for other kinds, missing members and JSON that is not whole."""
    # as the only element of a list: the parser alone would pass what follows a complete value
    whole = F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]")))
    inner = F.concat(F.lit("$[0]"), F.substr(path, F.lit(2)))
    kind = F.schema_of_variant(F.try_variant_get(whole, inner, "variant"))
    usable = kind.rlike(r"^(STRING|BIGINT|DOUBLE|FLOAT|DECIMAL)") & F.try_variant_get(whole, "$[1]", "variant").isNull()
    return F.when(usable, F.try_variant_get(whole, inner, "string"))


def raw_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, rec_id, raw, zone, month_first of every time-bearing text of the item log and the API records."""
    target = table(spark, sf_dir, "intel_target").select(F.col("id").alias("target_id"), "zone", F.coalesce(F.col("locale").rlike(r"[-_]US$"), F.lit(False)).alias("month_first"), F.col("spec.time_path").alias("time_path"))
    items = table(spark, sf_dir, "intel_item").select("seq", "target_id", F.explode(F.create_map(F.lit("found_at"), "found_at", F.lit("published_at"), "published_at")).alias("field", "raw"))
    # blank texts go before the join: most of a hot target's rows may be empty
    items = items.filter(~blank(F.col("raw"))).join(target.drop("time_path"), "target_id", "left").select("field", F.col("seq").alias("rec_id"), "raw", "zone", "month_first")
    api = table(spark, sf_dir, "api_record").select("record_id", "target_id", "payload").filter("payload IS NOT NULL")
    api = api.join(target.filter("time_path IS NOT NULL"), "target_id").select(F.lit("time_path").alias("field"), F.col("record_id").alias("rec_id"), json_scalar(F.col("payload"), json_path(F.col("time_path"))).alias("raw"), "zone", "month_first")
    return items.unionByName(api)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_times(spark, sf_dir)
    found = normalise(rows, InstantDictionary(spark, scratch(spark, "instants")))
    return found.select("field", "rec_id", F.unix_micros("utc").alias("utc_us"))
