"""Joins on substring containment, without comparing every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, size: int) -> Column:
    last = F.length(text) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size)))))


def contains_join(needles: DataFrame, needle: str, hay: DataFrame, text: str) -> DataFrame:
    """needles joined with hay where ``text`` contains ``needle`` (distinct, not empty).

    Each needle probes an index of the hay's three-letter pieces with the rarest of its own (shorter needles with all of
    themselves), so it meets only texts that hold this piece; containment is then verified. All joins are on equal keys; pieces are
    many more than the texts that the planner knows the size of, so they ask for merge joins.
    """
    keys = hay.select(F.col(text).alias("__t")).distinct()
    asked = needles.select(F.col(needle).alias("__n")).where("__n <> ''").distinct()
    size = F.least(F.length("__n"), F.lit(GRAM))
    pieces = keys.select("__t", F.explode(F.concat(*[F.coalesce(_grams(F.col("__t"), k), F.array().cast("array<string>")) for k in range(1, GRAM + 1)])).alias("__g"))
    common = pieces.groupBy("__g").agg(F.count(F.lit(1)).alias("__c"))
    own = F.when(F.length("__n") <= GRAM, F.array("__n")).otherwise(_grams(F.col("__n"), GRAM))
    probes = asked.withColumn("__size", size).select("__n", F.explode(own).alias("__g")).join(common.hint("merge"), "__g", "left")
    best = probes.groupBy("__n").agg(F.min(F.struct(F.coalesce("__c", F.lit(0)).alias("__c"), "__g")).alias("__b")).where("__b.__c > 0")
    met = best.select("__n", F.col("__b.__g").alias("__g")).join(pieces.hint("merge"), "__g").where(F.contains("__t", "__n")).select("__n", "__t")
    return needles.join(met, F.col(needle) == F.col("__n")).join(hay, F.col(text) == F.col("__t")).drop("__n", "__t")
