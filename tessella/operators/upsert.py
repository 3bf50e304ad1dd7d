"""Keyed upserts and source order: how rule outputs become nodes, edges and numbered call occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialize


def upsert(rows: DataFrame, keys: list[str], seq: str, evidence: str) -> DataFrame:
    """One row a key: the other columns of the first row by seq, and the distinct evidence of all in order."""
    others = [c for c in rows.columns if c not in {*keys, seq, evidence}]
    listed = F.transform(F.array_sort(F.collect_list(F.struct(seq, evidence))), lambda x: x[evidence])
    firsts = F.min_by(F.struct(*others, F.lit(0).alias("_")), seq).alias("_first")
    out = rows.groupBy(*keys).agg(firsts, F.array_distinct(F.flatten(listed)).alias(evidence))
    return out.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in others], evidence)


def call_order(calls: DataFrame, owner: str) -> DataFrame:
    """Add order, the 1-based place of each call of its owner in the source: by line, column, file and fact."""
    by = Window.partitionBy(owner).orderBy("line", "column", "file", "fact_seq")
    return calls.withColumn("order", F.row_number().over(by))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Add `name`, the 1-based place of each row of a group in that order, without one task for a whole group.

    Rows are dealt by range, numbered in each partition and moved on by what partitions before hold of the group.
    """
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = materialize(dealt.withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = placed.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    # A row a partition and group: partitions that share a group are few.
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    return placed.withColumn("_own", own).join(offsets, ["_part", *by]).select(*rows.columns, (F.col("_own") + F.col("_before")).cast("int").alias(name))


def fact_summary(facts: DataFrame) -> DataFrame:
    """kind, file, n: facts per kind, per file and in all (the other columns null)."""
    sets = facts.groupingSets([["kind"], ["file"], []], "kind", "file")
    return sets.agg(F.count("*").alias("n"))
