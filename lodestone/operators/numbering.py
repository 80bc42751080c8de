"""Stable numbering: gaps filled first, existing numbers kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def format_number(prefix: Column, n: Column, width: int) -> Column:
    """Prefix and number with a minimum width (lpad alone would cut longer numbers)."""
    text = n.cast("string")
    return F.concat(prefix, F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0")))


def numbers_in(ident: Column, prefix: str, width: int) -> Column:
    """The number of an id in the format, else null."""
    return F.regexp_extract(ident, f"^{prefix}(\\d{{{width},}})$", 1).try_cast("bigint")


def fill_gaps(rows: DataFrame, group: str, number: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``assigned``: the number where there is one, else the smallest unused positive
    numbers of the group in ``order``.

    The k-th free number of a group is k plus the used numbers below it, so pending rows meet
    the runs between used numbers by a range test on ranks; no list of numbers is made."""
    used = rows.where(F.col(number) > 0).select(group, F.col(number).alias("_n")).distinct()
    w = Window.partitionBy(group).orderBy("_n")
    runs = used.withColumn("_i", F.row_number().over(w))
    # before used number n (the i-th) there are n - i free numbers
    runs = runs.withColumn("_free", F.col("_n") - F.col("_i"))
    runs = runs.groupBy(group, "_free").agg(F.max("_i").alias("_i"))
    pend = rows.where(F.col(number).isNull() | (F.col(number) <= 0)).withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    r = runs.withColumn("_next", F.coalesce(F.lead("_free").over(Window.partitionBy(group).orderBy("_free")), F.lit(1 << 60)))
    below = r.select(F.col(group).alias("_g"), "_free", "_i", "_next")
    joined = pend.join(below, (F.col(group) == F.col("_g")) & (F.col("_k") > F.col("_free")) & (F.col("_k") <= F.col("_next")), "left")
    filled = joined.withColumn("assigned", (F.col("_k") + F.coalesce("_i", F.lit(0))).cast("bigint")).drop("_g", "_free", "_i", "_next", "_k")
    kept = rows.where(F.col(number) > 0).withColumn("assigned", F.col(number).cast("bigint"))
    return kept.unionByName(filled)


def renumber(rows: DataFrame, group: str, number: str, order: list[Column]) -> DataFrame:
    """``assigned`` 1, 2, ... in the order of the present number, rows without one last."""
    w = Window.partitionBy(group).orderBy(F.coalesce(number, F.lit(1_000_000_000)), *order)
    return rows.withColumn("assigned", F.row_number().over(w).cast("bigint"))


def natural_key(ident: Column) -> Column:
    """Sort key: runs of digits as numbers, text before numbers at the same place."""
    parts = F.regexp_extract_all(ident, F.lit("(\\d+|\\D+)"), 1)
    return F.transform(parts, lambda p: F.when(p.rlike("^\\d"), F.struct(p.cast("decimal(38,0)").alias("n"), F.lit("").alias("t"))).otherwise(F.struct(F.lit(-1).cast("decimal(38,0)").alias("n"), p.alias("t"))))
