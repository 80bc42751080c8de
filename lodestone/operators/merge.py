"""Group-merge of records by concept, edge merge, and merging into a store."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(c: str) -> Column:
    return F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(c))


def _other_than(c: str) -> Callable[[Column], Column]:
    return lambda x: x != F.col(c)


def distinct_in_order(records: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """keys, name: the distinct filled values of each key by first appearance. Values are made distinct
    before they are gathered, so a list is as long as a key has different values, not records."""
    each = records.select(*keys, F.struct(*order).alias("_o"), value.alias("_v")).where("_v is not null and cast(_v as string) <> ''")
    first = each.groupBy(*keys, "_v").agg(F.min("_o").alias("_o"))
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_o", "_v"))).alias("_l"))
    return listed.select(*keys, F.transform("_l", lambda r: r["_v"]).alias(name))


def merge_records(records: DataFrame, key: str, order: Sequence[str], name: str, statement: str, scalars: Sequence[str] = (), multis: Sequence[str] = (), appends: Sequence[str] = (), source: Sequence[str] = ()) -> DataFrame:
    """One item for each ``key``.

    name: of the first record; statement: the longest, the earliest of equals, the others in
    ``conflicts``; scalars: first filled value, later different ones in ``<c>_conflicts``; multis
    (arrays): union by first appearance; appends: blank-line join that skips contained text;
    ``sources``: all of them, sorted. First, longest and count are partial aggregates; lists hold
    distinct values only, but for the sources, which are the result."""
    o = F.struct(*order)
    aggs = [
        F.min_by(F.col(name), F.when(F.col(name).isNotNull(), o)).alias("name"),
        F.count_distinct(F.col(name)).alias("n_names"),
        F.min_by(F.col(statement), F.when(F.col(statement).isNotNull(), F.struct(-F.length(statement), o))).alias("statement"),
        F.collect_set(statement).alias("_statements"),
        F.count("*").alias("n_records"),
    ]
    for c in scalars:
        aggs += [F.min_by(F.col(c), F.when(filled(c).isNotNull(), o)).alias(c), F.collect_set(filled(c)).alias(f"_{c}")]
    if source:
        aggs.append(F.array_sort(F.collect_list(F.struct(*source))).alias("sources"))
    out = records.groupBy(key).agg(*aggs)
    out = out.withColumns({"statement": F.coalesce("statement", F.lit("")), "conflicts": F.array_sort(F.filter("_statements", lambda x: x != F.coalesce("statement", F.lit(""))))})
    for c in scalars:
        out = out.withColumn(f"{c}_conflicts", F.array_sort(F.filter(f"_{c}", _other_than(c))))
    out = out.drop("_statements", *(f"_{c}" for c in scalars))
    for c in multis:
        exploded = records.select(key, *order, F.posexplode(c).alias("_at", "_x"))
        listed = distinct_in_order(exploded, [key], [*order, "_at"], F.col("_x"), c)
        out = out.join(listed, key, "left").withColumn(c, F.coalesce(c, F.array().cast(records.schema[c].dataType)))
    for c in appends:
        listed = distinct_in_order(records, [key], order, F.col(c), c)
        joined = F.aggregate(F.coalesce(c, F.array().cast("array<string>")), F.lit(""), lambda a, x: F.when(a == "", x).when(F.contains(a, x), a).otherwise(F.concat(a, F.lit("\n\n"), x)))
        out = out.join(listed, key, "left").withColumn(c, joined)
    return out


def declared_union(values: Column, declared: Sequence[str]) -> Column:
    """Distinct values, the declared ones in their order first, then others as they appear."""
    known = F.array(*map(F.lit, declared)) if declared else F.array().cast("array<string>")
    v = F.array_distinct(values)
    return F.concat(F.filter(known, lambda x: F.array_contains(v, x)), F.array_except(v, known))


def merge_edges(edges: DataFrame, keys: Sequence[str], order: Sequence[str], scalars: Sequence[str] = (), notes: str | None = None) -> DataFrame:
    """One edge for each key: first filled scalar and its conflicts, notes joined, and the count."""
    o = F.struct(*order)
    aggs = [F.count("*").alias("n_edges")]
    for c in scalars:
        first = F.min_by(F.col(c), F.when(filled(c).isNotNull(), o)).alias(c)
        aggs += [first, F.greatest(F.lit(0), F.count_distinct(filled(c)) - 1).cast("long").alias(f"{c}_conflicts")]
    out = edges.groupBy(*keys).agg(*aggs)
    if notes:
        listed = distinct_in_order(edges, keys, order, F.col(notes), "_notes")
        out = out.join(listed, list(keys), "left").withColumn(notes, F.coalesce(F.array_join("_notes", "\n"), F.lit(""))).drop("_notes")
    return out


def merge_store(store: DataFrame, built: DataFrame, key: str, attrs: Sequence[str], protected: str = "protected") -> DataFrame:
    """Built attributes over stored ones, but for names in the store's ``protected`` array;
    attributes that were not built stay."""
    a = store.select(F.col(key), F.col(protected), *(F.col(c).alias(f"_old_{c}") for c in attrs))
    both = a.join(built.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in attrs)), key, "full")
    keep = lambda c: F.coalesce(F.array_contains(protected, F.lit(c)), F.lit(False))
    return both.select(key, protected, *(F.when(keep(c), F.col(f"_old_{c}")).otherwise(F.coalesce(f"_new_{c}", f"_old_{c}")).alias(c) for c in attrs))


def contradictions(positions: DataFrame) -> DataFrame:
    """subject, n_positions, positions: subjects with two or more different filled statements."""
    p = positions.where(F.coalesce("statement", F.lit("")) != "").select("subject", "statement").distinct()
    out = p.groupBy("subject").agg(F.count("*").alias("n_positions"), F.concat_ws(" ／ ", F.array_sort(F.collect_list("statement"))).alias("positions"))
    return out.where("n_positions >= 2")
