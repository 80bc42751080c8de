"""Declarative report sections compiled to DataFrames: items, relation, matrix, trace."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.predicates import matches

KEYS = {"kind", "type", "relation", "where", "columns", "group_by", "cols", "cell", "gap", "side", "heading", "full", "label"}
OWN = ("id", "type", "status")


class PlanError(ValueError):
    """A section that cannot be compiled (finding E040)."""


def _attr(name: str, prefix: str = "") -> Column:
    col = f"{prefix}attrs"
    return F.col(f"{prefix}{name}") if name in OWN else F.try_element_at(F.col(col), F.lit(name))


def _live(items: DataFrame, kind: str | None, where: Mapping | None) -> DataFrame:
    out = items.where(F.col("status") != "deprecated")
    if kind:
        out = out.where(F.col("type") == kind)
    if where:
        out = out.where(matches(where, {k: _attr(k) for k in where}))
    return out


def validate_section(section: Mapping) -> None:
    unknown = set(section) - KEYS
    if unknown:
        raise PlanError(f"unknown keys: {sorted(unknown)}")
    need = {"items": ("type", "columns"), "relation": ("relation", "columns"), "matrix": ("relation", "cols"), "trace": ("type", "relation")}
    kind = section.get("kind")
    if kind not in need:
        raise PlanError(f"unknown kind: {kind}")
    for k in need[kind]:
        if k not in section:
            raise PlanError(f"{kind} needs {k}")


def compile_section(section: Mapping, items: DataFrame, relations: DataFrame) -> DataFrame:
    """items (id, type, status, attrs), relations (type, from, to, ord) -> the section's rows."""
    validate_section(section)
    return {"items": _items, "relation": _relation, "matrix": _matrix, "trace": _trace}[section["kind"]](section, items, relations)


def _items(s: Mapping, items: DataFrame, relations: DataFrame) -> DataFrame:
    group = [_attr(s["group_by"]).alias("section")] if s.get("group_by") else []
    return _live(items, s["type"], s.get("where")).select("id", *group, *(_attr(c).alias(c) for c in s["columns"]))


def _edges(s: Mapping, relations: DataFrame) -> DataFrame:
    return relations.where(F.col("type").isin(list(s["relation"])))


def _relation(s: Mapping, items: DataFrame, relations: DataFrame) -> DataFrame:
    side = lambda p: items.select(F.col("id").alias(f"{p}id"), F.col("type").alias(f"{p}type"), F.col("status").alias(f"{p}status"), F.col("attrs").alias(f"{p}attrs"))
    edges = _edges(s, relations).select(F.col("from").alias("from_id"), F.col("to").alias("to_id"), "ord")
    d = edges.join(side("f_"), F.col("from_id") == F.col("f_id"), "left").join(side("t_"), F.col("to_id") == F.col("t_id"), "left")
    columns = []
    for c in s["columns"]:
        end, _, name = c.partition(".")
        columns.append((_attr(name, "f_" if end == "from" else "t_") if name else F.col(c)).alias(c))
    return d.select("from_id", "to_id", "ord", *columns)


def _matrix(s: Mapping, items: DataFrame, relations: DataFrame) -> DataFrame:
    """Rows by the given columns; the columns are data of the plan, so the schema is fixed."""
    cell = F.lit(s.get("cell", "○"))
    edges = _edges(s, relations).where(F.col("to").isin(list(s["cols"])))
    return edges.groupBy(F.col("from").alias("row_id")).pivot("to", list(s["cols"])).agg(F.max(cell))


def reference(name: str) -> Column:
    """Label of an item: its id and name, or the one that is there, or the id alone when both say the same."""
    n = F.coalesce(_attr(name), F.lit(""))
    return F.when((n == "") | (n == F.col("id")), F.col("id")).otherwise(F.concat_ws(" ", "id", n))


def _trace(s: Mapping, items: DataFrame, relations: DataFrame) -> DataFrame:
    own, other = ("to", "from") if s.get("side") == "to" else ("from", "to")
    rows = _live(items, s["type"], s.get("where"))
    columns = ["id", *(_attr(c).alias(c) for c in s.get("columns", []))]
    edges = _edges(s, relations).select(F.col(own).alias("id"), F.col(other).alias("other"))
    if edges.isEmpty() and not s.get("full"):  # nothing was taken in, so nothing can be missing
        rows = rows.where("false")
    if s.get("label"):
        edges = edges.join(items.select(F.col("id").alias("other"), reference(s["label"]).alias("label")), "other", "left").select("id", F.coalesce("label", "other").alias("other"))
    if s.get("gap"):
        return rows.select(*columns).join(edges, "id", "left_anti")
    sets = edges.groupBy("id").agg(F.collect_set("other").alias("_set"))
    sets = sets.select("id", F.size("_set").cast("long").alias("n_linked"), F.concat_ws("、", F.array_sort("_set")).alias("linked"))
    return rows.select(*columns).join(sets, "id", "left").withColumns({"n_linked": F.coalesce("n_linked", F.lit(0)).cast("long"), "linked": F.coalesce("linked", F.lit("―"))})


def drop_blank_columns(df: DataFrame, keep: tuple[str, ...] = ("id",)) -> tuple[DataFrame, list[str]]:
    """The table without columns that are blank in every row, and their names (one pass)."""
    names = [c for c in df.columns if c not in keep]
    if not names:
        return df, []
    filled = df.agg(*(F.bool_or(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(c) for c in names)).first()
    blank = [c for c in names if not filled[c]]
    return df.drop(*blank), blank
