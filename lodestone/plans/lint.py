"""Findings about report sections: plans that cannot be compiled, columns without values, sections
without rows.

Plans are mappings as in ``sections``; the vocabulary is a mapping: ``items`` type -> attribute names,
``relations`` name -> (from types, to types, attribute names).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.checks import finding
from lodestone.plans import sections

#: Columns that every item has beside its attributes.
ITEM_COLUMNS = ("id", "type", "status", "name", "statement", "source", "description")
_SCHEMA = "level string, code string, target string, message string"


def _names(section: Mapping) -> list[str]:
    r = section.get("relation") or []
    return [r] if isinstance(r, str) else list(r)


def faults(section: Mapping, vocabulary: Mapping) -> list[str]:
    """What cannot be resolved in one section: kind, keys, type, relations, columns, group and where."""
    kind = section.get("kind", "items")
    if kind not in ("items", "relation", "matrix", "trace"):
        return [f"unknown kind {kind}"]
    out = [f"unknown key {k}" for k in sorted(set(section) - sections.KEYS)]
    columns, attributes = list(section.get("columns", [])), vocabulary["items"]
    if kind in ("items", "trace"):
        own = attributes.get(section.get("type"))
        if own is None:
            return [*out, f"unknown type {section.get('type')}"]
        allowed = {*own, *ITEM_COLUMNS, *(["linked"] if kind == "trace" else [])}
        out += [f"column {c} of an end" if "." in c else f"unknown column {c}" for c in columns if "." in c or c not in allowed]
        out += [f"unknown {where} {c}" for where in ("group_by", "where") for c in ([section[where]] if isinstance(section.get(where), str) else section.get(where) or []) if c not in allowed]
    if kind in ("relation", "matrix", "trace"):
        known = vocabulary["relations"]
        out += [f"unknown relation {r}" for r in _names(section) if r not in known]
        ends = {"from": set(), "to": set()}
        own_names = {"from", "to", "order", "status", "description"}
        for r in _names(section):
            if r in known:
                ends["from"] |= {a for t in known[r][0] for a in attributes.get(t, ())}
                ends["to"] |= {a for t in known[r][1] for a in attributes.get(t, ())}
                own_names |= set(known[r][2])
        if kind == "relation":
            for c in columns:
                side, _, name = c.partition(".")
                good = (side in ends and name in ends[side] | set(ITEM_COLUMNS)) if name else c in own_names
                out += [] if good else [f"unknown column {c}"]
    return out


def plan_findings(spark: SparkSession, plan: Sequence[Mapping], vocabulary: Mapping) -> DataFrame:
    """E040, one row a fault; the target is the section's heading."""
    rows = [("error", "E040", str(s.get("heading", "")), f) for s in plan for f in faults(s, vocabulary)]
    return spark.createDataFrame(rows, _SCHEMA)


def _filled(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the number of rows and, for each column, of filled cells."""
    filled = [F.count_if(~F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).isin("", "―")).alias(c) for c in columns]
    return rows.agg(F.count("*").alias("rows "), *filled)


def value_findings(plan: Sequence[Mapping], items: DataFrame, relations: DataFrame) -> DataFrame:
    """W034 a section without rows although its data is there; for columns blank in every row of a
    filled section W046 (they are folded), W043 when a column of the same name on another end has
    values, W047 when descriptions of the printed items are in use. One aggregate a section."""
    out = finding(items.where("false"), "", "", F.col("id"), "")
    described = items.where((F.col("status") != "deprecated") & (F.coalesce(F.try_element_at("attrs", F.lit("description")), F.lit("")) != "")).groupBy("type").agg(F.count("*").alias("told"))
    for s in plan:
        kind, heading = s.get("kind", "items"), str(s.get("heading", ""))
        columns = [c for c in s.get("columns", []) if c not in ("linked", "id")]
        rows = sections.compile_section({k: v for k, v in s.items() if k not in ("heading", "group_by")}, items, relations)
        have = items.where((F.col("type") == s["type"]) & (F.col("status") != "deprecated")) if kind in ("items", "trace") else relations.where(F.col("type").isin(_names(s)))
        n = _filled(rows, [c for c in columns if c in rows.columns])
        stats = n.join(F.broadcast(have.agg(F.count("*").alias("have "))))
        at = F.lit(heading)
        out = out.union(finding(stats.where((F.col("rows ") == 0) & (F.col("have ") > 0)), "W034", "warn", at, "data is there, the section is empty"))
        for c in columns:
            blank = stats.where((F.col("rows ") > 0) & (F.col(f"`{c}`") == 0)) if c in rows.columns else stats.where("false")
            target = F.lit(f"{heading}.{c}")
            out = out.union(finding(blank, "W046", "warn", target, "column folded"))
            if kind == "relation":
                name = c.rpartition(".")[2]
                twins = [x for x in columns if x != c and x.rpartition(".")[2] == name]
                if twins:
                    full = reduce(lambda a, b: a | b, [F.col(f"`{x}`") > 0 for x in twins])
                    out = out.union(finding(blank.where(full), "W043", "warn", target, "the same column of another end has values"))
            if kind in ("items", "trace") and c != "description":
                used = blank.join(F.broadcast(described.where(F.col("type") == s["type"])))
                out = out.union(finding(used, "W047", "warn", target, "blank while descriptions are in use"))
    return out
