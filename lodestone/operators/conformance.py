"""Conformance of a store to declared rules, and derived items with their basis.

Rules are data (lists of mappings, as read from a rule file); each becomes a filter or an anti join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.checks import finding
from lodestone.operators.predicates import matches

#: How sure a derived item is.
CONFIDENCES = ("高", "中", "低")
UNGROUPED = "未分類"


def _attr(name: str) -> Column:
    return F.col(name) if name in ("id", "type", "status") else F.try_element_at("attrs", F.lit(name))


def _ruled(items: DataFrame, rule: Mapping) -> DataFrame:
    out = items.where(F.col("type") == rule.get("type", ""))
    if rule.get("when_status"):
        out = out.where(F.col("status").isin([str(s) for s in rule["when_status"]]))
    if rule.get("where"):
        out = out.where(matches(rule["where"], {k: _attr(k) for k in rule["where"]}))
    return out


def _all(parts: Sequence[DataFrame], items: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, parts, finding(items.where("false"), "", "", F.col("id"), ""))


def attribute_rules(items: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """C201: attributes that a status or a condition requires (type, attribute, when_status, where, level)."""
    return _all([finding(_ruled(items, r).where(F.coalesce(_attr(r["attribute"]), F.lit("")) == ""), "C201", r.get("level", "warn"), F.concat_ws(".", "id", F.lit(r["attribute"])), "required in this state") for r in rules], items)


def trace_rules(items: DataFrame, relations: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """C202: items that must have a relation (type, relation, direction, when_status, where, level)."""
    parts = []
    for r in rules:
        ends = relations.where(F.col("type") == r["relation"]).select(F.col(r.get("direction", "from")).alias("id")).distinct()
        parts.append(finding(_ruled(items, r).join(ends, "id", "left_anti"), "C202", r.get("level", "warn"), F.concat_ws(".", "id", F.lit(r["relation"])), "not connected"))
    return _all(parts, items)


def baseline(items: DataFrame, relations: DataFrame, required: str) -> DataFrame:
    """C203: items in another status, and relations that have a status and another one."""
    bad = finding(items.where(~F.coalesce(F.col("status") == required, F.lit(False))), "C203", "error", F.col("id"), "status of a baseline")
    edges = relations.where((F.coalesce("status", F.lit("")) != "") & (F.col("status") != required))
    return bad.union(finding(edges, "C203", "error", F.concat_ws("-", "from", "type", "to"), "status of a baseline"))


def required_documents(documents: DataFrame, required: DataFrame) -> DataFrame:
    """C204: required documents (name) that are not defined."""
    return finding(required.join(documents.select("name").distinct(), "name", "left_anti"), "C204", "error", F.col("name"), "required document missing")


def section_sizes(items: DataFrame, sections: Sequence[Mapping], floor: float = 2.0, least: int = 6, level: str = "warn") -> DataFrame:
    """C205: item sections (title, heading, type, group_by, where) of ``least`` rows or more that are
    cut in two or more groups of fewer than ``floor`` rows on average."""
    parts = []
    for s in sections:
        rows = _ruled(items.where("status <> 'deprecated'"), s)
        value = _attr(s["group_by"])
        n = rows.agg(F.count("*").alias("n"), F.count_distinct(F.when(F.coalesce(value, F.lit("")) == "", UNGROUPED).otherwise(value)).alias("g"))
        bad = n.where((F.col("n") >= least) & (F.col("g") >= 2) & (F.col("n") / F.col("g") < floor))
        parts.append(finding(bad, "C205", level, F.lit(f"{s['title']}「{s['heading']}」"), "sections too fine"))
    return _all(parts, items)


def pack_lock(locked: DataFrame, resolved: DataFrame, frozen: bool = False) -> DataFrame:
    """C001 nothing locked where it must be, C002 packs (pack, version, content_hash) that differ from
    the lock, are not in it, or are gone; an error when frozen, else a warning. Without a lock and
    not frozen there is nothing to say."""
    level = "error" if frozen else "warn"
    if locked.isEmpty():
        return finding(resolved.limit(1 if frozen else 0), "C001", "error", F.lit("pack.lock"), "no lock")
    a = locked.select("pack", F.struct("version", "content_hash").alias("was"))
    b = resolved.select("pack", F.struct("version", "content_hash").alias("now"))
    return finding(a.join(b, "pack", "full").where(~F.col("was").eqNullSafe(F.col("now"))), "C002", level, F.col("pack"), "differs from the lock")


def pack_chain(packs: DataFrame, start: str) -> tuple[list[str], list[tuple[str, str, str, str]]]:
    """Packs from the root to ``start`` and findings (level, code, target, message): C010 a pack that
    is not there, C011 a circle. packs: name, extends; a declared vocabulary, so a few rows."""
    parent = {r["name"]: r["extends"] for r in packs.select("name", "extends").collect()}
    chain: list[str] = []
    name: str | None = start
    while name:
        if name in chain:
            return chain[::-1], [("error", "C011", name, "packs extend in a circle")]
        if name not in parent:
            return chain[::-1], [("error", "C010", name, "pack not found")]
        chain.append(name)
        name = parent[name]
    return chain[::-1], []


def derived_findings(derived: DataFrame, items: DataFrame, anchors: DataFrame) -> DataFrame:
    """D001 fields missing, D002 no basis, D003 a basis (item or file#anchor) or member that does not
    exist, D004 confidence not known, D005 ids that repeat (the first stands). derived: seq, id,
    type, name, statement, confidence, basis array, members array."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    target = F.when(blank("id"), F.concat(F.lit("derived["), F.col("seq").cast("string"), F.lit("]"))).otherwise(F.col("id"))
    d = derived.withColumn("target", target)
    at = F.col("target")
    d001 = finding(d.where(blank("id") | blank("type") | blank("name") | blank("statement")), "D001", "error", at, "field missing")
    d004 = finding(d.where(~F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(False))), "D004", "error", at, "confidence not known")
    d002 = finding(d.where(F.coalesce(F.size("basis"), F.lit(0)) <= 0), "D002", "error", at, "no basis")
    again = d.where(~blank("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))).alias("k"))
    d005 = finding(again, "D005", "error", F.col("id"), "id repeats")
    ids = items.select(F.col("id").alias("ref")).distinct()
    known = ids.union(anchors.select(F.concat_ws("#", "file", "anchor"))).distinct()
    basis = d.select("target", F.explode("basis").alias("ref")).join(known, "ref", "left_anti")
    members = d.select("target", F.explode("members").alias("ref")).join(ids, "ref", "left_anti")
    return reduce(DataFrame.union, [d001, d004, d002, d005, finding(basis, "D003", "error", at, "basis does not exist"), finding(members, "D003", "error", at, "member does not exist")])
