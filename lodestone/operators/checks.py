"""Constraint checks over items and relations: every check is a filter or an anti join that gives
findings (level, code, target, message); the vocabulary is a few broadcast rows or literals."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The states of an item.
STATUSES = ("draft", "review", "approved", "deprecated")


@dataclass(frozen=True)
class Attribute:
    owner: str
    name: str
    required: bool = False
    unique: bool = False
    pattern: str | None = None
    values: Sequence[str] = ()
    extensible: bool = False


@dataclass(frozen=True)
class Relation:
    name: str
    from_types: Sequence[str]
    to_types: Sequence[str]
    low: int = 0
    high: int | None = None
    ordered: bool = False
    same_type_only: bool = False


@dataclass
class Vocabulary:
    item_types: Sequence[str]
    attributes: Sequence[Attribute] = ()
    relations: Sequence[Relation] = ()
    warn_if_no_upstream: dict[str, str] = field(default_factory=dict)

    def of(self, owner: str) -> list[Attribute]:
        return [a for a in self.attributes if a.owner == owner]


def finding(df: DataFrame, code: str | Column, level: str | Column, target: Column, message: str) -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(as_col(level).alias("level"), as_col(code).alias("code"), target.alias("target"), F.lit(message).alias("message"))


def _value(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _edge_name() -> Column:
    return F.concat_ws("-", "from", "type", "to")


def _ids(items: DataFrame) -> DataFrame:
    return items.groupBy("id").agg(F.min("type").alias("item_type"))


def _each_attribute(v: Vocabulary, want: Callable[[Attribute], bool], test: Callable[[Attribute], Column]) -> Column:
    """The attributes of a row that fail a test, by its type."""
    tests = [F.when((F.col("type") == a.owner) & test(a), F.lit(a.name)) for a in v.attributes if want(a)]
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def _attribute_findings(items: DataFrame, names: Column, code: str | Callable[[Column], Column], level: str | Callable[[Column], Column], message: str) -> DataFrame:
    d = items.select("id", "gaps", F.explode(names).alias("_a"))
    known = F.coalesce(F.array_contains("gaps", F.col("_a")), F.lit(False))
    return finding(d, code(known) if callable(code) else code, level(known) if callable(level) else level, F.concat_ws(".", "id", "_a"), message)


def _wrong_end(items: DataFrame, relations: DataFrame, v: Vocabulary, end: str, code: str) -> DataFrame:
    typed = relations.join(_ids(items).withColumnRenamed("id", end), end)
    tests = [(F.col("type") == r.name) & ~F.coalesce(F.col("item_type").isin(list(r.from_types if end == "from" else r.to_types)), F.lit(False)) for r in v.relations]
    return finding(typed.where(reduce(lambda a, b: a | b, tests, F.lit(False))), code, "error", _edge_name(), f"type of {end} not allowed")


def _cardinality(items: DataFrame, relations: DataFrame, v: Vocabulary) -> DataFrame:
    """Zero counts included: the items are the left side."""
    out = None
    n = relations.groupBy("type", "from").agg(F.count("*").alias("n"))
    for r in v.relations:
        if r.low == 0 and r.high is None:
            continue
        own = items.where(F.col("type").isin(list(r.from_types))).select("id").join(n.where(F.col("type") == r.name).select(F.col("from").alias("id"), "n"), "id", "left")
        k = F.coalesce("n", F.lit(0))
        bad = own.where((k < r.low) | ((k > r.high) if r.high is not None else F.lit(False)))
        part = finding(bad, "E027", "error", F.concat(F.col("id"), F.lit(f".{r.name}")), "number of relations out of range")
        out = part if out is None else out.unionByName(part)
    return finding(items.where("false"), "E027", "error", F.col("id"), "") if out is None else out


def _unique(items: DataFrame, v: Vocabulary) -> DataFrame:
    own = _each_attribute(v, lambda a: a.unique, lambda a: ~_blank(_value(a.name)))
    d = items.select("id", "type", "attrs", F.explode(own).alias("_a"))
    d = d.withColumn("_v", F.try_element_at("attrs", F.col("_a")))
    w = Window.partitionBy("type", "_a", "_v").orderBy("id")
    # only values that repeat go to the window
    many = d.groupBy("type", "_a", "_v").agg(F.count("*").alias("_n")).where("_n > 1").select("type", "_a", "_v")
    d = d.join(many, ["type", "_a", "_v"]).withColumn("_k", F.row_number().over(w)).where("_k > 1")
    return finding(d, "E012", "error", F.concat_ws(".", "id", "_a"), "value repeats")


def _duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k > 1")


def _order(relations: DataFrame, v: Vocabulary) -> DataFrame:
    names = [r.name for r in v.relations if r.ordered]
    d = relations.where(F.col("type").isin(names))
    same = d.withColumn("_n", F.count("*").over(Window.partitionBy("type", "from", "ord")))
    return finding(same.where(F.col("ord").isNull() | (F.col("_n") > 1)), "W021", "warn", _edge_name(), "order missing or repeated")


def _undeclared(items: DataFrame, v: Vocabulary) -> DataFrame:
    declared = F.coalesce(*(F.when(F.col("type") == t, F.array(*(F.lit(a.name) for a in v.of(t))) if v.of(t) else F.array().cast("array<string>")) for t in v.item_types), F.array().cast("array<string>"))
    d = items.select("id", F.explode(F.array_except(F.map_keys("attrs"), declared)).alias("_a"))
    return finding(d, "W010", "warn", F.concat_ws(".", "id", "_a"), "attribute not declared")


def checks(items: DataFrame, relations: DataFrame, v: Vocabulary) -> dict[str, Callable[[], DataFrame]]:
    """Code -> its findings. items: id, type, status, attrs map, gaps array (declared gaps);
    relations: type, from, to, ord."""
    ids = _ids(items)
    missing = lambda end, code: finding(relations.join(ids.select(F.col("id").alias(end)), end, "left_anti"), code, "error", _edge_name(), f"{end} missing")
    same_only = [r.name for r in v.relations if r.same_type_only]

    def same_type() -> DataFrame:
        a, b = ids.select(F.col("id").alias("from"), F.col("item_type").alias("_a")), ids.select(F.col("id").alias("to"), F.col("item_type").alias("_b"))
        return finding(relations.where(F.col("type").isin(same_only)).join(a, "from").join(b, "to").where("_a <> _b"), "E025", "error", _edge_name(), "ends of different types")

    def no_upstream() -> DataFrame:
        parts = [finding(items.where(F.col("type") == t).join(relations.where(F.col("type") == r).select(F.col("from").alias("id")), "id", "left_anti"), "W031", "warn", F.col("id"), f"no {r}") for t, r in v.warn_if_no_upstream.items()]
        return reduce(DataFrame.unionByName, parts, finding(items.where("false"), "W031", "warn", F.col("id"), ""))

    referenced = {t for r in v.relations for t in r.to_types}
    required = lambda: _each_attribute(v, lambda a: a.required, lambda a: _blank(_value(a.name)))
    return {
        "E001": lambda: finding(items.where(_blank(F.col("id"))), "E001", "error", F.coalesce("id", F.lit("")), "no id"),
        "E002": lambda: finding(_duplicates(items, ["id"], ["type"]), "E002", "error", F.col("id"), "id repeats"),
        "E003": lambda: finding(items.where(~F.coalesce(F.col("type").isin(list(v.item_types)), F.lit(False))), "E003", "error", F.col("id"), "type not defined"),
        "E004": lambda: finding(items.where(~F.coalesce(F.col("status").isin(list(STATUSES)), F.lit(False))), "E004", "error", F.col("id"), "status not defined"),
        "E010": lambda: _attribute_findings(items, required(), lambda known: F.when(known, "W032").otherwise("E010"), lambda known: F.when(known, "warn").otherwise("error"), "required attribute blank"),
        "E011": lambda: _attribute_findings(items, _each_attribute(v, lambda a: bool(a.values) and not a.extensible, lambda a: ~_blank(_value(a.name)) & ~_value(a.name).isin(list(a.values))), "E011", "error", "value not declared"),
        "E012": lambda: _unique(items, v),
        "E013": lambda: _attribute_findings(items, _each_attribute(v, lambda a: a.pattern is not None, lambda a: ~_blank(_value(a.name)) & ~_value(a.name).rlike(f"^(?:{a.pattern})$")), "E013", "error", "pattern does not match"),
        "E020": lambda: finding(relations.where(~F.coalesce(F.col("type").isin([r.name for r in v.relations]), F.lit(False))), "E020", "error", _edge_name(), "relation not defined"),
        "E021": lambda: missing("from", "E021"),
        "E022": lambda: missing("to", "E022"),
        "E023": lambda: _wrong_end(items, relations, v, "from", "E023"),
        "E024": lambda: _wrong_end(items, relations, v, "to", "E024"),
        "E025": same_type,
        "E026": lambda: finding(relations.where(F.col("from") == F.col("to")), "E026", "error", _edge_name(), "relation to itself"),
        "E027": lambda: _cardinality(items, relations, v),
        "W010": lambda: _undeclared(items, v),
        "W020": lambda: finding(_duplicates(relations, ["type", "from", "to"], ["ord"]), "W020", "warn", _edge_name(), "relation repeats"),
        "W021": lambda: _order(relations, v),
        "W030": lambda: finding(items.where(F.col("type").isin(sorted(referenced))).join(relations.select(F.col("to").alias("id")), "id", "left_anti"), "W030", "warn", F.col("id"), "never referenced"),
        "W031": no_upstream,
        "W033": lambda: _attribute_findings(items, F.array_except(F.coalesce("gaps", F.array().cast("array<string>")), required()), "W033", "warn", "declared gap is filled"),
    }


def validate(items: DataFrame, relations: DataFrame, v: Vocabulary, codes: Sequence[str] | None = None) -> DataFrame:
    """The findings of the chosen checks (all by default) in one table."""
    every = checks(items, relations, v)
    return reduce(DataFrame.unionByName, [every[c]() for c in (codes or every)])


def in_report_order(findings: DataFrame) -> DataFrame:
    """Errors first, then code, target, message."""
    return findings.orderBy(F.col("level") != "error", "code", "target", "message")


def gate(findings: DataFrame) -> DataFrame:
    """errors, warns and a map of counts by code, in one row."""
    by = findings.groupBy("level", "code").agg(F.count("*").alias("n"))
    count = lambda level: F.coalesce(F.sum(F.when(F.col("level") == level, F.col("n"))), F.lit(0)).cast("long")
    return by.agg(count("error").alias("errors"), count("warn").alias("warns"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("counts"))


def coverage_gate(anchors: DataFrame, records: DataFrame, out_of_scope: DataFrame) -> DataFrame:
    """G001 for anchors that nothing claims and G004 for claims of anchors that do not exist."""
    on = ["file", "anchor"]
    name = F.concat_ws("#", *on)
    claimed = records.select(*on).union(out_of_scope.select(*on)).distinct()
    return finding(anchors.join(claimed, on, "left_anti"), "G001", "error", name, "anchor not claimed").unionByName(finding(claimed.join(anchors, on, "left_anti"), "G004", "error", name, "anchor does not exist"))


def grounded(records: DataFrame, anchors: DataFrame) -> DataFrame:
    """G005: no word of two or more letters of the statement occurs in the anchor's text."""
    d = records.join(anchors.select("file", "anchor", "text"), ["file", "anchor"])
    words = F.array_distinct(F.regexp_extract_all("statement", F.lit("[A-Za-z_][A-Za-z0-9_]+|[゠-ヿ]{2,}|[一-鿿]+"), 0))
    return finding(d.where((F.size(words) > 0) & ~F.exists(words, lambda w: F.contains(F.col("text"), w))), "G005", "warn", F.concat_ws("#", "file", "anchor"), "statement not in its source")
