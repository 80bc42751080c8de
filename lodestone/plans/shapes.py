"""Declared shapes of records, checked on JSON columns.

A shape is data: ``required`` (lists of paths with a code; ``together``: all or none), ``keys`` (path ->
``values`` with a code), ``kinds`` (path -> list or mapping, with a code) and ``unknown`` (a code for
keys beside the known ones). Paths are dotted. Every rule becomes an expression over the column.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.checks import finding


def dig(body: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text; null where it is not there."""
    return F.get_json_object(body, "$." + path)


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))).isin("", "[]", "{}", "null")


def _is(c: Column, kind: str) -> Column:
    return c.isNull() | F.trim(c).startswith("[" if kind == "list" else "{")


def shape_findings(records: DataFrame, shape: Mapping, body: str = "body", target: str = "target") -> DataFrame:
    """Findings (level, code, target, message) of records (target, body as JSON text). A body that is
    no mapping gives the shape's own code only."""
    b = F.col(body)
    whole = F.coalesce(F.trim(b).startswith("{") & F.get_json_object(b, "$").isNotNull(), F.lit(False))
    at = F.col(target)
    out = [finding(records.where(~whole), shape["code"], "error", at, "no mapping")]
    good = records.where(whole)
    for rule in shape.get("required", ()):
        blank = [_blank(dig(b, k)) for k in rule["keys"]]
        some, every = reduce(lambda x, y: x | y, blank), reduce(lambda x, y: x & y, blank)
        out.append(finding(good.where(some & ~every if rule.get("together") else some), rule["code"], rule.get("level", "error"), at, "required: " + ", ".join(rule["keys"])))
    for path, rule in shape.get("keys", {}).items():
        value = dig(b, path)
        out.append(finding(good.where(~_blank(value) & ~value.isin(list(rule["values"]))), rule["code"], rule.get("level", "error"), at, f"{path} is none of its values"))
    for path, rule in shape.get("kinds", {}).items():
        out.append(finding(good.where(~_is(dig(b, path), rule["kind"])), rule["code"], rule.get("level", "error"), at, f"{path} is no {rule['kind']}"))
    if shape.get("unknown"):
        known = F.array(*(F.lit(k) for k in shape["known"]))
        stray = F.array_except(F.coalesce(F.json_object_keys(b), F.array().cast("array<string>")), known)
        out.append(finding(good.where(F.size(stray) > 0), shape["unknown"], "warn", at, "unknown keys"))
    return reduce(DataFrame.union, out)
