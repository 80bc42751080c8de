"""Checks of a declared vocabulary, and of an overlay that may only add to it or tighten it.

The vocabulary is tables: types (seq, name, layer, id_prefix, seq_attribute, seq_by, seq_prefix_from,
upstream), attributes (owner, name, kind, values array, multi, pattern, required, unique,
extensible), relations (name, from array, to array, cardinality map), groups (name, members array),
facts (seq, owner, fact, fixed map).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lodestone.operators.checks import finding

#: Fixed values.
KINDS = ("string", "int", "bool", "enum")
CARDINALITY = r"^\d+\.\.(\d+|\*)$"


@F.pandas_udf(BooleanType())
def compiles(pattern: pd.Series) -> pd.Series:
    """Whether a pattern can be compiled; the vocabulary's patterns only."""

    def good(p: str) -> bool:
        try:
            re.compile(p)
        except re.error:
            return False
        return True

    return pattern.map(good)


def _filled(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) != ""


def vocabulary_findings(types: DataFrame, attributes: DataFrame, relations: DataFrame, groups: DataFrame, facts: DataFrame, layers: Sequence[str], reserved: Sequence[str]) -> DataFrame:
    """M001 to M013, M020 and M021: one finding a fault."""
    known = types.select(F.col("name").alias("member")).distinct()
    name = F.col("name")
    out = [finding(types.where(~F.coalesce(F.col("layer").isin(list(layers)), F.lit(False))), "M001", "error", name, "layer missing or unknown")]
    out.append(finding(groups.join(types.select("name").distinct(), "name", "left_semi"), "M002", "error", name, "group named like a type"))
    out.append(finding(groups.select("name", F.explode("members").alias("member")).join(known, "member", "left_anti"), "M003", "error", F.concat(F.lit("item_groups."), name), "unknown type"))
    for side in ("from", "to"):
        out.append(finding(relations.select("name", F.explode(side).alias("member")).join(known, "member", "left_anti"), "M003", "error", name, "unknown type"))
    own = attributes.select(F.col("owner").alias("name"), F.col("name").alias("attribute")).distinct()
    for column, code in (("seq_attribute", "M004"), ("seq_by", "M005"), ("seq_prefix_from", "M006")):
        used = types.where(_filled(column)).select("name", F.col(column).alias("attribute"))
        out.append(finding(used.join(own, ["name", "attribute"], "left_anti"), code, "error", name, f"{column} is no attribute"))
    up = types.where(_filled("upstream")).select("name", F.col("upstream").alias("relation")).join(relations.select(F.col("name").alias("relation"), F.col("from").alias("starts"), F.lit(True).alias("there")), "relation", "left")
    out.append(finding(up.where("there is null or (size(starts) > 0 and not array_contains(starts, name))"), "M007", "error", name, "upstream relation not possible"))
    sides = relations.select("name", F.explode("cardinality").alias("side", "range"))
    out.append(finding(sides.where(~F.col("side").isin("from", "to") | ~F.coalesce(F.col("range").rlike(CARDINALITY), F.lit(False))), "M008", "error", name, "cardinality not readable"))
    at = F.concat_ws(".", "owner", "name")
    out.append(finding(attributes.where(name.isin(list(reserved))), "M009", "error", at, "reserved name"))
    kind = F.coalesce("kind", F.lit(""))
    out.append(finding(attributes.where(~kind.isin(*KINDS)), "M010", "error", at, "kind not known"))
    out.append(finding(attributes.where((kind == "enum") & (F.coalesce(F.size("values"), F.lit(0)) <= 0)), "M010", "error", at, "list without values"))
    out.append(finding(attributes.where(F.coalesce("multi", F.lit(False)) & (kind != "enum")), "M011", "error", at, "several values of a kind that is no list"))
    out.append(finding(attributes.where(_filled("pattern") & (kind != "string")), "M011", "error", at, "pattern on a kind that is no text"))
    first = types.where(_filled("id_prefix")).groupBy("id_prefix").agg(F.min("seq").alias("first"))
    out.append(finding(types.join(first, "id_prefix").where("seq > first"), "M012", "error", name, "id prefix repeats"))
    out.append(finding(attributes.where(_filled("pattern")).where(~compiles("pattern")), "M013", "error", at, "pattern broken"))
    claimed = facts.groupBy("fact").agg(F.min("seq").alias("first"))
    out.append(finding(facts.join(claimed, "fact").where("seq > first"), "M020", "error", F.concat_ws(".", "owner", "fact"), "fact type claimed twice"))
    fixed = facts.select("owner", "fact", F.explode("fixed").alias("name", "value")).join(attributes.select("owner", "name", "kind", "values", "extensible", F.lit(True).alias("there")), ["owner", "name"], "left")
    wrong = "there is null or (kind = 'enum' and not coalesce(extensible, false) and not array_contains(coalesce(values, array()), value))"
    out.append(finding(fixed.where(wrong), "M021", "error", F.concat_ws(".", "owner", "fact", "name"), "fixed attribute not possible"))
    return reduce(DataFrame.union, out)


def overlay_findings(base_types: DataFrame, base_relations: DataFrame, base_attributes: DataFrame, types: DataFrame, relations: DataFrame, attributes: DataFrame) -> DataFrame:
    """M101 types and M102 relations (name, removed) taken away, M103 ends taken from a relation, M110
    required or unique given up, M111 values of a list taken away, M112 a closed list opened. Null in
    an overlay's column means: not touched."""
    out = []
    for base, over, code in ((base_types, types, "M101"), (base_relations, relations, "M102")):
        out.append(finding(over.where("removed").join(base.select("name").distinct(), "name", "left_semi"), code, "error", F.col("name"), "may not be taken away"))
    both = base_relations.select("name", F.col("from").alias("b_from"), F.col("to").alias("b_to")).join(relations.where("not removed").select("name", "from", "to"), "name")
    for side in ("from", "to"):
        gone = F.col(side).isNotNull() & (F.size(F.array_except(f"b_{side}", F.coalesce(side, F.array().cast("array<string>")))) > 0)
        out.append(finding(both.where(gone), "M103", "error", F.col("name"), f"{side} types taken away"))
    a = base_attributes.select("owner", "name", *(F.col(c).alias(f"b_{c}") for c in ("required", "unique", "kind", "values", "extensible")))
    both = a.join(attributes, ["owner", "name"])
    at = F.concat_ws(".", "owner", "name")
    for flag in ("required", "unique"):
        out.append(finding(both.where(f"b_{flag} and {flag} = false"), "M110", "error", at, f"{flag} given up"))
    out.append(finding(both.where("b_kind = 'enum' and values is not null and size(array_except(b_values, values)) > 0"), "M111", "error", at, "values taken away"))
    out.append(finding(both.where("b_extensible = false and extensible"), "M112", "error", at, "closed list opened"))
    return reduce(DataFrame.union, out)


def merged(base: DataFrame, overlay: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The base with the overlay's rows over it: what an overlay leaves null stays, new rows are added."""
    values = [c for c in base.columns if c not in keys]
    b = base.select(*keys, *(F.col(c).alias(f"b_{c}") for c in values))
    return b.join(overlay.select(*keys, *values), list(keys), "full").select(*keys, *(F.coalesce(c, f"b_{c}").alias(c) for c in values))
