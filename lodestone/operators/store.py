"""Checks of a store beyond required values and relation ends: kinds, lists, overrides, gaps,
dropped values, and display numbers.

items: id, type, status, attrs (map), lists (map of arrays), overridden (map name -> reason),
gap_reasons (map name -> reason), conflicts (map name -> array of dropped values). Vocabulary:
attributes (owner, name, kind, multi), relations (rel), formats (type, grp, attribute, prefix,
width; grp null is the default).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.checks import finding

INT, BOOL = r"^-?\d+$", "^(true|false)$"


def _blank(c):
    return F.coalesce(c, F.lit("")) == ""


def kind_findings(items: DataFrame, attributes: DataFrame) -> DataFrame:
    """E014 a value that is not of its kind (int, bool), E015 a list for one value or one value for a
    list."""
    at = F.concat_ws(".", "id", "name")
    words = F.broadcast(attributes.select(F.col("owner").alias("type"), "name", "kind", "multi"))
    one = items.select("id", "type", F.explode("attrs").alias("name", "value")).where(~_blank(F.col("value"))).join(words, ["type", "name"])
    wrong = ((F.col("kind") == "int") & ~F.col("value").rlike(INT)) | ((F.col("kind") == "bool") & ~F.col("value").rlike(BOOL))
    many = items.select("id", "type", F.explode("lists").alias("name", "values")).join(words, ["type", "name"])
    return finding(one.where(wrong & ~F.col("multi")), "E014", "error", at, "value of another kind").union(finding(one.where("multi"), "E015", "error", at, "one value for a list")).union(finding(many.where("not multi"), "E015", "error", at, "list for one value"))


def override_findings(items: DataFrame, attributes: DataFrame) -> DataFrame:
    """E016 overrides of unknown attributes, E017 without a reason, W012 of a blank value."""
    at = F.concat_ws(".", "id", "name")
    rows = items.select("id", "type", "attrs", F.explode("overridden").alias("name", "reason"))
    rows = rows.join(F.broadcast(attributes.select(F.col("owner").alias("type"), "name", F.lit(True).alias("known"))), ["type", "name"], "left")
    blank = _blank(F.try_element_at("attrs", F.col("name")))
    return finding(rows.where("known is null"), "E016", "error", at, "override of an unknown attribute").union(finding(rows.where(_blank(F.trim("reason"))), "E017", "error", at, "override without a reason")).union(finding(rows.where(F.col("known") & blank), "W012", "warn", at, "override of a blank value"))


def gap_findings(items: DataFrame, attributes: DataFrame, relations: DataFrame) -> DataFrame:
    """E018 gaps of names that are no relation and no attribute of the type, E019 without a reason."""
    at = F.concat_ws(".", "id", "name")
    rows = items.select("id", "type", F.explode("gap_reasons").alias("name", "reason"))
    own = attributes.select(F.col("owner").alias("type"), "name").distinct()
    stray = rows.join(F.broadcast(relations.select(F.col("rel").alias("name")).distinct()), "name", "left_anti").join(F.broadcast(own), ["type", "name"], "left_anti")
    return finding(stray, "E018", "error", at, "gap of an unknown name").union(finding(rows.where(_blank(F.trim("reason"))), "E019", "error", at, "gap without a reason"))


def conflict_findings(items: DataFrame) -> DataFrame:
    """W045: values that a merge did not take, one finding each."""
    dropped = items.select("id", F.explode("conflicts").alias("name", "values")).select("id", "name", F.explode("values").alias("value"))
    return finding(dropped, "W045", "warn", F.concat_ws(".", "id", "name"), "value dropped")


def conforms(value, prefix, width):
    """Whether a display number is the prefix and at least ``width`` digits."""
    rest = F.substr(value, F.length(prefix) + 1)
    return value.startswith(prefix) & rest.rlike(r"^\d+$") & (F.length(rest) >= width)


def _numbered(items: DataFrame, formats: DataFrame, by: str) -> DataFrame:
    """items with the format of their group, or the type's default, and the present number."""
    given = formats.where("grp is not null").select("type", F.col("grp"), F.col("attribute").alias("a1"), F.col("prefix").alias("p1"), F.col("width").alias("w1"))
    default = formats.where("grp is null").select("type", F.col("attribute").alias("a0"), F.col("prefix").alias("p0"), F.col("width").alias("w0"))
    named = formats.groupBy("type").agg(F.min("attribute").alias("attribute"))
    rows = items.join(F.broadcast(named), "type").withColumn("grp", F.try_element_at("attrs", F.lit(by)))
    rows = rows.join(F.broadcast(given), ["type", "grp"], "left").join(F.broadcast(default), "type", "left")
    return rows.withColumns({"prefix": F.coalesce("p1", "p0"), "width": F.coalesce("w1", "w0"), "value": F.try_element_at("attrs", F.col("attribute"))}).withColumn("reason", F.try_element_at("overridden", F.col("attribute")))


def number_findings(items: DataFrame, formats: DataFrame, by: str) -> DataFrame:
    """E028 numbers that are not in the format (W042 when they were overridden with a reason), W040
    blank numbers of a group without a format, W041 numbers out of format that an override keeps
    from being renumbered."""
    rows = _numbered(items, formats, by)
    off = rows.where(~_blank(F.col("value")) & F.col("prefix").isNotNull() & ~conforms(F.col("value"), F.col("prefix"), F.col("width")))
    told = ~_blank(F.trim("reason"))
    e028 = finding(off, F.when(told, "W042").otherwise("E028"), F.when(told, "warn").otherwise("error"), F.col("id"), "number not in the format")
    w040 = finding(rows.where(_blank(F.col("value")) & F.col("prefix").isNull()), "W040", "warn", F.col("id"), "no format for the group")
    w041 = finding(off.where(F.col("reason").isNotNull()), "W041", "warn", F.col("id"), "kept from renumbering")
    return reduce(DataFrame.union, [e028, w040, w041])


def shape_findings(lines: DataFrame) -> DataFrame:
    """E000: lines of a store file (file, line, body as JSON) that are no mapping."""
    ok = F.expr("try_parse_json(body) is not null and substr(trim(body), 1, 1) = '{'")
    return finding(lines.where(~F.coalesce(ok, F.lit(False))), "E000", "error", F.concat_ws("#", "file", F.col("line").cast("string")), "no mapping")
