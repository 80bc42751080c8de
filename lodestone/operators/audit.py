"""Audits of printed reports.

A printed report is a table of cells: report, section (number), heading, level, kind (items,
relation, matrix, trace), row, col, column (title), path (attribute), text, is_id, is_source; notes:
report, section, note. Every audit is an aggregate over cells or a join with the store.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.checks import finding

#: Texts that stand for nothing, the heading of rows without a group, how often a text
#: must repeat, its least length (in free columns, in others), the share of ungrouped rows, columns
#: that two reports share, and columns that are added to every table.
NOTHING = ("", "―", "-", "—", "‐")
UNGROUPED = "未分類"
REPEAT, LONG, LONG_FREE, FREE = 4, 60, 10, ("description", "note")
UNGROUPED_SHARE, SAME_COLUMNS, ADDED = 0.25, 3, ("課題",)


def _place(*parts: str):
    return F.concat_ws(" / ", *parts)


def nothing(c: str):
    return F.trim(F.coalesce(c, F.lit(""))).isin(*NOTHING)


def repeated_cells(table: DataFrame, columns: Sequence[str], times: int = REPEAT, length: int = LONG) -> DataFrame:
    """col, text, n: texts of at least ``length`` characters that a column holds ``times`` or more."""
    cells = table.select(F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("text")) for c in columns))).alias("x")).select("x.*")
    return cells.where(F.length("text") >= length).groupBy("col", "text").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def population(cells: DataFrame) -> DataFrame:
    """P101: a trace whose ``linked`` column says nothing in any row."""
    own = cells.where("kind = 'trace' and path = 'linked'").groupBy("report", "section", "heading").agg(F.bool_and(nothing("text")).alias("empty"))
    return finding(own.where("empty"), "P101", "warn", _place("report", "heading"), "population printed as conclusion")


def legends(cells: DataFrame, notes: DataFrame) -> DataFrame:
    """P102: a matrix without a note that tells what a blank (空欄) means."""
    told = notes.where(F.contains("note", F.lit("空欄"))).select("report", "section").distinct()
    drawn = cells.where("kind = 'matrix'").select("report", "section", "heading").distinct()
    return finding(drawn.join(told, ["report", "section"], "left_anti"), "P102", "warn", _place("report", "heading"), "matrix without legend")


def raw_headings(headings: DataFrame) -> DataFrame:
    """P103: headings below level 2 that are bare ASCII words. headings: report, level, heading."""
    raw = headings.where((F.col("level") >= 3) & F.trim("heading").rlike(r"^[A-Za-z][A-Za-z0-9_\-]*$"))
    return finding(raw, "P103", "warn", _place("report", "heading"), "heading is a raw value")


def repeats(cells: DataFrame) -> DataFrame:
    """P104: a column, over all sections of a report with the same columns, in which a long text
    repeats. Source columns do not count; free columns have a lower bound of length."""
    shape = cells.select("report", "section", "col", "column").distinct().groupBy("report", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "column"))), lambda s: s["column"]), "|").alias("shape"))
    text = F.trim(F.coalesce("text", F.lit("")))
    least = F.when(F.element_at(F.split(F.coalesce("path", F.lit("")), r"\."), -1).isin(*FREE), LONG_FREE).otherwise(LONG)
    own = cells.where(~F.col("is_source") & ~nothing("text")).withColumn("body", text).where(F.length("body") >= least).join(shape, ["report", "section"])
    many = own.groupBy("report", "shape", "col", "column", "body").agg(F.count("*").alias("n")).where(F.col("n") >= REPEAT)
    return finding(many.groupBy("report", "shape", "col", "column").agg(F.max("n")), "P104", "warn", _place("report", "column"), "text repeats in a column")


def unmarked_disputes(cells: DataFrame, disputed: DataFrame) -> DataFrame:
    """P105: a report with rows of disputed items (display) that carry no mark of an issue."""
    marked = cells.groupBy("report", "section", "row").agg(F.bool_or(F.contains("text", F.lit("課題")) | F.contains("text", F.lit("ISS-"))).alias("marked"), F.max(F.when(F.col("is_id"), F.trim("text"))).alias("display"))
    bad = marked.where("not coalesce(marked, false)").join(F.broadcast(disputed.select("display").distinct()), "display", "left_semi")
    return finding(bad.select("report").distinct(), "P105", "warn", F.col("report"), "disputed item without a mark")


def printed_twice(cells: DataFrame) -> DataFrame:
    """P106: pairs of reports that print the same items, each with the same columns (SAME_COLUMNS or
    more, ids of tables of three columns or more), REPEAT times or more. Items meet by their id, and
    each report counts once for an item and a set of columns."""
    shapes = cells.where(~F.col("column").isin(*ADDED)).groupBy("report", "section").agg(F.array_sort(F.collect_set("column")).alias("shape"))
    wide = cells.groupBy("report", "section").agg(F.count_distinct("col").alias("n")).where("n >= 3").drop("n")
    ids = cells.where(F.col("is_id") & ~nothing("text")).select("report", "section", F.trim("text").alias("display")).join(wide, ["report", "section"], "left_semi").join(shapes, ["report", "section"])
    kinds = ids.groupBy("report", "display", "shape").agg(F.count("*").alias("n"))
    a, b = (kinds.select("display", *(F.col(c).alias(f"{p}_{c}") for c in ("report", "shape", "n"))) for p in "ab")
    both = a.join(b, "display").where((F.col("a_report") < F.col("b_report")) & (F.size(F.array_intersect("a_shape", "b_shape")) >= SAME_COLUMNS))
    pairs = both.groupBy("a_report", "b_report").agg(F.sum(F.col("a_n") * F.col("b_n")).alias("n")).where(F.col("n") >= REPEAT)
    return finding(pairs, "P106", "warn", _place("a_report", "b_report"), "items printed in full in two reports")


def source_columns(plans: DataFrame) -> DataFrame:
    """P107: types that some item sections print with a source column and some without. plans:
    report, kind, type, columns array."""
    own = plans.where("kind = 'items' and type <> ''").groupBy("type").agg(F.bool_or(F.array_contains("columns", "source")).alias("some"), F.bool_and(F.array_contains("columns", "source")).alias("all"))
    return finding(own.where("some and not all"), "P107", "warn", F.col("type"), "source column not in all reports")


def ungrouped(sections: DataFrame) -> DataFrame:
    """P108: chapters of two or more filled sections in which the ungrouped one holds a quarter or
    more of the rows. sections: report, chapter, heading, n_rows."""
    filled = sections.where("n_rows > 0")
    total = filled.groupBy("report", "chapter").agg(F.count("*").alias("n"), F.sum("n_rows").alias("total")).where("n >= 2")
    own = filled.where(F.col("heading") == UNGROUPED).join(total, ["report", "chapter"]).where(F.col("n_rows") >= UNGROUPED_SHARE * F.col("total"))
    return finding(own, "P108", "warn", _place("report", "chapter", "heading"), "too many rows without a group")


def negatives(plans: DataFrame, relations: DataFrame, words: DataFrame) -> DataFrame:
    """P109: matrices (report, heading, kind, relation, cell) of an attribute with negative words
    (words: relation, cell, negative array) of which no live relation uses one. relations: type,
    status, attrs map."""
    drawn = plans.where("kind = 'matrix'").join(F.broadcast(words.where(F.size("negative") > 0)), ["relation", "cell"])
    used = relations.where("status <> 'deprecated'").select(F.col("type").alias("relation"), F.explode("attrs").alias("cell", "value")).join(F.broadcast(words), ["relation", "cell"]).where("array_contains(negative, value)").select("relation", "cell").distinct()
    return finding(drawn.join(used, ["relation", "cell"], "left_anti"), "P109", "warn", _place("report", "heading"), "negative value never used")


def unprinted_relations(relations: DataFrame, plans: DataFrame, elsewhere: Sequence[str] = ("disputes",)) -> DataFrame:
    """P110: types of live relations that no section (plans: relations array) prints."""
    used = plans.select(F.explode("relations").alias("type")).distinct()
    live = relations.where("status <> 'deprecated'").groupBy("type").agg(F.count("*").alias("n"))
    return finding(live.where(~F.col("type").isin(*elsewhere)).join(F.broadcast(used), "type", "left_anti"), "P110", "warn", F.col("type"), "relation type never printed")


def unprinted_attributes(items: DataFrame, printed: DataFrame, exempt: DataFrame) -> DataFrame:
    """P111: attributes with values on live items (id, type, status, attrs) that no report prints
    for them. printed: type, name, and ``where_type`` the items it prints; exempt: type, name."""
    held = items.where("status <> 'deprecated'").select("id", "type", F.explode("attrs").alias("name", "value")).where(F.coalesce("value", F.lit("")) != "")
    left = held.join(F.broadcast(exempt), ["type", "name"], "left_anti").join(printed.select("id", "name").distinct(), ["id", "name"], "left_anti")
    return finding(left.groupBy("type", "name").agg(F.count("*").alias("n")), "P111", "warn", F.concat_ws(".", "type", "name"), "attribute never printed")
