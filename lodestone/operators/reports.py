"""What reports need beside their sections: groups, marks, legends, owners of ids, holes, origins,
drafts and declarations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNGROUPED = "未分類"
ISSUE_COLUMN = "課題"


def filled(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) != ""


def display_value(value: Column, labels: Mapping[str, str] | None = None) -> Column:
    """A cell: declared labels for values, ○ for true, ― for nothing."""
    shown = F.when(value == "true", "○").when(~filled(value) | (value == "false"), "―")
    for v, label in (labels or {}).items():
        shown = shown.when(value == v, label)
    return shown.otherwise(value)


def grouped(rows: DataFrame, group: str, declared: Sequence[str], labels: Mapping[str, str] | None = None) -> DataFrame:
    """``rows`` with section (number) and heading: declared values first in their order, then others
    by name, rows without one last. A single group makes no sections: number 0, null heading."""
    value = F.when(filled(group), F.col(group)).otherwise(UNGROUPED)
    groups = rows.select(value.alias("_v")).distinct()
    known = F.array(*map(F.lit, declared)) if declared else F.array().cast("array<string>")
    place = F.when(F.col("_v") == UNGROUPED, 1 << 30).when(F.array_contains(known, F.col("_v")), F.array_position(known, F.col("_v"))).otherwise(1 << 29)
    named = groups.select("_v", F.row_number().over(Window.orderBy(place, "_v")).alias("_n"), F.count("*").over(Window.partitionBy()).alias("_k"))  # one row a group
    heading = F.col("_v")
    for v, label in (labels or {}).items():
        heading = F.when(F.col("_v") == v, label).otherwise(heading)
    named = named.select("_v", F.when(F.col("_k") > 1, F.col("_n")).otherwise(0).cast("long").alias("section"), F.when(F.col("_k") > 1, heading).alias("heading"))
    return rows.withColumn("_v", value).join(F.broadcast(named), "_v").drop("_v")


def dispute_marks(rows: DataFrame, relations: DataFrame, names: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with the issues (display names) that dispute them in a last column; blank for none."""
    marks = relations.where((F.col("type") == "disputes") & (F.coalesce("status", F.lit("")) != "deprecated")).join(names.select(F.col("id").alias("from"), "display"), "from", "left")
    marks = marks.groupBy(F.col("to").alias(key)).agg(F.concat_ws("、", F.array_sort(F.collect_set(F.coalesce("display", "from")))).alias(ISSUE_COLUMN))
    return rows.join(marks, key, "left").withColumn(ISSUE_COLUMN, F.coalesce(ISSUE_COLUMN, F.lit("")))


def matrix_omitted(items: DataFrame, relations: DataFrame, relation: str, from_type: str, to_type: str) -> DataFrame:
    """side, id: live items that could be rows or columns of a matrix and have no relation."""
    own = relations.where(F.col("type") == relation)
    live = items.where("status <> 'deprecated'")
    side = lambda end, t: live.where(F.col("type") == t).select("id").join(own.select(F.col(end).alias("id")).distinct(), "id", "left_anti").select(F.lit(end).alias("side"), "id")
    return side("from", from_type).union(side("to", to_type))


def legend(relations: DataFrame, relation: str, attribute: str, declared: Sequence[str]) -> DataFrame:
    """value, n: how often each declared value of a matrix's cells occurs, zero included."""
    words = relations.sparkSession.createDataFrame([(v,) for v in declared], "value string")
    n = relations.where(F.col("type") == relation).groupBy(F.try_element_at("attrs", F.lit(attribute)).alias("value")).agg(F.count("*").alias("n"))
    return words.join(n, "value", "left").select("value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def provenance(sources: DataFrame, key: str, label: str, shown: int = 2) -> DataFrame:
    """key, n, sources: the first ``shown`` distinct labels and how many more. The set is built from
    distinct labels, the list of the first ones only."""
    each = sources.select(key, label).distinct()
    ranked = each.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(label)))
    by = ranked.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_r") <= shown, F.col(label)))).alias("_s"))
    more = F.when(F.col("n") > shown, F.concat(F.lit(" ほか "), (F.col("n") - shown).cast("string"), F.lit(" 件"))).otherwise("")
    return by.select(key, "n", F.concat(F.concat_ws("、", "_s"), more).alias("sources"))


def reference_label(display: Column, name: Column) -> Column:
    """Display id and name; one of them when the other is missing or the same."""
    return F.when(~filled(name) | (name == display), display).when(~filled(display), name).otherwise(F.concat_ws(" ", display, name))


def qualified(items: DataFrame, parents: DataFrame) -> DataFrame:
    """id, label: items (id, type, name) whose name another item of the type has get their owner's
    name, when exactly one owner (parents: id, owner_name) is known."""
    same = items.groupBy("type", "name").agg(F.count("*").alias("_n"))
    one = parents.groupBy("id").agg(F.count_distinct("owner_name").alias("_k"), F.min("owner_name").alias("_o"))
    rows = items.join(same, ["type", "name"]).join(one, "id", "left")
    label = F.when((F.col("_n") > 1) & (F.col("_k") == 1), F.concat("name", F.lit("（"), "_o", F.lit("）"))).otherwise(F.col("name"))
    return rows.select("id", label.alias("label"))


def display_owners(printed: DataFrame, reports: DataFrame) -> DataFrame:
    """display, owner, links: the first report in phase order that prints an id owns it, the others
    link to it. printed: report, display; reports: report, phase, place."""
    rows = printed.distinct().join(F.broadcast(reports), "report")
    return rows.groupBy("display").agg(F.min_by("report", F.struct("phase", "place", "report")).alias("owner"), (F.count("*") - 1).alias("links"))


def document_index(reports: DataFrame, rows: DataFrame) -> DataFrame:
    """phase, number, report, sections, n_rows: reports numbered in their phase with what they hold.
    rows: report, section, n_rows."""
    held = rows.groupBy("report").agg(F.count_if(F.col("n_rows") > 0).alias("sections"), F.sum("n_rows").alias("n_rows"))
    number = F.row_number().over(Window.partitionBy("phase").orderBy("place", "report")).cast("long")
    return reports.withColumn("number", number).join(held, "report", "left").select("phase", "number", "report", F.coalesce("sections", F.lit(0)).cast("long").alias("sections"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


def glossary(terms: DataFrame) -> DataFrame:
    """terms (name, reading) with their place: by reading, those without one first, then by name."""
    initial = F.substring(F.coalesce("reading", "name"), 1, 1)
    w = Window.partitionBy("initial").orderBy(F.coalesce("reading", F.lit("")), "name")
    return terms.withColumn("initial", initial).withColumn("place", F.row_number().over(w).cast("long"))


def holes(items: DataFrame, relations: DataFrame, scope: DataFrame, folded: DataFrame) -> DataFrame:
    """kind, target, detail: dropped values, disputes, what was not read, declared gaps, folded columns."""
    live = items.where("status <> 'deprecated'")
    conflicts = live.select("id", F.explode("conflicts").alias("name", "values")).select(F.lit("conflict").alias("kind"), F.col("id").alias("target"), "name")
    disputes = relations.where("type = 'disputes' and coalesce(status, '') <> 'deprecated'").select(F.lit("dispute"), "to", "from")
    unread = scope.where(F.col("kind") == "未読取").select(F.lit("unread"), F.concat_ws("#", "file", "anchor"), "reason")
    gaps = live.select("id", F.explode("gap_reasons").alias("name", "reason")).select(F.lit("gap"), "id", "name")
    return reduce(DataFrame.union, [conflicts, disputes, unread, gaps, folded.select(F.lit("folded"), "section", "column")]).toDF("kind", "target", "detail")


def provenance_coverage(files: DataFrame, sources: DataFrame, scope: DataFrame) -> DataFrame:
    """file, anchors, used, out_of_scope, items: for each source file how much of it became items."""
    used = sources.select("file", "anchor").distinct()
    n = used.groupBy("file").agg(F.count("*").alias("used"))
    out = scope.select("file", "anchor").distinct().join(used, ["file", "anchor"], "left_anti").groupBy("file").agg(F.count("*").alias("out_of_scope"))
    items = sources.groupBy("file").agg(F.count_distinct("item").alias("items"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return files.groupBy("file").agg(F.count("*").alias("anchors")).join(n, "file", "left").join(out, "file", "left").join(items, "file", "left").select("file", "anchors", zero("used"), zero("out_of_scope"), zero("items"))


def origin_state(captured: DataFrame, organised: DataFrame, published: DataFrame) -> DataFrame:
    """path, state: each source is published, in the store only, organised only, or only read."""
    o, p = organised.select("path").distinct().withColumn("_o", F.lit(True)), published.groupBy("path").agg(F.count_if(F.col("report").isNotNull()).alias("_p"), F.lit(True).alias("_s"))
    rows = captured.join(o, "path", "left").join(p, "path", "left")
    return rows.select("path", F.when(F.col("_p") > 0, "published").when(F.col("_s"), "stored").when(F.col("_o"), "organised").otherwise("read").alias("state"))


def auto_gaps(items: DataFrame, relations: DataFrame, needed: DataFrame, targets: DataFrame) -> DataFrame:
    """id, relation: items that lack a needed relation (needed: type, relation) while no item of any
    type that it could lead to (targets: relation, type) is there: these gaps can be declared."""
    filled_types = items.where("status <> 'deprecated'").select("type").distinct()
    possible = targets.join(filled_types, "type", "left_semi").select("relation").distinct()
    hopeless = needed.join(possible, "relation", "left_anti")
    return items.join(F.broadcast(hopeless), "type").join(relations.select(F.col("from").alias("id"), F.col("type").alias("relation")).distinct(), ["id", "relation"], "left_anti").select("id", "relation")


def promote(items: DataFrame, relations: DataFrame, issue_type: str = "open-issue") -> DataFrame:
    """items with status: review becomes approved, but for issues and for what open issues dispute."""
    disputed = relations.where("type = 'disputes' and coalesce(status, '') <> 'deprecated'").select(F.col("to").alias("id")).distinct().withColumn("_d", F.lit(True))
    stay = (F.col("type") == issue_type) | F.coalesce("_d", F.lit(False))
    return items.join(disputed, "id", "left").withColumn("status", F.when((F.col("status") == "review") & ~stay, "approved").otherwise(F.col("status"))).drop("_d")


def draft(chunks: DataFrame) -> DataFrame:
    """Records from code chunks (file, anchor, kind, path, name, body): concept, type, name, and a
    statement that is a slot to fill; imports and constants make none."""
    kind = F.when(F.col("kind") == "class", "module-fact").when(F.col("kind").isin("method", "function"), "method-fact").when(F.col("kind") == "module", "module-fact")
    prefix = F.when(kind == "method-fact", "c-met-").otherwise("c-mod-")
    concept = F.concat(prefix, "path", F.when(F.col("kind") == "module", "").otherwise(F.concat(F.lit("."), "name")))
    slot = F.concat(F.lit("<TODO "), "file", F.lit("#"), "anchor", F.lit(">"))
    special = F.col("name").rlike(r"__\w+__$")
    return chunks.where(kind.isNotNull() & ~((kind == "method-fact") & special)).select("file", "anchor", concept.alias("concept"), kind.alias("type"), "name", slot.alias("statement"), F.size(F.split("body", "\n")).cast("long").alias("lines"))


def out_of_scope(anchors: DataFrame, claimed: DataFrame, glob: str, reason: str) -> DataFrame:
    """Declarations for all unclaimed anchors of files that a glob (* and ?) matches."""
    pattern = "".join({"*": ".*", "?": "."}.get(c, f"\\Q{c}\\E") for c in glob)
    left = anchors.where(F.col("file").rlike(f"^{pattern}$")).join(claimed, ["file", "anchor"], "left_anti")
    return left.select("file", "anchor", F.lit("対象外").alias("kind"), F.lit(reason).alias("reason"))


def placement(new: DataFrame, stored: DataFrame) -> DataFrame:
    """new (id, type) with the file to write to: the one that holds most items of the type (of
    equals the first by name), else a file named after the type."""
    held = stored.groupBy("type", "file").agg(F.count("*").alias("n")).groupBy("type").agg(F.max_by("file", F.struct("n", F.expr("-xxhash64(file)"))).alias("_most"), F.max("n").alias("_n"))
    ties = stored.groupBy("type", "file").agg(F.count("*").alias("_n")).join(held, ["type", "_n"]).groupBy("type").agg(F.min("file").alias("file"))
    return new.join(F.broadcast(ties), "type", "left").withColumn("file", F.coalesce("file", F.concat("type", F.lit(".yml"))))


def folded_decisions(log: DataFrame, examples: int = 3) -> DataFrame:
    """actor, kind, confidence, n, examples of a decision log (seq, actor, text, confidence): kinds are
    texts without their names and numbers; the first examples only."""
    kind = F.regexp_replace(F.regexp_replace("text", r"[（(][^）)]*[）)]", ""), r"\S*\d\S*", "N")
    rows = log.withColumn("kind", kind).withColumn("_r", F.row_number().over(Window.partitionBy("actor", "kind", "confidence").orderBy("seq")))
    by = rows.groupBy("actor", "kind", "confidence").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_r") <= examples, F.struct("seq", "text")))).alias("_e"))
    return by.select("actor", "kind", "confidence", "n", F.concat_ws(" / ", F.transform("_e", lambda e: e["text"])).alias("examples"))


def replace_by_actor(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log without the entries of the actors in ``new``, and theirs."""
    return log.join(F.broadcast(new.select("actor").distinct()), "actor", "left_anti").unionByName(new)


def only_codes(findings: DataFrame, prefixes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The findings whose code begins with one of the prefixes, and the hidden rest."""
    keep = reduce(lambda a, b: a | b, [F.col("code").startswith(p) for p in prefixes], F.lit(not prefixes))
    return findings.where(keep), findings.where(~keep)


def only_under(findings: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The findings under a path, and one row with the number of hidden ones."""
    inside = F.contains("target", F.lit(path))
    return findings.where(inside), findings.agg(F.count_if(~inside).alias("hidden"))


def sections_kept(rows: DataFrame, have: DataFrame) -> DataFrame:
    """section, n, reason: sections with rows, and why others are left out. rows: section, n; have:
    section, n_data, n_relations (what the store has for it)."""
    d = rows.join(have, "section")
    reason = F.when(F.col("n") > 0, F.lit(None)).when(F.col("n_data") == 0, "no data").when(F.col("n_relations") == 0, "no relation").otherwise("filtered away")
    return d.select("section", "n", reason.alias("reason"))


def exclude_produced(items: DataFrame, sources: DataFrame, produced_type: str) -> tuple[DataFrame, DataFrame]:
    """items without, and those with, a source file that made an item of ``produced_type``. sources:
    id, file."""
    files = sources.join(items.where(F.col("type") == produced_type).select("id"), "id", "left_semi").select("file").distinct()
    out = sources.join(F.broadcast(files), "file", "left_semi").select("id").distinct()
    return items.join(out, "id", "left_anti"), items.join(out, "id", "left_semi")
