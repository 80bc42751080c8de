"""Findings of a build: records of a round, grouped by concept, against ledger, store and vocabulary.

Tables: records (concept, file, anchor, seq, type, name, statement, attrs map, gaps map); refs
(file, anchor, seq, concept, rel, to, attrs map); ledger (concept, type, item, since, aliases);
vocabulary as small tables: facts (fact, item_type, prefix), attributes (owner, name, kind, multi,
append, values, extensible), endpoints (rel, from_type, to_type). A record without a type only
refers; the others are complete. Every rule is a join or an aggregate whose group is partial before
the shuffle; what the first record of a concept says is a ``min_by`` and never a list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.checks import finding
from lodestone.operators.joins import orient

TARGET = "concat_ws('#', file, anchor)"


def filled(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) != ""


def item_id(prefix: Column, concept: Column) -> Column:
    return F.concat(prefix, F.lit("-"), F.substring(F.sha2(concept, 256), 1, 12))


def concepts(records: DataFrame, ledger: DataFrame, facts: DataFrame) -> DataFrame:
    """concept, fact, item_type, item, has_complete, first_target, name, statement: what is known of
    each concept of the round. The first complete record gives type and name; the longest statement
    wins, the first of equals."""
    done = filled("type")
    by = records.groupBy("concept").agg(
        F.min_by("type", F.when(done, F.col("seq"))).alias("own"),
        F.min_by("name", F.when(done, F.col("seq"))).alias("name"),
        F.max_by("statement", F.when(done, F.struct(F.length("statement"), -F.col("seq")))).alias("statement"),
        F.bool_or(done).alias("has_complete"),
        F.min_by(F.expr(TARGET), "seq").alias("first_target"),
    )
    known = ledger.select("concept", F.col("type").alias("known_type"), F.col("item").alias("known_item"))
    out = by.join(known, "concept", "left").withColumn("fact", F.when(filled("own"), F.col("own")).otherwise(F.when(filled("known_type"), F.col("known_type"))))
    out = out.join(facts.select("fact", "item_type", "prefix"), "fact", "left")
    item = F.when(filled("known_item"), F.col("known_item")).otherwise(item_id(F.col("prefix"), F.col("concept")))
    return out.withColumn("item", F.when(F.col("item_type").isNotNull(), item)).drop("own", "known_type", "known_item", "prefix")


def typing_findings(known: DataFrame, store: DataFrame) -> DataFrame:
    """B014: no record or ledger entry tells the type, or only references and no stored item;
    B010: a type without a receptacle."""
    untyped = finding(known.where(F.col("fact").isNull()), "B014", "error", F.col("first_target"), "only references: type unknown")
    homeless = finding(known.where("fact is not null and item_type is null"), "B010", "error", F.col("first_target"), "type has no receptacle")
    lone = known.where("item_type is not null and not has_complete").join(store.select(F.col("id").alias("item")).distinct(), "item", "left_anti")
    return untyped.union(homeless).union(finding(lone, "B014", "error", F.col("first_target"), "only references: no stored item"))


def merge_findings(records: DataFrame, known: DataFrame, attributes: DataFrame) -> DataFrame:
    """B020 names, B021 undeclared attributes, B022 attribute values, B023 statements, B027 reasons
    of gaps that differ within a concept. The first filled value is the one kept."""
    typed = known.where("item_type is not null").select("concept", "item", "item_type", F.col("name").alias("_name"), F.col("statement").alias("_statement"))
    rows = records.join(typed, "concept")
    done = rows.where(filled("type"))
    b020 = finding(done.where(~F.col("name").eqNullSafe(F.col("_name"))), "B020", "warn", F.col("item"), "names differ")
    b023 = finding(done.where(~F.col("statement").eqNullSafe(F.col("_statement"))).select("item").distinct(), "B023", "warn", F.col("item"), "statements differ")
    held = rows.select("concept", "item", F.col("item_type").alias("owner"), F.expr(TARGET).alias("target"), "seq", F.explode("attrs").alias("name", "value"))
    held = held.join(F.broadcast(attributes.select("owner", "name", F.lit(True).alias("declared"), "multi", "append")), ["owner", "name"], "left")
    b021 = finding(held.where("declared is null"), "B021", "warn", F.concat_ws(".", "target", "name"), "attribute not declared")
    single = held.where("declared and not multi and not append")
    first = single.where(filled("value")).groupBy("concept", "name").agg(F.struct(F.min("seq").alias("seq"), F.min_by("value", F.struct("seq", "value")).alias("value")).alias("first"))
    other = single.join(first, ["concept", "name"]).where((F.col("seq") > F.col("first.seq")) & (F.coalesce("value", F.lit("")) != F.col("first.value")))
    b022 = finding(other, "B022", "warn", F.concat_ws(".", "item", "name"), "attribute values differ")
    gaps = rows.select("concept", "item", "seq", F.explode("gaps").alias("name", "reason"))
    told = gaps.groupBy("concept", "name").agg(F.min_by("reason", "seq").alias("first"))
    b027 = finding(gaps.join(told, ["concept", "name"]).where(F.coalesce("reason", F.lit("")) != F.coalesce("first", F.lit(""))), "B027", "warn", F.concat_ws(".", "item", "name"), "reasons of a gap differ")
    return reduce(DataFrame.union, [b020, b021, b022, b023, b027])


def merged_gaps(records: DataFrame, known: DataFrame, stored: DataFrame) -> DataFrame:
    """item, name, reason: gaps that records declare, the first reason of a concept, and those of the
    store (item, name, reason), which win."""
    rows = records.join(known.where("item is not null").select("concept", "item"), "concept").select("item", "seq", F.explode("gaps").alias("name", "reason"))
    told = rows.groupBy("item", "name").agg(F.min_by("reason", "seq").alias("told"))
    both = told.join(stored.select("item", "name", F.col("reason").alias("kept"), F.lit(True).alias("has")), ["item", "name"], "full")
    return both.select("item", "name", F.when(F.col("has"), F.col("kept")).otherwise(F.col("told")).alias("reason"))


def resolved_refs(refs: DataFrame, known: DataFrame, store: DataFrame, endpoints: DataFrame) -> DataFrame:
    """refs with from, to (items), types, ``declared`` (relation in the vocabulary) and direction.
    The other end is a concept of the round or else the id of a stored item."""
    own = known.where("item is not null").select("concept", F.col("item").alias("src"), F.col("item_type").alias("src_type"))
    other = known.where("item is not null").select(F.col("concept").alias("to_name"), F.col("item").alias("_item"), F.col("item_type").alias("_type"))
    stored = store.groupBy("id").agg(F.min("type").alias("_stored"))
    rows = refs.withColumnRenamed("to", "to_name").join(own, "concept")
    rows = rows.join(F.broadcast(endpoints.select("rel").distinct().withColumn("declared", F.lit(True))), "rel", "left")
    rows = rows.join(other, "to_name", "left").join(stored.select(F.col("id").alias("to_name"), "_stored"), "to_name", "left")
    rows = rows.withColumns({"dst": F.coalesce("_item", F.when(F.col("_stored").isNotNull(), F.col("to_name"))), "dst_type": F.coalesce("_type", "_stored")}).drop("_item", "_type", "_stored")
    return orient(rows, endpoints)


def reference_findings(resolved: DataFrame, attributes: DataFrame) -> DataFrame:
    """B011 relation unknown, B012 other end unknown, B013 no direction fits, B024 attribute values
    of one edge differ, B026 both directions fit (one finding for each pair of types)."""
    at = F.expr(TARGET)
    b011 = finding(resolved.where("declared is null"), "B011", "error", at, "relation not in the vocabulary")
    known = resolved.where("declared")
    b012 = finding(known.where("dst is null"), "B012", "warn", at, "other end not in the store")
    ends = known.where("dst is not null")
    b013 = finding(ends.where("direction = 'neither'"), "B013", "error", at, "direction not declared")
    unsure = ends.where("direction = 'ambiguous'").select("rel", "src_type", "dst_type").distinct()
    b026 = finding(unsure, "B026", "warn", F.concat(F.col("rel"), F.lit(" "), F.col("src_type"), F.lit("→"), F.col("dst_type")), "both directions fit")
    edges = ends.where("direction <> 'neither'").select("rel", "from", "to", "seq", F.explode("attrs").alias("name", "value"))
    edges = edges.join(F.broadcast(attributes.select(F.col("owner").alias("rel"), "name", "multi")), ["rel", "name"]).where("not multi")
    first = edges.where(filled("value")).groupBy("rel", "from", "to", "name").agg(F.struct(F.min("seq").alias("seq"), F.min_by("value", F.struct("seq", "value")).alias("value")).alias("first"))
    other = edges.join(first, ["rel", "from", "to", "name"]).where((F.col("seq") > F.col("first.seq")) & (F.coalesce("value", F.lit("")) != F.col("first.value")))
    b024 = finding(other, "B024", "warn", F.concat_ws("-", "from", "rel", "to"), "attribute values of a relation differ")
    return reduce(DataFrame.union, [b011, b012, b013, b024, b026])


def ledger_findings(ledger: DataFrame, items: DataFrame) -> DataFrame:
    """B000 entries without a concept, B001 concepts that repeat (the first stands), W035 entries
    without an item, E029 entries whose item is not in the store. ledger: seq, concept, item."""
    b000 = finding(ledger.where(~filled("concept")), "B000", "error", F.concat(F.lit("ledger["), F.col("seq").cast("string"), F.lit("]")), "no concept")
    first = ledger.where(filled("concept")).groupBy("concept").agg(F.min("seq").alias("seq"), F.count("*").alias("n"), F.min_by("item", "seq").alias("item"))
    b001 = finding(first.where("n > 1").select("concept", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))).alias("k")), "B001", "error", F.col("concept"), "concept repeats")
    w035 = finding(first.where(~filled("item")), "W035", "warn", F.col("concept"), "maps to no item")
    e029 = finding(first.where(filled("item")).join(items.select(F.col("id").alias("item")).distinct(), "item", "left_anti"), "E029", "error", F.col("concept"), "item of the ledger not in the store")
    return reduce(DataFrame.union, [b000, b001, w035, e029])


def apply_proposal(ledger: DataFrame, new: DataFrame, assign: DataFrame, round_name: str) -> tuple[DataFrame, DataFrame]:
    """The ledger (concept, type, label, since, aliases) after a proposal, and its findings.

    ``new`` (seq, concept, type, label, aliases): concepts that are not there are added, the first of
    a name; known ones only give their aliases (B002, unless they came in this round and bring
    none). ``assign`` (seq, concept, aliases_add): aliases of known concepts, B003 for unknown."""
    none = F.array().cast("array<string>")
    b000 = finding(new.where(~filled("concept")), "B000", "error", F.lit("new"), "no concept").union(finding(assign.where(~filled("concept")), "B000", "error", F.lit("assign"), "no concept"))
    given = new.where(filled("concept"))
    known = ledger.select("concept", F.col("aliases").alias("held"), F.col("since").alias("held_since"))
    first = given.join(known.select("concept"), "concept", "left_anti").groupBy("concept").agg(
        F.min_by("type", "seq").alias("type"), F.coalesce(F.min_by("label", "seq"), F.col("concept")).alias("label"), F.coalesce(F.min_by("aliases", "seq"), none).alias("aliases"), F.min("seq").alias("first_seq")
    )
    added = first.select("concept", "type", "label", F.lit(round_name).alias("since"), "aliases")
    base = ledger.select("concept", "type", "label", "since", "aliases").union(added)
    # proposals of concepts that are known by then: their aliases are added, in order
    again = given.join(base.select("concept", F.col("aliases").alias("held"), F.col("since").alias("held_since")), "concept").join(first.select("concept", "first_seq"), "concept", "left")
    again = again.where("first_seq is null or seq > first_seq")
    fresh = F.size(F.array_except(F.coalesce("aliases", none), "held"))
    b002 = finding(again.where((fresh > 0) | (F.col("held_since") != round_name)), "B002", "warn", F.col("concept"), "concept already known")
    b003 = finding(assign.where(filled("concept")).join(base.select("concept"), "concept", "left_anti"), "B003", "error", F.col("concept"), "concept to assign to not known")
    more = again.select("concept", F.explode(F.coalesce("aliases", none)).alias("alias")).union(assign.select("concept", F.explode(F.coalesce("aliases_add", none)).alias("alias")))
    more = more.groupBy("concept").agg(F.collect_set("alias").alias("more"))
    after = base.join(more, "concept", "left").withColumn("aliases", F.array_sort(F.array_union("aliases", F.coalesce("more", none)))).drop("more")
    return after, reduce(DataFrame.union, [b000, b002, b003])


def contradiction_findings(positions: DataFrame, known: DataFrame, store: DataFrame, disputable: list[str], issue_type: str = "open-issue") -> DataFrame:
    """Findings of subjects with two or more filled statements: B015 the subject is an issue itself,
    B016 an item in dispute that cannot be disputed or is not there, B017 the subject came before.
    positions: entry (read order), subject, concept (of the position or null), statement."""
    entries = positions.groupBy("entry", "subject").agg(F.count_if(filled("statement")).alias("n")).where((F.col("n") >= 2) & filled("subject")).drop("n")
    stored = store.groupBy("id").agg(F.min("type").alias("stored_type"))
    names = known.where("item is not null").select(F.col("concept").alias("subject"), "item").join(stored.withColumnRenamed("id", "item"), "item", "left")
    types = known.where("item is not null").select(F.col("concept").alias("subject"), F.col("item_type").alias("built_type"))
    entries = entries.join(names, "subject", "left").join(types, "subject", "left").withColumn("item_type", F.coalesce("built_type", "stored_type")).drop("built_type", "stored_type")
    b015 = finding(entries.where(F.col("item_type") == issue_type), "B015", "warn", F.col("subject"), "subject is an issue")
    real = entries.where(~F.coalesce(F.col("item_type") == issue_type, F.lit(False)))
    first = real.groupBy("subject").agg(F.min("entry").alias("first"))
    b017 = finding(real.join(first, "subject").where("entry > first"), "B017", "warn", F.col("subject"), "subject came before")
    issue = F.concat(F.lit("iss-"), F.substring(F.sha2("subject", 256), 1, 12))
    own = positions.join(real.select("entry", "subject"), ["entry", "subject"]).select("entry", "subject", F.col("concept"))
    by_position = own.join(known.where("item is not null").select("concept", F.col("item").alias("target"), F.col("item_type").alias("target_type")), "concept").select("entry", "subject", "target", "target_type").distinct()
    by_subject = real.join(by_position.select("entry").distinct(), "entry", "left_anti").select("entry", "subject", F.col("item").alias("target"), F.col("item_type").alias("target_type"))
    targets = by_position.union(by_subject)
    b016 = finding(targets.where(F.col("target").isNull() | ~F.coalesce(F.col("target_type").isin(disputable), F.lit(False))), "B016", "warn", issue, "item in dispute cannot be disputed or is missing")
    return reduce(DataFrame.union, [b015, b016, b017])
