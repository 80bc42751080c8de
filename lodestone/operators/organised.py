"""The gate over the records of a round: rules that are checked while records can still be edited.

Tables as in ``build``, with anchors (file, anchor, kind, body, images array), scope (file, anchor,
kind, reason), cells (file, anchor, row, col, text; row 0 is the heading), and files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.build import TARGET, filled, orient
from lodestone.operators.checks import coverage_gate, finding

#: Kinds of a declaration out of scope, slots that a draft leaves, the length of a
#: drafted statement, how often a heading must repeat, and the shape of anchors in code.
SCOPE_KINDS = ("対象外", "未読取")
UNREAD = "未読取"
TODO = r"<TODO[^>]*>"
STATEMENT_LENGTH = (10, 200)
REPEAT = 4
CODE_ANCHOR, IMPORT_ANCHOR = r"^[mvitpj]\d+$", "i1"
NOT_FILE_CHUNKS = ("クラス:", "テストクラス:", "定数", "テスト")
MODULE_PREFIX = "c-mod-"


def _at(df: DataFrame, code: str, level: str, message: str, target: str = TARGET) -> DataFrame:
    return finding(df, code, level, F.expr(target), message)


def item_types(records: DataFrame, ledger: DataFrame, facts: DataFrame) -> DataFrame:
    """concept, item_type: by its records (the last that names a known type) or else the ledger."""
    own = records.where(filled("type")).join(F.broadcast(facts.select(F.col("fact").alias("type"), "item_type")), "type").groupBy("concept").agg(F.max_by("item_type", "seq").alias("own"))
    led = ledger.join(F.broadcast(facts.select(F.col("fact").alias("type"), "item_type")), "type").select("concept", F.col("item_type").alias("led"))
    return own.join(led, "concept", "full").select("concept", F.coalesce("own", "led").alias("item_type"))


def shape_findings(records: DataFrame, scope: DataFrame) -> DataFrame:
    """G006 required fields (concept, anchor; type, name and statement all or none; a gap's and a
    declaration's reason), G008 fields beside the known ones (``extra`` array), G011 kinds of
    declarations, G000 references without relation or end (``refs`` array of struct rel, to)."""
    some = filled("type") | filled("name") | filled("statement")
    every = filled("type") & filled("name") & filled("statement")
    g006 = _at(records.where(~filled("concept") | ~filled("anchor") | (some & ~every)), "G006", "error", "required field missing")
    reasons = records.select("file", "anchor", F.explode("gaps").alias("gap", "reason"))
    g006 = g006.union(_at(reasons.where(~filled("reason")), "G006", "error", "a gap has no reason")).union(_at(scope.where(~filled("reason")), "G006", "error", "declaration has no reason"))
    g008 = _at(records.where(F.size("extra") > 0), "G008", "warn", "unknown fields in a record")
    g011 = _at(scope.where(~F.coalesce("kind", F.lit(SCOPE_KINDS[0])).isin(*SCOPE_KINDS)), "G011", "error", "kind of a declaration not known")
    refs = records.select("file", "anchor", F.explode("refs").alias("r"))
    g000 = _at(refs.where(~filled("r.rel") | ~filled("r.to")), "G000", "error", "reference without relation or end")
    return reduce(DataFrame.union, [g006, g008, g011, g000])


def vocabulary_findings(records: DataFrame, refs: DataFrame, facts: DataFrame, attributes: DataFrame, relations: DataFrame) -> DataFrame:
    """G002 types and relations outside the vocabulary, G016 undeclared attributes (one finding for
    a record or reference), G028 values outside closed lists, of records and of references."""
    typed = records.join(F.broadcast(facts.select(F.col("fact").alias("type"), F.col("item_type").alias("owner"))), "type", "left")
    g002 = _at(typed.where(filled("type") & F.col("owner").isNull()), "G002", "error", "type not in the vocabulary")
    names = F.broadcast(relations.select("rel", F.lit(True).alias("declared")).distinct())
    linked = refs.join(names, "rel", "left")
    g002 = g002.union(_at(linked.where("declared is null"), "G002", "error", "relation not in the vocabulary"))
    held = typed.where("owner is not null").select("file", "anchor", "seq", "owner", F.lit("").alias("to"), "attrs").union(linked.where("declared").select("file", "anchor", "seq", F.col("rel").alias("owner"), "to", "attrs"))
    held = held.select("file", "anchor", "seq", "owner", "to", F.explode("attrs").alias("name", "value"))
    held = held.join(F.broadcast(attributes.select("owner", "name", F.lit(True).alias("known"), "kind", "values", "extensible")), ["owner", "name"], "left")
    g016 = _at(held.where("known is null").select("file", "anchor", "seq", "owner", "to").distinct(), "G016", "warn", "undeclared attribute")
    g028 = _at(held.where("known and kind = 'enum' and not extensible and not array_contains(values, value)"), "G028", "warn", "value not declared", f"concat_ws('.', {TARGET}, owner, name)")
    return reduce(DataFrame.union, [g002, g016, g028])


def concept_findings(records: DataFrame, refs: DataFrame, ledger: DataFrame, new: DataFrame, assign: DataFrame, facts: DataFrame) -> DataFrame:
    """G003 ends and assignments that no record, proposal or ledger entry names; G013 concepts that
    only references name, at their first record; G002 and G021 of the proposal."""
    known = records.select("concept").union(ledger.select("concept")).union(new.select("concept")).where(filled("concept")).distinct()
    g003 = _at(refs.join(known.select(F.col("concept").alias("to")), "to", "left_anti"), "G003", "error", "concept does not exist")
    g003 = g003.union(finding(assign.join(known, "concept", "left_anti"), "G003", "error", F.coalesce("concept", F.lit("")), "concept to assign to does not exist"))
    defining = records.where(filled("type")).select("concept").union(ledger.where(filled("type")).select("concept")).distinct()
    lone = records.where(~filled("type")).join(defining, "concept", "left_anti").groupBy("concept").agg(F.min(F.expr(TARGET)).alias("at"))
    g013 = finding(lone, "G013", "error", F.col("at"), "only references")
    g002 = finding(new.where(filled("type")).join(F.broadcast(facts.select(F.col("fact").alias("type"))), "type", "left_anti"), "G002", "error", F.col("concept"), "type of a proposal not in the vocabulary")
    g021 = finding(assign.where(filled("concept")).join(ledger.select("concept"), "concept", "left_anti"), "G021", "error", F.col("concept"), "concept to assign to not in the ledger")
    return reduce(DataFrame.union, [g003, g013, g002, g021])


def proposal_findings(proposed: DataFrame, types: DataFrame, facts: DataFrame) -> DataFrame:
    """G007: proposed types (name, status, deferred_reason) that the vocabulary does not have: an
    error, or a warning when they are deferred with a reason."""
    open_ = proposed.where(filled("name")).join(types.select("name"), "name", "left_anti").join(facts.select(F.col("fact").alias("name")), "name", "left_anti")
    deferred = F.coalesce(F.col("status") == "deferred", F.lit(False)) & filled("deferred_reason")
    return finding(open_, "G007", F.when(deferred, "warn").otherwise("error"), F.col("name"), "proposal not approved")


def pair_findings(records: DataFrame, refs: DataFrame, types: DataFrame, endpoints: DataFrame) -> DataFrame:
    """G012: a relation whose types fit neither direction. Unknown ends and relations are others' business."""
    own = types.select("concept", F.col("item_type").alias("src_type"))
    other = types.select(F.col("concept").alias("to"), F.col("item_type").alias("dst_type"))
    named = refs.join(F.broadcast(endpoints.select("rel").distinct()), "rel").join(own, "concept").join(other, "to").withColumnRenamed("to", "dst").withColumn("src", F.col("concept"))
    return _at(orient(named, endpoints).where("direction = 'neither'"), "G012", "error", "relation does not fit its ends")


def requirement_findings(records: DataFrame, refs: DataFrame, types: DataFrame, facts: DataFrame, needed: DataFrame, attributes: DataFrame, relations: DataFrame) -> DataFrame:
    """G020 a needed relation (needed: item_type, rel) that neither references nor gaps of the concept
    name, at its first complete record; G031 gaps that name nothing (error) or are filled (warn)."""
    fact_type = F.broadcast(facts.select(F.col("fact").alias("type"), "item_type"))
    written = refs.select("concept", "rel").distinct()
    gaps = records.select("concept", "file", "anchor", "seq", "type", F.explode("gaps").alias("rel", "reason"))
    mapped = gaps.join(fact_type, "type")
    names = relations.select("rel").distinct()
    g031 = _at(mapped.join(F.broadcast(names), "rel", "left_anti").join(F.broadcast(attributes.select(F.col("owner").alias("item_type"), F.col("name").alias("rel"))), ["item_type", "rel"], "left_anti"), "G031", "error", "gap of an unknown name", f"concat_ws('.', {TARGET}, rel)")
    first = gaps.groupBy("concept", "rel").agg(F.min_by(F.expr(TARGET), "seq").alias("at"))
    g031 = g031.union(finding(first.join(written, ["concept", "rel"]), "G031", "warn", F.concat_ws(".", "at", "rel"), "declared gap is filled"))
    speaker = records.where(filled("type")).groupBy("concept").agg(F.min_by("type", "seq").alias("type"), F.min_by(F.expr(TARGET), "seq").alias("at")).join(fact_type, "type")
    want = speaker.join(F.broadcast(needed), "item_type").join(written, ["concept", "rel"], "left_anti").join(gaps.select("concept", "rel").distinct(), ["concept", "rel"], "left_anti")
    return g031.union(finding(want, "G020", "warn", F.concat_ws(".", "at", "rel"), "needed relation not written"))


def wording_findings(records: DataFrame, drafted: DataFrame) -> DataFrame:
    """G026 slots that a draft left; G027 drafted statements (files in ``drafted``) out of length, or
    without the identifier that names the record."""
    hole = F.col("name").rlike(TODO) | F.col("statement").rlike(TODO) | F.exists(F.map_values("attrs"), lambda x: x.rlike(TODO))
    g026 = _at(records.where(F.coalesce(hole, F.lit(False))), "G026", "error", "slot left open")
    low, high = STATEMENT_LENGTH
    ident = F.substring_index("name", ".", -1)
    lost = F.col("name").rlike(r"^[A-Za-z_][\w.]*$") & (ident != "") & ~F.contains(F.col("statement"), ident)
    own = records.where(filled("type")).join(F.broadcast(drafted.select("file").distinct()), "file", "left_semi").where(~F.col("statement").rlike(TODO))
    return g026.union(_at(own.where(~F.length("statement").between(low, high) | lost), "G027", "warn", "drafted text out of range"))


def code_findings(records: DataFrame, refs: DataFrame, types: DataFrame, facts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Conventions of records from code: G022 calls from an import to a method, G023 methods with
    double underscores, G024 a package that is not on the file's path and not explained, G025 a
    module whose source is a part of its file."""
    code = F.col("anchor").rlike(CODE_ANCHOR)
    methods = types.where("item_type = 'method'").select(F.col("concept").alias("to"))
    g022 = _at(refs.where(code & (F.col("anchor") == IMPORT_ANCHOR) & (F.col("rel") == "calls")).join(methods, "to", "left_semi"), "G022", "warn", "import calls a method")
    own = records.where(code).join(F.broadcast(facts.select(F.col("fact").alias("type"), "item_type")), "type")
    called = F.when(filled("name"), F.col("name")).otherwise(F.col("concept"))
    g023 = _at(own.where((F.col("item_type") == "method") & called.rlike(r"__\w+__$")), "G023", "warn", "special method raised")
    attr = lambda k: F.coalesce(F.try_element_at("attrs", F.lit(k)), F.lit(""))
    path = F.concat(F.lit("."), F.expr(f"substr(concept, {len(MODULE_PREFIX) + 1})"), F.lit("."))
    module = own.where("item_type = 'module'")
    off = module.where(F.col("concept").startswith(MODULE_PREFIX) & (attr("package") != "") & (attr("description") == "") & ~F.contains(path, F.concat(F.lit("."), attr("package"), F.lit("."))))
    g024 = _at(off, "G024", "warn", "package not on the file's path")
    head = F.substring_index("body", "\n", 1)
    part = module.where(filled("type") & (attr("class_name") == "")).join(anchors.select("file", "anchor", "body"), ["file", "anchor"]).where(reduce(lambda a, b: a | b, [head.startswith(x) for x in NOT_FILE_CHUNKS]))
    return reduce(DataFrame.union, [g022, g023, g024, _at(part, "G025", "warn", "module sourced from a part of its file")])


def description_findings(records: DataFrame, refs: DataFrame, facts: DataFrame, attributes: DataFrame, relations: DataFrame) -> DataFrame:
    """Headings inside descriptions (``head value / head value``): G029 two or more name declared
    fields of which one is empty, counted by file and owner; G030 the first heading is no field and
    opens REPEAT or more descriptions of an owner."""
    own = records.join(F.broadcast(facts.select(F.col("fact").alias("type"), F.col("item_type").alias("owner"))), "type").select("file", "anchor", "seq", "owner", F.lit(False).alias("edge"), F.lit("").alias("to"), "attrs", F.try_element_at("attrs", F.lit("description")).alias("told"))
    edge = refs.join(F.broadcast(relations.select("rel").distinct()), "rel").select("file", "anchor", "seq", F.col("rel").alias("owner"), F.lit(True).alias("edge"), "to", "attrs", F.col("note").alias("told"))
    rows = own.union(edge).withColumn("segments", F.filter(F.transform(F.split(F.coalesce("told", F.lit("")), "[／/｜|、]"), lambda x: F.trim(x)), lambda x: x != ""))
    heads = F.filter(F.transform("segments", lambda x: F.struct(F.trim(F.element_at(F.split(x, "[ 　:：=＝]", 2), 1)).alias("head"), x.alias("all"))), lambda s: (s["head"] != "") & (s["head"] != s["all"]))
    rows = rows.withColumn("heads", F.transform(heads, lambda s: s["head"])).where(F.size("heads") > 0)
    fields = attributes.select("owner", F.explode(F.array_distinct(F.array("name", F.coalesce("label", "name")))).alias("head"), "name").dropDuplicates(["owner", "head"])
    key = ["file", "anchor", "seq", "owner", "edge", "to"]
    named = rows.select(*key, "attrs", F.explode("heads").alias("head")).join(F.broadcast(fields), ["owner", "head"]).where("name <> 'description'")
    empty = F.coalesce(F.try_element_at("attrs", F.col("name")), F.lit("")) == ""
    escaped = named.groupBy(*key).agg(F.count("*").alias("n"), F.bool_or(empty).alias("open")).where("n >= 2 and open")
    g029 = finding(escaped.groupBy("file", "owner").agg(F.count("*").alias("n")), "G029", "warn", F.concat_ws("#", "file", "owner"), "declared field in a description")
    lead = rows.select("owner", "edge", F.get("heads", F.lit(0)).alias("head")).join(F.broadcast(fields.select("owner", "head")), ["owner", "head"], "left_anti")
    many = lead.groupBy("owner", "edge", "head").agg(F.count("*").alias("n")).where(F.col("n") >= REPEAT)
    return g029.union(finding(many, "G030", "warn", F.concat_ws("#", "owner", "head"), "heading of descriptions has no field"))


def column_findings(records: DataFrame, cells: DataFrame, facts: DataFrame, attributes: DataFrame) -> DataFrame:
    """G018: the source row that a record names has a filled cell in a column bound to an attribute
    (attributes.column) that the record leaves out. The row is the one whose first cell ends the
    record's name at a word's edge; several or none: no finding."""
    bound = attributes.where(filled("column")).select(F.col("owner").alias("item_type"), F.col("name").alias("attribute"), F.col("column").alias("heading"))
    own = records.join(F.broadcast(facts.select(F.col("fact").alias("type"), "item_type")), "type").join(F.broadcast(bound.select("item_type").distinct()), "item_type", "left_semi")
    first = cells.where("row > 0 and col = 0").select("file", "anchor", "row", F.col("text").alias("key"))
    hit = own.join(first, ["file", "anchor"]).where(filled("key") & F.col("name").endswith(F.col("key")))
    before = F.expr("substr(name, length(name) - length(key), 1)")
    hit = hit.where((F.col("name") == F.col("key")) | ~before.rlike(r"[\p{L}\p{N}_]"))
    unique = hit.groupBy("file", "anchor", "seq").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    one = hit.join(unique, ["file", "anchor", "seq"])
    heading = cells.where("row = 0").select("file", "anchor", "col", F.col("text").alias("heading"))
    value = cells.where("row > 0").select("file", "anchor", "row", "col", F.col("text").alias("value")).join(heading, ["file", "anchor", "col"])
    lost = one.join(value, ["file", "anchor", "row"]).join(F.broadcast(bound), ["item_type", "heading"]).where(filled("value") & (F.coalesce(F.try_element_at("attrs", F.col("attribute")), F.lit("")) == ""))
    return _at(lost, "G018", "warn", "source column filled, attribute missing", f"concat_ws('.', {TARGET}, attribute)")


def image_findings(scope: DataFrame, anchors: DataFrame) -> DataFrame:
    """G015: declared unread although the file has images and the reason names none of them."""
    names = anchors.select("file", F.explode("images").alias("image")).select("file", F.substring_index("image", "/", -1).alias("name")).groupBy("file").agg(F.collect_set("name").alias("names"))
    told = scope.where(F.col("kind") == UNREAD).join(names, "file")
    return _at(told.where(~F.exists("names", lambda n: F.contains(F.coalesce(F.col("reason"), F.lit("")), n))), "G015", "warn", "images not named in the reason")


def drift_findings(pinned: DataFrame, present: DataFrame, amended: DataFrame) -> DataFrame:
    """G009: files (file, hash) of a frozen round that changed, went or came, but for amended ones."""
    both = pinned.select("file", F.col("hash").alias("was")).join(present.select("file", F.col("hash").alias("now")), "file", "full")
    bad = both.where(~F.col("was").eqNullSafe(F.col("now"))).join(F.broadcast(amended.select("file").distinct()), "file", "left_anti")
    return finding(bad, "G009", "error", F.col("file"), "frozen result edited")


def source_drift(captured: DataFrame, present: DataFrame) -> DataFrame:
    """G019: sources (path, hash) that changed or went since they were read; new ones say nothing."""
    both = captured.select("path", F.col("hash").alias("was")).join(present.select("path", F.col("hash").alias("now")), "path", "left")
    return finding(both.where(~F.col("was").eqNullSafe(F.col("now"))), "G019", "warn", F.col("path"), "source changed since it was read")


def file_findings(files: DataFrame, parsed: DataFrame, reserved: list[str]) -> DataFrame:
    """G032: a file whose name begins with an underscore and is neither reserved nor has a source.
    ``files``: file (path without its ending)."""
    stem = F.substring_index("file", "/", -1)
    odd = files.where(stem.startswith("_") & (F.instr("file", "/") == 0) & ~stem.isin(reserved)).join(parsed.select("file").distinct(), "file", "left_anti")
    return finding(odd, "G032", "warn", F.col("file"), "name is not reserved")


def round_findings(records: DataFrame, rounds: DataFrame) -> DataFrame:
    """G010: sources that name a round which is not there (records: round, file, anchor)."""
    return _at(records.join(F.broadcast(rounds.select("round").distinct()), "round", "left_anti"), "G010", "error", "round does not exist")


def metrics(records: DataFrame, anchors: DataFrame, scope: DataFrame) -> DataFrame:
    """One row: files, anchors, records, references, out of scope, unread, unclaimed, declared gaps."""
    claimed = records.select("file", "anchor").union(scope.select("file", "anchor")).distinct()
    a = anchors.agg(F.count_distinct("file").alias("parsed_files"), F.count("*").alias("anchors"))
    r = records.agg(F.count("*").alias("records"), F.count_if(~filled("type")).alias("references"), F.coalesce(F.sum(F.size(F.map_keys("gaps"))), F.lit(0)).cast("long").alias("known_gaps"))
    s = scope.agg(F.count("*").alias("out_of_scope"), F.count_if(F.col("kind") == UNREAD).alias("unreadable"))
    u = anchors.join(claimed, ["file", "anchor"], "left_anti").agg(F.count("*").alias("unclaimed"))
    return reduce(lambda x, y: x.join(F.broadcast(y)), [a, r, s, u])  # one row each


def subset(findings: DataFrame, path: str) -> DataFrame:
    """The findings of one file: those whose target lies in it."""
    return findings.where((F.col("target") == path) | F.col("target").startswith(f"{path}#"))


def gate(records: DataFrame, refs: DataFrame, anchors: DataFrame, scope: DataFrame, ledger: DataFrame, new: DataFrame, assign: DataFrame, facts: DataFrame, attributes: DataFrame, endpoints: DataFrame, needed: DataFrame) -> DataFrame:
    """All findings of a round in one table: coverage, shape, vocabulary, concepts, pairs, requirements,
    wording and images. With ``metrics`` this is the report of a gate; ``subset`` is that of one file."""
    types = item_types(records, ledger, facts)
    parts = [
        coverage_gate(anchors, records, scope),
        shape_findings(records, scope),
        vocabulary_findings(records, refs, facts, attributes, endpoints),
        concept_findings(records, refs, ledger, new, assign, facts),
        pair_findings(records, refs, types, endpoints),
        requirement_findings(records, refs, types, facts, needed, attributes, endpoints),
        wording_findings(records, records.select("file").limit(0)),
        image_findings(scope, anchors),
    ]
    return reduce(DataFrame.union, parts)


def freeze(files: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """The manifest of a frozen round: file, hash (first 12 digits) and the amendments (file, reason) of
    the manifest before, which stay."""
    pinned = files.select("file", F.substring(F.sha2("content", 256), 1, 12).alias("hash"))
    if previous is None:
        return pinned.withColumn("amendment", F.lit(None).cast("string"))
    return pinned.join(previous.select("file", "amendment"), "file", "left")
