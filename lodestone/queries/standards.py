"""Vocabulary, conformance, derived items and audits of printed reports on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import audit, conformance, vocabulary
from lodestone.queries.registry import query

LAYERS, RESERVED = ["SMALL", "ECONOMY", "PROMO"], ["id", "type", "status"]
_LAYERS_SQL, _RESERVED_SQL = "('SMALL', 'ECONOMY', 'PROMO')", "('id', 'type', 'status')"
_S = "array<string>"


def _words(t):
    """Parts as types and relations, suppliers as their attributes, nations as groups."""
    p, k, s = t("part"), F.col("p_partkey"), F.col("s_suppkey")
    pick = lambda at, *names: F.element_at(F.array(*(F.lit(n).cast("string") for n in names)), (at % len(names) + 1).cast("int"))
    types = p.select(
        k.alias("seq"), F.concat(F.lit("t"), k).alias("name"), F.when(k % 13 != 0, F.col("p_type")).alias("layer"), F.when(k % 3 == 0, F.concat(F.lit("x"), k % 600)).otherwise("").alias("id_prefix"),
        F.when(k % 4 == 0, F.concat(F.lit("a"), k % 10)).alias("seq_attribute"), F.when(k % 5 == 0, F.lit("a1")).alias("seq_by"), F.when(k % 7 == 0, F.lit("nope")).alias("seq_prefix_from"), F.when(k % 6 == 0, F.concat(F.lit("r"), k % 40)).alias("upstream"),
    )
    attributes = t("supplier").select(
        F.concat(F.lit("t"), s).alias("owner"), pick(s, "a0", "a1", "a2", "status", "a4").alias("name"), pick(s, "string", "enum", "int", "list", "bool", "enum").alias("kind"),
        F.when(s % 4 == 1, F.array(F.lit("v"), F.lit("w"))).otherwise(F.array().cast(_S)).alias("values"), (s % 9 == 0).alias("multi"), F.when(s % 8 == 0, "(a").when(s % 8 == 1, "a+").otherwise("").alias("pattern"), (s % 2 == 0).alias("extensible"),
    )
    relations = t("nation").select(
        F.concat(F.lit("r"), "n_nationkey").alias("name"), F.when(F.col("n_nationkey") % 5 == 0, F.array().cast(_S)).otherwise(F.array(F.concat(F.lit("t"), F.col("n_nationkey") * 6), F.lit("ghost"))).alias("from"), F.array(F.lit("t1")).alias("to"),
        F.create_map(F.when(F.col("n_nationkey") % 4 == 0, "side").otherwise("from"), F.when(F.col("n_nationkey") % 3 == 0, "1").when(F.col("n_nationkey") % 3 == 1, "0..*").otherwise("1..12")).alias("cardinality"),
    )
    groups = t("region").select(F.when(F.col("r_regionkey") == 0, "t3").otherwise(F.col("r_name")).alias("name"), F.array(F.concat(F.lit("t"), "r_regionkey"), F.lit("nobody")).alias("members"))
    facts = t("supplier").select(s.alias("seq"), F.concat(F.lit("t"), s).alias("owner"), F.concat(F.lit("f"), s % 60).alias("fact"), F.create_map(pick(s, "a0", "a1"), pick(s, "v", "q", "w")).alias("fixed"))
    return types, attributes, relations, groups, facts


_WORDS = f"""with ty as (select p_partkey as seq, 't' || p_partkey as name, case when p_partkey % 13 <> 0 then p_type end as layer, case when p_partkey % 3 = 0 then 'x' || (p_partkey % 600) else '' end as prefix, case when p_partkey % 4 = 0 then 'a' || (p_partkey % 10) end as sa,
  case when p_partkey % 5 = 0 then 'a1' end as sb, case when p_partkey % 7 = 0 then 'nope' end as sp, case when p_partkey % 6 = 0 then 'r' || (p_partkey % 40) end as up from part),
 at as (select 't' || s_suppkey as owner, (['a0', 'a1', 'a2', 'status', 'a4'])[(s_suppkey % 5 + 1)::int] as name, (['string', 'enum', 'int', 'list', 'bool', 'enum'])[(s_suppkey % 6 + 1)::int] as kind, case when s_suppkey % 4 = 1 then ['v', 'w'] else [] end as vals,
  s_suppkey % 9 = 0 as multi, case when s_suppkey % 8 = 0 then '(a' when s_suppkey % 8 = 1 then 'a+' else '' end as pattern, s_suppkey % 2 = 0 as ext from supplier),
 re as (select n_nationkey as k, 'r' || n_nationkey as name, case when n_nationkey % 5 = 0 then [] else ['t' || (n_nationkey * 6), 'ghost'] end as f from nation),
 gr as (select case when r_regionkey = 0 then 't3' else r_name end as name, unnest(['t' || r_regionkey, 'nobody']) as member from region),
 fa as (select s_suppkey as seq, 't' || s_suppkey as owner, 'f' || (s_suppkey % 60) as fact, (['a0', 'a1'])[(s_suppkey % 2 + 1)::int] as name, (['v', 'q', 'w'])[(s_suppkey % 3 + 1)::int] as value from supplier)
 select 'M001' as code, name as target from ty where layer is null or layer not in {_LAYERS_SQL}
 union all select 'M002', name from (select distinct name from gr) where name in (select name from ty) union all select 'M003', 'item_groups.' || name from gr where member not in (select name from ty)
 union all select 'M003', name from (select name, unnest(f) as m from re) where m not in (select name from ty) union all select 'M003', name from re where 't1' not in (select name from ty)
 union all select 'M004', name from ty where sa is not null and (name, sa) not in (select (owner, name) from at) union all select 'M005', name from ty where sb is not null and (name, sb) not in (select (owner, name) from at)
 union all select 'M006', name from ty where sp is not null
 union all select 'M007', ty.name from ty left join re on re.name = ty.up where up is not null and (re.name is null or (len(f) > 0 and not list_contains(f, ty.name)))
 union all select 'M008', name from re where k % 4 = 0 or k % 3 = 0 union all select 'M009', owner || '.' || name from at where name in {_RESERVED_SQL}
 union all select 'M010', owner || '.' || name from at where kind = 'list' union all select 'M010', owner || '.' || name from at where kind = 'enum' and len(vals) = 0
 union all select 'M011', owner || '.' || name from at where multi and kind <> 'enum' union all select 'M011', owner || '.' || name from at where pattern <> '' and kind <> 'string'
 union all select 'M012', name from (select *, min(seq) over (partition by prefix) as first_seq from ty where prefix <> '') where seq > first_seq
 union all select 'M013', owner || '.' || name from at where pattern = '(a'
 union all select 'M020', owner || '.' || fact from (select *, min(seq) over (partition by fact) as first_seq from fa) where seq > first_seq
 union all select 'M021', fa.owner || '.' || fact || '.' || fa.name from fa left join at on at.owner = fa.owner and at.name = fa.name where at.name is null or (kind = 'enum' and not ext and not list_contains(vals, value))""".replace(" at ", " ats ").replace(" at.", " ats.").replace("from at)", "from ats)").replace("=at.", "=ats.")


@query(_WORDS)
def vocabulary_findings(t, spark):
    """Faults of a declared vocabulary."""
    return vocabulary.vocabulary_findings(*_words(t), LAYERS, RESERVED).select("code", "target")


@query("""with b as (select 't' || p_partkey as name from part), o as (select 't' || (p_partkey * 2) as name, p_partkey % 5 = 0 as removed from part),
 br as (select 'r' || n_nationkey as name, n_nationkey as k from nation),
 ba as (select 't' || s_suppkey as owner, s_suppkey as s, s_suppkey % 2 = 0 as req, s_suppkey % 3 = 0 as uni, s_suppkey % 5 <> 0 as is_enum, case when s_suppkey % 7 = 0 then false end as ext from supplier)
 select 'M101' as code, name as target from o where removed and name in (select name from b)
 union all select 'M102', name from br where k % 6 = 0 union all select 'M103', name from br where k % 6 <> 0 and k % 4 = 1
 union all select 'M110', owner || '.a' from ba where req and s % 4 = 0 union all select 'M110', owner || '.a' from ba where uni and s % 6 = 0
 union all select 'M111', owner || '.a' from ba where is_enum and s % 8 = 3 union all select 'M112', owner || '.a' from ba where ext = false and s % 3 = 1""")
def overlay_findings(t, spark):
    """What an overlay takes away or loosens."""
    p, n, s = F.col("p_partkey"), F.col("n_nationkey"), F.col("s_suppkey")
    none = lambda c, v: F.when(c, v)
    bt = t("part").select(F.concat(F.lit("t"), p).alias("name"))
    ot = t("part").select(F.concat(F.lit("t"), p * 2).alias("name"), (p % 5 == 0).alias("removed"))
    both = F.array(F.lit("x"), F.lit("y"))
    br = t("nation").select(F.concat(F.lit("r"), n).alias("name"), both.alias("from"), both.alias("to"))
    orl = t("nation").select(F.concat(F.lit("r"), n).alias("name"), (n % 6 == 0).alias("removed"), none(n % 4 == 1, F.array(F.lit("x"))).alias("from"), none(n % 4 == 2, F.array(F.lit("z"), F.lit("y"), F.lit("x"))).alias("to"))
    sup = t("supplier")
    ba = sup.select(F.concat(F.lit("t"), s).alias("owner"), F.lit("a").alias("name"), (s % 2 == 0).alias("required"), (s % 3 == 0).alias("unique"), F.when(s % 5 != 0, "enum").otherwise("string").alias("kind"), both.alias("values"), none(s % 7 == 0, F.lit(False)).alias("extensible"))
    oa = sup.select(F.concat(F.lit("t"), s).alias("owner"), F.lit("a").alias("name"), none(s % 4 == 0, F.lit(False)).alias("required"), none(s % 6 == 0, F.lit(False)).alias("unique"), none(s % 8 == 3, F.array(F.lit("y"))).alias("values"), none(s % 3 == 1, F.lit(True)).alias("extensible"))
    return vocabulary.overlay_findings(bt, br, ba, ot, orl, oa).select("code", "target")


@query("""select coalesce(b.k, o.k) as k, coalesce(o.label, b.label) as label, coalesce(o.layer, b.layer) as layer from (select p_partkey as k, p_name as label, p_type as layer from part where p_partkey % 3 <> 0) b
 full join (select p_partkey as k, case when p_partkey % 2 = 0 then upper(p_name) end as label, p_brand as layer from part where p_partkey % 4 <> 0) o on b.k = o.k""")
def merged_vocabulary(t, spark):
    """A vocabulary with an overlay laid over it."""
    p = F.col("p_partkey")
    base = t("part").where(p % 3 != 0).select(p.alias("k"), F.col("p_name").alias("label"), F.col("p_type").alias("layer"))
    over = t("part").where(p % 4 != 0).select(p.alias("k"), F.when(p % 2 == 0, F.upper("p_name")).alias("label"), F.col("p_brand").alias("layer"))
    return vocabulary.merged(base, over, ["k"])


@query("""with a as (select s_name as pack, 1 + s_suppkey % 3 as v, sha256(s_name) as h, s_suppkey as k from supplier where s_suppkey % 5 <> 0), b as (select s_name as pack, 1 + (s_suppkey + case when s_suppkey % 7 = 0 then 1 else 0 end) % 3 as v, sha256(s_name || case when s_suppkey % 11 = 0 then 'x' else '' end) as h, s_suppkey as k from supplier where s_suppkey % 6 <> 0)
 select 'C002' as code, 'warn' as level, coalesce(a.pack, b.pack) as target from a full join b using (pack) where a.k is null or b.k is null or a.v <> b.v or a.h <> b.h
 union all select 'C001', 'error', 'pack.lock' union all select 'C011', 'error', 'p1' union all select 'C010', 'error', 'p9'""")
def pack_findings(t, spark):
    """Packs against their lock, and chains that end in nothing or in themselves."""
    s = F.col("s_suppkey")
    row = lambda v, h: t("supplier").select(F.col("s_name").alias("pack"), (1 + v % 3).cast("string").alias("version"), F.sha2(h, 256).alias("content_hash"), s.alias("k"))
    locked = row(s, F.col("s_name")).where("k % 5 <> 0").drop("k")
    now = row(s + F.when(s % 7 == 0, 1).otherwise(0), F.concat("s_name", F.when(s % 11 == 0, "x").otherwise(""))).where("k % 6 <> 0").drop("k")
    packs = spark.createDataFrame([("p1", "p2"), ("p2", "p1"), ("p3", "p9"), ("p4", None)], "name string, extends string")
    chains = [f for start in ("p1", "p3", "p4") for f in conformance.pack_chain(packs, start)[1]]
    out = conformance.pack_lock(locked, now).union(conformance.pack_lock(locked.limit(0), now, frozen=True)).union(spark.createDataFrame(chains, "level string, code string, target string, message string"))
    return out.select("code", "level", "target")


def _store(t):
    c = F.col("c_custkey")
    items = t("customer").select(F.concat(F.lit("c"), c).alias("id"), F.when(c % 3 == 0, "rule").otherwise("need").alias("type"), F.when(c % 10 == 0, "deprecated").when(c % 2 == 0, "approved").otherwise("review").alias("status"), F.create_map(F.lit("owner"), F.when(c % 7 == 0, "").otherwise(F.col("c_mktsegment")), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("attrs"))
    o = t("orders")
    relations = o.select(F.lit("realizes").alias("type"), F.concat(F.lit("c"), "o_custkey").alias("from"), F.concat(F.lit("o"), "o_orderkey").alias("to"), F.when(F.col("o_orderkey") % 3 == 0, "approved").when(F.col("o_orderkey") % 3 == 1, "review").alias("status"))
    return items, relations


_STORE = """with it as (select c_custkey as k, 'c' || c_custkey as id, case when c_custkey % 3 = 0 then 'rule' else 'need' end as type, case when c_custkey % 10 = 0 then 'deprecated' when c_custkey % 2 = 0 then 'approved' else 'review' end as status, case when c_custkey % 7 = 0 then '' else c_mktsegment end as owner, c_nationkey as nation from customer) """


@query(_STORE + """select 'C201' as code, 'error' as level, id || '.owner' as target from it where type = 'need' and status = 'approved' and owner = ''
 union all select 'C201', 'warn', id || '.reason' from it where type = 'rule' and nation in (1, 2)
 union all select 'C202', 'warn', id || '.realizes' from it where type = 'need' and status in ('approved', 'review') and k not in (select o_custkey from orders)
 union all select 'C203', 'error', id from it where status <> 'approved' union all select 'C203', 'error', 'c' || o_custkey || '-realizes-o' || o_orderkey from orders where o_orderkey % 3 = 1
 union all select 'C204', 'error', 'absent'
 union all select 'C205', 'warn', 'Book「Rules」' from (select count(*) as n, count(distinct owner || nation) from it) where false
 union all select 'C205', 'warn', 'Book「Needs」' from (select count(*) as n, count(distinct id) as g from it where type = 'need' and status <> 'deprecated') where n >= 6 and g >= 2 and n < 2 * g""")
def conformance_findings(t, spark):
    """Declared rules on states, relations, baselines, documents and section sizes."""
    items, relations = _store(t)
    parts = [
        conformance.attribute_rules(items, [{"type": "need", "attribute": "owner", "when_status": ["approved"], "level": "error"}, {"type": "rule", "attribute": "reason", "where": {"nation": ["1", "2"]}}]),
        conformance.trace_rules(items, relations, [{"type": "need", "relation": "realizes", "when_status": ["approved", "review"]}]),
        conformance.baseline(items, relations, "approved"),
        conformance.required_documents(spark.createDataFrame([("book",)], "name string"), spark.createDataFrame([("book",), ("absent",)], "name string")),
        conformance.section_sizes(items, [{"title": "Book", "heading": "Rules", "type": "rule", "group_by": "nation"}, {"title": "Book", "heading": "Needs", "type": "need", "group_by": "id"}]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("code", "level", "target")


@query("""with d as (select p_partkey as seq, case when p_partkey % 41 = 0 then '' else 'd' || (p_partkey - case when p_partkey % 20 = 10 then 10 else 0 end) end as id, case when p_partkey % 13 = 0 then '' else 'g' end as type, p_name as name, case when p_partkey % 17 = 0 then null else 's' end as statement,
  (['高', '中', '低', '?'])[(p_partkey % 4 + 1)::int] as confidence, case when p_partkey % 9 = 0 then [] else ['c' || p_partkey, 'f1#a' || (p_partkey % 50)] end as basis, case when p_partkey % 6 = 0 then ['c' || (p_partkey * 2)] else [] end as members from part),
 n as (select *, case when id = '' then 'derived[' || seq || ']' else id end as name_of from d), known as (select 'c' || c_custkey as ref from customer union all select 'f1#a' || i from (select unnest(range(40)) as i))
 select 'D001' as code, name_of as target from n where id = '' or type = '' or statement is null union all select 'D004', name_of from n where confidence = '?' union all select 'D002', name_of from n where len(basis) = 0
 union all select 'D005', id from (select id, row_number() over (partition by id order by seq) as r from d where id <> '') where r > 1
 union all select 'D003', name_of from (select name_of, unnest(basis) as ref from n) where ref not in (select ref from known)
 union all select 'D003', name_of from (select name_of, unnest(members) as ref from n) where ref not in (select 'c' || c_custkey from customer)""")
def derived_findings(t, spark):
    """Derived items: fields, basis, members, confidence, repeats."""
    p = F.col("p_partkey")
    d = t("part").select(
        p.alias("seq"), F.when(p % 41 == 0, "").otherwise(F.concat(F.lit("d"), p - F.when(p % 20 == 10, 10).otherwise(0))).alias("id"), F.when(p % 13 == 0, "").otherwise("g").alias("type"), F.col("p_name").alias("name"), F.when(p % 17 != 0, "s").alias("statement"),
        F.element_at(F.array(*map(F.lit, "高中低?")), (p % 4 + 1).cast("int")).alias("confidence"), F.when(p % 9 == 0, F.array().cast(_S)).otherwise(F.array(F.concat(F.lit("c"), p), F.concat(F.lit("f1#a"), p % 50))).alias("basis"), F.when(p % 6 == 0, F.array(F.concat(F.lit("c"), p * 2))).otherwise(F.array().cast(_S)).alias("members"),
    )
    items = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    anchors = spark.range(40).select(F.lit("f1").alias("file"), F.concat(F.lit("a"), "id").alias("anchor"))
    return conformance.derived_findings(d, items, anchors).select("code", "target")


def _cells(t):
    """Reports (nations) that print customers: id, segment, linked and note."""
    c = F.col("c_custkey")
    rows = t("customer").select(F.concat(F.lit("R"), F.col("c_nationkey")).alias("report"), (F.col("c_nationkey") % 3).alias("section"), c.alias("row"), "c_mktsegment", "c_nationkey", c.alias("c"))
    c = F.col("c")
    kind = F.when(F.col("c_nationkey") % 3 == 0, "trace").when(F.col("c_nationkey") % 3 == 1, "matrix").otherwise("items")
    cell = lambda i, col, path, text, is_id=False, src=False: F.struct(F.lit(i).alias("col"), F.lit(col).alias("column"), F.lit(path).alias("path"), text.cast("string").alias("text"), F.lit(is_id).alias("is_id"), F.lit(src).alias("is_source"))
    linked = F.when((F.col("c_nationkey") == 6) | (c % 3 == 0), "―").otherwise(F.concat(F.lit("x"), c))
    note = F.when(c % 4 == 0, F.concat("c_mktsegment", F.lit(" repeated note"))).when(c % 9 == 0, "see ISS-1").otherwise("―")
    cells = F.array(cell(0, "ID", "id", F.concat(F.lit("C-"), F.floor(c / 2)), True), cell(1, "Segment", "segment", F.col("c_mktsegment")), cell(2, "Linked", "linked", linked), cell(3, "Note", "a.note", note), cell(4, "Source", "source", F.lit("the very same source text of more than ten letters"), False, True))
    return rows.select("report", "section", F.concat(F.lit("S"), "section").alias("heading"), kind.alias("kind"), "row", F.explode(cells).alias("x")).select("report", "section", "heading", "kind", "row", "x.*")


@query("""with r as (select 'R' || c_nationkey as report, 'S' || (c_nationkey % 3) as heading, c_nationkey as n, c_custkey as c, 'C-' || (c_custkey // 2) as id, c_mktsegment as seg, case when c_nationkey = 6 or c_custkey % 3 = 0 then '―' else 'x' || c_custkey end as linked,
  case when c_custkey % 4 = 0 then c_mktsegment || ' repeated note' when c_custkey % 9 = 0 then 'see ISS-1' else '―' end as note from customer),
 dup as (select a.report as x, b.report as y, count(*) as n from r a join r b on a.id = b.id and a.report < b.report group by 1, 2 having count(*) >= 4)
 select 'P101' as code, report || ' / ' || heading as target from r where n % 3 = 0 group by report, heading having bool_and(linked = '―')
 union all select distinct 'P102', report || ' / ' || heading from r where n % 3 = 1 and n % 2 = 0
 union all select 'P104', report || ' / Note' from (select report, note from r where length(note) >= 10 and note <> '―' group by 1, 2 having count(*) >= 4) group by report
 union all select distinct 'P105', report from r where c // 2 % 50 = 7 and note not like '%ISS-%'
 union all select 'P106', x || ' / ' || y from dup""")
def audit_cells(t, spark):
    """Audits of the printed cells."""
    cells = _cells(t)
    notes = cells.where("kind = 'matrix'").select("report", "section").distinct().where("cast(substr(report, 2) as int) % 2 = 1").withColumn("note", F.lit("空欄は記載なし"))
    disputed = t("customer").where("floor(c_custkey / 2) % 50 = 7").select(F.concat(F.lit("C-"), F.floor(F.col("c_custkey") / 2)).alias("display"))
    out = audit.population(cells).union(audit.legends(cells, notes)).union(audit.repeats(cells)).union(audit.unmarked_disputes(cells, disputed)).union(audit.printed_twice(cells))
    return out.select("code", "target")


@query("""with s as (select 'R' || c_nationkey as report, case when c_custkey % 5 = 0 then '未分類' when c_nationkey % 2 = 0 then lower(c_mktsegment) else '節' || (c_custkey % 3) end as heading, count(*) as n from customer group by 1, 2),
 tot as (select report, count(*) as k, sum(n) as total from s group by 1)
 select 'P103' as code, report || ' / ' || heading as target from s where regexp_matches(heading, '^[A-Za-z][A-Za-z0-9_-]*$')
 union all select 'P108', report || ' / all / 未分類' from s join tot using (report) where heading = '未分類' and k >= 2 and n >= 0.25 * total
 union all select 'P107', 'type' || (n_nationkey % 7) from nation group by n_nationkey % 7 having bool_or(n_nationkey % 4 = 0) and not bool_and(n_nationkey % 4 = 0)
 union all select 'P109', 'M' || i || ' / grid' from (values (1), (2)) m(i) where i = 2
 union all select 'P110', event_type from events where event_type <> 'view' and user_id % 10 <> 0 and event_type not in ('view', 'click') group by event_type
 union all select 'P111', 'customer.' || name from (select c_custkey, 'segment' as name from customer where c_custkey % 3 <> 0 union all select c_custkey, 'nation' from customer) where name = 'segment' and c_custkey % 6 <> 4 and c_custkey % 10 <> 0 group by name""")
def audit_plans(t, spark):
    """Audits of what reports print, against the store."""
    c, n = F.col("c_custkey"), F.col("n_nationkey")
    heading = F.when(c % 5 == 0, "未分類").when(F.col("c_nationkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.concat(F.lit("節"), c % 3))
    sec = t("customer").groupBy(F.concat(F.lit("R"), "c_nationkey").alias("report"), heading.alias("heading")).agg(F.count("*").alias("n_rows")).withColumns({"chapter": F.lit("all"), "level": F.lit(3)})
    plans = t("nation").select(F.concat(F.lit("R"), n).alias("report"), F.lit("items").alias("kind"), F.concat(F.lit("type"), n % 7).alias("type"), F.when(n % 4 == 0, F.array(F.lit("name"), F.lit("source"))).otherwise(F.array(F.lit("name"))).alias("columns"))
    grids = spark.createDataFrame([("M1", "grid", "matrix", "view", "level"), ("M2", "grid", "matrix", "click", "level"), ("M3", "grid", "matrix", "error", "other")], "report string, heading string, kind string, relation string, cell string")
    words = spark.createDataFrame([("view", "level", ["8"]), ("click", "level", ["never"]), ("error", "other", [])], "relation string, cell string, negative array<string>")
    rel = t("events").select(F.col("event_type").alias("type"), F.when(F.col("user_id") % 10 == 0, "deprecated").otherwise("review").alias("status"), F.create_map(F.lit("level"), (F.col("event_id") % 9).cast("string")).alias("attrs"))
    shown = spark.createDataFrame([(["view"],), (["click"],)], "relations array<string>")
    items = t("customer").select(c.alias("id"), F.lit("customer").alias("type"), F.when(c % 10 == 0, "deprecated").otherwise("review").alias("status"), F.create_map(F.lit("segment"), F.when(c % 3 == 0, "").otherwise(F.col("c_mktsegment")), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("attrs"))
    printed = t("customer").where(c % 6 == 4).select(c.alias("id"), F.lit("segment").alias("name"))
    exempt = spark.createDataFrame([("customer", "nation")], "type string, name string")
    out = audit.raw_headings(sec).union(audit.ungrouped(sec)).union(audit.source_columns(plans)).union(audit.negatives(grids, rel, words)).union(audit.unprinted_relations(rel, shown)).union(audit.unprinted_attributes(items, printed, exempt))
    return out.select("code", "target")
