"""Store checks, section findings and report parts on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import reports, store
from lodestone.plans import lint
from lodestone.queries.registry import query

_MAP, _ARR = "map<string,string>", "array<string>"


def _pairs(*rows):
    """A map of the pairs whose condition holds."""
    arrays = [F.when(c, F.array(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>")) for c, k, v in rows]
    return F.map_from_entries(F.concat(*arrays))


def _items(t):
    c, s = F.col("c_custkey"), F.lit("")
    attrs = _pairs((c % 5 != 0, "age", F.when(c % 12 == 0, "old").otherwise((c % 90).cast("string"))), (c % 3 == 0, "flag", F.when(c % 9 == 0, "yes").otherwise("true")), (c % 8 == 0, "tags", F.lit("one")), (c % 7 != 0, "code", F.concat(F.when(c % 13 == 0, "X-").when(c % 2 == 0, "A-").otherwise("B-"), F.lpad((c % 1000).cast("string"), 4, "0"))), (F.lit(True), "grp", F.when(c % 11 == 0, "none").when(c % 2 == 0, "even").otherwise("odd")))
    lists = F.when(c % 10 == 0, F.create_map(F.lit("age"), F.array(F.lit("1")))).when(c % 10 == 1, F.create_map(F.lit("tags"), F.array(F.lit("a"), F.lit("b")))).otherwise(F.create_map().cast("map<string,array<string>>"))
    over = _pairs((c % 26 == 0, "code", F.when(c % 52 == 0, "").otherwise("fixed")), (c % 25 == 0, "age", F.lit("typed")), (c % 33 == 0, "ghost", F.lit("why")))
    gaps = _pairs((c % 14 == 0, "age", F.when(c % 28 == 0, " ").otherwise("unknown")), (c % 15 == 0, "nowhere", F.lit("x")), (c % 16 == 0, "knows", F.lit("y")))
    conflicts = F.when(c % 17 == 0, F.create_map(F.lit("age"), F.array(F.lit("1"), F.lit("2")))).otherwise(F.create_map().cast("map<string,array<string>>"))
    return t("customer").select(F.concat(F.lit("c"), c).alias("id"), F.lit("person").alias("type"), F.when(c % 30 == 0, "deprecated").otherwise("review").alias("status"), attrs.alias("attrs"), lists.alias("lists"), over.alias("overridden"), gaps.alias("gap_reasons"), conflicts.alias("conflicts"), s.alias("x"))


def _words(spark):
    attributes = spark.createDataFrame([("person", "age", "int", False), ("person", "flag", "bool", False), ("person", "tags", "enum", True), ("person", "code", "string", False), ("person", "grp", "string", False)], "owner string, name string, kind string, multi boolean")
    formats = spark.createDataFrame([("person", "even", "code", "A-", 4), ("person", "odd", "code", "B-", 4)], "type string, grp string, attribute string, prefix string, width int")
    return attributes, formats


_C = "with c as (select c_custkey as k, 'c' || c_custkey as id from customer) "


@query(_C + """select 'E014' as code, id || '.age' as target from c where k % 5 <> 0 and k % 12 = 0 union all select 'E014', id || '.flag' from c where k % 9 = 0
 union all select 'E015', id || '.tags' from c where k % 8 = 0 union all select 'E015', id || '.age' from c where k % 10 = 0
 union all select 'E016', id || '.ghost' from c where k % 33 = 0 union all select 'E017', id || '.code' from c where k % 52 = 0 union all select 'W012', id || '.code' from c where k % 26 = 0 and k % 7 = 0 union all select 'W012', id || '.age' from c where k % 25 = 0
 union all select 'E018', id || '.nowhere' from c where k % 15 = 0 union all select 'E019', id || '.age' from c where k % 28 = 0
 union all select 'W045', id || '.age' from c where k % 17 = 0 union all select 'W045', id || '.age' from c where k % 17 = 0""")
def store_findings(t, spark):
    """Kinds, lists, overrides, gaps and dropped values of a store."""
    attributes, _ = _words(spark)
    items, relations = _items(t), spark.createDataFrame([("knows",)], "rel string")
    out = store.kind_findings(items, attributes).union(store.override_findings(items, attributes)).union(store.gap_findings(items, attributes, relations)).union(store.conflict_findings(items))
    return out.select("code", "target")


@query(_C + """, n as (select *, case when k % 7 <> 0 then case when k % 13 = 0 then 'X-' when k % 2 = 0 then 'A-' else 'B-' end || lpad((k % 1000)::varchar, 4, '0') end as v, case when k % 11 = 0 then null when k % 2 = 0 then 'A-' else 'B-' end as p, case when k % 52 = 0 then '' when k % 26 = 0 then 'fixed' end as why from c)
 select case when coalesce(why, '') <> '' then 'W042' else 'E028' end as code, case when coalesce(why, '') <> '' then 'warn' else 'error' end as level, id as target from n where v is not null and p is not null and not starts_with(v, p)
 union all select 'W040', 'warn', id from n where v is null and p is null union all select 'W041', 'warn', id from n where v is not null and p is not null and not starts_with(v, p) and why is not null""")
def number_findings(t, spark):
    """Display numbers against the formats of their groups."""
    return store.number_findings(_items(t), _words(spark)[1], "grp").select("code", "level", "target")


@query("""select 'E000' as code, 'f' || event_id % 10 || '#' || event_id as target from events where event_id % 7 in (1, 2, 3)""")
def shape_findings(t, spark):
    """Lines of store files that are no mapping."""
    k = F.col("event_id")
    body = F.when(k % 7 == 1, "[1, 2]").when(k % 7 == 2, '{"a": ').when(k % 7 == 3, '"text"').otherwise(F.col("props"))
    return store.shape_findings(t("events").select(F.concat(F.lit("f"), k % 10).alias("file"), k.alias("line"), body.alias("body"))).select("code", "target")


PLAN = [
    {"kind": "items", "type": "person", "columns": ["age", "memo"], "heading": "people"},
    {"kind": "items", "type": "person", "columns": ["code"], "where": {"grp": ["nobody"]}, "heading": "empty"},
    {"kind": "relation", "relation": ["knows"], "columns": ["from.code", "to.code"], "heading": "pairs"},
    {"kind": "trace", "type": "person", "relation": ["knows"], "side": "from", "columns": ["age"], "heading": "trace"},
]
BROKEN = [
    {"kind": "items", "type": "person", "columns": ["age", "wrong", "to.age"], "group_by": "no", "heading": "A"}, {"kind": "odd", "heading": "B"}, {"kind": "items", "type": "alien", "columns": [], "heading": "C"},
    {"kind": "relation", "relation": ["knows", "hates"], "columns": ["from.age", "to.nope", "since"], "colour": 1, "heading": "D"}, *PLAN[:1],
]


@query("""select * from (values ('E040', 'A', 3), ('E040', 'B', 1), ('E040', 'C', 1), ('E040', 'D', 4)) v(code, target, n)""")
def plan_findings(t, spark):
    """Sections that cannot be compiled, counted by section."""
    vocabulary = {"items": {"person": ["age", "memo", "code", "grp"]}, "relations": {"knows": (["person"], ["person"], ["weight"])}}
    return lint.plan_findings(spark, BROKEN, vocabulary).groupBy("code", "target").agg(F.count("*").cast("int").alias("n"))


@query("""select * from (values ('W034', 'empty'), ('W046', 'people.memo'), ('W047', 'people.memo'), ('W046', 'pairs.to.code'), ('W043', 'pairs.to.code')) v(code, target)""")
def section_findings(t, spark):
    """Empty sections, folded columns, and where their values are instead."""
    items = _items(t).select("id", "type", "status", F.map_concat("attrs", F.create_map(F.lit("description"), F.lit("told"))).alias("attrs"))
    blank = spark.createDataFrame([("ghost", "other", "review", {"a": "b"})], "id string, type string, status string, attrs map<string,string>")
    relations = t("orders").where("o_custkey % 7 <> 0").select(F.lit("knows").alias("type"), F.concat(F.lit("c"), "o_custkey").alias("from"), F.lit("ghost").alias("to"), F.lit(1).alias("ord"))
    return lint.value_findings(PLAN, items.union(blank), relations).select("code", "target")


@query("""with g as (select c_custkey, case when c_custkey % 6 = 0 then '未分類' else c_mktsegment end as v from customer),
 n as (select v, row_number() over (order by case v when '未分類' then 3 when 'MACHINERY' then 0 when 'BUILDING' then 1 else 2 end, v) as section from (select distinct v from g))
 select c_custkey, section::bigint as section, case v when 'BUILDING' then '建物' else v end as heading from g join n using (v)""")
def grouped_sections(t, spark):
    """Items in sections: declared groups first, the rest by name, ungrouped last."""
    rows = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("g"))
    return reports.grouped(rows, "g", ["MACHINERY", "BUILDING"], {"BUILDING": "建物"}).select("c_custkey", "section", "heading")


@query("""with d as (select 'c' || (l_suppkey * 3) as t, 'ISS-' || (l_partkey % 50) as i from lineitem where l_returnflag = 'A' and l_linenumber <> 1)
 select 'c' || c_custkey as id, coalesce((select string_agg(distinct i, '、' order by i) from d where t = 'c' || c_custkey), '') as marks from customer""")
def dispute_marks(t, spark):
    """Items with the issues that dispute them."""
    l = t("lineitem").where("l_returnflag = 'A'")
    rel = l.select(F.lit("disputes").alias("type"), F.when(F.col("l_linenumber") == 1, "deprecated").otherwise("review").alias("status"), F.concat(F.lit("i"), F.col("l_partkey") % 50).alias("from"), F.concat(F.lit("c"), F.col("l_suppkey") * 3).alias("to"))
    names = spark.range(50).select(F.concat(F.lit("i"), "id").alias("id"), F.concat(F.lit("ISS-"), "id").alias("display"))
    rows = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    return reports.dispute_marks(rows, rel, names).withColumnRenamed(reports.ISSUE_COLUMN, "marks")


_STORE = """with it as (select 'c' || c_custkey as id, 'customer' as type, case when c_custkey % 20 = 0 then 'deprecated' else 'review' end as status from customer union all select 's' || s_suppkey, 'supplier', 'review' from supplier),
 rel as (select 'buys' as type, 'c' || o_custkey as f, 's' || (o_orderkey % 90) as t, o_orderstatus as cell from orders where o_custkey % 3 <> 0) """


def _linked(t):
    c = F.col("c_custkey")
    items = t("customer").select(F.concat(F.lit("c"), c).alias("id"), F.lit("customer").alias("type"), F.when(c % 20 == 0, "deprecated").otherwise("review").alias("status")).union(t("supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.lit("supplier"), F.lit("review")))
    rel = t("orders").where("o_custkey % 3 <> 0").select(F.lit("buys").alias("type"), F.concat(F.lit("c"), "o_custkey").alias("from"), F.concat(F.lit("s"), F.col("o_orderkey") % 90).alias("to"), F.lit("review").alias("status"), F.create_map(F.lit("cell"), "o_orderstatus").alias("attrs"))
    return items, rel


@query(_STORE + """select 'from' as side, id from it where type = 'customer' and status <> 'deprecated' and id not in (select f from rel) union all select 'to', id from it where type = 'supplier' and id not in (select t from rel)
 union all select 'legend ' || v, (select count(*) from rel where cell = v)::varchar from (values ('F'), ('O'), ('P'), ('X')) w(v)""")
def matrix_notes(t, spark):
    """What a matrix leaves out, and how often its values occur."""
    items, rel = _linked(t)
    out = reports.matrix_omitted(items, rel, "buys", "customer", "supplier")
    return out.union(reports.legend(rel, "buys", "cell", ["F", "O", "P", "X"]).select(F.concat(F.lit("legend "), "value"), F.col("n").cast("string")))


@query("""select l_orderkey, count(distinct s_name)::bigint as n, string_agg(s_name, '、' order by s_name) filter (where k <= 2) || case when count(*) > 2 then ' ほか ' || (count(*) - 2)::varchar || ' 件' else '' end as sources from
 (select l_orderkey, s_name, row_number() over (partition by l_orderkey order by s_name) as k from (select distinct l_orderkey, s_name from lineitem join supplier on s_suppkey = l_suppkey)) group by 1""")
def provenance_label(t, spark):
    """At most two sources, then how many more."""
    d = t("lineitem").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return reports.provenance(d, "l_orderkey", "s_name")


@query("""with i as (select c_custkey as id, c_mktsegment as type, 'N' || (c_custkey % 40) as name from customer), s as (select type, name, count(*) as n from i group by 1, 2), p as (select o_custkey as id, count(distinct o_orderstatus) as k, min(o_orderstatus) as o from orders where o_orderkey % 9 = 0 group by 1)
 select i.id, case when n > 1 and k = 1 then i.name || '（' || o || '）' else i.name end as label, case when i.id % 4 = 0 then i.name when i.id % 4 = 1 then 'D' || i.id else 'D' || i.id || ' ' || i.name end as reference from i join s using (type, name) left join p on p.id = i.id""")
def ambiguity_qualifier(t, spark):
    """Names that clash get their owner's name; reference labels."""
    c = F.col("c_custkey")
    items = t("customer").select(c.alias("id"), F.col("c_mktsegment").alias("type"), F.concat(F.lit("N"), c % 40).alias("name"))
    parents = t("orders").where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("owner_name"))
    display, name = F.when(F.col("id") % 4 != 0, F.concat(F.lit("D"), "id")), F.when(F.col("id") % 4 != 1, F.concat(F.lit("N"), F.col("id") % 40))
    return reports.qualified(items, parents).select("id", "label", reports.reference_label(display, name).alias("reference"))


@query("""with p as (select distinct 'R' || c_nationkey as report, 'D' || (c_custkey % 200) as display from customer), r as (select 'R' || n_nationkey as report, n_regionkey as phase, n_nationkey % 4 as place from nation)
 select display, arg_min(report, (phase, place, report)) as owner, (count(*) - 1)::bigint as links from p join r using (report) group by 1""")
def display_owners(t, spark):
    """Which report owns a display id."""
    printed = t("customer").select(F.concat(F.lit("R"), "c_nationkey").alias("report"), F.concat(F.lit("D"), F.col("c_custkey") % 200).alias("display"))
    plan = t("nation").select(F.concat(F.lit("R"), "n_nationkey").alias("report"), F.col("n_regionkey").alias("phase"), (F.col("n_nationkey") % 4).alias("place"))
    return reports.display_owners(printed, plan)


@query("""with h as (select c_nationkey, c_mktsegment, count(*) filter (where c_custkey % 9 = 0) as n from customer group by 1, 2), s as (select c_nationkey, count(*) filter (where n > 0) as sections, sum(n) as n_rows from h group by 1)
 select n_regionkey as phase, row_number() over (partition by n_regionkey order by n_nationkey % 4, n_name)::bigint as number, n_name as report, coalesce(sections, 0)::bigint as sections, coalesce(n_rows, 0)::bigint as n_rows from nation left join s on c_nationkey = n_nationkey""")
def document_index(t, spark):
    """Reports numbered in their phases, with their sections and rows."""
    plan = t("nation").select(F.col("n_regionkey").alias("phase"), (F.col("n_nationkey") % 4).alias("place"), F.col("n_name").alias("report"), "n_nationkey")
    held = t("customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("section")).agg(F.count_if(F.col("c_custkey") % 9 == 0).alias("n_rows"))
    held = held.join(plan.select(F.col("n_nationkey").alias("c_nationkey"), "report"), "c_nationkey").select("report", "section", "n_rows")
    return reports.document_index(plan.drop("n_nationkey"), held)


@query("""with g as (select p_partkey, p_name as name, case when p_partkey % 3 = 0 then p_type end as reading from part) select p_partkey, substr(coalesce(reading, name), 1, 1) as initial, row_number() over (partition by substr(coalesce(reading, name), 1, 1) order by coalesce(reading, ''), name, p_partkey)::bigint as place from g""")
def glossary(t, spark):
    """Terms by reading, then name."""
    g = t("part").select("p_partkey", F.struct("p_name", "p_partkey").alias("n"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("reading"), F.col("p_name").alias("shown"))
    terms = g.withColumn("name", F.concat("shown", F.lit("\x01"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")))
    return reports.glossary(terms).select("p_partkey", "initial", "place")


@query(_C + """select 'conflict' as kind, id as target, 'age' as detail from c where k % 17 = 0 and k % 30 <> 0 union all select 'gap', id, 'age' from c where k % 14 = 0 and k % 30 <> 0 union all select 'gap', id, 'nowhere' from c where k % 15 = 0 and k % 30 <> 0 union all select 'gap', id, 'knows' from c where k % 16 = 0 and k % 30 <> 0
 union all select 'dispute', 'c' || s_suppkey, 'i' || s_suppkey from supplier where s_suppkey % 3 <> 0 union all select 'unread', 'f#a' || n_nationkey, n_name from nation where n_nationkey % 4 = 0 union all select 'folded', 'people', 'memo'""")
def holes(t, spark):
    """The page of holes: everything that is known to be missing or unsure."""
    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    rel = t("supplier").select(F.lit("disputes").alias("type"), F.when(s % 3 == 0, "deprecated").alias("status"), F.concat(F.lit("i"), s).alias("from"), F.concat(F.lit("c"), s).alias("to"))
    scope = t("nation").select(F.lit("f").alias("file"), F.concat(F.lit("a"), n).alias("anchor"), F.when(n % 4 == 0, "未読取").otherwise("対象外").alias("kind"), F.col("n_name").alias("reason"))
    return reports.holes(_items(t), rel, scope, spark.createDataFrame([("people", "memo")], "section string, column string"))


@query("""with a as (select 'f' || (c_custkey % 30) as file, c_custkey as anchor from customer), s as (select distinct 'f' || (o_custkey % 30) as file, o_custkey as anchor, o_orderstatus as item from orders where o_custkey % 4 <> 0), u as (select distinct file, anchor from s), x as (select file, anchor from a where anchor % 6 = 0)
 select a.file, count(*)::bigint as anchors, (select count(*) from u where u.file = a.file)::bigint as used, (select count(*) from x where x.file = a.file and (x.file, x.anchor) not in (select (file, anchor) from u))::bigint as out_of_scope, (select count(distinct item) from s where s.file = a.file)::bigint as items from a group by a.file""")
def provenance_coverage(t, spark):
    """How much of each source became items."""
    a = t("customer").select(F.concat(F.lit("f"), F.col("c_custkey") % 30).alias("file"), F.col("c_custkey").alias("anchor"))
    s = t("orders").where("o_custkey % 4 <> 0").select(F.concat(F.lit("f"), F.col("o_custkey") % 30).alias("file"), F.col("o_custkey").alias("anchor"), F.col("o_orderstatus").alias("item"))
    return reports.provenance_coverage(a, s, a.where("anchor % 6 = 0"))


@query("""select 'p' || c_custkey as path, case when c_custkey % 5 = 0 and c_custkey % 2 = 0 then 'published' when c_custkey % 5 = 0 then 'stored' when c_custkey % 3 = 0 then 'organised' else 'read' end as state from customer""")
def origin_state(t, spark):
    """How far each source has come."""
    c = F.col("c_custkey")
    path = t("customer").select(F.concat(F.lit("p"), c).alias("path"), c.alias("k"))
    published = path.where("k % 5 = 0").select("path", F.when(F.col("k") % 2 == 0, "R").alias("report"))
    return reports.origin_state(path.select("path"), path.where("k % 3 = 0").select("path"), published)


@query(_STORE + """select id, 'serves' as relation from it where type = 'supplier' union all select id, 'buys' from it where false""")
def auto_gaps(t, spark):
    """Needed relations that nothing could fill."""
    items, rel = _linked(t)
    needed = spark.createDataFrame([("supplier", "serves"), ("customer", "buys")], "type string, relation string")
    targets = spark.createDataFrame([("serves", "kitchen"), ("buys", "supplier")], "relation string, type string")
    return reports.auto_gaps(items, rel, needed, targets)


@query(_STORE + """select id, case when status = 'review' and type <> 'supplier' and id not in (select 'c' || s_suppkey from supplier where s_suppkey % 2 = 0) then 'approved' else status end as status from it""")
def promoted(t, spark):
    """Review becomes approved but for what is open."""
    items, _ = _linked(t)
    rel = t("supplier").select(F.lit("disputes").alias("type"), F.when(F.col("s_suppkey") % 2 != 0, "deprecated").alias("status"), F.concat(F.lit("c"), "s_suppkey").alias("to"))
    return reports.promote(items, rel, "supplier").select("id", "status")


@query("""with c as (select p_partkey as k, (['class', 'method', 'import', 'module'])[(p_partkey % 4 + 1)::int] as kind, case when p_partkey % 5 = 0 then '__init__' else p_brand end as name from part)
 select 'f' || (k % 9) as file, 'a' || k as anchor, case kind when 'method' then 'c-met-x.y.' || name when 'class' then 'c-mod-x.y.' || name else 'c-mod-x.y' end as concept, case kind when 'method' then 'method-fact' else 'module-fact' end as type, name, '<TODO f' || (k % 9) || '#a' || k || '>' as statement, 3::bigint as lines
 from c where kind <> 'import' and not (kind = 'method' and name = '__init__')""")
def drafted_records(t, spark):
    """Records drafted from chunks of code."""
    p = F.col("p_partkey")
    chunks = t("part").select(F.concat(F.lit("f"), p % 9).alias("file"), F.concat(F.lit("a"), p).alias("anchor"), F.element_at(F.array(*map(F.lit, ("class", "method", "import", "module"))), (p % 4 + 1).cast("int")).alias("kind"), F.lit("x.y").alias("path"), F.when(p % 5 == 0, "__init__").otherwise(F.col("p_brand")).alias("name"), F.lit("a\nb\nc").alias("body"))
    return reports.draft(chunks)


@query("""select 'src/f' || (p_partkey % 30) || '.py' as file, 'a' || p_partkey as anchor, '対象外' as kind, 'generated' as reason from part where (p_partkey % 30) between 10 and 19 and p_partkey % 4 <> 0""")
def bulk_scope(t, spark):
    """Unclaimed anchors of files under a pattern, declared out of scope."""
    p = F.col("p_partkey")
    a = t("part").select(F.concat(F.lit("src/f"), p % 30, F.lit(".py")).alias("file"), F.concat(F.lit("a"), p).alias("anchor"), p.alias("k"))
    return reports.out_of_scope(a.select("file", "anchor"), a.where("k % 4 = 0").select("file", "anchor"), "src/f1?.*", "generated")


@query("""with h as (select p_type as type, 'file' || (p_size % 7) as file, count(*) as n from part where p_type <> 'PROMO' group by 1, 2), b as (select type, min(file) as file from h where (type, n) in (select (type, max(n)) from h group by type) group by 1)
 select p_partkey as id, p_type as type, coalesce(b.file, p_type || '.yml') as file from part left join b on b.type = p_type where p_partkey % 5 = 0""")
def record_placement(t, spark):
    """The file that new records go to."""
    stored = t("part").where("p_type <> 'PROMO'").select(F.col("p_type").alias("type"), F.concat(F.lit("file"), F.col("p_size") % 7).alias("file"))
    return reports.placement(t("part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type")), stored)


@query("""with l as (select event_id as seq, 'u' || (user_id % 4) as actor, event_type || ' (' || event_id || ') item' || (event_id % 9) as text, case when value > 20 then 'sure' else 'guess' end as confidence from events),
 r as (select *, event_type_kind as kind, row_number() over (partition by actor, event_type_kind, confidence order by seq) as k from (select *, split_part(text, ' ', 1) || '  N' as event_type_kind from l))
 select actor, kind, confidence, count(*)::bigint as n, string_agg(text, ' / ' order by seq) filter (where k <= 3) as examples from r group by 1, 2, 3""")
def folded_decisions(t, spark):
    """Decisions folded by kind, with examples."""
    k = F.col("event_id")
    log = t("events").select(k.alias("seq"), F.concat(F.lit("u"), F.col("user_id") % 4).alias("actor"), F.concat("event_type", F.lit(" ("), k, F.lit(") item"), k % 9).alias("text"), F.when(F.col("value") > 20, "sure").otherwise("guess").alias("confidence"))
    return reports.folded_decisions(log)


@query("""with f as (select event_type as code, 'd' || (user_id % 10) || '/' || event_id as target, case when event_id % 4 = 0 then 'b' else 'a' end as actor from events)
 select 'kept' as part, code || target as row from f where code like 'c%' or code like 'v%' union all select 'hidden', code || target from f where not (code like 'c%' or code like 'v%')
 union all select 'under', code || target from f where contains(target, 'd1/') union all select 'count', (count(*) filter (where not contains(target, 'd1/')))::varchar from f
 union all select 'log', code || target from f where actor <> 'b' union all select 'log', 'new' """)
def finding_filters(t, spark):
    """Findings by code and path with what that hides, and a log with an actor replaced."""
    k = F.col("event_id")
    f = t("events").select(F.col("event_type").alias("code"), F.concat(F.lit("d"), F.col("user_id") % 10, F.lit("/"), k).alias("target"), F.when(k % 4 == 0, "b").otherwise("a").alias("actor"))
    row = F.concat("code", "target")
    kept, hidden = reports.only_codes(f, ["c", "v"])
    under, count = reports.only_under(f, "d1/")
    log = reports.replace_by_actor(f.select("actor", row.alias("row")), spark.createDataFrame([("b", "new")], "actor string, row string"))
    parts = [kept.select(F.lit("kept").alias("part"), row.alias("row")), hidden.select(F.lit("hidden"), row), under.select(F.lit("under"), row), count.select(F.lit("count"), F.col("hidden").cast("string")), log.select(F.lit("log"), "row")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("""with s as (select n_nationkey as section, count(c_custkey) filter (where c_custkey % 30 = 0) as n, count(c_custkey) filter (where n_nationkey % 5 <> 0) as d, count(c_custkey) filter (where n_nationkey % 3 <> 0) as r from nation left join customer on c_nationkey = n_nationkey group by 1)
 select section, n::bigint as n, case when n > 0 then null when d = 0 then 'no data' when r = 0 then 'no relation' else 'filtered away' end as reason from s""")
def sections_kept(t, spark):
    """Sections left out, with the reason."""
    n, c = F.col("n_nationkey"), F.col("c_custkey")
    d = t("nation").join(t("customer"), F.col("c_nationkey") == n, "left").groupBy(n.alias("section"))
    rows = d.agg(F.count_if(c % 30 == 0).alias("n"))
    have = d.agg(F.count(F.when(n % 5 != 0, c)).alias("n_data"), F.count(F.when(n % 3 != 0, c)).alias("n_relations"))
    return reports.sections_kept(rows, have)


@query("""with s as (select c_custkey as id, 'f' || (c_custkey % 60) as file, case when c_custkey % 45 = 0 then 'T' else 'U' end as type from customer) select id, file in (select file from s where type = 'T') as left_out from s""")
def exclude_produced(t, spark):
    """Items from files that produced an item of a type."""
    c = F.col("c_custkey")
    items = t("customer").select(c.alias("id"), F.when(c % 45 == 0, "T").otherwise("U").alias("type"))
    kept, out = reports.exclude_produced(items, t("customer").select(c.alias("id"), F.concat(F.lit("f"), c % 60).alias("file")), "T")
    return kept.select("id", F.lit(False).alias("left_out")).union(out.select("id", F.lit(True)))
