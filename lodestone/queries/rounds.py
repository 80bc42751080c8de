"""Findings of a round of records made of the shared tables: build, ledger and gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import build, organised
from lodestone.plans import shapes
from lodestone.queries.registry import ORACLE, query
from lodestone.scratch import cut
from lodestone.streaming import metering

FACTS = [("account-fact", "account", "acc"), ("person-fact", "person", "per"), ("method-fact", "method", "met"), ("module-fact", "module", "mod"), ("issue-fact", "open-issue", "iss")]
#: owner, name, kind, multi, append, values, extensible, label, column
ATTRIBUTES = [
    ("account", "priority", "enum", False, False, ["1-URGENT", "2-HIGH"], False, "優先", "Priority"), ("account", "status", "enum", True, False, ["F", "O"], True, None, None),
    ("person", "priority", "string", False, True, [], False, "優先", None), ("person", "status", "enum", False, False, ["F", "O"], False, None, "Status"),
    ("person", "description", "string", False, True, [], False, None, None), ("knows", "weight", "enum", False, False, ["F"], False, None, None), ("owns", "weight", "string", True, False, [], False, None, None),
]
ENDS = [("knows", "person", "person"), ("owns", "person", "account"), ("near", "person", "account"), ("near", "account", "person")]
_STRINGS = "array<string>"


def _words(spark):
    facts = spark.createDataFrame(FACTS, "fact string, item_type string, prefix string")
    attributes = spark.createDataFrame(ATTRIBUTES, "owner string, name string, kind string, multi boolean, append boolean, values array<string>, extensible boolean, label string, column string")
    return facts, attributes, spark.createDataFrame(ENDS, "rel string, from_type string, to_type string")


def _records(t):
    """Orders as records: each says something of its customer. Faults come by rule."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 4 == 0, None).when(c % 11 == 0, "ghost").when(c % 30 == 0, "issue-fact").when(c % 3 == 0, "account-fact").otherwise("person-fact")
    attrs = F.map_concat(F.create_map(F.lit("priority"), "o_orderpriority", F.lit("status"), "o_orderstatus"), F.when(k % 17 == 0, F.create_map(F.lit("stray"), F.lit("s"))).otherwise(F.create_map().cast("map<string,string>")))
    gaps = F.when(k % 13 == 0, F.create_map(F.lit("owns"), F.concat(F.lit("r"), (k % 2).cast("string")))).when(k % 19 == 0, F.create_map(F.lit("nothing"), F.lit(""))).otherwise(F.create_map().cast("map<string,string>"))
    return t("orders").select(
        F.concat(F.lit("k"), c).alias("concept"), F.concat(F.lit("f"), k % 40).alias("file"), F.concat(F.lit("a"), k).alias("anchor"), k.alias("seq"), kind.alias("type"),
        F.concat(F.lit("N"), c, F.when(k % 9 == 0, "x").otherwise("")).alias("name"), F.concat("o_orderpriority", "o_orderstatus").alias("statement"), attrs.alias("attrs"), gaps.alias("gaps"),
    )


def _refs(t):
    """Line items as references of their order's record to other customers."""
    rows = t("lineitem").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    k = F.col("l_orderkey")
    rel = F.element_at(F.array(*map(F.lit, ("knows", "owns", "near", "unheard"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    to = F.when(F.col("l_partkey") % 10 == 0, "nowhere").when(F.col("l_partkey") % 10 == 1, "led-30").otherwise(F.concat(F.lit("k"), F.col("l_suppkey") * 7))
    return rows.select(
        F.concat(F.lit("f"), k % 40).alias("file"), F.concat(F.lit("a"), k).alias("anchor"), (k * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("k"), "o_custkey").alias("concept"),
        rel.alias("rel"), to.alias("to"), F.create_map(F.lit("weight"), "l_linestatus").alias("attrs"), F.concat(F.lit("qty "), F.col("l_quantity").cast("int").cast("string")).alias("note"),
    )


def _ledger(t):
    c = F.col("c_custkey")
    return t("customer").where(c % 5 == 0).select(
        c.alias("seq"), F.when(c % 70 == 35, "").otherwise(F.concat(F.lit("k"), F.when(c % 40 == 20, c - 20).otherwise(c))).alias("concept"), F.when(c % 10 == 0, "person-fact").otherwise("").alias("type"),
        F.when(c % 15 == 0, F.concat(F.lit("led-"), c)).otherwise("").alias("item"), F.concat(F.lit("r00"), c % 2).alias("since"), F.array(F.concat(F.lit("a"), c % 3)).alias("aliases"), F.concat(F.lit("L"), c).alias("label"),
    )


def _store(t):
    return t("customer").where("c_custkey % 30 = 0").select(F.concat(F.lit("led-"), "c_custkey").alias("id"), F.when(F.col("c_custkey") % 60 == 0, "open-issue").otherwise("person").alias("type"))


def _first(ledger):
    first = ledger.where("concept <> ''").groupBy("concept").agg(F.min("seq").alias("seq"))
    return ledger.join(first, ["concept", "seq"])


_ROUND = """with facts(fact, item_type, prefix) as (values ('account-fact', 'account', 'acc'), ('person-fact', 'person', 'per'), ('method-fact', 'method', 'met'), ('module-fact', 'module', 'mod'), ('issue-fact', 'open-issue', 'iss')),
 attr(owner, name, kind, multi, app, vals, ext, label) as (values ('account', 'priority', 'enum', false, false, ['1-URGENT', '2-HIGH'], false, '優先'), ('account', 'status', 'enum', true, false, ['F', 'O'], true, null),
  ('person', 'priority', 'string', false, true, null, false, '優先'), ('person', 'status', 'enum', false, false, ['F', 'O'], false, null), ('person', 'description', 'string', false, true, null, false, null),
  ('knows', 'weight', 'enum', false, false, ['F'], false, null), ('owns', 'weight', 'string', true, false, null, false, null)),
 ends(rel, ft, tt) as (values ('knows', 'person', 'person'), ('owns', 'person', 'account'), ('near', 'person', 'account'), ('near', 'account', 'person')),
 rec as (select 'k' || o_custkey as concept, 'f' || (o_orderkey % 40) as file, 'a' || o_orderkey as anchor, 'f' || (o_orderkey % 40) || '#a' || o_orderkey as loc, o_orderkey as seq,
  case when o_orderkey % 4 = 0 then null when o_custkey % 11 = 0 then 'ghost' when o_custkey % 30 = 0 then 'issue-fact' when o_custkey % 3 = 0 then 'account-fact' else 'person-fact' end as type,
  'N' || o_custkey || case when o_orderkey % 9 = 0 then 'x' else '' end as name, o_orderpriority || o_orderstatus as statement, o_orderpriority as pr, o_orderstatus as st, o_orderkey % 17 = 0 as stray,
  case when o_orderkey % 13 = 0 then 'owns' when o_orderkey % 19 = 0 then 'nothing' end as gap, case when o_orderkey % 13 = 0 then 'r' || (o_orderkey % 2) else '' end as reason from orders),
 ref as (select 'f' || (l_orderkey % 40) || '#a' || l_orderkey as loc, 'f' || (l_orderkey % 40) as file, l_orderkey * 10 + l_linenumber as seq, 'k' || o_custkey as concept, (['knows', 'owns', 'near', 'unheard'])[(l_suppkey % 4 + 1)::int] as rel,
  case when l_partkey % 10 = 0 then 'nowhere' when l_partkey % 10 = 1 then 'led-30' else 'k' || (l_suppkey * 7) end as dst_name, l_linestatus as weight, 'qty ' || l_quantity::int as note from lineitem join orders on o_orderkey = l_orderkey),
 led0 as (select c_custkey as seq, case when c_custkey % 70 = 35 then '' else 'k' || case when c_custkey % 40 = 20 then c_custkey - 20 else c_custkey end end as concept, case when c_custkey % 10 = 0 then 'person-fact' else '' end as type,
  case when c_custkey % 15 = 0 then 'led-' || c_custkey else '' end as item, 'r00' || (c_custkey % 2) as since, ['a' || (c_custkey % 3)] as aliases from customer where c_custkey % 5 = 0),
 led as (select * from led0 where concept <> '' qualify row_number() over (partition by concept order by seq) = 1),
 store as (select 'led-' || c_custkey as id, case when c_custkey % 60 = 0 then 'open-issue' else 'person' end as type from customer where c_custkey % 30 = 0),
 grp as (select concept, arg_min(type, seq) filter (where type is not null) as own, arg_min(name, seq) filter (where type is not null) as first_name, arg_max(statement, (length(statement), -seq)) filter (where type is not null) as best,
  bool_or(type is not null) as complete, arg_min(loc, seq) as first_at from rec group by 1),
 known as (select g.*, coalesce(own, nullif(l.type, '')) as fact, f.item_type, case when f.item_type is not null then coalesce(nullif(l.item, ''), f.prefix || '-' || substr(sha256(concept), 1, 12)) end as item
  from grp g left join led l using (concept) left join facts f on f.fact = coalesce(own, nullif(l.type, ''))),
 typed as (select concept, coalesce(max(own), max(led)) as item_type from (select concept, arg_max(f.item_type, seq) as own, null as led from rec join facts f on f.fact = rec.type group by 1
  union all select concept, null, f.item_type from led join facts f on f.fact = led.type) group by 1) """


def _known(t, spark):
    facts, _, _ = _words(spark)
    return build.concepts(_records(t), _first(_ledger(t)), facts)


@query(_ROUND + """select 'B014' as code, 'error' as level, first_at as target from known where fact is null
 union all select 'B010', 'error', first_at from known where fact is not null and item_type is null
 union all select 'B014', 'error', first_at from known where item_type is not null and not complete and item not in (select id from store)""")
def findings_types(t, spark):
    """Types that no record tells, or that have no receptacle."""
    return build.typing_findings(_known(t, spark), _store(t)).select("code", "level", "target")


@query(_ROUND + """, r as (select rec.*, k.item, k.item_type, k.first_name, k.best from rec join known k using (concept) where k.item_type is not null),
 a as (select concept, item, item_type as owner, loc, seq, u.k as name, u.v as value from (select *, unnest([{'k': 'priority', 'v': pr}, {'k': 'status', 'v': st}] || case when stray then [{'k': 'stray', 'v': 's'}] else [] end) as u from r)),
 s as (select a.* from a join attr using (owner, name) where not multi and not app),
 f as (select concept, name, min(seq) as at_first, arg_min(value, (seq, value)) as v from s group by 1, 2),
 g as (select concept, gap, arg_min(reason, seq) as told from r where gap is not null group by 1, 2)
 select 'B020' as code, 'warn' as level, item as target from r where type is not null and name is distinct from first_name
 union all select distinct 'B023', 'warn', item from r where type is not null and statement is distinct from best
 union all select 'B021', 'warn', loc || '.' || name from a where not exists (select 1 from attr where attr.owner = a.owner and attr.name = a.name)
 union all select 'B022', 'warn', item || '.' || s.name from s join f using (concept, name) where seq > at_first and value <> v
 union all select 'B027', 'warn', item || '.' || r.gap from r join g on g.concept = r.concept and g.gap = r.gap where reason <> told""")
def findings_merge(t, spark):
    """What the records of a concept disagree on."""
    _, attributes, _ = _words(spark)
    return build.merge_findings(_records(t), _known(t, spark), attributes).select("code", "level", "target")


@query(_ROUND + """, told as (select k.item, gap as name, arg_min(reason, seq) as reason from rec join known k using (concept) where gap is not null and k.item is not null group by 1, 2),
 kept as (select 'led-' || c_custkey as item, 'owns' as name, 'stored' as reason from customer where c_custkey % 45 = 0)
 select coalesce(t.item, k.item) as item, coalesce(t.name, k.name) as name, coalesce(k.reason, t.reason) as reason from told t full join kept k on t.item = k.item and t.name = k.name""")
def merged_gaps(t, spark):
    """Declared gaps of items: the first reason of a round, the store's before it."""
    kept = t("customer").where("c_custkey % 45 = 0").select(F.concat(F.lit("led-"), "c_custkey").alias("item"), F.lit("owns").alias("name"), F.lit("stored").alias("reason"))
    return build.merged_gaps(_records(t), _known(t, spark), kept)


@query(_ROUND + """, e as (select ref.*, s.item as src, s.item_type as st, coalesce(d.item, o.id) as dst, coalesce(d.item_type, o.type) as dt, rel in (select rel from ends) as declared from ref join known s on s.concept = ref.concept and s.item is not null
  left join known d on d.concept = ref.dst_name and d.item is not null left join store o on o.id = ref.dst_name),
 o as (select *, exists (select 1 from ends where ends.rel = e.rel and ft = st and tt = dt) as fwd, exists (select 1 from ends where ends.rel = e.rel and ft = dt and tt = st) as rev from e where declared and dst is not null),
 d as (select *, case when rev and not fwd then dst else src end as f, case when rev and not fwd then src else dst end as g from o where fwd or rev),
 v as (select d.* from d join attr on attr.owner = d.rel and attr.name = 'weight' and not multi), x as (select rel, f, g, min(seq) as first_seq, arg_min(weight, (seq, weight)) as w from v group by 1, 2, 3)
 select 'B011' as code, 'error' as level, loc as target from e where not declared union all select 'B012', 'warn', loc from e where declared and dst is null
 union all select 'B013', 'error', loc from o where not fwd and not rev
 union all select distinct 'B026', 'warn', rel || ' ' || st || '→' || dt from o where fwd and rev and st <> dt
 union all select 'B024', 'warn', v.f || '-' || v.rel || '-' || v.g from v join x on x.rel = v.rel and x.f = v.f and x.g = v.g where seq > first_seq and weight <> w""")
def findings_references(t, spark):
    """References that cannot be built, turn both ways, or disagree."""
    _, attributes, ends = _words(spark)
    resolved = build.resolved_refs(_refs(t), _known(t, spark), _store(t), ends)
    needed = ["rel", "file", "anchor", "seq", "attrs", "declared", "src_type", "dst_type", "dst", "direction", "from", "to"]
    return build.reference_findings(cut(resolved.select(*needed), "references"), attributes).select("code", "level", "target")


@query(_ROUND + """select 'B000' as code, 'error' as level, 'ledger[' || seq || ']' as target from led0 where concept = ''
 union all select 'B001', 'error', concept from (select concept, row_number() over (partition by concept order by seq) as k from led0 where concept <> '') where k > 1
 union all select 'W035', 'warn', concept from led where item = '' union all select 'E029', 'error', concept from led where item <> '' and item not in (select id from store)""")
def findings_ledger(t, spark):
    """Entries of the ledger: blank, repeated, unmapped, or mapped to nothing."""
    return build.ledger_findings(_ledger(t), _store(t)).select("code", "level", "target")


def _proposal(t):
    c = F.col("c_custkey")
    new = t("customer").where(c % 4 == 0).select(c.alias("seq"), F.when(c % 52 == 0, "").otherwise(F.concat(F.lit("k"), F.when(c % 24 == 0, c - 4).otherwise(c))).alias("concept"), F.lit("person-fact").alias("type"), F.lit(None).cast("string").alias("label"), F.array(F.concat(F.lit("a"), c % 3)).alias("aliases"))
    assign = t("customer").where(c % 6 == 1).select(c.alias("seq"), F.concat(F.lit("k"), c).alias("concept"), F.array(F.lit("z")).alias("aliases_add"))
    return new, assign


_PROPOSAL = """, new as (select c_custkey as seq, case when c_custkey % 52 = 0 then '' else 'k' || case when c_custkey % 24 = 0 then c_custkey - 4 else c_custkey end end as concept, 'a' || (c_custkey % 3) as alias from customer where c_custkey % 4 = 0),
 asg as (select 'k' || c_custkey as concept from customer where c_custkey % 6 = 1),
 fresh as (select concept, min(seq) as first_seq, arg_min(alias, seq) as alias from new where concept <> '' and concept not in (select concept from led) group by 1),
 base as (select concept, since, aliases from led union all select concept, 'r001', [alias] from fresh),
 again as (select new.concept, new.alias, b.aliases, b.since from new join base b using (concept) left join fresh f using (concept) where f.concept is null or new.seq > f.first_seq) """


@query(_ROUND + _PROPOSAL + """select 'B000' as code, 'error' as level, 'new' as target from new where concept = ''
 union all select 'B002', 'warn', concept from again where not list_contains(aliases, alias) or since <> 'r001'
 union all select 'B003', 'error', concept from asg where concept not in (select concept from base)""")
def findings_proposal(t, spark):
    """A proposal's entries that are blank, known already, or assign to nothing."""
    return build.apply_proposal(_first(_ledger(t)), *_proposal(t), "r001")[1].select("code", "level", "target")


@query(_ROUND + _PROPOSAL + """, more as (select concept, alias from again union all select concept, 'z' from asg)
 select b.concept, b.since, array_to_string(list_sort(list_distinct(b.aliases || coalesce((select list(alias) from more m where m.concept = b.concept), []))), ',') as aliases from base b""")
def ledger_after_proposal(t, spark):
    """The ledger with new concepts and aliases."""
    return build.apply_proposal(_first(_ledger(t)), *_proposal(t), "r001")[0].select("concept", "since", F.concat_ws(",", "aliases").alias("aliases"))


@query(_ROUND + """, pos as (select l_orderkey as entry, case when l_suppkey % 9 = 0 then 'led-x' when l_suppkey % 5 = 0 then 'k' || (l_orderkey % 300 // 30 * 30) else 'k' || (l_orderkey % 300) end as subject, l_linestatus || l_returnflag as statement from lineitem),
 ent as (select entry, subject from pos group by 1, 2 having count(*) >= 2),
 e as (select ent.*, k.item, coalesce(k.item_type, s.type) as item_type from ent left join known k on k.concept = ent.subject and k.item is not null left join store s on s.id = k.item),
 fst as (select subject, min(entry) as first_entry from e where item_type is distinct from 'open-issue' group by 1)
 select 'B015' as code, 'warn' as level, subject as target from e where item_type = 'open-issue'
 union all select 'B017', 'warn', subject from e join fst using (subject) where item_type is distinct from 'open-issue' and entry > first_entry
 union all select 'B016', 'warn', 'iss-' || substr(sha256(subject), 1, 12) from e where item_type is distinct from 'open-issue' and (item is null or coalesce(item_type, '') <> 'person')""")
def findings_contradictions(t, spark):
    """Subjects that sources contradict each other on: issues, repeats, and what cannot be disputed."""
    k = F.col("l_orderkey") % 300
    subject = F.when(F.col("l_suppkey") % 9 == 0, "led-x").when(F.col("l_suppkey") % 5 == 0, F.concat(F.lit("k"), (F.floor(k / 30) * 30).cast("string"))).otherwise(F.concat(F.lit("k"), k))
    positions = t("lineitem").select(F.col("l_orderkey").alias("entry"), subject.alias("subject"), F.lit(None).cast("string").alias("concept"), F.concat("l_linestatus", "l_returnflag").alias("statement"))
    return build.contradiction_findings(positions, _known(t, spark), _store(t), ["person"]).select("code", "level", "target")


def _shaped(t):
    k = F.col("seq")
    rows = _records(t).withColumn("extra", F.when(k % 23 == 0, F.array(F.lit("memo"))).otherwise(F.array().cast(_STRINGS)))
    rows = rows.withColumn("statement", F.when(k % 29 == 0, "").otherwise(F.col("statement"))).withColumn("name", F.when(F.col("type").isNull(), None).otherwise(F.col("name")))
    rows = rows.withColumn("statement", F.when(F.col("type").isNull(), None).otherwise(F.col("statement"))).withColumn("concept", F.when(k % 31 == 0, "").otherwise(F.col("concept")))
    return rows.withColumn("refs", F.when(k % 37 == 0, F.array(F.struct(F.lit("knows").alias("rel"), F.lit("").alias("to")))).otherwise(F.array().cast("array<struct<rel:string,to:string>>")))


def _scope(t):
    """Anchors declared out of scope, from customers."""
    c = F.col("c_custkey")
    kind = F.when(c % 8 == 0, "未読取").when(c % 21 == 0, "other").when(c % 5 == 0, None).otherwise("対象外")
    reason = F.when(c % 10 == 0, "").when(c % 16 == 0, F.concat(F.lit("opened p"), (c % 40).cast("string"), F.lit(".png"))).otherwise("seen")
    return t("customer").where(c % 4 == 0).select(F.concat(F.lit("f"), c % 40).alias("file"), F.concat(F.lit("a"), c).alias("anchor"), kind.alias("kind"), reason.alias("reason"))


_SCOPE = """, scope as (select 'f' || (c_custkey % 40) as file, 'a' || c_custkey as anchor, 'f' || (c_custkey % 40) || '#a' || c_custkey as loc, case when c_custkey % 8 = 0 then '未読取' when c_custkey % 21 = 0 then 'other' when c_custkey % 5 = 0 then null else '対象外' end as kind,
  case when c_custkey % 10 = 0 then '' when c_custkey % 16 = 0 then 'opened p' || (c_custkey % 40) || '.png' else 'seen' end as reason from customer where c_custkey % 4 = 0) """


@query(_ROUND + _SCOPE + """select 'G006' as code, 'error' as level, loc as target from rec where seq % 31 = 0 or (type is not null and seq % 29 = 0)
 union all select 'G006', 'error', loc from rec where gap is not null and reason = '' union all select 'G006', 'error', loc from scope where reason = ''
 union all select 'G008', 'warn', loc from rec where seq % 23 = 0 union all select 'G011', 'error', loc from scope where kind = 'other' union all select 'G000', 'error', loc from rec where seq % 37 = 0""")
def gate_shape(t, spark):
    """Fields that records and declarations must or must not have."""
    return organised.shape_findings(_shaped(t), _scope(t)).select("code", "level", "target")


@query(_ROUND + """, own as (select rec.loc, rec.seq, f.item_type as owner, '' as dst, unnest([{'k': 'priority', 'v': pr}, {'k': 'status', 'v': st}] || case when stray then [{'k': 'stray', 'v': 's'}] else [] end) as u from rec join facts f on f.fact = rec.type),
 every as (select loc, seq, owner, dst, u.k as name, u.v as value from own union all select loc, seq, rel, dst_name, 'weight', weight from ref where rel in (select rel from ends))
 select 'G002' as code, 'error' as level, loc as target from rec where type is not null and type not in (select fact from facts) union all select 'G002', 'error', loc from ref where rel not in (select rel from ends)
 union all select 'G016', 'warn', loc from (select distinct loc, seq, owner, dst from every e where not exists (select 1 from attr where attr.owner = e.owner and attr.name = e.name))
 union all select 'G028', 'warn', loc || '.' || e.owner || '.' || e.name from every e join attr a on a.owner = e.owner and a.name = e.name where a.kind = 'enum' and not ext and not list_contains(vals, value)""")
def gate_vocabulary(t, spark):
    """Types, relations, attributes and values that the vocabulary does not have."""
    facts, attributes, ends = _words(spark)
    return organised.vocabulary_findings(_records(t), _refs(t), facts, attributes, ends).select("code", "level", "target")


@query(_ROUND + _PROPOSAL + """, asg2 as (select concept from asg), every as (select concept from rec union select concept from led union select concept from new where concept <> '')
 select 'G003' as code, 'error' as level, loc as target from ref where dst_name not in (select concept from every) union all select 'G003', 'error', concept from asg2 where concept not in (select concept from every)
 union all select 'G013', 'error', min(loc) from rec where type is null and concept not in (select concept from rec where type is not null) and concept not in (select concept from led where type <> '') group by concept
 union all select 'G002', 'error', concept from new where seq % 3 = 0 union all select 'G021', 'error', concept from asg2 where concept not in (select concept from led)""")
def gate_concepts(t, spark):
    """Concepts that nothing defines, and a proposal's types and assignments."""
    facts, _, _ = _words(spark)
    new, assign = _proposal(t)
    new = new.withColumn("type", F.when(F.col("seq") % 3 == 0, "unknown-fact").otherwise(F.col("type")))
    return organised.concept_findings(_records(t), _refs(t), _first(_ledger(t)), new, assign, facts).select("code", "level", "target")


@query("""with p as (select 'type-' || c_custkey as name, case when c_custkey % 3 = 0 then 'deferred' else '' end as status, case when c_custkey % 6 = 0 then 'why' else '' end as reason from customer where c_custkey % 50 < 6
  union all values ('person', '', ''), ('person-fact', '', ''), ('', '', ''))
 select 'G007' as code, case when status = 'deferred' and reason <> '' then 'warn' else 'error' end as level, name as target from p where name not in ('', 'person', 'account', 'person-fact', 'account-fact', 'method-fact', 'module-fact', 'issue-fact')""")
def gate_proposals(t, spark):
    """Proposed types that are not approved."""
    c = F.col("c_custkey")
    p = t("customer").where("c_custkey % 50 < 6").select(F.concat(F.lit("type-"), c).alias("name"), F.when(c % 3 == 0, "deferred").otherwise("").alias("status"), F.when(c % 6 == 0, "why").otherwise("").alias("deferred_reason"))
    p = p.union(spark.createDataFrame([("person", "", ""), ("person-fact", "", ""), ("", "", "")], p.schema))
    types = spark.createDataFrame([("person",), ("account",)], "name string")
    return organised.proposal_findings(p, types, _words(spark)[0]).select("code", "level", "target")


@query(_ROUND + """select 'G012' as code, 'error' as level, loc as target from ref join typed s on s.concept = ref.concept join typed d on d.concept = ref.dst_name where rel in (select rel from ends)
 and not exists (select 1 from ends where ends.rel = ref.rel and ((ft = s.item_type and tt = d.item_type) or (ft = d.item_type and tt = s.item_type)))""")
def gate_pairs(t, spark):
    """Relations between types that fit neither direction."""
    facts, _, ends = _words(spark)
    types = organised.item_types(_records(t), _first(_ledger(t)), facts)
    return organised.pair_findings(_records(t), _refs(t), types, ends).select("code", "level", "target")


@query(_ROUND + """, w as (select distinct concept, rel from ref), g as (select concept, gap, arg_min(loc, seq) as loc from rec where gap is not null group by 1, 2),
 sp as (select concept, arg_min(type, seq) as type, arg_min(loc, seq) as loc from rec where type is not null group by 1)
 select 'G031' as code, 'error' as level, loc || '.' || gap as target from rec join facts f on f.fact = rec.type where gap is not null and gap not in (select rel from ends) and not exists (select 1 from attr where owner = f.item_type and name = gap)
 union all select 'G031', 'warn', loc || '.' || gap from g where exists (select 1 from w where w.concept = g.concept and w.rel = g.gap)
 union all select 'G020', 'warn', sp.loc || '.owns' from sp join facts f on f.fact = sp.type where f.item_type = 'person' and not exists (select 1 from w where w.concept = sp.concept and rel = 'owns') and not exists (select 1 from g where g.concept = sp.concept and gap = 'owns')""")
def gate_requirements(t, spark):
    """Needed relations that are not written, and gaps that name nothing or are filled."""
    facts, attributes, ends = _words(spark)
    needed = spark.createDataFrame([("person", "owns")], "item_type string, rel string")
    out = organised.requirement_findings(_records(t), _refs(t), None, facts, needed, attributes, ends)
    return out.select("code", "level", "target")


@query("""with r as (select 'd' || source as file, 'a' || doc_id as anchor, case when doc_id % 3 = 0 then 'my.' || lang when doc_id % 7 = 0 then 'free name' else lang end as name,
  case when doc_id % 11 = 0 then 'see <TODO from x> ' else '' end || substr(text, 1, (doc_id % 260)::int) as statement, doc_id % 13 = 0 as hole from documents where text is not null)
 select 'G026' as code, 'error' as level, file || '#' || anchor as target from r where hole or regexp_matches(statement, '<TODO[^>]*>')
 union all select 'G027', 'warn', file || '#' || anchor from r where file in ('dsrc1', 'dsrc2') and not regexp_matches(statement, '<TODO[^>]*>') and (length(statement) not between 10 and 200
  or (name <> 'free name' and not contains(statement, string_split(name, '.')[-1])))""")
def gate_wording(t, spark):
    """Slots left open and drafted texts that are no copies."""
    k = F.col("doc_id")
    d = t("documents").where("text is not null")
    name = F.when(k % 3 == 0, F.concat(F.lit("my."), "lang")).when(k % 7 == 0, "free name").otherwise(F.col("lang"))
    statement = F.concat(F.when(k % 11 == 0, "see <TODO from x> ").otherwise(""), F.expr("substr(text, 1, cast(doc_id % 260 as int))"))
    attrs = F.create_map(F.lit("x"), F.when(k % 13 == 0, "<TODO>").otherwise("y"))
    r = d.select(F.concat(F.lit("d"), "source").alias("file"), F.concat(F.lit("a"), k).alias("anchor"), F.lit("person-fact").alias("type"), name.alias("name"), statement.alias("statement"), attrs.alias("attrs"))
    drafted = spark.createDataFrame([("dsrc1",), ("dsrc2",)], "file string")
    return organised.wording_findings(r, drafted).select("code", "level", "target")


@query("""with r as (select 'p' || (p_partkey % 30) as file, (['m', 'v', 'i', 'x'])[(p_partkey % 4 + 1)::int] || (p_partkey % 3) as anchor, p_partkey as seq, 'c-mod-' || replace(p_name, ' ', '.') || '.' || p_partkey as concept,
  case when p_size % 3 = 0 then 'module-fact' when p_size % 3 = 1 then 'method-fact' end as type, case when p_partkey % 9 = 0 then 'm.__init__' else p_name end as name, lower(p_brand) as brand, p_size from part),
 m as (select *, file || '#' || anchor as loc, case when p_size % 5 = 0 then split_part(concept, '.', 2) when p_size % 5 = 1 then '' else brand end as package, case when p_size % 7 = 0 then 'why' else '' end as descr, case when p_size % 2 = 0 then 'C' else '' end as cls from r where anchor[1] <> 'x'),
 heads as (select file, anchor, (['クラス: A', 'def f', '定数', 'テスト x'])[(p_partkey % 4 + 1)::int] as head, p_partkey from (select 'p' || (p_partkey % 30) as file, (['m', 'v', 'i', 'x'])[(p_partkey % 4 + 1)::int] || (p_partkey % 3) as anchor, p_partkey from part) qualify row_number() over (partition by file, anchor order by p_partkey) = 1)
 select 'G022' as code, 'warn' as level, loc as target from m where anchor = 'i1' and seq % 2 = 0
 union all select 'G023', 'warn', loc from m where type = 'method-fact' and regexp_matches(name, '__\\w+__$')
 union all select 'G024', 'warn', loc from m where type = 'module-fact' and package <> '' and descr = '' and not contains('.' || substr(concept, 7) || '.', '.' || package || '.')
 union all select 'G025', 'warn', m.loc from m join heads h on h.file = m.file and h.anchor = m.anchor where type = 'module-fact' and cls = '' and (head like 'クラス:%' or head like 'テスト%' or head like '定数%')""")
def gate_code(t, spark):
    """Conventions of records taken from code."""
    p, size = F.col("p_partkey"), F.col("p_size")
    letters = F.element_at(F.array(*map(F.lit, "mvix")), (p % 4 + 1).cast("int"))
    rows = t("part").select("*", F.concat(F.lit("p"), p % 30).alias("file"), F.concat(letters, p % 3).alias("anchor"), p.alias("seq"), F.concat(F.lit("c-mod-"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), p).alias("concept"))
    package = F.when(size % 5 == 0, F.split_part("concept", F.lit("."), F.lit(2))).when(size % 5 == 1, "").otherwise(F.lower("p_brand"))
    attrs = F.create_map(F.lit("package"), package, F.lit("description"), F.when(size % 7 == 0, "why").otherwise(""), F.lit("class_name"), F.when(size % 2 == 0, "C").otherwise(""))
    kind = F.when(size % 3 == 0, "module-fact").when(size % 3 == 1, "method-fact")
    rec = rows.select("file", "anchor", "seq", "concept", kind.alias("type"), F.when(p % 9 == 0, "m.__init__").otherwise(F.col("p_name")).alias("name"), F.lit("s").alias("statement"), attrs.alias("attrs"))
    refs = rec.where("seq % 2 = 0").select("file", "anchor", F.lit("calls").alias("rel"), F.lit("the-method").alias("to"))
    types = spark.createDataFrame([("the-method", "method")], "concept string, item_type string")
    head = F.element_at(F.array(*map(F.lit, ("クラス: A", "def f", "定数", "テスト x"))), (p % 4 + 1).cast("int"))
    anchors = rows.groupBy("file", "anchor").agg(F.min_by(F.concat(head, F.lit("\n body")), p).alias("body"))
    return organised.code_findings(rec, refs, types, _words(spark)[0], anchors).select("code", "level", "target")


@query(_ROUND + """, told as (select file, loc, seq, concept, type, st, pr, case when seq % 6 = 0 then '優先 高 ／ status x' when seq % 6 = 1 then '単位 円、priority 1' when seq % 6 = 2 then 'plain text' end as told from rec),
 own as (select t.file, t.loc, t.seq, f.item_type as owner, false as edge, told, case when seq % 18 = 0 then '' else pr end as pr, st from told t join facts f on f.fact = t.type where told is not null),
 g29 as (select file, owner, count(*) as n from own where told = '優先 高 ／ status x' and (pr = '' or st = '') and owner <> 'open-issue' group by 1, 2),
 lead as (select owner, false as edge, '優先' as head from own where owner = 'open-issue' and told like '優先%' union all select owner, false as edge, '単位' as head from own where told like '単位%' union all select owner, false, 'plain' from own where told like 'plain%' union all select rel, true, 'qty' from ref where rel in (select rel from ends))
 select 'G029' as code, 'warn' as level, file || '#' || owner as target from g29
 union all select 'G030', 'warn', owner || '#' || head from lead group by owner, edge, head having count(*) >= 4""")
def gate_descriptions(t, spark):
    """Fields that escaped into descriptions, and headings that have no field."""
    facts, attributes, ends = _words(spark)
    k = F.col("seq")
    told = F.when(k % 6 == 0, "優先 高 ／ status x").when(k % 6 == 1, "単位 円、priority 1").when(k % 6 == 2, "plain text")
    priority = F.when(k % 18 == 0, "").otherwise(F.try_element_at("attrs", F.lit("priority")))
    rec = _records(t).withColumn("attrs", F.create_map(F.lit("priority"), priority, F.lit("status"), F.try_element_at("attrs", F.lit("status")), F.lit("description"), told))
    return organised.description_findings(rec, _refs(t), facts, attributes, ends).select("code", "level", "target")


@query(_ROUND + """, bare as (select *, seq % 5 = 0 as no_pr, seq % 7 = 0 as no_st from rec where type in ('person-fact', 'account-fact')), cells as (select loc, name, unnest(['N' || (seq % 3), 'Q', name, case when seq % 10 = 3 then name else 'R' end]) as key, generate_subscripts([1, 2, 3, 4], 1) as row from bare),
 hit as (select c.* from cells c where c.key <> '' and ends_with(c.name, c.key) and (c.name = c.key or not regexp_matches(substr(c.name, length(c.name) - length(c.key), 1), '[\\p{L}\\p{N}_]'))), one as (select loc, count(*) as n from hit group by 1 having count(*) = 1)
 select 'G018' as code, 'warn' as level, b.loc || '.' || case type when 'account-fact' then 'priority' else 'status' end as target from bare b join one using (loc) where case type when 'account-fact' then no_pr else no_st end""")
def gate_columns(t, spark):
    """Source rows whose filled cells did not become attributes."""
    facts, attributes, _ = _words(spark)
    k = F.col("seq")
    kept = F.map_filter("attrs", lambda n, v: ~(((n == "priority") & (k % 5 == 0)) | ((n == "status") & (k % 7 == 0))))
    rec = _records(t).where("type in ('person-fact', 'account-fact')").withColumn("attrs", kept)
    keys = F.array(F.concat(F.lit("N"), k % 3), F.lit("Q"), "name", F.when(k % 10 == 3, F.col("name")).otherwise("R"))
    body = rec.select("file", "anchor", F.posexplode(keys).alias("p", "key"))
    body = body.select("file", "anchor", (F.col("p") + 1).alias("row"), F.posexplode(F.array(F.col("key"), F.lit("v"), F.lit("w"))).alias("col", "text"))
    head = rec.select("file", "anchor", F.lit(0).alias("row"), F.posexplode(F.array(F.lit("Key"), F.lit("Priority"), F.lit("Status"))).alias("col", "text"))
    return organised.column_findings(rec, body.union(head), facts, attributes).select("code", "level", "target")


@query(_ROUND + _SCOPE + """select 'G015' as code, 'warn' as level, loc as target from scope where kind = '未読取' and substr(file, 2)::int % 16 = 0 and not contains(reason, 'p' || substr(file, 2) || '.png') """)
def gate_images(t, spark):
    """Declared unread although there are images that the reason does not name."""
    c = F.col("c_custkey")
    anchors = t("customer").select(F.concat(F.lit("f"), c % 40).alias("file"), F.concat(F.lit("g"), c).alias("anchor"), F.when(c % 40 % 16 == 0, F.array(F.concat(F.lit("img/p"), c % 40, F.lit(".png")))).otherwise(F.array().cast(_STRINGS)).alias("images"))
    return organised.image_findings(_scope(t), anchors).select("code", "level", "target")


@query("""with a as (select p_partkey as k, 'd/' || p_partkey as file, sha256(p_name) as h from part where p_partkey % 7 <> 0), b as (select p_partkey as k, 'd/' || p_partkey as file, sha256(p_name || case when p_partkey % 10 = 0 then '!' else '' end) as h from part where p_partkey % 9 <> 0)
 select 'G009' as code, 'error' as level, coalesce(a.file, b.file) as target from a full join b using (file) where a.h is distinct from b.h and coalesce(a.k, b.k) % 4 <> 0
 union all select 'G019', 'warn', a.file from a left join b using (file) where a.h is distinct from b.h""")
def gate_drift(t, spark):
    """Frozen results and sources that changed."""
    p = F.col("p_partkey")
    rows = t("part").select(p.alias("k"), F.concat(F.lit("d/"), p).alias("file"), F.sha2("p_name", 256).alias("was"), F.sha2(F.concat("p_name", F.when(p % 10 == 0, "!").otherwise("")), 256).alias("now"))
    was, now = rows.where("k % 7 <> 0").select("file", F.col("was").alias("hash")), rows.where("k % 9 <> 0").select("file", F.col("now").alias("hash"))
    amended = rows.where("k % 4 = 0").select("file")
    source = organised.source_drift(was.withColumnRenamed("file", "path"), now.withColumnRenamed("file", "path"))
    return organised.drift_findings(was, now, amended).union(source).select("code", "level", "target")


@query("""with f as (select case when p_partkey % 5 = 0 then '_' else '' end || 'n' || p_partkey as file, p_partkey as k from part union all values ('_concepts', -1), ('sub/_x', -2)),
 g as (select k, 'a' || k as loc, 'r' || (k % 6) as r from f where k > 0)
 select 'G032' as code, 'warn' as level, file as target from f where file[1] = '_' and file <> '_concepts' and k % 10 <> 0 union all select 'G010', 'error', 'n' || k || '#' || loc from g where r in ('r4', 'r5')""")
def gate_files(t, spark):
    """Files that are not read for their names, and rounds that are not there."""
    p = F.col("p_partkey")
    named = t("part").select(F.concat(F.when(p % 5 == 0, "_").otherwise(""), F.lit("n"), p).alias("file"), p.alias("k"))
    files = named.select("file").union(spark.createDataFrame([("_concepts",), ("sub/_x",)], "file string"))
    parsed = named.where("k % 10 = 0").select("file")
    rec = t("part").where("p_partkey > 0").select(F.concat(F.lit("n"), p).alias("file"), F.concat(F.lit("a"), p).alias("anchor"), F.concat(F.lit("r"), p % 6).alias("round"))
    rounds = spark.createDataFrame([(f"r{i}",) for i in range(4)], "round string")
    return organised.file_findings(files, parsed, ["_concepts"]).union(organised.round_findings(rec, rounds)).select("code", "level", "target")


@query(_ROUND + _SCOPE + """, anc as (select 'f' || (o_orderkey % 40) as file, 'a' || o_orderkey as anchor from orders where o_orderkey % 3 <> 0 union all select 'f' || i, 'extra' from (select unnest(range(45)) as i))
 select (select count(distinct file) from anc)::bigint as parsed_files, (select count(*) from anc)::bigint as anchors, (select count(*) from rec)::bigint as records, (select count(*) from rec where type is null)::bigint as "references",
 (select count(gap) from rec)::bigint as known_gaps, (select count(*) from scope)::bigint as out_of_scope, (select count(*) from scope where kind = '未読取')::bigint as unreadable,
 (select count(*) from anc where (file, anchor) not in (select (file, anchor) from rec) and (file, anchor) not in (select (file, anchor) from scope))::bigint as unclaimed""")
def gate_metrics(t, spark):
    """The counts that a gate reports."""
    k = F.col("o_orderkey")
    anchors = t("orders").where(k % 3 != 0).select(F.concat(F.lit("f"), k % 40).alias("file"), F.concat(F.lit("a"), k).alias("anchor"))
    anchors = anchors.union(spark.range(45).select(F.concat(F.lit("f"), "id"), F.lit("extra")))
    return organised.metrics(_records(t), anchors, _scope(t))


def _counted(*names: str) -> str:
    return " union all ".join(f"select code, level, target from ({ORACLE[n]})" for n in names)


_GATE = _counted("gate_vocabulary", "gate_pairs", "gate_requirements")


@query(f"select code, level, count(*)::bigint as n from ({_GATE} union all select code, level, target from ({ORACLE['gate_concepts']}) where code <> 'G002' or target like 'f%') where code not in ('G001', 'G004') group by 1, 2")
def gate_report(t, spark):
    """The whole gate in one report, counted by code."""
    facts, attributes, ends = _words(spark)
    new, assign = _proposal(t)
    records = _records(t).withColumns({"extra": F.array().cast(_STRINGS), "refs": F.array().cast("array<struct<rel:string,to:string>>")})
    anchors = records.select("file", "anchor", F.array().cast(_STRINGS).alias("images"))
    scope = anchors.select("file", "anchor", F.lit("対象外").alias("kind"), F.lit("why").alias("reason")).limit(0)
    needed = spark.createDataFrame([("person", "owns")], "item_type string, rel string")
    refs = cut(_refs(t).drop("note"), "gate-references")
    out = organised.gate(records, refs, anchors, scope, _first(_ledger(t)), new, assign, facts, attributes, ends, needed)
    return out.where("code not in ('G006')").groupBy("code", "level").agg(F.count("*").alias("n"))


@query("""select 'f' || page_id as file, substr(sha256(html), 1, 12) as hash, case when page_id % 5 = 0 then 'why ' || page_id end as amendment from pages""")
def frozen_manifest(t, spark):
    """Hashes of a frozen round, with the amendments of the manifest before."""
    files = t("pages").select(F.concat(F.lit("f"), "page_id").alias("file"), F.col("html").alias("content"), "page_id")
    before = files.where("page_id % 5 = 0").select("file", F.concat(F.lit("why "), "page_id").alias("amendment"))
    return organised.freeze(files, before)


@query("""with m as (select 'p' || p_partkey as path, sha256(p_name) as hash, 'r00' || (1 + p_partkey % 3) as round from part where p_partkey % 4 <> 0), p as (select 'p' || p_partkey as path, sha256(p_name || case when p_partkey % 6 = 0 then '!' else '' end) as hash from part)
 select p.path, p.hash, 'r004' as round from p left join m using (path) where m.hash is distinct from p.hash""")
def next_rounds(t, spark):
    """Sources that go to a new round."""
    p = F.col("p_partkey")
    rows = t("part").select(p.alias("k"), F.concat(F.lit("p"), p).alias("path"), F.sha2("p_name", 256).alias("was"), F.sha2(F.concat("p_name", F.when(p % 6 == 0, "!").otherwise("")), 256).alias("now"))
    manifest = rows.where("k % 4 <> 0").select("path", F.col("was").alias("hash"), F.concat(F.lit("r00"), 1 + F.col("k") % 3).alias("round"))
    return metering.next_rounds(manifest, rows.select("path", F.col("now").alias("hash")))


SHAPE = {
    "code": "G000", "known": ["k", "name", "list", "kind"], "unknown": "G008",
    "required": [{"keys": ["k"], "code": "G006"}, {"keys": ["name", "kind"], "together": True, "code": "G006", "level": "warn"}],
    "keys": {"kind": {"values": ["a", "b"], "code": "G011"}}, "kinds": {"list": {"kind": "list", "code": "G000"}},
}


@query("""with e as (select event_id as i, event_id % 12 as r from events)
 select 'G000' as code, 'error' as level, i as target from e where r in (1, 2) union all select 'G006', 'error', i from e where r = 3 union all select 'G006', 'warn', i from e where r in (4, 5)
 union all select 'G011', 'error', i from e where r in (5, 6) union all select 'G000', 'error', i from e where r = 7 union all select 'G008', 'warn', i from e where r = 8""")
def declared_shapes(t, spark):
    """Records against a declared shape."""
    r = F.col("event_id") % 12
    body = F.when(r == 1, "[1]").when(r == 2, "{broken").when(r == 3, '{"k": ""}').when(r == 4, '{"k": 1, "name": "x"}').when(r == 5, '{"k": 1, "kind": "z"}').when(r == 6, '{"k": 1, "name": "x", "kind": "z"}').when(r == 7, '{"k": 1, "list": {"x": 1}}').when(r == 8, '{"k": 1, "memo": 2}').when(r == 9, '{"k": 1, "list": [1], "name": "x", "kind": "a"}').otherwise(F.col("props"))
    return shapes.shape_findings(t("events").select(F.col("event_id").alias("target"), body.alias("body")), SHAPE).select("code", "level", "target")
