"""Constraint queries over a store of items and relations made of the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import checks
from lodestone.plans import sections
from lodestone.queries.registry import query

#: The vocabulary of the sample store.
VOCAB = checks.Vocabulary(
    attributes=[
        checks.Attribute("customer", "segment", required=True, values=["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]),
        checks.Attribute("customer", "name", unique=True, pattern="Customer#[0-9]+"),
        checks.Attribute("nation", "name", required=True, unique=True),
        checks.Attribute("supplier", "name", pattern="Supplier#[0-9]*[02468]"),
    ],
    relations=[
        checks.Relation("lives-in", ["customer"], ["nation"], low=1, high=1, ordered=False),
        checks.Relation("ships-from", ["supplier"], ["nation"], low=0, high=None, ordered=True),
    ],
    item_types=["customer", "nation", "supplier"],
)


def store(t):
    """items (id, type, status, attrs, gaps) and relations (type, from, to, ord). Faults are put
    in by rule, so the checks have something to find."""
    c, n, s = t("customer"), t("nation"), t("supplier")
    attrs = lambda **kv: F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v)))
    k = F.col("c_custkey")
    seg = F.when(k % 10 == 0, "").otherwise(F.col("c_mktsegment"))
    items = (
        c.select(F.concat(F.lit("c"), k).alias("id"), F.lit("customer").alias("type"), F.when(k % 50 == 0, "odd").otherwise("draft").alias("status"), attrs(segment=seg, name=F.when(k % 25 == 0, "Customer#1").otherwise(F.concat(F.lit("Customer#"), k))).alias("attrs"), F.when(k % 20 == 0, F.array(F.lit("segment"))).otherwise(F.array().cast("array<string>")).alias("gaps"))
        .union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.lit("nation"), F.lit("draft"), attrs(name=F.col("n_name"), note=F.lit("x")), F.array().cast("array<string>")))
        .union(s.select(F.concat(F.lit("s"), "s_suppkey"), F.lit("supplier"), F.lit("approved"), attrs(name=F.concat(F.lit("Supplier#"), "s_suppkey")), F.array().cast("array<string>")))
    )
    lives = c.where((k % 9 != 0) & (F.col("c_nationkey") != 24)).select(F.lit("lives-in").alias("type"), F.concat(F.lit("c"), k).alias("from"), F.when(k % 16 == 0, F.lit("n999")).otherwise(F.concat(F.lit("n"), "c_nationkey")).alias("to"), F.lit(None).cast("int").alias("ord"))
    ships = s.where("s_nationkey % 4 <> 0 or s_suppkey = 2").select(F.lit("ships-from").alias("type"), F.concat(F.lit("s"), "s_suppkey").alias("from"), F.concat(F.lit("n"), "s_nationkey").alias("to"), F.when(F.col("s_suppkey") % 6 != 0, (F.col("s_suppkey") % 4).cast("int")).alias("ord"))
    wrong = s.where("s_suppkey % 8 = 0").select(F.lit("lives-in"), F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("s"), "s_suppkey"), F.lit(None).cast("int"))
    return items, lives.union(ships).union(wrong).union(ships.where(F.col("from") == "s2"))


_STORE = """with c as (select *, case when c_custkey % 10 = 0 then '' else c_mktsegment end as seg, case when c_custkey % 25 = 0 then 'Customer#1' else 'Customer#' || c_custkey end as nm from customer),
 rel as (select 'lives-in' as type, 'c' || c_custkey as f, case when c_custkey % 16 = 0 then 'n999' else 'n' || c_nationkey end as t, null::int as ord from customer where c_custkey % 9 <> 0 and c_nationkey <> 24
  union all select 'ships-from', 's' || s_suppkey, 'n' || s_nationkey, case when s_suppkey % 6 <> 0 then (s_suppkey % 4)::int end from supplier where s_nationkey % 4 <> 0 or s_suppkey = 2
  union all select 'lives-in', 's' || s_suppkey, 's' || s_suppkey, null from supplier where s_suppkey % 8 = 0
  union all select 'ships-from', 's' || s_suppkey, 'n' || s_nationkey, case when s_suppkey % 6 <> 0 then (s_suppkey % 4)::int end from supplier where s_suppkey = 2) """


def _check(name: str, code: str, sql: str):
    @query(_STORE + sql)
    def run(t, spark, code=code):
        items, relations = store(t)
        return checks.validate(items, relations, VOCAB, codes=[code]).select("code", "level", "target")

    from lodestone.queries.registry import ORACLE, QUERIES

    QUERIES[name], ORACLE[name] = QUERIES.pop("run"), ORACLE.pop("run")


_check("check_e004_status", "E004", "select 'E004' as code, 'error' as level, 'c' || c_custkey as target from c where c_custkey % 50 = 0")
_check("check_e010_required", "E010", "select case when c_custkey % 20 = 0 then 'W032' else 'E010' end as code, case when c_custkey % 20 = 0 then 'warn' else 'error' end as level, 'c' || c_custkey || '.segment' as target from c where seg = ''")
_check("check_e011_enum", "E011", "select 'E011' as code, 'error' as level, 'c' || c_custkey || '.segment' as target from c where seg <> '' and seg not in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY')")
_check("check_e012_unique", "E012", "select 'E012' as code, 'error' as level, 'c' || c_custkey || '.name' as target from (select *, row_number() over (partition by nm order by 'c' || c_custkey) as k from c) where k > 1")
_check("check_e013_pattern", "E013", "select 'E013' as code, 'error' as level, 's' || s_suppkey || '.name' as target from supplier where s_suppkey % 2 = 1")
_check("check_e022_target", "E022", "select 'E022' as code, 'error' as level, f || '-lives-in-' || t as target from rel where t = 'n999' ")
_check("check_e023_from_type", "E023", "select 'E023' as code, 'error' as level, f || '-lives-in-' || t as target from rel where type = 'lives-in' and f[1] = 's'")
_check("check_e024_to_type", "E024", "select 'E024' as code, 'error' as level, f || '-lives-in-' || t as target from rel where type = 'lives-in' and t[1] = 's'")
_check("check_e026_self", "E026", "select 'E026' as code, 'error' as level, f || '-' || type || '-' || t as target from rel where f = t")
_check("check_e027_cardinality", "E027", "select 'E027' as code, 'error' as level, 'c' || c_custkey || '.lives-in' as target from c where c_custkey % 9 = 0 or c_nationkey = 24")
_check("check_w010_undeclared", "W010", "select 'W010' as code, 'warn' as level, 'n' || n_nationkey || '.note' as target from nation")
_check("check_w020_duplicate", "W020", "select 'W020' as code, 'warn' as level, f || '-' || type || '-' || t as target from (select *, row_number() over (partition by type, f, t order by ord) as k from rel) where k > 1")
_check("check_w021_order", "W021", "select 'W021' as code, 'warn' as level, f || '-' || type || '-' || t as target from (select *, count(*) over (partition by type, f, ord) as n from rel) where type = 'ships-from' and (ord is null or n > 1)")
_check("check_w030_unreferenced", "W030", "select 'W030' as code, 'warn' as level, 'n' || n_nationkey as target from nation where 'n' || n_nationkey not in (select t from rel)")


@query(_STORE + """select n_name as heading, count(distinct f)::bigint as n, string_agg(distinct f, '、' order by f) as linked from rel join nation on 'n' || n_nationkey = t where type = 'ships-from' and n_nationkey < 100 group by 1""")
def report_trace(t, spark):
    """A trace section from its declaration."""
    items, relations = store(t)
    out = sections.compile_section({"kind": "trace", "type": "nation", "relation": ["ships-from"], "side": "to", "columns": ["name"]}, items, relations)
    return out.where("n_linked > 0").select(F.col("name").alias("heading"), F.col("n_linked").alias("n"), F.col("linked"))


@query(_STORE + """select 'n' || n_nationkey as id, n_name as name from nation where 'n' || n_nationkey not in (select t from rel where type = 'ships-from')""")
def report_gap(t, spark):
    """A trace section that keeps only the gaps."""
    items, relations = store(t)
    return sections.compile_section({"kind": "trace", "type": "nation", "relation": ["ships-from"], "side": "to", "columns": ["name"], "gap": True}, items, relations).select("id", "name")


@query("""select 'c' || c_custkey as id, 'Customer#' || c_custkey as name, c_mktsegment as segment from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_custkey % 10 <> 0 and c_custkey % 25 <> 0 and c_custkey <> 1""")
def report_items(t, spark):
    """An items section with a where clause."""
    items, relations = store(t)
    where = {"segment": ["BUILDING", "MACHINERY"], "name": {"not": ["Customer#1"]}}
    out = sections.compile_section({"kind": "items", "type": "customer", "where": where, "columns": ["name", "segment"]}, items, relations)
    return out.select("id", "name", "segment")


@query(_STORE + """select f as from_id, t as to_id, 'Supplier#' || substr(f, 2) as from_name, n_name as to_name from rel join nation on 'n' || n_nationkey = t where type = 'ships-from'""")
def report_relation(t, spark):
    """A relation section with columns of both ends."""
    items, relations = store(t)
    out = sections.compile_section({"kind": "relation", "relation": ["ships-from"], "columns": ["from.name", "to.name"]}, items, relations)
    return out.select("from_id", "to_id", F.col("from.name").alias("from_name") if "from" in out.columns else F.col("`from.name`").alias("from_name"), F.col("`to.name`").alias("to_name"))


@query(_STORE + """select f as row_id, max(case when t = 'n1' then '○' end) as n1, max(case when t = 'n2' then '○' end) as n2 from rel where type = 'ships-from' and t in ('n1', 'n2') group by 1""")
def report_matrix(t, spark):
    """A matrix section with given columns."""
    items, relations = store(t)
    return sections.compile_section({"kind": "matrix", "relation": ["ships-from"], "cols": ["n1", "n2"], "cell": "○"}, items, relations)
