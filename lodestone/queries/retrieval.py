"""Vectors, keyword scores, fusion, filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text, vectors
from lodestone.operators import joins, predicates, search
from lodestone.queries.registry import query

_COS = "coalesce(list_inner_product(a.embedding::double[], b.embedding::double[]) / nullif(sqrt(list_inner_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_inner_product(b.embedding::double[], b.embedding::double[])), 0), 0)"


@query(f"""select b.vec_id, round({_COS}, 6) as similarity from embeddings a, embeddings b where a.vec_id = 0 order by {_COS} desc, b.vec_id limit 50""")
def cosine_topk(t, spark):
    """The 50 vectors nearest to one (a top-k report)."""
    e = t("embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    sim = e.crossJoin(F.broadcast(q)).withColumn("s", vectors.cosine(F.col("embedding"), F.col("q")))  # one query vector
    return sim.orderBy(F.desc("s"), "vec_id").limit(50).select("vec_id", F.round("s", 6).alias("similarity"))


@query("""with s as (select vec_id, embedding::double[] as v, list_max(list_transform(embedding::double[], lambda x: abs(x))) as top from embeddings),
 q as (select vec_id, v, case when top = 0 then 1.0 else top / 127.0 end as s from s), r as (select vec_id, v, s, list_transform(v, lambda x: greatest(-127, least(127, round_even(x / s, 0)::int))) as c from q)
 select vec_id, round(s, 9) as scale, list_sum(list_transform(c, lambda x: x))::bigint as code_sum, round(coalesce(sqrt(list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i] * s) * (v[i] - c[i] * s)))) / nullif(sqrt(list_inner_product(v, v)), 0), 0), 6) as error from r""")
def quantize_error(t, spark):
    """int8 codes and the error of reading them back."""
    d = t("embeddings").withColumn("s", vectors.scale(F.col("embedding"))).withColumn("c", vectors.quantize(F.col("embedding"), F.col("s")))
    err = vectors.error_ratio(F.col("embedding"), vectors.dequantize(F.col("c"), F.col("s")))
    total = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("vec_id", F.round("s", 9).alias("scale"), total.alias("code_sum"), F.round(err, 6).alias("error"))


_TF = "((length(lower(text)) - length(replace(lower(text), '{0}', ''))) / {1})"


@query(f"""select doc_id, ({_TF.format('the', 3)} + {_TF.format('tion', 4)})::bigint as score from documents where ({_TF.format('the', 3)} + {_TF.format('tion', 4)}) > 0""")
def keyword_score(t, spark):
    """Summed term frequencies above zero."""
    low = F.lower("text")
    return t("documents").select("doc_id", (text.term_frequency(low, "the") + text.term_frequency(low, "tion")).cast("long").alias("score")).where("score > 0")


_RRF = f"""with v as (select b.vec_id as id, row_number() over (order by {_COS} desc, b.vec_id) as r from embeddings a, embeddings b where a.vec_id = 0 qualify r <= 50),
 k as (select doc_id as id, row_number() over (order by {_TF.format('tion', 4)} desc, doc_id) as r from documents where {_TF.format('tion', 4)} > 0 qualify r <= 50),
 f as (select id, sum(1.0 / (60 + r)) as s, bool_or(src = 'v') as in_v, bool_or(src = 'k') as in_k from (select id, r, 'v' as src from v union all select id, r, 'k' from k) group by 1)"""


@query(_RRF + " select id, round(s, 6) as score, case when in_v and in_k then 'both' when in_v then 'vector' else 'keyword' end as found_by, row_number() over (order by round(s, 9) desc, id)::bigint as pos from f")
def rrf_fusion(t, spark):
    """Vector and keyword candidates fused by reciprocal ranks."""
    v, k = _ranked(t)
    return search.fuse(v, k).select("id", F.round("score", 6).alias("score"), "found_by", "pos")


def _ranked(t):
    e = t("embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    v = e.crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("id"), vectors.cosine(F.col("embedding"), F.col("q")).alias("score"))
    k = t("documents").select(F.col("doc_id").alias("id"), text.term_frequency(F.lower("text"), "tion").alias("score")).where("score > 0")
    return search.top(v, 50), search.top(k, 50)


@query(_RRF + " select (count(*) filter (where in_v and in_k))::bigint as both, (count(*) filter (where in_v and not in_k))::bigint as vector_only, (count(*) filter (where in_k and not in_v))::bigint as keyword_only from f")
def source_overlap(t, spark):
    """How many results each source found."""
    f = search.fuse(*_ranked(t))
    n = lambda s: F.count_if(F.col("found_by") == s)
    return f.agg(n("both").alias("both"), n("vector").alias("vector_only"), n("keyword").alias("keyword_only"))


_INT8 = """with s as (select vec_id, embedding::double[] as v, list_max(list_transform(embedding::double[], lambda x: abs(x))) as top from embeddings),
 q as (select vec_id, v, list_transform(v, lambda x: greatest(-127, least(127, round_even(x / case when top = 0 then 1.0 else top / 127.0 end, 0)::int))::double) as c from s)"""
_SIM = "round(coalesce(list_inner_product(a.{0}, b.{0}) / nullif(sqrt(list_inner_product(a.{0}, a.{0})) * sqrt(list_inner_product(b.{0}, b.{0})), 0), 0), 6)"


@query(f"""{_INT8}, p as (select a.vec_id as query, b.vec_id, {_SIM.format('v')} as x, {_SIM.format('c')} as y from q a, q b where a.vec_id % 50 = 0),
 r as (select query, vec_id, row_number() over (partition by query order by x desc, vec_id) as i, row_number() over (partition by query order by y desc, vec_id) as j from p),
 g as (select query, count(*) filter (where i <= 10 and j <= 10) / 10.0 as o from r group by 1) select round(coalesce(avg(o), 1.0), 6) as agreement from g""")
def reindex_agreement(t, spark):
    """Mean overlap of the ten nearest under whole vectors and under their int8 codes, for every
    fiftieth vector as a query."""
    e = t("embeddings").select("vec_id", F.col("embedding").alias("v"))
    c = e.select("vec_id", vectors.quantize(F.col("v"), vectors.scale(F.col("v"))).alias("v"))
    near = lambda own: search.top_by_query(own, own.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("qv")), 10)
    return search.agreement(near(e), near(c), 10).select(F.round("agreement", 6).alias("agreement"))


@query("""select event_id, (props::json->>'k')::bigint as k from events where event_type in ('click', 'view') and (props::json->>'k')::bigint in (1, 2, 3, 5, 8, 13)""")
def json_filter(t, spark):
    """Metadata in JSON: AND over keys, OR over values."""
    d = t("events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return d.where(F.col("event_type").isin("click", "view") & F.col("k").isin(1, 2, 3, 5, 8, 13)).select("event_id", "k")


@query("""select doc_id from documents where lang in ('en', 'de') and source in ('src1', 'src2', 'src3')""")
def metadata_filter(t, spark):
    """The same on a map of arrays; a missing key fails."""
    d = t("documents").withColumn("m", F.create_map(F.lit("lang"), F.array("lang"), F.lit("source"), F.array("source")))
    return d.where(predicates.metadata_matches(F.col("m"), {"lang": ["en", "de"], "source": ["src1", "src2", "src3"]})).select("doc_id")


@query("""with c as (select sha256('m1' || chr(0) || 'passage' || chr(0) || trim(regexp_replace(text, '\\s+', ' ', 'g'))) as k from conversations)
 select count(*)::bigint as wanted, count(distinct k)::bigint as billed, (count(*) - count(distinct k))::bigint as cached from c""")
def embed_cache(t, spark):
    """Texts to embed, and how many a cache saves."""
    c = t("conversations").select(text.cache_key(F.lit("m1"), F.lit("passage"), F.col("text")).alias("k"))
    return c.agg(F.count("*").alias("wanted"), F.count_distinct("k").alias("billed")).withColumn("cached", F.col("wanted") - F.col("billed"))


@query("""with k as (select doc_id, count(*) over (partition by sha256(text)) as same, min(doc_id) over (partition by sha256(text)) as first from documents)
 select doc_id, first as keeper, case when doc_id = first then 'ingest' else 'skip' end as action from k""")
def exact_dedupe(t, spark):
    """The first of equal contents is taken in, the others are skipped."""
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    keep = d.groupBy("h").agg(F.min("doc_id").alias("keeper"))
    return d.join(keep, "h").select("doc_id", "keeper", F.when(F.col("doc_id") == F.col("keeper"), "ingest").otherwise("skip").alias("action"))


@query("""select n.doc_id, case when o.doc_id is null then 'ingest' when o.h is distinct from n.h then 'ingest' when o.lang = n.lang then 'skip' else 'metadata_only' end as action from
 (select doc_id, sha256(text) as h, lang from documents) n left join (select doc_id, sha256(case when doc_id % 7 = 0 then text || 'x' else text end) as h, case when doc_id % 5 = 0 then 'xx' else lang end as lang from documents where doc_id % 3 <> 0) o using (doc_id)""")
def reingest_decision(t, spark):
    """New, changed, only metadata changed, or the same as stored."""
    d = t("documents")
    old = d.where("doc_id % 3 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("h"), F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")).alias("meta"))
    new = d.select("doc_id", F.sha2("text", 256).alias("h"), F.col("lang").alias("meta"))
    return search.dedupe_decision(new, old, "doc_id")


@query("select doc_id, item_id from documents, benchmark where contains(documents.text, benchmark.text)")
def benchmark_containment(t, spark):
    """Documents that hold an item verbatim: joined on a run of words inside the item, then compared."""
    return joins.contained(t("documents").select("doc_id", "text"), t("benchmark").select("item_id", F.col("text").alias("item")))
