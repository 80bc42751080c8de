"""Retrieval service, orders, stock and billing on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text, vectors
from lodestone.operators import service
from lodestone.queries.registry import query


@query("""select doc_id, case when contains(lower(text), 'the of') then 5.0 else 0.0 end as phrase,
 ((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 + (length(lower(text)) - length(replace(lower(text), 'and', ''))) / 3)::double as words from documents where text is not null""")
def phrase_score(t, spark):
    """Scores of a quoted phrase and of words."""
    d = t("documents").where("text is not null")
    return d.select("doc_id", service.keyword_score(F.col("text"), '"the of"').alias("phrase"), service.keyword_score(F.col("text"), " the and ").alias("words"))


_COS = "round(coalesce(list_inner_product(a.embedding::double[], b.embedding::double[]) / nullif(sqrt(list_inner_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_inner_product(b.embedding::double[], b.embedding::double[])), 0), 0), 9)"
_TF = "((length(lower(text)) - length(replace(lower(text), 'tion', ''))) / 4)::double"


@query(f"""with scope as (select doc_id as id from documents where lang = 'en'), v as (select b.vec_id as id, row_number() over (order by {_COS} desc, b.vec_id) as r from embeddings a, embeddings b where a.vec_id = 0 and b.vec_id in (select id from scope) qualify r <= 30),
 k as (select doc_id as id, row_number() over (order by {_TF} desc, doc_id) as r from documents where doc_id in (select id from scope) and {_TF} > 0 qualify r <= 30),
 f as (select id, sum(1.0 / (60 + r)) as s, bool_or(src = 'v') as in_v, bool_or(src = 'k') as in_k from (select id, r, 'v' as src from v union all select id, r, 'k' from k) group by 1)
 select f.id, case when in_v and in_k then 'both' when in_v then 'vector' else 'keyword' end as found_by, row_number() over (order by round(s, 9) desc, f.id)::bigint as pos,
  d.doc_id, case when d.doc_id % 3 <> 0 then 'T' || d.doc_id else '' end as title from f join documents d on d.doc_id = f.id""")
def hybrid_search(t, spark):
    """Scoped hybrid search down to chunks and titles."""
    d = t("documents")
    chunks = d.select(F.col("doc_id").alias("id"), "doc_id", F.col("text").alias("body"))
    titles = d.where("doc_id % 3 <> 0").select("doc_id", F.concat(F.lit("T"), "doc_id").alias("title"))
    e = t("embeddings")
    probe = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    index = e.join(F.broadcast(probe)).withColumnRenamed("vec_id", "id")  # one query vector
    scope = d.where("lang = 'en'").select(F.col("doc_id").alias("id"))
    out = service.hybrid(chunks, index, titles, F.round(vectors.cosine(F.col("embedding"), F.col("q")), 9), "tion", 30, scope)
    return out.select("id", "found_by", "pos", "doc_id", "title")


@query("""select c_custkey as tenant, c_name as name, event_type as kind, sum(value) as quantity from events join customer on c_custkey = user_id where strftime(ts, '%Y%m') = '202401' group by 1, 2, 3""")
def month_view(t, spark):
    """Usage of one month by tenant and kind."""
    usage = t("events").select(F.col("user_id").alias("tenant"), F.col("event_type").alias("kind"), F.col("ts").alias("day"), F.col("value").alias("quantity"))
    return service.month_view(usage, t("customer").select(F.col("c_custkey").alias("tenant"), F.col("c_name").alias("name")), "202401")


@query("""with r as (select l_suppkey as job, case l_returnflag when 'A' then 'ingest' when 'N' then 'skip' else 'metadata_only' end as action, l_linenumber as chunks, l_linestatus = 'F' and l_suppkey % 3 = 0 or l_suppkey % 7 = 0 as bad from lineitem)
 select job, (count(*) filter (where action = 'ingest' and not bad))::bigint as ingested, (count(*) filter (where action = 'skip' and not bad))::bigint as skipped, (count(*) filter (where action = 'metadata_only' and not bad))::bigint as metadata_only,
 (count(*) filter (where bad))::bigint as failed, coalesce(sum(chunks) filter (where not bad), 0)::bigint as chunks, case when count(*) filter (where bad) = 0 then 'done' when count(*) filter (where bad) = count(*) then 'failed' else 'partial' end as status from r group by 1""")
def job_summary(t, spark):
    """Ingest jobs by their documents' results."""
    bad = ((F.col("l_linestatus") == "F") & (F.col("l_suppkey") % 3 == 0)) | (F.col("l_suppkey") % 7 == 0)
    action = F.when(F.col("l_returnflag") == "A", "ingest").when(F.col("l_returnflag") == "N", "skip").otherwise("metadata_only")
    return service.job_summary(t("lineitem").select(F.col("l_suppkey").alias("job"), action.alias("action"), F.col("l_linenumber").alias("chunks"), F.when(bad, "broken").alias("error")))


@query("""select source, sum(greatest(1, ceil(n_chars / 4 / 512.0)))::bigint as chunks from documents group by 1""")
def chunk_estimate(t, spark):
    """Chunks that uploads will give, by source."""
    return t("documents").groupBy("source").agg(F.sum(service.chunk_estimate(F.col("n_chars") / 4)).alias("chunks"))


@query("""select c_custkey from customer where c_custkey % 10 = 3 and c_custkey % 4 <> 1 and (c_custkey % 3 = 0 or c_custkey % 5 > 1)""")
def usable_keys(t, spark):
    """Keys by the hash of a secret, neither expired nor revoked."""
    c = F.col("c_custkey")
    keys = t("customer").select("c_custkey", F.sha2(F.concat(F.lit("secret"), c % 10), 256).alias("key_hash"), F.when(c % 4 == 1, "2024-01-01").cast("timestamp").alias("revoked_at"), F.when(c % 3 != 0, F.when(c % 5 > 1, "2030-01-01").otherwise("2020-01-01")).cast("timestamp").alias("expires_at"))
    return service.usable_keys(keys, F.lit("secret3"), F.lit("2025-01-01").cast("timestamp")).select("c_custkey")


@query("""with d as (select c_custkey, (['10', '20', '30'])[(c_custkey % 3 + 1)::int] as present, (['10', '20', '30'])[(c_custkey % 5 % 3 + 1)::int] as wanted, case when c_custkey % 2 = 0 then 'external' else 'internal' end as route from customer)
 select c_custkey, case when wanted >= present then wanted end as granted, present = '30' and route = 'external' as violates from d""")
def classification_rules(t, spark):
    """Classifications may only tighten; the strictest may not leave."""
    c = F.col("c_custkey")
    pick = lambda k: F.element_at(F.array(F.lit("10"), F.lit("20"), F.lit("30")), (k + 1).cast("int"))
    d = t("customer").select("c_custkey", pick(c % 3).alias("classification"), pick(c % 5 % 3).alias("wanted"), F.when(c % 2 == 0, "external").otherwise("internal").alias("route"))
    bad = service.violations(d).select("c_custkey", F.lit(True).alias("violates"))
    return d.join(bad, "c_custkey", "left").select("c_custkey", service.tightened(F.col("classification"), F.col("wanted")).alias("granted"), F.coalesce("violates", F.lit(False)).alias("violates"))


@query("""with a as (select 'alias' || (p_size % 5) as alias, 'index' || p_partkey as physical, p_partkey as switched from part where p_size % 5 <> 3),
 n as (select alias, arg_max(physical, switched) as physical, count(*) as k from a group by 1), p as (select alias, arg_max(physical, switched) as previous from (select *, row_number() over (partition by alias order by switched desc) as r from a) where r > 1 group by 1)
 select 'alias' || i as name, coalesce(n.physical, 'alias' || i) as physical, p.previous, case when n.k is not null then n.k + 2 end::bigint as generation from (select unnest(range(6)) as i) q left join n on n.alias = 'alias' || i left join p on p.alias = n.alias""")
def index_aliases(t, spark):
    """Present and previous index of aliases, and the next generation."""
    a = t("part").where("p_size % 5 <> 3").select(F.concat(F.lit("alias"), F.col("p_size") % 5).alias("alias"), F.concat(F.lit("index"), "p_partkey").alias("physical"), F.col("p_partkey").alias("switched"))
    requests = spark.range(6).select(F.concat(F.lit("alias"), "id").alias("name"))
    back = service.previous_index(a).select(F.col("alias").alias("name"), "previous")
    turn = service.next_generation(a.withColumnRenamed("alias", "index")).withColumnRenamed("index", "name")
    return service.resolve_alias(requests, a).join(back, "name", "left").join(turn, "name", "left")


@query("""with n as (select lang as "index", count(*) as total from documents group by 1), d as (select lang as "index", count(*) as done from documents where doc_id % 3 = 0 and lang <> 'es' group by 1),
 s as (select lang as "index", doc_id, row_number() over (partition by lang order by doc_id) as r from documents)
 select n."index", total::bigint as total, coalesce(done, 0)::bigint as done, ceil((total - coalesce(done, 0)) / 256.0)::bigint as batches, case when total = coalesce(done, 0) then 0 else floor((total - coalesce(done, 0)) / 40.0) + 1 end::bigint as minutes,
 (select count(*) from s where s."index" = n."index" and r > coalesce(done, 0) and r <= coalesce(done, 0) + 256)::bigint as step, (select min(doc_id) from s where s."index" = n."index" and r > coalesce(done, 0))::bigint as next_id from n left join d using ("index")""")
def rebuild_plan(t, spark):
    """What is left of index rebuilds, and the next step of each."""
    chunks = t("documents").select(F.col("lang").alias("index"), F.col("doc_id").alias("seq"))
    done = chunks.where("seq % 3 = 0 and index <> 'es'").groupBy("index").agg(F.count("*").alias("done"))
    step = service.rebuild_step(chunks, done).groupBy("index").agg(F.count("*").alias("step"), F.min("seq").alias("next_id"))
    return service.rebuild_plan(chunks, done, 40.0).join(step, "index", "left").select("index", "total", "done", "batches", "minutes", F.coalesce("step", F.lit(0)).cast("long").alias("step"), "next_id")


@query("""with c as (select user_id % 50 as key, ts as created, event_id as v from events), f as (select key, max(created) as created, arg_max(v, created) as v from c where created > timestamp '2024-02-05' - interval 30 day group by 1)
 select key, created, v, (select count(*) from c where created <= timestamp '2024-02-05' - interval 30 day)::bigint as purged, (select count(*) from c where created > timestamp '2024-02-05' - interval 30 day)::bigint as kept from f""")
def cache_ttl(t, spark):
    """Live entries of a cache and what a purge takes."""
    c = t("events").select((F.col("user_id") % 50).alias("key"), F.col("ts").alias("created"), F.col("event_id").alias("vector"))
    now = F.lit("2024-02-05").cast("timestamp")
    return service.live_cache(c, now).withColumnRenamed("vector", "v").join(F.broadcast(service.purged(c, now)))


@query("""select event_id, least(0.5 * pow(2.0, event_id % 8 - 0), 8.0) as wait, user_id % 3 = 0 or value >= 20 as may_switch from events""")
def backoff_and_switch(t, spark):
    """Waiting times of attempts, and the rule of a switch."""
    return t("events").select("event_id", service.backoff(F.col("event_id") % 8 + 1).alias("wait"), service.may_switch(F.col("value"), F.col("user_id") % 3 == 0, 20.0).alias("may_switch"))


@query("""select o_orderkey, (select count(*) from orders)::bigint as total from orders order by o_totalprice desc, o_orderkey limit 100 offset 200""")
def order_page(t, spark):
    """The third page of orders (a paged search)."""
    return service.page(t("orders"), [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_orderkey", "total")


@query("""select l_partkey as product, l_orderkey as lot, l_linenumber as line, row_number() over (partition by l_partkey order by l_shipdate, l_orderkey * 10 + l_linenumber, l_suppkey, l_quantity)::bigint as place,
 sum(l_quantity) over (partition by l_partkey order by l_shipdate, l_orderkey * 10 + l_linenumber, l_suppkey, l_quantity rows unbounded preceding) as available from lineitem where l_quantity > 0""")
def lots_in_order(t, spark):
    """Lots of each product, the oldest first, with what they make available."""
    lots = t("lineitem").select(F.col("l_partkey").alias("product"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a"), "l_suppkey", "l_quantity").alias("lot"), F.col("l_shipdate").alias("received"), F.col("l_quantity").alias("quantity"), "l_orderkey", F.col("l_linenumber").alias("line"))
    return service.lots_in_order(lots).select("product", F.col("l_orderkey").alias("lot"), "line", "place", "available")


@query("""with i as (select o_custkey as customer, o_totalprice - case when o_orderkey % 2 = 0 then 0 else o_totalprice / 2 end as open, greatest(0, date_diff('day', last_day((o_orderdate + interval 1 month)::date), date '1998-06-30')) as late from orders where o_orderkey % 5 <> 0)
 select customer, round(sum(open), 4) as amount, round(coalesce(sum(open) filter (where late > 0), 0), 4) as overdue_amount, max(late)::bigint as max_overdue from i group by 1""")
def receivables(t, spark):
    """Open and overdue sums of customers."""
    k, total = F.col("o_orderkey"), F.col("o_totalprice")
    i = t("orders").select(F.col("o_custkey").alias("customer"), total.alias("amount"), F.when(k % 5 == 0, total).when(k % 2 == 0, 0.0).otherwise(total / 2).alias("paid"), F.col("o_orderdate").cast("date").alias("invoiced"))
    out = service.receivables(i, F.lit("1998-06-30").cast("date"))
    return out.select("customer", F.round("amount", 4).alias("amount"), F.round("overdue_amount", 4).alias("overdue_amount"), "max_overdue")


@query("""select p_partkey as product, (p_size - case when p_partkey % 4 = 0 then 1 when p_partkey % 9 = 0 then -2 else 0 end - p_size)::bigint as difference from part where p_partkey % 6 <> 0 and (p_partkey % 4 = 0 or p_partkey % 9 = 0)""")
def count_differences(t, spark):
    """Differences of a stock count."""
    p = F.col("p_partkey")
    stock = t("part").select(p.alias("product"), F.col("p_size").cast("long").alias("quantity"))
    counted = t("part").where(p % 6 != 0).select(p.alias("product"), (F.col("p_size") - F.when(p % 4 == 0, 1).when(p % 9 == 0, -2).otherwise(0)).cast("long").alias("counted"))
    return service.count_differences(stock, counted)


@query("""with m as (select n_nationkey, make_date(2024, 1 + n_nationkey % 12, 10) as m, 20 + n_nationkey % 12 as d from nation)
 select n_nationkey, least(last_day(m), make_date(2024, month(m)::int, 1) + (d - 1)::int)::date as closing, (select count(*) from customer where c_custkey % 3 <> 0 and 25 + c_custkey % 7 >= 29 and c_custkey not in (select o_custkey from orders where o_orderkey % 50 = 0))::bigint as targets from m""")
def closing_days(t, spark):
    """Closing dates, and customers that close on the last day of February 2024."""
    n = F.col("n_nationkey")
    month = F.make_date(F.lit(2024), 1 + n % 12, F.lit(10))
    customers = t("customer").select(F.col("c_custkey").alias("customer"), (F.col("c_custkey") % 3 != 0).alias("active"), (25 + F.col("c_custkey") % 7).cast("int").alias("closing_day"))
    invoiced = t("orders").where("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("customer"), F.lit("2024-02-10").cast("date").alias("invoiced"))
    targets = service.close_targets(customers, invoiced, F.lit("2024-02-29").cast("date")).agg(F.count("*").alias("targets"))
    return t("nation").select("n_nationkey", service.closing_day(month, (20 + n % 12).cast("int")).alias("closing")).join(F.broadcast(targets))


@query("""select l_orderkey as "order", count(*)::bigint as lines, sum(floor(l_quantity * (l_discount * 100)))::bigint as total from lineitem group by 1""")
def order_totals(t, spark):
    """Order totals of floored lines."""
    return service.order_totals(t("lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_quantity").alias("quantity"), (F.col("l_discount") * 100).alias("price")))


@query("""with s as (select o_custkey as customer, case when o_orderkey % 3 = 0 then 0.08 else 0.1 end as rate, sum(floor(o_totalprice)) as amount from orders where o_custkey % 4 <> 0 group by 1, 2),
 o as (select customer, sum(amount) as sales, sum(floor(amount * rate + 0.5)) as tax from s group by 1), b as (select c_custkey as customer, (c_custkey % 3) * 100.0 as previous, (c_custkey % 3) * 50.0 as deposit from customer)
 select coalesce(b.customer, o.customer) as customer, coalesce(sales, 0)::double as sales, coalesce(tax, 0)::double as tax, (coalesce(previous, 0) - coalesce(deposit, 0) + coalesce(sales, 0) + coalesce(tax, 0))::double as total
 from b full join o on b.customer = o.customer where coalesce(previous, 0) - coalesce(deposit, 0) <> 0 or coalesce(sales, 0) <> 0""")
def invoices(t, spark):
    """Invoices: sales by tax rate, tax, balance."""
    sales = t("orders").where("o_custkey % 4 <> 0").select(F.col("o_custkey").alias("customer"), F.when(F.col("o_orderkey") % 3 == 0, 0.08).otherwise(0.1).alias("rate"), F.floor("o_totalprice").cast("double").alias("amount"))
    c = F.col("c_custkey")
    balances = t("customer").select(c.alias("customer"), ((c % 3) * 100.0).alias("previous"), ((c % 3) * 50.0).alias("deposit"))
    return service.invoices(sales, balances)


@query("""with a as (select o_custkey as invoice, sum(case when o_orderkey % 10 = 0 then -100 else 40 end) as applied from orders group by 1), b as (select c_custkey as invoice, 200 + c_custkey % 3 * 100 as billed from customer)
 select invoice, applied::bigint as applied, case when applied <= 0 or applied > billed then 'refused' when applied >= billed then 'settled' else 'partial' end as state from a join b using (invoice)""")
def deposit_states(t, spark):
    """Deposits applied to invoices within their bounds."""
    applied = t("orders").select(F.col("o_custkey").alias("invoice"), F.when(F.col("o_orderkey") % 10 == 0, -100).otherwise(40).alias("amount"))
    billing = t("customer").select(F.col("c_custkey").alias("invoice"), (200 + F.col("c_custkey") % 3 * 100).alias("billed"))
    return service.deposits(applied, billing)


@query("""select e.event_id, e.user_id, (select arg_max('s' || p.event_id, p.ts) from events p where p.user_id = e.user_id and p.event_type = 'purchase' and p.ts <= e.ts) as label from events e where e.event_type = 'view'""")
def range_labels(t, spark):
    """Points with the range that they are in (as pages to sections)."""
    e = t("events")
    ranges = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("start"), F.concat(F.lit("s"), "event_id").alias("label"))
    return service.in_ranges(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), ranges, "user_id", "ts").select("event_id", "user_id", "label")


@query("""select p_partkey, p_name || case when row_number() over (partition by lower(p_name) order by p_partkey) = 1 then '' else '-' || row_number() over (partition by lower(p_name) order by p_partkey) end as unique_name from part""")
def unique_names(t, spark):
    """Names of outputs made unique."""
    return service.unique_names(t("part"), "p_name", "p_partkey").select("p_partkey", F.col("unique").alias("unique_name"))


@query("""select p_partkey, concat_ws(chr(10), case when trim(p_name) <> '' then 'name: ' || trim(p_name) end, case when p_partkey % 3 <> 0 then 'brand: ' || p_brand end) as block,
 case when p_partkey % 2 = 0 then 'see ' || p_name || ' and pic' || chr(10) || '```' || chr(10) || '[x](y)' || chr(10) || '```' || chr(10) || 'end z' else 'plain' end as plain,
 case p_partkey % 4 when 0 then 'pdf' when 1 then 'zip' when 2 then 'gzip' end as kind, (p_size // 60) || ':' || lpad((p_size % 60)::varchar, 2, '0') as elapsed, (p_size * 12700 / 12700.0)::double as points, (p_size * 10) || '.0%' as share from part""")
def document_forms(t, spark):
    """Labelled rows, unwrapped Markdown, file kinds, times, units and shares."""
    p = F.col("p_partkey")
    block = text.labelled_rows(F.array(F.lit("name"), F.lit("brand"), F.lit("")), F.array("p_name", F.when(p % 3 != 0, F.col("p_brand")), F.lit("lost")))
    md = F.when(p % 2 == 0, F.concat(F.lit("see ["), "p_name", F.lit("](http://x) and ![pic](a.png)\n```\n[x](y)\n```\nend [z](#q)"))).otherwise("plain")
    head = F.when(p % 4 == 0, "25504446aa").when(p % 4 == 1, "504B030400").when(p % 4 == 2, "1f8b08").otherwise("00ff")
    return t("part").select(
        "p_partkey", block.alias("block"), text.unwrap_markdown(md).alias("plain"), text.sniff(F.unhex(head)).alias("kind"), text.elapsed(F.col("p_size") * 60).alias("elapsed"), text.points(F.col("p_size") * 12700).alias("points"), text.percent(F.col("p_size") / 10, 1).alias("share"),
    )


@query("""with s as (select vec_id, embedding::double[] as v, list_max(list_transform(embedding::double[], lambda x: abs(x))) as top from embeddings),
 q as (select vec_id, list_transform(v, lambda x: greatest(-127, least(127, round_even(x / case when top = 0 then 1.0 else top / 127.0 end, 0)::int))) as c from s)
 select vec_id, array_to_string(list_transform(c, lambda x: printf('%02X', x + 128)), '') as packed, true as same from q""")
def code_bytes(t, spark):
    """int8 codes as bytes and back."""
    d = t("embeddings").withColumn("c", vectors.quantize(F.col("embedding"), vectors.scale(F.col("embedding")))).withColumn("packed", vectors.code_bytes(F.col("c")))
    return d.select("vec_id", "packed", (vectors.bytes_codes(F.col("packed")) == F.col("c").cast("array<int>")).alias("same"))


@query("""select event_id, case when strftime(d, '%H:%M:%S') = '00:00:00' then strftime(d, '%Y-%m-%d') when second(d) = 0 then strftime(d, '%Y-%m-%d %H:%M') else strftime(d, '%Y-%m-%d %H:%M:%S') end as shown from
 (select event_id, case event_id % 3 when 0 then date_trunc('day', ts) when 1 then date_trunc('minute', ts) else date_trunc('second', ts) end as d from events)""")
def sheet_dates(t, spark):
    """Dates of cells as a sheet shows them."""
    k = F.col("event_id") % 3
    d = F.when(k == 0, F.date_trunc("day", "ts")).when(k == 1, F.date_trunc("minute", "ts")).otherwise(F.date_trunc("second", "ts"))
    return t("events").select("event_id", text.sheet_date(d).alias("shown"))
