"""Operators of a retrieval service and of order, stock and billing data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as texts
from lodestone.operators import search

#: Score of a phrase that is contained, tokens of a chunk, days a cached vector lives,
#: page sizes, rows of a batch of a rebuild, ranks of classifications.
PHRASE_SCORE, CHUNK_TOKENS, TTL_DAYS = 5.0, 512, 30
PAGE, LONGEST_PAGE, BATCH = 100, 500, 256
CLASSES = {"10": 1, "20": 2, "30": 3}


def keyword_score(body: Column, query: str) -> Column:
    """Summed occurrences of the words of a query, or a fixed score for a quoted phrase that occurs."""
    low = F.lower(body)
    q = query.strip()
    if len(q) >= 2 and q[0] == q[-1] == '"':
        return F.when(F.contains(low, F.lit(q[1:-1].lower())), PHRASE_SCORE).otherwise(0.0)
    total: Column = F.lit(0)
    for word in q.lower().split():
        total = total + texts.term_frequency(low, word)
    return total.cast("double")


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """hits (id) with their chunk (id, doc_id, body) and title: hits without a chunk are dropped, a
    missing document leaves a blank title."""
    out = hits.join(chunks, "id").join(documents.select("doc_id", "title"), "doc_id", "left")
    return out.withColumn("title", F.coalesce("title", F.lit("")))


def hybrid(chunks: DataFrame, vectors: DataFrame, documents: DataFrame, score: Column, query: str, k: int, scope: DataFrame | None = None) -> DataFrame:
    """Hydrated results of a vector list (``score`` over ``vectors``: id and its columns) and a keyword
    list over ``chunks`` (id, doc_id, body), both within ``scope`` (id) before scoring, fused by
    reciprocal ranks."""
    if scope is not None:
        chunks, vectors = chunks.join(scope, "id", "left_semi"), vectors.join(scope, "id", "left_semi")
    near = search.top(vectors.select("id", score.alias("score")), k)
    words = search.top(chunks.select("id", keyword_score(F.col("body"), query).alias("score")).where("score > 0"), k)
    return hydrate(search.fuse(near, words), chunks, documents)


def month_view(usage: DataFrame, tenants: DataFrame, month: str) -> DataFrame:
    """tenant, name, kind, quantity of one month (yyyyMM) of known tenants."""
    own = usage.where(F.date_format("day", "yyyyMM") == month)
    return own.join(tenants, "tenant").groupBy("tenant", "name", "kind").agg(F.sum("quantity").alias("quantity"))


def job_summary(results: DataFrame) -> DataFrame:
    """job, ingested, skipped, metadata_only, failed, chunks, status from the results of its documents
    (job, action, chunks, error): done without failures, partial with some, failed when all failed."""
    n = lambda a: F.count_if((F.col("action") == a) & F.col("error").isNull())
    by = results.groupBy("job").agg(n("ingest").alias("ingested"), n("skip").alias("skipped"), n("metadata_only").alias("metadata_only"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("chunks"))), F.lit(0)).cast("long").alias("chunks"), F.count("*").alias("_n"))
    return by.withColumn("status", F.when(F.col("failed") == 0, "done").when(F.col("failed") == F.col("_n"), "failed").otherwise("partial")).drop("_n")


def chunk_estimate(tokens: Column) -> Column:
    """Chunks that a text of so many tokens will give, at least one."""
    return F.greatest(F.lit(1), F.ceil(tokens / CHUNK_TOKENS)).cast("long")


def usable_keys(keys: DataFrame, given: Column, now: Column) -> DataFrame:
    """Keys whose hash is that of the given secret and that are neither expired nor revoked."""
    live = F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return keys.where((F.col("key_hash") == F.sha2(given, 256)) & live)


def tightened(present: Column, wanted: Column) -> Column:
    """The wanted classification where it is as strict as the present one or stricter, else null."""
    rank = lambda c: F.coalesce(*(F.when(c == k, v) for k, v in CLASSES.items()))
    return F.when(rank(wanted) >= rank(present), wanted)


def violations(audit: DataFrame) -> DataFrame:
    """Rows of the strictest class that left by an outside route."""
    return audit.where((F.col("classification") == "30") & (F.col("route") == "external"))


def resolve_alias(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """requests (name) with the physical index: the alias's present one, else the name itself."""
    now = aliases.groupBy("alias").agg(F.max_by("physical", "switched").alias("physical"))
    return requests.join(F.broadcast(now.withColumnRenamed("alias", "name")), "name", "left").withColumn("physical", F.coalesce("physical", "name"))


def previous_index(aliases: DataFrame) -> DataFrame:
    """alias, physical, previous: what a rollback goes back to."""
    w = Window.partitionBy("alias").orderBy("switched")
    rows = aliases.withColumn("previous", F.lag("physical").over(w))
    return rows.groupBy("alias").agg(F.max_by("physical", "switched").alias("physical"), F.max_by("previous", "switched").alias("previous"))


def rebuild_plan(chunks: DataFrame, done: DataFrame, per_minute: float) -> DataFrame:
    """index, total, done, batches, minutes for what is left of each rebuild: whole batches of BATCH
    and minutes rounded up."""
    n = chunks.groupBy("index").agg(F.count("*").alias("total"))
    rows = n.join(done, "index", "left").withColumn("done", F.least(F.coalesce("done", F.lit(0)), F.col("total")).cast("long"))
    left = F.col("total") - F.col("done")
    return rows.select("index", "total", "done", F.ceil(left / BATCH).cast("long").alias("batches"), F.when(left == 0, 0).otherwise(F.floor(left / per_minute) + 1).cast("long").alias("minutes"))


def rebuild_step(chunks: DataFrame, done: DataFrame, limit: int = BATCH) -> DataFrame:
    """The next ``limit`` chunks (index, seq) of each rebuild after those that are done."""
    rows = chunks.withColumn("_r", F.row_number().over(Window.partitionBy("index").orderBy("seq")))
    rows = rows.join(F.broadcast(done), "index", "left")
    start = F.coalesce("done", F.lit(0))
    return rows.where((F.col("_r") > start) & (F.col("_r") <= start + limit)).drop("_r", "done")


def may_switch(agreement: Column, forced: Column, least: float = 0.9) -> Column:
    """Whether a new index may take over: it agrees enough, or the switch is forced."""
    return (agreement >= least) | forced


def next_generation(existing: DataFrame) -> DataFrame:
    """index, generation of the index that would come next."""
    return existing.groupBy("index").agg((F.count("*") + 2).alias("generation"))


def live_cache(cache: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    """Entries (key, created) that have not expired; a read takes the youngest of a key."""
    fresh = cache.where(F.col("created") > now - F.make_dt_interval(F.lit(days)))
    return fresh.groupBy("key").agg(F.max("created").alias("created"), F.max_by("vector", "created").alias("vector"))


def purged(cache: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    """One row: how many entries a purge would take away and keep."""
    old = F.col("created") <= now - F.make_dt_interval(F.lit(days))
    return cache.agg(F.count_if(old).alias("purged"), F.count_if(~old).alias("kept"))


def backoff(attempt: Column, base: float = 0.5, longest: float = 8.0) -> Column:
    """Seconds to wait before a further attempt."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(longest))


def page(rows: DataFrame, order: Sequence[str], number: int, size: int | None = None) -> DataFrame:
    """One page (from 1) and the total in ``total``; sizes are PAGE by default, LONGEST_PAGE at most."""
    n = min(size or PAGE, LONGEST_PAGE)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset((number - 1) * n).limit(n).join(F.broadcast(total))


def lots_in_order(lots: DataFrame) -> DataFrame:
    """lots (product, lot, received, quantity) with place and the available total before and with them:
    the oldest go first."""
    w = Window.partitionBy("product").orderBy("received", "lot")
    return lots.where("quantity > 0").withColumns({"place": F.row_number().over(w).cast("long"), "available": F.sum("quantity").over(w.rowsBetween(Window.unboundedPreceding, 0))})


def receivables(invoices: DataFrame, base: Column) -> DataFrame:
    """customer, amount, overdue_amount, max_overdue: open sums, days overdue from the end of the month
    after the invoice's."""
    due = F.last_day(F.add_months(F.col("invoiced"), 1))
    late = F.greatest(F.lit(0), F.date_diff(base, due))
    rows = invoices.where("amount > paid").select("customer", (F.col("amount") - F.col("paid")).alias("open"), late.alias("late"))
    return rows.groupBy("customer").agg(F.sum("open").alias("amount"), F.coalesce(F.sum(F.when(F.col("late") > 0, F.col("open"))), F.lit(0)).alias("overdue_amount"), F.max("late").cast("long").alias("max_overdue"))


def count_differences(stock: DataFrame, counted: DataFrame) -> DataFrame:
    """product, difference of a stock count; equal ones are left out, uncounted ones too."""
    return stock.join(counted, "product").select("product", (F.col("counted") - F.col("quantity")).alias("difference")).where("difference <> 0")


def closing_day(month: Column, day: Column) -> Column:
    """The closing date of a month: the nominal day, or the month's last."""
    last = F.last_day(month)
    return F.date_add(F.trunc(month, "month"), F.least(day, F.dayofmonth(last)) - 1)


def close_targets(customers: DataFrame, invoiced: DataFrame, today: Column) -> DataFrame:
    """Active customers (customer, active, closing_day) that close today and have no invoice of the month."""
    due = customers.where(F.col("active") & (closing_day(today, F.col("closing_day")) == today))
    have = invoiced.where(F.trunc("invoiced", "month") == F.trunc(today, "month")).select("customer").distinct()
    return due.join(have, "customer", "left_anti")


def order_totals(lines: DataFrame) -> DataFrame:
    """order, lines, total: line amounts floored one by one, then added."""
    return lines.groupBy("order").agg(F.count("*").alias("lines"), F.sum(F.floor(F.col("quantity") * F.col("price"))).cast("long").alias("total"))


def invoices(sales: DataFrame, balances: DataFrame) -> DataFrame:
    """customer, sales, tax, total: sales (customer, rate, amount) are added by rate, taxed half up on
    each sum, and joined with the balance (customer, previous, deposit): previous - deposit + sales +
    tax. Customers without balance and sales get none."""
    by_rate = sales.groupBy("customer", "rate").agg(F.sum("amount").alias("amount"))
    own = by_rate.groupBy("customer").agg(F.sum("amount").alias("sales"), F.sum(F.floor(F.col("amount") * F.col("rate") + 0.5)).cast("double").alias("tax"))
    both = balances.join(own, "customer", "full").na.fill(0)
    left = F.col("previous") - F.col("deposit")
    return both.where((left != 0) | (F.col("sales") != 0)).select("customer", "sales", "tax", (left + F.col("sales") + F.col("tax")).alias("total"))


def deposits(applied: DataFrame, billing: DataFrame) -> DataFrame:
    """invoice, applied, state of deposits: refused beyond the open amount or not above zero, settled
    or partial."""
    rows = applied.groupBy("invoice").agg(F.sum("amount").alias("applied")).join(billing, "invoice")
    state = F.when((F.col("applied") <= 0) | (F.col("applied") > F.col("billed")), "refused").when(F.col("applied") >= F.col("billed"), "settled").otherwise("partial")
    return rows.select("invoice", "applied", state.alias("state"))


def in_ranges(points: DataFrame, ranges: DataFrame, group: str, at: str) -> DataFrame:
    """points with the label of the range (group, start, label) that began last before them: a union
    and a running last value, so no pair of point and range is made."""
    p = points.withColumns({"_at": F.col(at), "_kind": F.lit(1), "_label": F.lit(None).cast("string")})
    r = ranges.select(group, F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.col("label").alias("_label"))
    w = Window.partitionBy(group).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(r, allowMissingColumns=True).withColumn("label", F.last("_label", ignorenulls=True).over(w))
    return both.where("_kind = 1").drop("_at", "_kind", "_label")


def unique_names(targets: DataFrame, name: str, order: str) -> DataFrame:
    """targets with ``unique``: the first keeps its name, further ones get -2, -3, ..."""
    k = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(order))
    return targets.withColumn("unique", F.when(k == 1, F.col(name)).otherwise(F.concat(name, F.lit("-"), k.cast("string"))))
