"""Ranked lists: top-k, reciprocal rank fusion, reranking, ingest decisions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
#: Rows of the index and queries that meet in a task, queries multiplied at once, tasks, and units of a score.
INDEX_BLOCK, QUERY_BLOCK, STEP, MOST_TASKS, SCALE = 16_384, 2_048, 256, 2_000, 1e6


def top(scored: DataFrame, k: int) -> DataFrame:
    """id, r: ranks of the k best; ties by id. The cut comes first, as a distributed top-k, so the
    rank window sees k rows."""
    best = scored.orderBy(F.desc("score"), "id").limit(k)
    return best.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("r"))


def fuse(vector: DataFrame, keyword: DataFrame, k: int = RRF_K) -> DataFrame:
    """id, score, found_by, pos from two lists (id, r)."""
    rows = vector.select("id", "r", F.lit("v").alias("src")).union(keyword.select("id", "r", F.lit("k").alias("src")))
    f = rows.groupBy("id").agg(F.sum(F.lit(1.0) / (k + F.col("r"))).alias("score"), F.bool_or(F.col("src") == "v").alias("v"), F.bool_or(F.col("src") == "k").alias("k"))
    found = F.when(F.col("v") & F.col("k"), "both").when(F.col("v"), "vector").otherwise("keyword")
    pos = F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id")).cast("long")
    return f.select("id", "score", found.alias("found_by"), pos.alias("pos"))


def rerank(ranked: DataFrame, scores: DataFrame, head: int = 50) -> DataFrame:
    """The head of a list (id, pos) in the order of new scores (id, rerank), then the tail as it
    was; ids that the list does not have are dropped."""
    d = ranked.join(scores, "id", "left").withColumn("_tail", F.col("pos") > head)
    w = Window.orderBy("_tail", F.when(~F.col("_tail"), -F.coalesce("rerank", F.lit(float("-inf")))), "pos")
    return d.withColumn("pos", F.row_number().over(w).cast("long")).drop("_tail")


def dedupe_decision(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """key, action: ingest (new or changed hash), metadata_only, or skip."""
    o = old.select(key, F.col("h").alias("_h"), F.col("meta").alias("_m"), F.lit(1).alias("_has"))
    d = new.join(o, key, "left")
    same = F.col("h").eqNullSafe(F.col("_h"))
    action = F.when(F.col("_has").isNull() | ~same, "ingest").when(F.col("meta").eqNullSafe(F.col("_m")), "skip").otherwise("metadata_only")
    return d.select(key, action.alias("action"))


def fair_order(queue: DataFrame, tenant: str, order: Sequence[str]) -> DataFrame:
    """``queue`` with ``round`` (how many of its tenant come before, plus one) and ``turn``: rounds
    one after the other, tenants in order within a round. Turns are counted by rounds, so no
    window spans the queue."""
    k = F.row_number().over(Window.partitionBy(tenant).orderBy(*order)).cast("long")
    rounds = queue.withColumn("round", k)
    size = rounds.groupBy("round").agg(F.count("*").alias("_n"))
    ahead = size.withColumn("_ahead", F.sum("_n").over(Window.orderBy("round")) - F.col("_n")).select("round", "_ahead")  # one row a round
    place = F.row_number().over(Window.partitionBy("round").orderBy(tenant))
    return rounds.join(ahead, "round").withColumn("turn", (F.col("_ahead") + place).cast("long")).drop("_ahead")


def queue_depth(queue: DataFrame, tenant: str, since: str) -> DataFrame:
    """tenant, waiting, oldest (least ``since``), longest (waiting of the fullest tenant)."""
    by = queue.groupBy(tenant).agg(F.count("*").alias("waiting"), F.min(since).alias("oldest"))
    return by.join(F.broadcast(by.agg(F.max("waiting").alias("longest"))))  # one row


def _matrix(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, start and length (-1 for null) of each row's vector."""
    lists = table.column(column).combine_chunks()
    size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    held = np.maximum(size, 0)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(held) - held, size


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from left to right as SQL does."""
    return np.cumsum(a * b, axis=1)[:, -1]


def _block(index: pa.Table, queries: pa.Table, k: int, key: str) -> pa.Table:
    """The ``k`` best of ``index`` for each of ``queries``, STEP queries at a time. Products come from
    a matrix product; those that are next to where rounding turns are summed again in order."""
    index = index.take(pc.sort_indices(index.column(key)))
    held, first, size = _matrix(index, "v")
    asked, ask_first, ask_size = _matrix(queries, "qv")
    n, rows, places, scores = index.num_rows, [], [], []
    for dim in np.unique(ask_size):
        own, d = np.flatnonzero(ask_size == dim), max(int(dim), 1)
        m, fits = np.zeros((n, d)), np.flatnonzero(size == dim)  # a vector of another length scores 0
        q = np.zeros((len(own), d))
        if dim > 0:
            m[fits] = held[first[fits, None] + np.arange(d)]
            q = asked[ask_first[own, None] + np.arange(d)]
        norm, q_norm = np.sqrt(_dots(m, m)), np.sqrt(_dots(q, q))
        for at in range(0, len(own), STEP):
            part, whole = q[at : at + STEP], q_norm[at : at + STEP, None] * norm
            with np.errstate(divide="ignore", invalid="ignore"):
                y = np.where(whole == 0, 0.0, part @ m.T / whole) * SCALE
                near = np.nonzero(np.abs(np.abs(y) % 1 - 0.5) < 1e-4)
                for i in range(0, len(near[0]), 1 << 16):
                    r, c = near[0][i : i + (1 << 16)], near[1][i : i + (1 << 16)]
                    y[r, c] = np.where(whole[r, c] == 0, 0.0, _dots(part[r], m[c]) / whole[r, c]) * SCALE
            y = np.copysign(np.floor(np.abs(y) + 0.5), y)
            order = (-np.where(np.isnan(y), 2 * SCALE, y)).astype(np.int64) * n + np.arange(n)  # no number comes first, as in SQL
            best = np.argpartition(order, min(k, n) - 1, axis=1)[:, : min(k, n)]
            rows.append(np.repeat(own[at : at + STEP], best.shape[1]))
            places.append(best.ravel())
            scores.append((np.take_along_axis(y, best, 1) / SCALE).ravel())
    return pa.table({"query": queries.column("query").take(pa.array(np.concatenate(rows))), key: index.column(key).take(pa.array(np.concatenate(places))), "score": np.concatenate(scores)})


def top_by_query(index: DataFrame, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """query, key, score (cosine, six decimals) of the ``k`` best rows of ``index`` (key, v) for each row
    of ``queries`` (query, qv), ties by key: every pair is scored. Both are dealt into blocks by hash and
    each block of queries meets each block of the index in a task of its own, which holds these
    two and STEP rows of their product, and gives ``k`` rows a query."""
    parts, blocks = max(1, -(-index.count() // INDEX_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    whole = lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.col(c))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = min(2 * parts * blocks, MOST_TASKS)
    left = index.select(key, whole("v").alias("v"), deal(key, parts).alias("_p"), each(blocks).alias("_b")).repartition(tasks, "_p", "_b")
    right = queries.select("query", whole("qv").alias("qv"), deal("query", blocks).alias("_b"), each(parts).alias("_p")).repartition(tasks, "_p", "_b")
    types = {f.name: f.dataType.simpleString() for f in (*index.schema, *queries.schema)}
    schema = f"query {types['query']}, `{key}` {types[key]}, score double"

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not own.num_rows or not asked.num_rows:
            return pa.table({"query": asked.column("query").slice(0, 0), key: own.column(key).slice(0, 0), "score": pa.array([], pa.float64())})
        return _block(own, asked, k, key)

    best = left.groupBy("_p", "_b").cogroup(right.groupBy("_p", "_b")).applyInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last(key)))
    return best.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def agreement(old: DataFrame, new: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """agreement: the mean share of the old top ``k`` that the new index finds too; 1 without queries."""
    both = old.select("query", key, F.lit(1).alias("o")).join(new.select("query", key, F.lit(1).alias("n")), ["query", key], "left")
    by = both.groupBy("query").agg((F.count("n") / F.least(F.lit(k), F.count("*"))).alias("share"))
    return by.agg(F.coalesce(F.avg("share"), F.lit(1.0)).alias("agreement"))
