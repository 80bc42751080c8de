"""Joins of the record model: coverage, references, diffs, effective dates, duplicates."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from datetime import date, timedelta
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Up to this many bytes a side whose rows are bounded by the vocabulary is sent to all workers.
SMALL_ROWS = 10_000


def gap(items: DataFrame, links: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Items that no link mentions."""
    return items.join(links, on, "left_anti")


def linked(items: DataFrame, links: DataFrame, key: str, label: str, out: str) -> DataFrame:
    """Items with the sorted set of linked labels, '' when there are none. Labels are gathered
    before the join, so an item is one row on both sides."""
    sets = links.groupBy(key).agg(F.concat_ws("、", F.array_sort(F.collect_set(label))).alias(out))
    return items.join(sets, key, "left").withColumn(out, F.coalesce(out, F.lit("")))


def keyed_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, state (added, removed, changed), old, new of keys that differ."""
    a = old.select(F.col(key).alias("key"), F.col(value).alias("old"), F.lit(1).alias("in_old"))
    b = new.select(F.col(key).alias("key"), F.col(value).alias("new"), F.lit(1).alias("in_new"))
    both = a.join(b, "key", "full")
    state = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("changed")
    differs = F.col("in_old").isNull() | F.col("in_new").isNull() | ~F.col("old").eqNullSafe(F.col("new"))
    return both.where(differs).select("key", state.alias("state"), "old", "new")


def price_periods(prices: DataFrame) -> DataFrame:
    """kind, valid_from, valid_to, unit_price as disjoint periods: on each day the price that
    started last among those that cover it (of equal starts, the higher one).

    Every start and every day after an end opens a period; a kind's list is swept once with a heap."""

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        far = date(9999, 12, 31)
        rows = sorted(((f, far if pd.isna(t) or t is None else t, u) for f, t, u in zip(pdf["valid_from"], pdf["valid_to"], pdf["unit_price"], strict=True) if f is not None), key=lambda r: r[0])
        edges = sorted({f for f, _, _ in rows} | {t + timedelta(days=1) for _, t, _ in rows if t < far})
        out, heap, at = [], [], 0
        for k, start in enumerate(edges):
            while at < len(rows) and rows[at][0] <= start:
                heapq.heappush(heap, (-rows[at][0].toordinal(), -rows[at][2], rows[at][1]))
                at += 1
            while heap and heap[0][2] < start:
                heapq.heappop(heap)
            if heap:
                end = edges[k + 1] - timedelta(days=1) if k + 1 < len(edges) else far
                out.append((pdf["kind"].iloc[0], start, end, -heap[0][1]))
        return pd.DataFrame(out, columns=["kind", "valid_from", "valid_to", "unit_price"])

    p = prices.select("kind", F.col("valid_from").cast("date"), F.col("valid_to").cast("date"), "unit_price")
    return p.groupBy("kind").applyInPandas(sweep, p.schema)


def effective(facts: DataFrame, prices: DataFrame, kind: str, day: str) -> DataFrame:
    """``facts`` with the price of its kind whose validity covers the day; the latest
    ``valid_from`` wins; none leaves nulls.

    Prices (kind, valid_from, valid_to, unit_price) are turned into disjoint periods first, so the
    join has one match a fact and no window over the facts."""
    p = price_periods(prices).select(F.col("kind").alias("_kind"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), "unit_price")
    d = F.col(day).cast("date")
    return facts.join(p, (F.col(kind) == F.col("_kind")) & (d >= F.col("_from")) & (d <= F.col("_to")), "left").drop("_kind", "_from", "_to")


def resolve(refs: DataFrame, current: DataFrame, ledger: DataFrame, store: DataFrame) -> DataFrame:
    """refs (concept) with ``item``: this round's map first, then the ledger if the store still
    has that item; ``unresolved`` otherwise."""
    cur = current.select("concept", F.col("item").alias("_cur"))
    led = ledger.select("concept", F.col("item").alias("_led")).join(store.select(F.col("id").alias("_led")), "_led", "left_semi")
    out = refs.join(cur, "concept", "left").join(led, "concept", "left")
    return out.withColumn("item", F.coalesce("_cur", "_led")).withColumn("unresolved", F.col("item").isNull()).drop("_cur", "_led")


def orient(edges: DataFrame, endpoints: DataFrame) -> DataFrame:
    """edges (rel, src, dst, src_type, dst_type) against allowed (rel, from_type, to_type):
    ``direction`` declared, reversed, neither or ambiguous; reversed ends are swapped."""
    fwd = endpoints.select("rel", F.col("from_type").alias("src_type"), F.col("to_type").alias("dst_type"), F.lit(True).alias("_f")).distinct()
    rev = endpoints.select("rel", F.col("to_type").alias("src_type"), F.col("from_type").alias("dst_type"), F.lit(True).alias("_r")).distinct()
    on = ["rel", "src_type", "dst_type"]
    out = edges.join(fwd, on, "left").join(rev, on, "left")
    f, r = F.coalesce("_f", F.lit(False)), F.coalesce("_r", F.lit(False))
    same = F.col("src_type") == F.col("dst_type")
    out = out.withColumn("direction", F.when(f & r & ~same, "ambiguous").when(f, "declared").when(r, "reversed").otherwise("neither"))
    turned = F.col("direction") == "reversed"
    return out.withColumns({"from": F.when(turned, F.col("dst")).otherwise(F.col("src")), "to": F.when(turned, F.col("src")).otherwise(F.col("dst"))}).drop("_f", "_r")


def unique_suffix(names: DataFrame, files: DataFrame) -> DataFrame:
    """names (name) joined to the one file whose dotted path ends in it: ``hits`` 0 external, 1
    joined, more ambiguous (null file)."""
    parts = F.split("path", "\\.")
    tails = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, -i, i)))).alias("name"))
    by = tails.groupBy("name").agg(F.count("*").alias("hits"), F.min("path").alias("file"))
    out = names.join(by, "name", "left")
    return out.select("name", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.when(F.col("hits") == 1, F.col("file")).alias("file"))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts."""
    return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def near_statements(items: DataFrame, ratio: float = 0.75, least: int = 8, children: DataFrame | None = None) -> DataFrame:
    """Pairs of statements of one type with a matching ratio of at least ``ratio``: items (id,
    type, statement, sources, and status if it is there: deprecated ones do not count). White space
    and closing marks are ignored; shared sources exclude, and so does a common ordered parent
    (children: parent, id).

    Blocks: two texts with such a ratio share most characters, so they fall in the same or the
    next length band; within it a shared rare word pair is not required."""
    t = F.regexp_replace(F.regexp_replace("statement", "[\\s\\u3000]+", ""), "[。．.]+$", "")
    if "status" in items.columns:
        items = items.where(F.coalesce("status", F.lit("")) != "deprecated")
    n = items.withColumn("_t", t).withColumn("_n", F.length("_t")).where(F.col("_n") >= least)
    # the ratio is at most 2 * shorter / (shorter + longer): lengths differ by a bounded factor
    factor = (2 - ratio) / ratio
    band = F.floor(F.log(F.col("_n").cast("double")) / F.log(F.lit(factor))).cast("int")
    left = n.select(F.col("id").alias("a"), "type", F.explode(F.array(band - 1, band, band + 1)).alias("_band"), F.col("_t").alias("_ta"), F.col("_n").alias("_na"), F.col("sources").alias("_sa"))
    right = n.select(F.col("id").alias("b"), "type", band.alias("_band"), F.col("_t").alias("_tb"), F.col("_n").alias("_nb"), F.col("sources").alias("_sb"))
    pairs = left.join(right, ["type", "_band"]).where((F.col("a") < F.col("b")) & (F.least("_na", "_nb") >= ratio * F.greatest("_na", "_nb")))
    pairs = pairs.where((F.size("_sa") > 0) & (F.size("_sb") > 0) & ~F.coalesce(F.arrays_overlap("_sa", "_sb"), F.lit(False)))
    if children is not None:
        a, b = (children.select("parent", F.col("id").alias(c)) for c in "ab")
        pairs = pairs.join(a.join(b, "parent").select("a", "b").distinct(), ["a", "b"], "left_anti")
    return pairs.withColumn("ratio", similarity("_ta", "_tb")).where(F.col("ratio") >= ratio).select("type", "a", "b", "ratio")


#: Words of the run that a contained text is looked up by, and the most short items that are compared
#: with every document.
RUN, SHORT_ITEMS = 6, 10_000


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of documents (doc_id, text) that hold an item (item_id, item) verbatim.

    An item of more than RUN + 1 words is looked up by the RUN words after its first one: they are
    whole words of the document too, wherever the item begins. Shorter items are bounded in number
    and are compared with every document."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    rows = items.where("item is not null").select("item_id", "item", words("item").alias("w"))
    long_ = rows.where(F.size("w") > RUN + 1).select("item_id", "item", F.xxhash64(F.array_join(F.slice("w", 2, RUN), " ")).alias("run"))
    d = docs.where("text is not null").withColumn("w", words("text"))
    runs = F.when(F.size("w") >= RUN, F.transform(F.sequence(F.lit(1), F.size("w") - RUN + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, RUN), " "))))
    hits = d.select("doc_id", F.explode(F.array_distinct(runs)).alias("run")).join(long_.select("item_id", "run"), "run").select("doc_id", "item_id").distinct()
    found = hits.join(long_.select("item_id", "item"), "item_id").join(docs, "doc_id").where(F.contains("text", F.col("item"))).select("doc_id", "item_id")
    short = rows.where(F.size("w") <= RUN + 1).select("item_id", "item")
    n = short.limit(SHORT_ITEMS + 1).count()
    if n > SHORT_ITEMS:
        raise ValueError(f"more than {SHORT_ITEMS} items of {RUN + 1} words or fewer")
    if n:
        found = found.union(docs.join(F.broadcast(short), F.contains(F.col("text"), F.col("item"))).select("doc_id", "item_id"))
    return found


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
