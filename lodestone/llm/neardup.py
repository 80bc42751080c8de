"""Near-duplicate documents by a forest of sorted MinHash signatures.

Documents with equal shingle sets are folded first. Each tree reads the signature from another
place on: that is its sorted order. Documents with a common prefix of the least depth are a region
of the tree. Within a region the longest common prefixes come first: neighbours in the sorted order
are compared, which joins most of a dense region; what is still apart is compared at the region's
own depth, a pivot with all members at once, and only members outside the largest connected part
become pivots. So depth adapts to each region, a dense one costs few passes and no pair list, and no
pair of a region is left out.

A crowded region is divided into blocks that share some members (anchors); members that the anchors
did not connect to the region's largest part are then compared with all blocks. Regions yield
spanning edges only. Clusters of such edges are confirmed on full shingle sets in the same way.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import cut, map_batches, mix, python_batches, text_of, word_hashes
from lodestone.llm.components import components

N_HASHES = 128
#: Regions and clusters of more documents are divided into blocks of about this size, which share
#: so many anchors.
REGION_DOCS, CLUSTER_DOCS, ANCHORS = 1024, 1024, 64
#: Neighbours of the sorted order that are compared first.
NEIGHBOURS = 2
#: Up to so many clustered rows (about 40 bytes each) the texts stay where they are and the rows
#: go to every worker; beyond it both are shuffled by doc_id.
BROADCAST_ROWS = 1_000_000
#: Chance to lose a pair at the threshold, by the bands and by the signature together.
MISS = 1e-6
_RNG = np.random.default_rng(20240229)
_MUL = (_RNG.integers(0, 1 << 63, N_HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, N_HASHES, dtype=np.uint64)


def depth_and_trees(threshold: float) -> tuple[int, int]:
    """The deepest region prefix at which a pair at the threshold is missed by all trees with a
    chance of at most one in a million."""
    best = (1, N_HASHES)
    for depth in range(1, 17):
        trees = N_HASHES // depth
        if (1 - threshold**depth) ** trees <= MISS / 2:
            best = (depth, trees)
    return best


def least_agreement(threshold: float) -> int:
    """The most hashes that a pair must agree in, such that a pair at the threshold is lost by the
    bands or by this with a chance of at most MISS. Low bytes of different minima agree by 1/256."""
    depth, trees = depth_and_trees(threshold)
    left = MISS - (1 - threshold**depth) ** trees
    p = threshold + (1 - threshold) / 256
    lost, need = 0.0, 0
    while need < N_HASHES:
        lost += math.comb(N_HASHES, need) * p**need * (1 - p) ** (N_HASHES - need)
        if lost > left:
            break
        need += 1
    return need


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words: the sequence as one."""
    x = word_hashes(text)
    if not len(x):
        return x
    n = min(k, len(x))
    h = np.full(len(x) - n + 1, np.uint64(n), np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x[i : len(x) - n + 1 + i])
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    """N_HASHES minima as 32-bit values."""
    out = np.full(N_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        out = np.minimum(out, (s[at : at + 4096, None] * _MUL + _ADD).min(0))
    return (out >> np.uint64(32)).astype(np.uint32)


def features(docs: DataFrame, k: int, depth: int, trees: int, text: str = "text") -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set), sig (low bytes), keys (region keys of the trees; the
    low byte is the tree)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, digest, sigs, keys = [], [], [], []
        for t in batch.column(1):
            s = shingles(t.as_py(), k)
            n.append(len(s))
            digest.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64))
            if len(s):
                m = signature(s)
                sigs.append(m.astype(np.uint8).tobytes())
                parts = m[: depth * trees].reshape(trees, depth).astype(np.uint64)
                h = np.arange(1, trees + 1, dtype=np.uint64)
                for j in range(depth):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
                keys.append(((h & ~np.uint64(255)) | np.arange(trees, dtype=np.uint64)).view(np.int64).tolist())
            else:
                sigs.append(b"")
                keys.append([])
        d = np.array(digest).reshape(-1, 2)
        columns = [batch.column(0), pa.array(n, pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "d1", "d2", "sig", "keys"])

    return map_batches(docs.select("doc_id", text_of(docs, text).alias("text")), run, "doc_id long, n int, d1 long, d2 long, sig binary, keys array<long>")


def link(size: int, near: Callable[[int, np.ndarray], np.ndarray], first: list[tuple[int, int]] | None = None, pivots: np.ndarray | None = None) -> np.ndarray:
    """The part of each of 0..size-1 in the graph whose links ``near(i, others) -> bool array`` tells.

    Every pair of different final parts has had an end that was a pivot compared with all others,
    so no link between parts is lost. ``first``: links that are known; ``pivots``: only these are
    compared with all others."""
    part = np.arange(size)

    def join(i: int, j: int) -> None:
        if part[j] != part[i]:
            part[part == part[j]] = part[i]

    for i, j in first or []:
        join(i, j)
    done = np.zeros(size, bool)
    while True:
        if pivots is not None:
            todo = pivots[~done[pivots]]
        else:
            count = np.bincount(part, minlength=size)
            todo = np.flatnonzero(~done & (part != count.argmax())) if done.any() or count.max() > 1 else np.flatnonzero(~done)
        if not len(todo):
            return part
        i = int(todo[0])
        done[i] = True
        others = np.flatnonzero(part != part[i])
        if len(others):
            for j in others[near(i, others)]:
                join(i, int(j))


def stars(group: int, ids: np.ndarray, rank: np.ndarray, part: np.ndarray) -> list[tuple[int, int, int]]:
    """(group, a, b): in each part all others hang on its member of least rank. Ranks are the same
    in all regions, so a cluster that many regions hold gives the same edges again."""
    order = np.lexsort((rank, part))
    lead = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
    center = np.repeat(order[lead], np.diff(np.r_[lead, len(order)]))
    rows = center != order
    return [(group, int(a), int(b)) for a, b in zip(ids[center[rows]], ids[order[rows]], strict=True) if a != b]


def sorted_neighbours(x: np.ndarray, tree: int, depth: int, need: int) -> list[tuple[int, int]]:
    """Pairs next to each other in the tree's order (longest common prefixes) that agree enough."""
    order = np.ascontiguousarray(np.roll(x, -tree * depth, axis=1)).view(f"S{x.shape[1]}").ravel().argsort(kind="stable")
    out = []
    for w in range(1, NEIGHBOURS + 1):
        a, b = order[:-w], order[w:]
        hit = (x[a] == x[b]).sum(1) >= need
        out += zip(a[hit].tolist(), b[hit].tolist(), strict=True)
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.Array]]:
    """Column slices of the runs of equal leading keys in sorted batches; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None

    def out() -> list:
        t = pa.Table.from_batches(held)
        return [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in t.columns]

    for batch in batches:
        if not batch.num_rows:
            continue
        ks = [batch.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for x in ks:
            change |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(x[a] for x in ks)
            if held and key != last:
                yield out()
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield out()


def _edges(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    x = np.array(found, np.int64).reshape(-1, 3)
    return pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(3)], names=["g", "a", "b"])


def _few(df: DataFrame, name: str) -> DataFrame:
    """A table of one row a group, sent to all workers while its rows are few."""
    df = cut(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def group_links(grouped: DataFrame, limit: int, compare: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """a, b: spanning edges of each group. ``grouped``: g, doc_id, m (members of the group);
    ``compare`` turns tasks (g, t, doc_id, rank, pivot) into edges g, a, b: of all members of a task,
    or, where it has pivots, of pivots with all members.

    Groups of more than ``limit`` members are blocks with common anchors, the members of least rank,
    on which a dense group hangs as a whole. Then members that do not hang on the group's main
    centre meet every block: of two members that are apart, one does."""
    rank = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("rank")), 1)
    grouped = grouped.withColumn("rank", rank)
    big = grouped.where(F.col("m") > limit)
    tasks = grouped.where(F.col("m") <= limit).select("g", F.lit(0).cast("long").alias("t"), "doc_id", "rank", F.lit(False).alias("pivot"))
    found = compare(tasks).select("a", "b").distinct()
    if big.isEmpty():
        return cut(found, name)
    blocks = F.ceil(F.col("m") / limit).cast("long")
    own = F.pmod(F.xxhash64("doc_id"), blocks)
    anchor = F.col("rank") < F.lit(float(ANCHORS) * 2.0**63) / F.col("m")
    spread = big.select("g", F.explode(F.when(anchor, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(own))).alias("t"), "doc_id", "rank", F.lit(False).alias("pivot"))
    hung = cut(compare(spread), f"{name}-blocks")
    main = hung.groupBy("g", "a").agg(F.count_distinct("b").alias("n")).groupBy("g").agg(F.max_by("a", F.struct("n", "a")).alias("a"))
    main = _few(main, f"{name}-centres")
    near = hung.join(main, ["g", "a"]).select("g", F.col("b").alias("doc_id")).union(main.select("g", F.col("a").alias("doc_id"))).distinct()
    apart = cut(big.join(near, ["g", "doc_id"], "left_anti"), f"{name}-apart")
    found = found.union(hung.select("a", "b").distinct())
    if not apart.isEmpty():
        left = _few(apart.groupBy("g").agg(F.count("*").alias("k")), f"{name}-left")
        rounds = F.ceil(F.col("k") / limit).cast("long")
        code = lambda i: i * (1 << 31)
        pivots = apart.join(left, "g").select("g", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("b"), code(F.pmod(F.xxhash64("doc_id"), rounds)).alias("r"), "doc_id", "rank", F.lit(True).alias("pivot"))
        targets = big.join(left, "g").select("g", own.alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), rounds - 1)).alias("r"), "doc_id", "rank", F.lit(False).alias("pivot"))
        more = pivots.union(targets.withColumn("r", code(F.col("r")))).select("g", (F.col("r") + F.col("b")).alias("t"), "doc_id", "rank", "pivot")
        found = found.union(compare(more).select("a", "b").distinct())
    return cut(found.distinct(), name)


def region_edges(feats: DataFrame, threshold: float) -> DataFrame:
    """a, b: spanning edges, for each region of the forest, of pairs whose signatures agree in
    ``least_agreement(threshold)`` hashes. Regions of one document are counted away first."""
    entries = feats.select("doc_id", F.explode("keys").alias("g"))
    shared = entries.groupBy("g").agg(F.count("*").alias("m")).where("m > 1")
    need, depth = least_agreement(threshold), depth_and_trees(threshold)[0]
    n = int(feats.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int, int]] = []
        for g, _, ids, rank, pivot, sigs in _groups(batches, 2):
            x = np.frombuffer(b"".join(sigs.to_pylist()), np.uint8).reshape(-1, N_HASHES)
            group, lead = int(g[0].as_py()), np.flatnonzero(pivot.to_numpy(zero_copy_only=False))
            first = sorted_neighbours(x, group & 255, depth, need)
            part = link(len(x), lambda p, o, x=x: (x[o] == x[p]).sum(1) >= need, first, lead if len(lead) else None)
            found += stars(group, ids.to_numpy(), rank.to_numpy(), part)
            if len(found) > 50_000:
                yield _edges(found)
                found = []
        yield _edges(found)

    def compare(tasks: DataFrame) -> DataFrame:
        members = tasks.join(feats.select("doc_id", "sig"), "doc_id").select("g", "t", "doc_id", "rank", "pivot", "sig")
        return members.repartition(n, "g", "t").sortWithinPartitions("g", "t", "doc_id").mapInArrow(run, "g long, a long, b long")

    return group_links(cut(entries.join(shared, "g"), "minhash-regions"), REGION_DOCS, compare, "minhash-edges")


def confirmed_edges(clusters: DataFrame, texts: DataFrame, k: int, share: Fraction) -> DataFrame:
    """a, b: spanning edges on full sets within clusters (node, component). ``texts``: doc_id, text."""
    num, den = share.numerator, share.denominator
    need = least_agreement(float(share))  # the same signatures, so nothing more is lost
    n = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, _, ids, rank, pivot, texts in _groups(batches, 2):
            sets = [shingles(t.as_py(), k) for t in texts]
            sigs = np.array([signature(s).astype(np.uint8) for s in sets])
            sizes = np.array(list(map(len, sets)))
            lead = np.flatnonzero(pivot.to_numpy(zero_copy_only=False))

            def near(p: int, others: np.ndarray, sets=sets, sigs=sigs, sizes=sizes) -> np.ndarray:
                out = np.zeros(len(others), bool)
                maybe = np.flatnonzero((sigs[others] == sigs[p]).sum(1) >= need)
                own = sets[p]
                for m in maybe:
                    s = sets[others[m]]
                    at = np.searchsorted(own, s)
                    at[at == len(own)] = 0
                    both = int((own[at] == s).sum())
                    out[m] = den * both >= num * (sizes[p] + sizes[others[m]] - both)
                return out

            yield _edges(stars(int(g[0].as_py()), ids.to_numpy(), rank.to_numpy(), link(len(sets), near, None, lead if len(lead) else None)))

    def compare(tasks: DataFrame) -> DataFrame:
        tasks = cut(tasks, "minhash-tasks")
        few = tasks.count() <= BROADCAST_ROWS
        members = texts.join(F.broadcast(tasks) if few else tasks, "doc_id").select("g", "t", "doc_id", "rank", "pivot", "text")
        return members.repartition(n, "g", "t").sortWithinPartitions("g", "t", "doc_id").mapInArrow(run, "g long, a long, b long")

    sized = clusters.groupBy("component").agg(F.count("*").alias("m"))
    grouped = clusters.join(sized, "component").select(F.col("component").alias("g"), F.col("node").alias("doc_id"), "m")
    return group_links(cut(grouped, "minhash-grouped"), CLUSTER_DOCS, compare, "minhash-links")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: str = "0.8", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    Links are pairs with Jaccard similarity of at least ``threshold`` (exact fraction) of their
    distinct k-word shingles; component_id is the smallest doc_id reachable. Rows without words
    (null, empty) have no shingles and stand alone. A doc_id is taken to name one text: rows of one id
    with different texts keep their own n_shingles but may be linked through each other."""
    python_batches(docs.sparkSession)
    share = Fraction(threshold)
    depth, trees = depth_and_trees(float(share))
    feats = cut(features(docs, k, depth, trees, text), "minhash")
    worded = feats.where("n > 0")
    sets = cut(worded.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "minhash-sets")
    alone = worded.join(sets.select("d1", "d2", F.col("rep").alias("doc_id")), ["d1", "d2", "doc_id"], "left_semi")
    clusters = cut(components(region_edges(alone, float(share)), "a", "b"), "minhash-clusters")
    texts = docs.select("doc_id", text_of(docs, text).alias("text"))
    roots = components(confirmed_edges(clusters, texts, k, share), "a", "b").withColumnsRenamed({"node": "rep", "component": "root"})
    by_set = sets.join(roots, "rep", "left").select("d1", "d2", F.coalesce("root", "rep").alias("root"))
    out = feats.select("doc_id", "n", "d1", "d2").join(by_set, ["d1", "d2"], "left")
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
