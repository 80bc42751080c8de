"""Benchmark decontamination: BM25 over the test items with block-max WAND, then overlap checks.

The index holds the items; the queries are passages of the documents. Scores are divided by the
item's score for its own text, so one threshold serves all items. Statistics of terms are those of
all items, however the index is divided. Blocks are ranges of items: a document's summed block
maxima tell the blocks that it can reach, its passages' those that each of them can, and WAND runs
over the index within these.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import cut, map_batches, mix, python_batches, text_of

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach, and of its 5-word shingles.
MIN_SCORE, MIN_OVERLAP, SHINGLE = 0.6, 0.8, 5
#: Items of a block, words of a passage (at least twice the longest item), postings of an index
#: that is sent to every worker (some 100 MB with the items' shingles).
BLOCK, PASSAGE, INDEX_POSTINGS = 4, 128, 4_000_000
#: Passages whose bounds are taken at once.
PASSAGES = 512
_WORD = re.compile(r"[^\W_]+")
_ENDS = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence or line answers what comes before it; one sentence is both."""
    parts = [w for w in map(words_of, _ENDS.split(text)) if w]
    if len(parts) < 2:
        return (parts[0] if parts else []), (parts[0] if parts else [])
    return [w for p in parts[:-1] for w in p], parts[-1]


def word_codes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-word shingles, in order."""
    h = np.full(max(0, len(codes) - n + 1), np.uint64(n), np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - n + 1 + i])
    return h


def shingle_set(words: list[str]) -> tuple[int, np.ndarray]:
    """Words of a shingle (fewer where the text has fewer), and the distinct shingles."""
    n = min(SHINGLE, len(words))
    return n, np.unique(shingle_codes(word_codes(words), n)) if n else np.zeros(0, np.uint64)


def impact(tf: int, size: int, df: int, n: int, mean: float) -> float:
    return float(np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean)))


class BlockIndex:
    """Posting lists of terms 0..n-1 with the largest impact of each term in each block of items."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int) -> None:
        """Postings sorted by term, then item; every term has one."""
        cuts = np.searchsorted(terms, np.arange(1, n_terms))
        self.docs, self.impacts = (np.split(x, cuts) if n_terms else [] for x in (docs, impacts))
        # the blocks of each term and their maxima, flat, and where each term's begin
        self.n_blocks = int(docs.max()) // BLOCK + 1 if len(docs) else 0
        key = terms * max(1, self.n_blocks) + docs // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.block = docs[first] // BLOCK
        self.block_max = np.maximum.reduceat(impacts, first) if len(first) else impacts
        self.starts = np.searchsorted(terms[first], np.arange(n_terms + 1))
        self.top = np.array([x.max() for x in self.impacts])

    def entries(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``block`` and ``block_max`` of all blocks of the terms, and whose they are."""
        counts = self.starts[terms + 1] - self.starts[terms]
        owner = np.repeat(np.arange(len(terms)), counts)
        return np.arange(counts.sum()) + np.repeat(self.starts[terms] - np.r_[0, np.cumsum(counts)[:-1]], counts), owner

    def _block_max(self, term: int, block: int) -> float:
        a, b = self.starts[term], self.starts[term + 1]
        k = a + int(np.searchsorted(self.block[a:b], block))
        return float(self.block_max[k]) if k < b and self.block[k] == block else 0.0

    def search(self, terms: list[int], least: float = MIN_SCORE, live: np.ndarray | None = None) -> list[tuple[int, float]]:
        """All (item, score) of at least ``least``: WAND with block maxima. ``live``: the blocks (in
        order) outside which no item can reach it."""
        cursors = [[0, t] for t in sorted(set(terms))]
        out = []
        while cursors:
            cursors.sort(key=lambda c: self.docs[c[1]][c[0]])
            bound, pivot = 0.0, -1
            for k, (_, t) in enumerate(cursors):
                bound += self.top[t]
                if bound >= least - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = int(self.docs[cursors[pivot][1]][cursors[pivot][0]])
            while pivot + 1 < len(cursors) and self.docs[cursors[pivot + 1][1]][cursors[pivot + 1][0]] == item:
                pivot += 1
            block = item // BLOCK
            nearest = int(np.searchsorted(live, block)) if live is not None else 0
            if live is not None and nearest == len(live):
                break
            if live is not None and live[nearest] != block:
                goal = int(live[nearest]) * BLOCK
            elif sum(self._block_max(c[1], block) for c in cursors[: pivot + 1]) < least - 1e-9:
                # no item up to the block's end or the next list's item can reach it
                goal = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    goal = min(goal, int(self.docs[cursors[pivot + 1][1]][cursors[pivot + 1][0]]))
                goal = max(goal, item + 1)
            else:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    own = self.docs[c[1]]
                    at = c[0] + int(np.searchsorted(own[c[0] :], item))
                    if at < len(own) and own[at] == item:
                        score += self.impacts[c[1]][at]
                if score >= least - 1e-9:
                    out.append((item, float(score)))
                goal = item + 1
            for c in cursors[: pivot + 1]:
                c[0] += int(np.searchsorted(self.docs[c[1]][c[0] :], goal))
            cursors = [c for c in cursors if c[0] < len(self.docs[c[1]])]
        return out


class ItemIndex(BlockIndex):
    """Inverted index of items with impacts relative to each item's own score.

    ``items``: (id, text); ``df`` (terms not named: 1), ``n`` and ``mean``: the statistics of all
    items, by default of these. Items without words are left out."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int] | None = None, n: int | None = None, mean: float | None = None) -> None:
        kept = [(i, t, w) for i, t in items if (w := words_of(t))]
        self.ids = [i for i, _, _ in kept]
        self.parts = [tuple(map(shingle_set, question_and_answer(t))) for _, t, _ in kept]
        self.whole = [shingle_set(w) for _, _, w in kept]
        bags = [Counter(w) for _, _, w in kept]
        own_df = Counter(t for bag in bags for t in bag)
        df = own_df if df is None else df
        n = len(bags) if n is None else n
        mean = sum(sum(b.values()) for b in bags) / max(1, n) if mean is None else mean
        self.words = sorted(own_df)
        self.term = {t: k for k, t in enumerate(self.words)}
        postings: list[tuple[int, int, float]] = []
        for d, bag in enumerate(bags):
            size = sum(bag.values())
            impacts = {t: impact(f, size, df.get(t, 1), n, mean) for t, f in bag.items()}
            own = sum(impacts.values())
            postings += [(self.term[t], d, x / own) for t, x in impacts.items()]
        postings.sort()
        columns = list(zip(*postings, strict=True)) or [(), (), ()]
        super().__init__(np.array(columns[0], np.int64), np.array(columns[1], np.int64), np.array(columns[2], float), len(own_df))
        self.passage = max(PASSAGE, 2 * max((sum(b.values()) for b in bags), default=0))


def retrieved(words: list[str], index: ItemIndex) -> dict[int, tuple[float, int]]:
    """The best score of each item that a passage reaches, and the passage's first word."""
    codes = np.fromiter(map(index.term.get, words, repeat(-1)), np.int64, len(words))
    terms = np.unique(codes[codes >= 0])
    if not len(terms):
        return {}
    # blocks that the whole document's terms can reach, then those that each passage's can
    at, owner = index.entries(terms)
    live = np.flatnonzero(np.bincount(index.block[at], index.block_max[at], index.n_blocks) >= MIN_SCORE - 1e-9)
    if not len(live):
        return {}
    inside = np.isin(index.block[at], live)
    maxima = np.zeros((len(terms), len(live)))
    maxima[owner[inside], np.searchsorted(live, index.block[at[inside]])] = index.block_max[at[inside]]
    step = index.passage // 2
    n_passages = len(range(0, max(1, len(words) - step), step))
    spots = np.flatnonzero(codes >= 0)
    local = np.searchsorted(terms, codes[spots])
    halves = np.concatenate((spots // step, spots // step - 1))
    ok = (halves >= 0) & (halves < n_passages)
    pairs = np.unique(halves[ok] * len(terms) + np.tile(local, 2)[ok])  # by passage, then term
    of = pairs // len(terms)
    best: dict[int, tuple[float, int]] = {}
    for low in range(0, n_passages, PASSAGES):
        own = slice(*np.searchsorted(of, (low, low + PASSAGES)).tolist())
        if own.start == own.stop:
            continue
        first = np.flatnonzero(np.r_[True, np.diff(of[own]) > 0])
        bounds = np.add.reduceat(maxima[pairs[own] % len(terms)], first, axis=0) >= MIN_SCORE - 1e-9
        ends = np.r_[first[1:], own.stop - own.start]
        for k in np.flatnonzero(bounds.any(1)).tolist():
            start = int(of[own.start + first[k]]) * step
            held = terms[pairs[own.start + first[k] : own.start + ends[k]] % len(terms)]
            for item, score in index.search(held.tolist(), live=live[bounds[k]]):
                if score > best.get(item, (0.0, 0))[0] + 1e-9:  # ties: the first passage
                    best[item] = (score, start)
    return best


def find_leaks(text: str, index: ItemIndex) -> list[tuple[int, int, float, float, float, float]]:
    """(item id, first word of the best passage, score, overlap, of the question, of the answer)."""
    words = words_of(text)
    best = retrieved(words, index)
    if not best:
        return []
    out = []
    codes = word_codes(words)
    sizes = {n for i in best for n, _ in (*index.parts[i], index.whole[i])}
    have = {n: np.unique(shingle_codes(codes, n)) for n in sizes}

    def overlap(part: tuple[int, np.ndarray]) -> float:
        n, own = part
        return float(np.isin(own, have[n], assume_unique=True).mean()) if len(own) else 0.0

    for item, (score, at) in sorted(best.items()):
        whole, (q, a) = overlap(index.whole[item]), map(overlap, index.parts[item])
        if whole >= MIN_OVERLAP or (q >= MIN_OVERLAP and a >= MIN_OVERLAP):
            out.append((index.ids[item], at, score, whole, q, a))
    return out


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, text, size (words), term: the distinct terms of each item."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = words_of(t)
            out += [(i, t, len(w), x) for x in sorted(set(w))]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["item_id", "text", "size", "term"])

    return map_batches(items.select("item_id", "text"), run, "item_id long, text string, size long, term string")


def contaminated(docs: DataFrame, items: DataFrame, item_key: str = "item_id") -> DataFrame:
    """doc_id, item_id, passage, bm25, overlap, question_overlap, answer_overlap: every pair of a
    row and a test item whose passage is retrieved and whose shingles overlap.

    Null and empty texts and items match nothing. Rows and items that repeat are reported once for
    each row. Document frequencies, number and mean length come from all items. The index goes to
    the workers whole if it has up to INDEX_POSTINGS postings, else in parts of that size, each in
    a pass of its own over ``docs``; the results are the same. Other columns are ignored."""
    spark = docs.sparkSession
    python_batches(spark)
    listed = items.where(F.col("text").isNotNull()).select(F.col(item_key).cast("long").alias("item_id"), "text").dropDuplicates(["item_id", "text"])
    terms = cut(item_terms(listed), "items")
    sizes = terms.groupBy("item_id", "text").agg(F.first("size").alias("size"), F.count("*").alias("postings"))
    total = sizes.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), F.sum("postings").alias("postings")).first()
    often = cut(terms.groupBy("term").agg(F.count("*").alias("df")).where("df > 1"), "item-frequencies")
    n_parts = max(1, -(-(total["postings"] or 0) // INDEX_POSTINGS))
    schema = "doc_id long, item_id long, passage long, bm25 double, overlap double, question_overlap double, answer_overlap double"
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    found = None
    for part in range(n_parts):
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n_parts)) == part)
        df = {r["term"]: r["df"] for r in often.join(own.select("term").distinct(), "term", "left_semi").collect()}
        texts = own.select("item_id", "text").distinct().orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(ItemIndex([(r["item_id"], r["text"]) for r in texts], df, total["n"], total["mean"]))

        def run(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            out = [(i, *leak) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for leak in find_leaks(t.as_py(), shared.value)]
            names = ["doc_id", "item_id", "passage", "bm25", "overlap", "question_overlap", "answer_overlap"]
            kinds = [pa.int64()] * 3 + [pa.float64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

        mapped = map_batches(rows, run, schema)
        found = mapped if found is None else found.unionByName(mapped)
    return found
