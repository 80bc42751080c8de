"""Language-model scoring with a hashed maximum-entropy model.

p(word | context) = p(class of word | context) * p(word | its class, class of the word before).
Both factors are softmaxes over sums of feature weights. The classes' features are hashed: the word
before, that word with the class of the one before it (n-gram), and that class alone (skip). The
number of words that are modelled one by one and of weight buckets grow with the training text;
the words beyond are contexts by a hash of their own, belong to classes by frequency, and are told
apart within a class by smoothed counts. So the model is a distribution over all known words with a
share for unknown ones. Counts are gathered from every training document; weights follow
distributed gradient updates on those counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import cut, map_batches, mix, python_batches, text_of, word_hashes

#: Least number of words that are modelled one by one and of weight buckets; both grow with the
#: square root of the training tokens. Gradient rounds.
WORDS, BUCKETS, ROUNDS = 1024, 1 << 14, 10
#: Classes: 0 for words beyond the head and unknown ones, 1 to MID for words of the head that are
#: not modelled one by one, the rest for those that are.
CLASSES, MID = 48, 7
RARE, BEGIN = 0, CLASSES  # BEGIN: the class before the first word
#: Frequent words whose counts every worker has (16 bytes each); others are joined.
HEAD = 1 << 17
#: The end is a token of its own; no word hashes to it in practice.
END = np.uint64(0)
#: Rows of the bias and of the classes two words before, and blocks of hashed rows. A partition makes
#: the gradients of whole blocks, so partitions add up in the first rows only.
FIXED, BLOCKS = CLASSES + 2, 64
#: Cells of a partition that makes gradients, and contexts whose classes are computed at once.
PART_CELLS, CHUNK = 500_000, 8_000
#: Tokens gathered before counts are passed on.
FLUSH = 3_000_000


def tokens(text: str) -> np.ndarray:
    return np.append(word_hashes(text), END)


def gathered(docs: DataFrame, of: str, codes: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """``of``, c: how often each number in ``codes(token hashes of some texts)`` occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            x, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(c.astype(np.int64))], names=[of, "c"])

        for batch in batches:
            if batch.num_rows:
                held.append(codes([tokens(t.as_py()) for t in batch.column(0)]))
                size += len(held[-1])
            if size >= FLUSH:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return docs.select(text_of(docs).alias("text")).mapInArrow(run, f"{of} long, c long").groupBy(of).agg(F.sum("c").alias("c"))


def token_counts(train: DataFrame) -> DataFrame:
    """h, c over all tokens of all rows."""
    return gathered(train, "h", np.concatenate)


@dataclass
class Vocabulary:
    """Sorted head hashes with counts, classes and ``symbol``: 1..words for the modelled words, else 0."""

    head: np.ndarray
    count: np.ndarray
    symbol: np.ndarray
    head_class: np.ndarray
    words: int  # modelled one by one
    klass: np.ndarray  # class of symbols 0..words
    n: int
    v: int
    class_n: np.ndarray  # tokens and words of each class
    class_v: np.ndarray

    @property
    def begin(self) -> int:
        """Context symbols: 1..words, then as many shared by the words beyond, then this one."""
        return 2 * self.words + 1

    @property
    def buckets(self) -> int:
        return max(BUCKETS, 1 << (4 * self.words - 1).bit_length())

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """In head or not, count (0 beyond), symbol (0 beyond), class."""
        if not len(self.head):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        i = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        hit = self.head[i] == h
        return hit, np.where(hit, self.count[i], 0), np.where(hit, self.symbol[i], 0), np.where(hit, self.head_class[i], RARE)

    def contexts(self, h: np.ndarray, starts: np.ndarray, symbol: np.ndarray, klass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token the symbol before it, the class of the one before that, and the class
        before it. ``starts``: the first tokens of texts."""
        own = np.where(symbol > 0, symbol, self.words + 1 + (mix(h) % np.uint64(max(1, self.words))).astype(np.int64))
        one, before, two = (np.empty(len(h), np.int64) for _ in range(3))
        one[1:], before[1:], two[1:] = own[:-1], klass[:-1], 0
        one[starts], before[starts] = self.begin, BEGIN
        two[1:] = before[:-1]
        two[starts] = BEGIN
        return one, two, before


def _spread(counts: np.ndarray, first: int, classes: int) -> np.ndarray:
    """Classes of equal sums of square roots of counts, the most frequent words first."""
    share = np.cumsum(np.sqrt(counts)) / max(1e-9, np.sqrt(counts).sum())
    return first + np.minimum((share * classes - 1e-9).astype(np.int64), classes - 1)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The driver holds the HEAD most frequent words only."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("c"), "h").limit(HEAD).toPandas()
    n, v = int(total["n"] or 0), int(total["v"])
    words = min(len(top), max(WORDS, math.isqrt(n)))
    c = top.c.to_numpy(np.int64)
    klass = np.r_[_spread(c[:words], 1 + MID, CLASSES - 1 - MID), _spread(c[words:], 1, MID)].astype(np.int64)
    symbol = np.where(np.arange(len(top)) < words, np.arange(len(top)) + 1, 0)
    class_n = np.bincount(klass, c, CLASSES) if len(c) else np.zeros(CLASSES)
    class_v = np.bincount(klass, minlength=CLASSES).astype(float)
    class_n[RARE], class_v[RARE] = n - c.sum(), v - len(c)
    h = top.h.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return Vocabulary(h[order], c[order], symbol[order].astype(np.int64), klass[order], words, np.r_[RARE, klass[:words]], n, v, class_n, class_v)


def context_counts(train: DataFrame, vocab: Vocabulary) -> DataFrame:
    """cell, c. A cell is (symbol before, class before that, class now), or -1 - (class before,
    symbol now)."""
    shared = train.sparkSession.sparkContext.broadcast(vocab)

    def codes(hs: list[np.ndarray]) -> np.ndarray:
        v = shared.value
        h = np.concatenate(hs)
        starts = np.r_[0, np.cumsum(list(map(len, hs)))[:-1]]
        _, _, symbol, klass = v.find(h)
        one, two, before = v.contexts(h, starts, symbol, klass)
        own = symbol > 0
        return np.concatenate(((one * (CLASSES + 1) + two) * CLASSES + klass, -1 - (before * (v.words + 1) + symbol)[own]))

    return gathered(train, "cell", codes)


def block_of(one: np.ndarray) -> np.ndarray:
    """The block of weights that holds the features of a symbol before."""
    return (mix(one.astype(np.uint64) + np.uint64(11)) % np.uint64(BLOCKS)).astype(np.int64)


def class_features(one: np.ndarray, two: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Rows of weights [n, 3] of a context: the symbol before and that with the class before it, both
    hashed into the symbol's block, and the class alone, which has a row of its own. Row 0 is the
    bias. So contexts of different blocks share the first rows only."""
    at = FIXED + block_of(one) * (buckets // BLOCKS)
    width = np.uint64(buckets // BLOCKS)
    a, b = one.astype(np.uint64), two.astype(np.uint64)
    f = np.stack((a * np.uint64(4), (a * np.uint64(64) + b) * np.uint64(4) + np.uint64(1)), 1)
    return np.column_stack((at[:, None] + (mix(f + np.uint64(7)) % width).astype(np.int64), 1 + two.astype(np.int64)))


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


@dataclass
class Model:
    vocab: Vocabulary
    w: np.ndarray  # [FIXED + buckets, CLASSES]
    u: np.ndarray  # [bias and classes before, words + 1]

    def class_logp(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        f = class_features(one, two, len(self.w) - FIXED)
        return log_softmax(self.w[0] + self.w[f[:, 0]] + self.w[f[:, 1]] + self.w[f[:, 2]])

    def word_logp(self) -> np.ndarray:
        """[class before, symbol]: log p(symbol | its class, class before)."""
        logits = self.u[0] + self.u[1:]
        out = np.zeros_like(logits)
        klass = self.vocab.klass
        for k in np.unique(klass[1:]):
            own = np.flatnonzero(klass[1:] == k) + 1
            out[:, own] = log_softmax(logits[:, own])
        return out


def add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """total[at] += rows, where ``at`` repeats: sorted runs are added at once."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    total[at[first]] += np.add.reduceat(rows[order], first, axis=0)


def gradient(m: Model, cell: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Gradients and curvatures of w and u over some cells, without those of the bias rows."""
    g = [np.zeros(s, np.float32) for s in (m.w.shape, m.w.shape, m.u.shape, m.u.shape)]
    klass, width = m.vocab.klass, m.vocab.words + 1
    order = np.argsort(cell, kind="stable")
    cell, c = cell[order], c[order]
    del order
    split = int(np.searchsorted(cell, 0))
    rest, y, count = cell[split:] // CLASSES, cell[split:] % CLASSES, c[split:]
    ctx, first = np.unique(rest, return_index=True)
    ends = np.r_[first[1:], len(rest)]
    for low in range(0, len(ctx), CHUNK):
        own = ctx[low : low + CHUNK]
        one, two = own // (CLASSES + 1), own % (CLASSES + 1)
        p = np.exp(m.class_logp(one, two))
        a, b = first[low], ends[min(low + CHUNK, len(ctx)) - 1]
        where = np.repeat(np.arange(len(own)), ends[low : low + CHUNK] - first[low : low + CHUNK])
        seen = np.zeros_like(p)
        seen[where, y[a:b]] = count[a:b]
        total = seen.sum(1, keepdims=True)
        slope, bend = (seen - total * p).astype(np.float32), (total * p * (1 - p)).astype(np.float32)
        f = class_features(one, two, len(m.w) - FIXED)
        for j in range(3):
            add_rows(g[0], f[:, j], slope)
            add_rows(g[1], f[:, j], bend)
    if split:
        code = -1 - cell[:split]
        seen = np.bincount(code, c[:split], (CLASSES + 1) * width).reshape(CLASSES + 1, width)
        p = np.exp(m.word_logp())
        share = np.zeros((CLASSES + 1, CLASSES))
        for k in range(CLASSES):
            share[:, k] = seen[:, klass == k].sum(1)
        mean = share[:, klass] * p
        mean[:, 0] = 0
        g[2][1:], g[3][1:] = seen - mean, mean * (1 - p)
    return g


def parts_of_gradient(m: Model, cell: np.ndarray, c: np.ndarray, mine: np.ndarray) -> Iterator[tuple[str, int, bytes]]:
    """(which, number, packed gradient and curvature): the fixed rows, the blocks of w in ``mine``,
    and the rows of u that the cells are about."""
    g = gradient(m, cell, c)
    width = (len(m.w) - FIXED) // BLOCKS
    yield "fixed", 0, np.stack((g[0][1:FIXED], g[1][1:FIXED])).tobytes()
    for k in mine.tolist():
        own = slice(FIXED + k * width, FIXED + (k + 1) * width)
        yield "w", k, np.stack((g[0][own], g[1][own])).tobytes()
    for k in np.flatnonzero(g[3][1:].any(1)).tolist():
        yield "u", k + 1, np.stack((g[2][k + 1], g[3][k + 1])).tobytes()


def moved(old: np.ndarray, slope: np.ndarray, bend: np.ndarray, rate: float) -> np.ndarray:
    """Weights after a bounded step along the slope over the curvature; the slope's memory is used."""
    slope /= bend + 1.0
    np.clip(slope, -3, 3, out=slope)
    slope *= rate
    slope += old
    return np.clip(slope, -30, 30, out=slope)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, cell, c: rows sorted by part as packed arrays of up to PART_CELLS cells."""
    part, held, size = None, [], 0

    def out() -> pa.RecordBatch:
        cell, c = (np.concatenate(x).astype(np.int64).tobytes() for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([cell], pa.binary()), pa.array([c], pa.binary())], names=["part", "cell", "c"])

    for batch in batches:
        parts = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and (parts[a] != part or size >= PART_CELLS):
                yield out()
                held, size = [], 0
            part = int(parts[a])
            held.append((batch.column(1).to_numpy()[a:b], batch.column(2).to_numpy()[a:b]))
            size += b - a
    if held:
        yield out()


def fit(train: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model and the table of token counts. Each round, partitions of the gathered cells give
    gradients and curvatures of the blocks that are theirs, and these move the weights; the driver
    gets about one model a round."""
    spark = train.sparkSession
    python_batches(spark)
    counts = cut(token_counts(train), "lm-tokens")
    vocab = vocabulary(counts)
    cells = cut(context_counts(train, vocab), "lm-cells")
    n_parts = min(BLOCKS, max(4, -(-cells.count() // PART_CELLS)))

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cell = batch.column(0).to_numpy()
        code = -1 - cell
        at = np.where(cell >= 0, block_of(cell // (CLASSES * (CLASSES + 1))), code // (vocab_words + 1))
        yield pa.RecordBatch.from_arrays([pa.array((at % n_parts).astype(np.int32)), *batch.columns], names=["part", "cell", "c"])

    vocab_words = vocab.words
    placed = map_batches(cells, place, "part int, cell long, c long").repartition(n_parts, "part").sortWithinPartitions("part")
    cells = cut(placed.mapInArrow(_packed, "part int, cell binary, c binary"), "lm-cells-by-block")
    buckets = vocab.buckets // BLOCKS * BLOCKS
    model = Model(vocab, np.zeros((FIXED + buckets, CLASSES), np.float32), np.zeros((CLASSES + 2, vocab.words + 1), np.float32))
    # start at the frequencies, so the rounds only have the contexts to learn
    size = np.zeros(vocab.words + 1)
    held = vocab.symbol > 0
    size[vocab.symbol[held]] = vocab.count[held]
    model.w[0] = np.log(vocab.class_n + 0.5)
    model.u[0] = np.log(size + 0.5)
    width = buckets // BLOCKS
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(model)

        def run(batch: pa.RecordBatch, now=now) -> Iterator[pa.RecordBatch]:
            for part, cell, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                rows = parts_of_gradient(now.value, np.frombuffer(cell.as_buffer(), np.int64), np.frombuffer(c.as_buffer(), np.int64), np.arange(part, BLOCKS, n_parts))
                yield pa.RecordBatch.from_pylist([dict(zip(("which", "k", "g"), r, strict=True)) for r in rows], pa.schema([("which", pa.string()), ("k", pa.int32()), ("g", pa.binary())]))

        rows = map_batches(cells, run, "which string, k int, g binary").collect()
        now.destroy()
        g = [np.zeros(s, np.float32) for s in (model.w.shape, model.w.shape, model.u.shape, model.u.shape)]
        for r in rows:
            x = np.frombuffer(r["g"], np.float32).reshape(2, -1)
            a, b = (g[2], g[3]) if r["which"] == "u" else (g[0], g[1])
            at = {"fixed": slice(1, FIXED), "w": slice(FIXED + r["k"] * width, FIXED + (r["k"] + 1) * width), "u": r["k"]}[r["which"]]
            a[at] += x[0].reshape(a[at].shape)
            b[at] += x[1].reshape(b[at].shape)
        # every context has one class before: their rows add up to the bias
        g[0][0], g[1][0], g[2][0], g[3][0] = g[0][1:FIXED].sum(0), g[1][1:FIXED].sum(0), g[2][1:].sum(0), g[3][1:].sum(0)
        # each position moves four rows of w and two of u at once: smaller steps keep the sum stable
        model = Model(vocab, moved(model.w, g[0], g[1], 0.28), moved(model.u, g[2], g[3], 0.5))
        del rows, g
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, ``keep``, n_tokens, n_known, train_tokens, base_score, score for each row.

    Null and empty texts are the end alone. Words beyond the head get their counts by a join on
    their hash and come back by the row's own number, so repeated rows are scored each for itself."""
    keep = keep or []
    spark = docs.sparkSession
    python_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *keep, text_of(docs).alias("text"))

    def scored(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = shared.value
        v = m.vocab
        hs = [tokens(t.as_py()) for t in batch.column(batch.num_columns - 1)]
        lens = np.array(list(map(len, hs)))
        starts = np.r_[0, np.cumsum(lens)[:-1]]
        h = np.concatenate(hs)
        hit, c, symbol, klass = v.find(h)
        one, two, before = v.contexts(h, starts, symbol, klass)
        ctx, where = np.unique(one * (CLASSES + 1) + two, return_inverse=True)
        lp = np.empty(len(h))
        clp = np.empty((len(ctx), CLASSES), np.float32)
        for at in range(0, len(ctx), CHUNK):
            clp[at : at + CHUNK] = m.class_logp(ctx[at : at + CHUNK] // (CLASSES + 1), ctx[at : at + CHUNK] % (CLASSES + 1))
        if "word_logp" not in _TABLES or _TABLES["model"] is not m:
            _TABLES.update(model=m, word_logp=m.word_logp() / np.log(10))
        tail = symbol == 0
        unseen = np.log10(np.maximum(1.0, v.class_n + v.class_v + (np.arange(CLASSES) == RARE)))
        own = np.where(hit, np.log10(c + 1.0), 0.0)
        lp = clp[where, klass] / np.log(10) + np.where(tail, own - unseen[klass], _TABLES["word_logp"][before, symbol])
        total = lambda x: np.add.reduceat(x, starts)
        rare = np.flatnonzero(~hit)
        k = np.repeat(np.arange(len(hs)), lens)[rare]
        r = h[rare]
        order = np.lexsort((r, k))
        k, r = k[order], r[order]
        first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])]) if len(k) else np.zeros(0, np.int64)
        ends = pa.array(np.searchsorted(k[first], np.arange(len(hs) + 1)).astype(np.int32))
        words = pa.ListArray.from_arrays(ends, pa.array(r[first].view(np.int64)))
        times = pa.ListArray.from_arrays(ends, pa.array(np.diff(np.r_[first, len(k)]).astype(np.int32)))
        cols = [pa.array(lens.astype(np.int64)), pa.array(total(hit.astype(np.int64))), pa.array(total(own) - lens * np.log10(v.n + v.v + 1.0)), pa.array(total(lp)), words, times]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=["row", "doc_id", *keep, "n_tokens", "n_head", "b", "s", "words", "times"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    head = cut(map_batches(rows, scored, f"row long, doc_id long, {kinds}n_tokens long, n_head long, b double, s double, words array<long>, times array<int>"), "lm-scores")
    rare = head.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("h"), F.col("x.times").alias("tf"))
    tail = rare.join(counts, "h").groupBy("row").agg(F.sum("tf").alias("n_rare"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("t"))
    t = F.coalesce("t", F.lit(0.0))
    return head.drop("words", "times").join(tail, "row", "left").select(
        "doc_id",
        *keep,
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.vocab.n).cast("long").alias("train_tokens"),
        (F.col("b") + t).alias("base_score"),
        (F.col("s") + t).alias("score"),
    )


#: The word factor of the model that this worker scores with.
_TABLES: dict = {}
