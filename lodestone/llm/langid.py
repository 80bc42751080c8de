"""Language identification by interpolated Kneser-Ney character models.

Counts come from a bounded sample of labelled rows, gathered as (language, n-gram hash, count).
All languages share one sorted array of n-gram hashes and one of context hashes; each row has a
value for each language. A text goes to the language of lowest cross-entropy per character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import map_batches, mix, python_batches, text_of

ORDER, DISCOUNT = 4, 0.75
#: Bounds of the model: labelled documents for each language (in expectation, by a hash of
#: doc_id), and n-grams of a language and order (the most frequent). Every language has a model.
SAMPLE_DOCS, MAX_GRAMS = 1500, 100_000
#: Rejection: above this quantile of the language's documents that were left out of the counts (one in
#: CALIBRATION of the sample), plus a margin, in bits.
REJECT_QUANTILE, REJECT_MARGIN, CALIBRATION = 0.999, 0.5, 5

_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])
_HAS_LETTER = regex.compile(r"\p{L}")
_P = np.uint64(0x9E3779B97F4A7C15)


def symbols(text: str) -> np.ndarray:
    """Lower-cased letters as code points, each run of anything else as one space, spaces around."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(c, 0xFFFF)]
    far = np.flatnonzero(c > 0xFFFF)
    if len(far):
        letter[far] = [chr(v).isalpha() for v in c[far].tolist()]
    x = np.where(letter, c, 32).astype(np.uint64)
    x = np.concatenate(([np.uint64(32)], x, [np.uint64(32)]))
    return x[np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]]


def gram_hashes(x: np.ndarray) -> list[np.ndarray]:
    """h[n][i]: hash of the n symbols that end at i (n from 0), as if spaces came before."""
    out = [np.zeros(len(x), np.uint64)]
    for n in range(1, ORDER + 1):
        before = np.concatenate((_pad_hash(n - 1), out[-1][:-1]))
        out.append(mix(before * _P + x + np.uint64(n)))
    return out


def _pad_hash(n: int) -> np.ndarray:
    h = np.zeros(1, np.uint64)
    for k in range(1, n + 1):
        h = mix(h * _P + np.uint64(32) + np.uint64(k))
    return h


@dataclass
class Model:
    """langs; for each order the sorted gram hashes with ``a`` = discounted probability, and the
    sorted context hashes with ``b`` = weight of the lower order: what the grams that were kept leave
    of one. So the shares of all symbols after a context sum to one, however many grams are kept."""

    langs: list[str]
    grams: list[np.ndarray]
    a: list[np.ndarray]
    contexts: list[np.ndarray]
    b: list[np.ndarray]
    limits: np.ndarray

    def log2p(self, h: list[np.ndarray], ctx: list[np.ndarray]) -> np.ndarray:
        """[positions, languages] for grams h[n] with contexts ctx[n] (their first n-1 symbols)."""
        p = np.full((len(h[1]), len(self.langs)), 1.0 / (len(self.grams[1]) + 1))  # known symbols and one for the rest
        for n in range(1, ORDER + 1):
            p *= _look(self.contexts[n], self.b[n], ctx[n], 1.0)
            p += _look(self.grams[n], self.a[n], h[n], 0.0)
        return np.log2(p)


def _look(keys: np.ndarray, values: np.ndarray, at: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(at), values.shape[1]), default)
    i = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
    return np.where((keys[i] == at)[:, None], values[i], default)


def gram_counts(sample: DataFrame) -> DataFrame:
    """lang, n, gram, ctx, short (the gram without its first symbol), c: distinct n-grams."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, list[list[np.ndarray]]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            h = gram_hashes(symbols(text.as_py()))
            by_lang.setdefault(lang, []).append(h)
        for lang, hs in by_lang.items():
            for n in range(1, ORDER + 1):
                every = np.concatenate([h[n][1:] for h in hs])
                _, first, c = np.unique(every, return_index=True, return_counts=True)
                ctx = np.concatenate([np.concatenate((_pad_hash(n - 1), h[n - 1][:-1]))[1:] for h in hs])
                short = np.concatenate([h[n - 1][1:] for h in hs])
                cols = [pa.array([lang] * len(c)), pa.array(np.full(len(c), n, np.int32)), *(pa.array(x[first].view(np.int64)) for x in (every, ctx, short)), pa.array(c.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "n", "gram", "ctx", "short", "c"])

    out = map_batches(sample.select("lang", text_of(sample).alias("text")), run, "lang string, n int, gram long, ctx long, short long, c long")
    return out.groupBy("lang", "n", "gram", "ctx", "short").agg(F.sum("c").alias("c"))


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model of the languages in ``labelled`` (doc_id, text, lang); None without any.
    Rows with null lang are no examples. The driver holds only the bounded model. The limits of
    rejection come from documents that were not counted; a language without such has none."""
    python_batches(labelled.sparkSession)
    labelled = labelled.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    n_docs = labelled.groupBy("lang").count().orderBy("lang").collect()
    if not n_docs:
        return None
    # salt keeps this choice apart from others by doc_id
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1 << 30))
    rows = [(r["lang"], int((1 << 30) * min(1.0, sample_docs / r["count"])), r["count"] >= 10 * CALIBRATION) for r in n_docs]
    below = labelled.sparkSession.createDataFrame(rows, "lang string, _below long, many boolean")
    sample = labelled.join(F.broadcast(below), "lang").where(draw < F.col("_below")).select("doc_id", "text", "lang", "many")
    aside = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("calibration")), F.lit(CALIBRATION)) == 0
    aside = aside & F.col("many")  # a few documents are all needed for counts
    counts = gram_counts(sample.where(~aside))
    langs = sorted(r["lang"] for r in n_docs)
    pdf = counts.toPandas()
    model = Model(langs, [np.zeros(0, np.uint64)], [np.zeros((0, len(langs)))], [np.zeros(0, np.uint64)], [np.ones((0, len(langs)))], np.full(len(langs), np.inf))
    for n in range(1, ORDER + 1):
        grams, contexts = [], []
        higher = pdf[pdf.n == n + 1]
        for k, lang in enumerate(langs):
            own = pdf[(pdf.n == n) & (pdf.lang == lang)]
            if n < ORDER:  # continuation counts: distinct longer grams that end in this one
                own = own.assign(c=own.gram.map(higher[higher.lang == lang].groupby("short").gram.nunique()).fillna(1).astype(int))
            total = own.groupby("ctx").c.transform("sum")
            own = own.assign(a=np.maximum(own.c - DISCOUNT, 0) / total).sort_values(["c", "gram"], ascending=False)[:MAX_GRAMS]
            grams.append((k, own.gram.to_numpy().astype(np.int64).view(np.uint64), own.a.to_numpy()))
            rest = (1 - own.groupby("ctx").a.sum()).clip(lower=0)  # discounts and grams that were not kept
            contexts.append((k, rest.index.to_numpy().astype(np.int64).view(np.uint64), rest.to_numpy()))
        for keys, values, parts, default in ((model.grams, model.a, grams, 0.0), (model.contexts, model.b, contexts, 1.0)):
            every = np.unique(np.concatenate([g for _, g, _ in parts]))
            table = np.full((len(every), len(langs)), default)
            for k, g, v in parts:
                table[np.searchsorted(every, g), k] = v
            keys.append(every)
            values.append(table)
    scored = entropies(sample.where(aside).select("doc_id", "text", "lang"), model, ["lang"])
    own = F.get("bits", F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1)
    limits = {r["lang"]: r["q"] for r in scored.where("letters >= 50").groupBy("lang").agg(F.percentile_approx(own, REJECT_QUANTILE, 10_000).alias("q")).collect()}
    model.limits = np.array([limits.get(x, np.inf) for x in langs]) + REJECT_MARGIN
    return model


def entropies(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """doc_id, ``keep``, letters, bits: cross-entropy per symbol under each language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = shared.value
        texts = [t.as_py() for t in batch.column(batch.num_columns - 1)]
        letters = [1 if _HAS_LETTER.search(t) else 0 for t in texts]
        bits: list[list[float]] = [[0.0] * len(m.langs)] * len(texts)
        at = 0
        while at < len(texts):  # some texts at once, so the sort below stays small
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < 400_000):
                size += len(texts[end])
                end += 1
            xs = [symbols(t) for t in texts[at:end]]
            hs = [gram_hashes(x) for x in xs]
            h = [np.concatenate([g[n][1:] for g in hs]) for n in range(ORDER + 1)]
            ctx = [None, *(np.concatenate([np.concatenate((_pad_hash(n - 1), g[n - 1][:-1]))[1:] for g in hs]) for n in range(1, ORDER + 1))]
            _, first, where = np.unique(h[ORDER], return_index=True, return_inverse=True)
            lp = m.log2p([g[first] for g in h], [None, *(c[first] for c in ctx[1:])])
            ends = np.cumsum([len(x) - 1 for x in xs])
            total = np.add.reduceat(lp[where], np.r_[0, ends[:-1]], axis=0) if len(h[0]) else np.zeros((len(xs), len(m.langs)))
            for k, x in enumerate(xs):
                n = len(x) - 1
                bits[at + k] = (-total[k] / n).tolist() if n > 0 else [0.0] * len(m.langs)
                letters[at + k] *= n
            at = end
        cols = [*batch.columns[:-1], pa.array(letters, pa.int64()), pa.array(bits, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *keep, "letters", "bits"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(docs.select("doc_id", *keep, text_of(docs).alias("text")), run, f"doc_id long, {kinds}letters long, bits array<double>")


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """doc_id, ``keep``, lang_pred, score, rejected for each row.

    ``und`` with score 0 for null texts, texts without a letter, or without a model. score is the
    share of the best language when entropies count for up to 100 symbols. ``rejected``: even the
    best language fits worse than its calibrated limit. Ties go to the first language in order."""
    keep = keep or []
    python_batches(docs.sparkSession)
    if model is None:
        return docs.select("doc_id", *keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    out = entropies(docs, model, keep)
    best = F.array_position("bits", F.array_min("bits")).cast("int") - 1
    out = out.withColumn("_best", F.when(F.col("letters") > 0, best))
    weight = F.least(F.col("letters"), F.lit(100)).cast("double")
    total = F.aggregate(F.transform("bits", lambda x: F.pow(F.lit(2.0), weight * (F.array_min("bits") - x))), F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "doc_id",
        *keep,
        F.coalesce(F.get(F.array(*map(F.lit, model.langs)), F.col("_best")), F.lit("und")).alias("lang_pred"),
        F.when(F.col("letters") > 0, 1.0 / total).otherwise(0.0).alias("score"),
        F.coalesce(F.array_min("bits") > F.get(F.array(*map(F.lit, model.limits.tolist())), F.col("_best")), F.lit(True)).alias("rejected"),
    )
