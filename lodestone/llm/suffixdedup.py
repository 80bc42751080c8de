"""Repeated 50-byte strings across documents, removed from all but the smallest doc_id.

Every window of WIDTH bytes belongs to its minimizer, the gram of least hash in it; a maximal run
of windows with one minimizer is a segment. Equal windows have equal minimizers, so:
1. segments (hashes only) meet by minimizer hash: equal segments settle all their windows at once.
   Of equal segments in one batch only that of the smallest doc_id goes on, so a string that a
   third of all documents hold is a few rows; the others of the batch are settled there;
2. segments that share a minimizer with a different segment send their bytes, once for each
   distinct content, and their windows are sorted by fingerprint, runs of equal strings compared
   byte by byte, and given the smallest doc_id;
3. each document gets the answers and cuts the covered bytes.
Reducers keep a segment's smallest doc_id only, and answer with one row a covered segment, so
their rows follow the repeated bytes. Documents of any length are read in chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import cut, map_batches, mix, python_batches, text_of

WIDTH, GRAM = 50, 28
#: Bytes of a document handled at once. A chunk's edge only splits a segment in two.
CHUNK = 1 << 20
#: Bytes of text for each reducer, and the least number of reducers.
PART_BYTES, MIN_PARTS = 24 << 20, 8
#: Stands for a null doc_id: later than every other, and never covering another null one.
NO_ID = (1 << 63) - 1
_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if len(_POWERS.get("p", ())) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("p", _P), ("q", pow(_P, -1, 1 << 64))):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    p, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[:-1], out=out[1:])
    return out


def fingerprints(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], the same wherever the bytes stand."""
    _, q = _powers(len(sums))
    return mix((sums[end] - sums[start]) * q[start] + (end - start).astype(np.uint64))


def segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one document: first byte, end, minimizer hash, 48-bit content hash of each segment."""
    found = []
    for at in range(0, max(1, len(data) - WIDTH + 1), CHUNK):
        part = data[at : at + CHUNK + WIDTH - 1]
        if len(part) < WIDTH:
            continue
        sums = prefix_sums(part)
        grams = np.arange(len(part) - GRAM + 1)
        h = fingerprints(sums, grams, grams + GRAM)
        low = (h & np.uint64(0xFFFFFFFF00000000)) | grams.astype(np.uint64)
        span, width = WIDTH - GRAM + 1, 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if span > width:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        where = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        end = np.r_[first[1:], len(where)] + WIDTH - 1
        found.append((first + at, end + at, h[where[first]], fingerprints(sums, first, end) >> np.uint64(16)))
    if not found:
        none = np.zeros(0, np.uint64)
        return none.astype(np.int64), none.astype(np.int64), none, none
    return tuple(map(np.concatenate, zip(*found, strict=True)))  # type: ignore[return-value]


def _bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _segment_rows(rows: DataFrame, parts: int) -> DataFrame:
    """part, docs (ids), lens, mini (u32), low (u32), high (u16): packed segments of a batch, each
    content once, for its smallest doc_id. Rows with a negative part are answers: segments of
    ``docs`` that a smaller document of the same batch holds too."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        minis, hashes, at = [], [], []
        for k, t in enumerate(batch.column(1)):
            _, _, m, h = segments(_bytes_of(t.as_py()))
            h, first = np.unique(h, return_index=True)
            minis.append(m[first])
            hashes.append(h)
            at.append(np.full(len(h), k, np.int32))
        m, h, k = (np.concatenate(x) for x in (minis, hashes, at))
        ids = batch.column(0).to_numpy().astype(np.int64)
        rank = np.unique(ids, return_inverse=True)[1][k]
        order = np.lexsort((rank, h))
        m, h, k, rank = m[order], h[order], k[order], rank[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (m[1:] != m[:-1])]) if len(h) else np.zeros(0, np.int64)
        lead = np.repeat(first, np.diff(np.r_[first, len(h)]))
        over = rank > rank[lead]
        out = []

        def pack(p: int, own: np.ndarray) -> None:
            docs, lens = np.unique(k[own], return_counts=True)
            own = own[np.argsort(k[own], kind="stable")]
            x = h[own]
            out.append((p, ids[docs].tobytes(), lens.astype(np.int32).tobytes(), (m[own] >> np.uint64(32)).astype(np.uint32).tobytes(), x.astype(np.uint32).tobytes(), (x >> np.uint64(32)).astype(np.uint16).tobytes()))

        if over.any():
            pack(-1 - int(h[0] % np.uint64(1 << 30)), np.flatnonzero(over))
        part = (m[first] % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            pack(p, first[order[cuts[p] : cuts[p + 1]]])
        cols = [pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[c] for r in out], pa.binary()) for c in range(1, 6))]
        yield pa.RecordBatch.from_arrays(cols, names=["part", "docs", "lens", "mini", "low", "high"])

    return map_batches(rows, run, "part int, docs binary, lens binary, mini binary, low binary, high binary")


def _answers(doc: np.ndarray, h: np.ndarray, full: bool) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(doc), 200_000):
        own = slice(at, at + 200_000)
        d, x = doc[own], h[own].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(x), pa.array(np.full(len(d), full))], names=["doc_id", "h", "full"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, h, full: a row for each segment that is covered (full) or needs a look at its bytes,
    from the segments of one reducer."""
    docs, minis, hashes = [], [], []
    for batch in batches:
        for p, d, n, m, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            d = np.repeat(np.frombuffer(d, np.int64), np.frombuffer(n, np.int32))
            h = np.frombuffer(low, np.uint32).astype(np.uint64) | (np.frombuffer(high, np.uint16).astype(np.uint64) << np.uint64(32))
            if p < 0:
                yield from _answers(d, h, True)
                continue
            docs.append(d)
            minis.append(np.frombuffer(m, np.uint32))
            hashes.append(h)
    if not docs:
        return
    d, m, h = (np.concatenate(x) for x in (docs, minis, hashes))
    del docs, minis, hashes
    order = np.argsort(h, kind="stable")
    d, m, h = d[order], m[order], h[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (m[1:] != m[:-1])])
    least = np.minimum.reduceat(d, first)
    over = d > np.repeat(least, np.diff(np.r_[first, len(d)]))
    yield from _answers(d[over], h[over], True)
    # minimizers of different segments that are in different documents
    gm, gh = m[first], h[first]
    order = np.argsort(gm, kind="stable")
    gm, gh, gd = gm[order], gh[order], least[order]
    start = np.flatnonzero(np.r_[True, gm[1:] != gm[:-1]])
    size = np.diff(np.r_[start, len(gm)])
    mixed = (size > 1) & (np.minimum.reduceat(gd, start) < np.maximum.reduceat(gd, start))
    pick = np.repeat(mixed, size)
    yield from _answers(gd[pick], gh[pick], False)


def _sets(column: pa.Array) -> list[np.ndarray | None]:
    """The numbers of each list, sorted and distinct; null for an empty or null one."""
    out: list[np.ndarray | None] = []
    for x in column:
        v = x.values if x.is_valid else None
        out.append(np.unique(v.to_numpy()).view(np.uint64) if v is not None and len(v) else None)
    return out


def _wanted(batch: pa.RecordBatch, parts: int) -> Iterator[pa.RecordBatch]:
    """part, mini, doc_id, h, data: bytes of the segments that need a look."""
    out = []
    for i, t, want in zip(batch.column(0).to_pylist(), batch.column(1), _sets(batch.column(2)), strict=True):
        if want is None:
            continue
        data = _bytes_of(t.as_py())
        s, e, m, h = segments(data)
        at = np.flatnonzero(np.isin(h, want))
        _, first = np.unique(h[at], return_index=True)
        raw = data.tobytes()
        out += [(int(m[k] % np.uint64(parts)), i, int(h[k]), raw[s[k] : e[k]]) for k in at[first]]
    cols = [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.binary())]
    yield pa.RecordBatch.from_arrays(cols, names=["part", "doc_id", "h", "data"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, h, mask: which windows of a segment start in a smaller document too."""
    ids, hs, datas = [], [], []
    for batch in batches:
        ids.append(batch.column(1).to_numpy())
        hs.append(batch.column(2).to_numpy())
        datas += batch.column(3).to_pylist()
    if not datas:
        return
    doc, h = np.concatenate(ids), np.concatenate(hs)
    lens = np.array(list(map(len, datas)))
    data = np.frombuffer(b"".join(datas), np.uint8)
    del datas
    starts = np.r_[0, np.cumsum(lens)[:-1]]
    n_win = lens - WIDTH + 1
    first = np.r_[0, np.cumsum(n_win)]
    owner = np.repeat(np.arange(len(lens)), n_win)
    at = starts[owner] + np.arange(len(owner)) - first[owner]
    prints = np.empty(len(at), np.uint64)
    for lo in range(0, len(lens), 20_000):  # sums stay small
        hi = min(len(lens), lo + 20_000)
        base = starts[lo]
        own = slice(first[lo], first[hi])
        sums = prefix_sums(data[base : starts[hi - 1] + lens[hi - 1]])
        prints[own] = fingerprints(sums, at[own] - base, at[own] - base + WIDTH)
    order = np.lexsort((doc[owner], prints))
    p = prints[order]
    run = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    lead = np.repeat(order[run], np.diff(np.r_[run, len(p)]))
    later = doc[owner[order]] > doc[owner[lead]]
    a, b = at[order[later]], at[lead[later]]
    same = np.ones(len(a), bool)
    for j in range(WIDTH):
        same &= data[a + j] == data[b + j]
    mask = np.zeros(len(at), bool)
    mask[order[later][same]] = True
    out = [k for k in np.unique(owner[mask])]
    packed = [np.packbits(mask[first[k] : first[k + 1]]).tobytes() for k in out]
    yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(h[out]), pa.array(packed, pa.binary())], names=["doc_id", "h", "mask"])


def _cut_text(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    n_bytes, spans, kept = [], [], []
    for t, cover, partial in zip(batch.column(1), _sets(batch.column(2)), batch.column(3).to_pylist(), strict=True):
        data = _bytes_of(t.as_py())
        gone = np.zeros(len(data) + 1, np.int32)
        if cover is not None or partial:
            s, e, _, h = segments(data)
            full = np.isin(h, cover) if cover is not None else np.zeros(len(h), bool)
            np.add.at(gone, s[full], 1)
            np.add.at(gone, e[full], -1)
            masks = {r["h"]: r["mask"] for r in partial or []}
            for k in np.flatnonzero(np.isin(h, np.array(list(masks), np.int64).view(np.uint64))) if masks else ():
                bits = np.unpackbits(np.frombuffer(masks[int(h[k])], np.uint8))[: e[k] - s[k] - WIDTH + 1]
                at = s[k] + np.flatnonzero(bits)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + WIDTH, -1)
        removed = np.cumsum(gone)[:-1] > 0
        edge = np.diff(np.r_[0, removed.astype(np.int8), 0])
        n_bytes.append(len(data))
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
        kept.append(data[~removed].tobytes())
    cols = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (start, end) removed, kept bytes, for each row.

    Null text is empty; texts under WIDTH bytes keep all. Rows with equal doc_id never cover each
    other and share their answers. Rows with null doc_id come after all others. Other columns are
    ignored."""
    spark = docs.sparkSession
    python_batches(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_of(docs, text).alias("text"))
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    parts = max(MIN_PARTS, -(-size // PART_BYTES))
    packed = _segment_rows(rows, parts).repartition(parts, "part")
    settled = packed.mapInArrow(_settle, "doc_id long, h long, full boolean")
    listed = lambda want, name: F.collect_list(F.when(want, F.col("h"))).alias(name)
    answers = cut(settled.groupBy("doc_id").agg(listed(F.col("full"), "covered"), listed(~F.col("full"), "need")), "repeat-segments")
    asked = rows.join(answers.where(F.size("need") > 0).select("doc_id", "need"), "doc_id")
    wanted = map_batches(asked, lambda b: _wanted(b, parts), "part int, doc_id long, h long, data binary")
    masks = wanted.repartition(parts, "part").mapInArrow(_compare, "doc_id long, h long, mask binary")
    # rows of equal doc_id may ask for the same segment
    masks = cut(masks.groupBy("doc_id").agg(F.collect_set(F.struct("h", "mask")).alias("partial")), "repeat-windows")
    known = answers.where(F.size("covered") > 0).select("doc_id", "covered").join(masks, "doc_id", "full")
    out = map_batches(rows.join(known, "doc_id", "left").select("doc_id", "text", "covered", "partial"), _cut_text, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def digests(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
