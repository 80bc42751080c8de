"""Reversible line dedup: sharded cuckoo filters before exact reference-count tables.

Every (document, line key) is a row of a postings table; counts per key are sums over it, so a
deleted document only takes its own rows away. Keys are 128-bit hashes of the normalised line.
Cuckoo filters over the repeated keys, one a shard, keep unrepeated lines out of the exact join: at
every size; small sets of filters go to the lines, larger ones meet the lines shard by shard. A
``LineIndex`` keeps filters and postings in a folder and follows insertions and deletions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.base import WS_BYTES, ascii_lower_bytes, cut, fresh, map_batches, python_batches, text_of

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys that one shard's filter holds, and the bytes of all filters up to which they are sent to
#: every worker. Beyond it lines go to the filters, each shard's lines to SALTS tasks.
SHARD_KEYS, FILTER_BYTES, SALTS = 500_000, 24 << 20, 16
SLOTS = 4
#: Up to so many repeated keys (about 40 bytes each) go to every worker. Beyond it only the most
#: frequent do: no more keys than this can hold that share of all postings.
BROADCAST_KEYS = 200_000
#: Up to so many dropped lines the drops go to every worker and the texts stay where they are.
BROADCAST_LINES = 1_000_000


def line_key(line: bytes) -> bytes:
    return line.strip(WS_BYTES)


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def key_hashes(text: str, least: int = MIN_CHARS) -> list[tuple[int, int]]:
    """(line number, 128-bit hash) of each line whose key is long enough."""
    out = []
    for i, line in enumerate(ascii_lower_bytes(text).split(b"\n")):
        key = line.strip(WS_BYTES)
        if long_enough(key, least):
            out.append((i, xxhash.xxh3_128_intdigest(key)))
    return out


class CuckooFilter:
    """Buckets of four 16-bit fingerprints. ``add`` says whether there was room; ``remove`` takes
    one copy away. Wrong positives about 8 / 65536; no wrong negatives while every add succeeded."""

    def __init__(self, capacity: int, table: np.ndarray | None = None) -> None:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.85)))))
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.mask = len(self.table) - 1

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def _other(self, i: np.ndarray, f: np.ndarray) -> np.ndarray:
        return i ^ ((f.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(self.mask))

    def add(self, h: int, kicks: int = 500) -> bool:
        f = int(self._print(np.array([h], np.uint64))[0])
        i = h & self.mask
        j = int(self._other(np.array([i], np.uint64), np.array([f], np.uint16))[0])
        for at in (i, j):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = f
                return True
        at = j
        for k in range(kicks):
            slot = k % SLOTS
            f, self.table[at, slot] = int(self.table[at, slot]), f
            at = int(self._other(np.array([at], np.uint64), np.array([f], np.uint16))[0])
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = f
                return True
        return False

    def has(self, h: np.ndarray) -> np.ndarray:
        h = h.astype(np.uint64)
        f, i = self._print(h), h & np.uint64(self.mask)
        return (self.table[i] == f[:, None]).any(1) | (self.table[self._other(i, f)] == f[:, None]).any(1)

    def remove(self, h: int) -> bool:
        f = self._print(np.array([h], np.uint64))
        i = np.array([h & self.mask], np.uint64)
        for at in (int(i[0]), int(self._other(i, f)[0])):
            held = np.flatnonzero(self.table[at] == f[0])
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter that holds every key: it grows until all find room."""
        size = max(16, len(keys))
        while True:
            out = cls(size)
            if all(out.add(int(h)) for h in keys):
                return out
            size = 2 * size


def postings(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """doc_id, h1, h2: each long enough line key of each row once. Null text: one empty line."""
    python_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, keys = [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = {h for _, h in key_hashes(t.as_py(), least)}
            ids += [i] * len(own)
            keys += own
        raw = np.frombuffer(b"".join(k.to_bytes(16, "little") for k in keys), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw[:, 0]), pa.array(raw[:, 1])], names=["doc_id", "h1", "h2"])

    return map_batches(docs.select("doc_id", text_of(docs).alias("text")), run, "doc_id long, h1 long, h2 long")


def reference_counts(posted: DataFrame) -> DataFrame:
    """h1, h2, n_docs, max_doc: distinct documents of each key. Rows without doc_id are no
    documents. Counts are summed before the shuffle, so a line that a third of all documents hold
    is a few rows. Only ids that occur in several rows have their postings made distinct."""
    posted = posted.where("doc_id is not null").select("doc_id", "h1", "h2", F.lit(1).alias("one"))
    return posted.groupBy("h1", "h2").agg(F.sum("one").cast("long").alias("n_docs"), F.max("doc_id").alias("max_doc"))


def document_counts(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """``reference_counts`` of the documents in ``docs``, in which a doc_id may have several rows."""
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    again = cut(again, "line-ids")
    posted = postings(docs, least)
    if again.isEmpty():
        return reference_counts(posted)
    more = postings(docs.join(again, "doc_id", "left_semi"), least).groupBy("doc_id", "h1", "h2").agg((1 - F.count("*")).cast("int").alias("one"))
    every = posted.where("doc_id is not null").select("doc_id", "h1", "h2", F.lit(1).alias("one")).union(more.where("one < 0"))
    return every.groupBy("h1", "h2").agg(F.sum("one").cast("long").alias("n_docs"), F.max("doc_id").alias("max_doc"))


def _made(pdf: pd.DataFrame) -> pd.DataFrame:
    made = CuckooFilter.of(pdf["h1"].to_numpy().view(np.uint64))
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "slots": [made.table.tobytes()]})


def shard_filters(keys: DataFrame, n_keys: int) -> DataFrame:
    """shard, slots: a cuckoo filter for each shard of about SHARD_KEYS keys."""
    shards = max(1, -(-n_keys // SHARD_KEYS))

    sharded = keys.select(F.pmod("h2", F.lit(shards)).cast("int").alias("shard"), "h1")
    return sharded.groupBy("shard").applyInPandas(_made, "shard int, slots binary")


def marked_lines(docs: DataFrame, filters: dict[int, bytes] | None, shards: int, least: int = MIN_CHARS) -> DataFrame:
    """doc_id, pos, h1, h2 of the lines that the filters let through (all, without filters)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, at, keys = [], [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for pos, h in key_hashes(t.as_py(), least):
                ids.append(i)
                at.append(pos)
                keys.append(h.to_bytes(16, "little"))
        raw = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        keep = np.ones(len(raw), bool)
        if filters is not None:
            keep[:] = False
            shard = raw[:, 1] % shards
            for s, slots in filters.items():
                own = np.flatnonzero(shard == s)
                probe = CuckooFilter(0, np.frombuffer(slots, np.uint16).reshape(-1, SLOTS))
                keep[own] = probe.has(np.ascontiguousarray(raw[own, 0]).view(np.uint64))
        columns = [np.array(ids, np.int64)[keep], np.array(at, np.int32)[keep], raw[keep, 0], raw[keep, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "pos", "h1", "h2"])

    return map_batches(docs.where("doc_id is not null").select("doc_id", text_of(docs).alias("text")), run, "doc_id long, pos int, h1 long, h2 long")


def probed_by_shard(lines: DataFrame, filters: DataFrame, shards: int, salts: int = SALTS) -> DataFrame:
    """The lines that the filters (shard, slots) let through, where the filters are too many to be
    sent about: each shard's filter goes to ``salts`` tasks, ahead of their lines, which stream by."""
    salted = lines.select("*", F.pmod("h2", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "pos"), F.lit(salts)).cast("int").alias("salt"), F.lit(None).cast("binary").alias("slots"))
    ahead = filters.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in lines.schema), "shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "slots")
    both = salted.unionByName(ahead).repartition(shards * salts, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("slots").isNull())
    names = lines.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, own = None, None
        for batch in batches:
            shard, salt = batch.column("shard").to_numpy(), batch.column("salt").to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            edge = np.flatnonzero((shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
                slots = batch.column("slots")[a]
                if slots.is_valid:
                    probe, own = CuckooFilter(0, np.frombuffer(slots.as_py(), np.uint16).reshape(-1, SLOTS)), (shard[a], salt[a])
                    a += 1
                if a < b and own == (shard[a], salt[a]):
                    keep[a:b] = probe.has(batch.column("h1").slice(a, b - a).to_numpy().view(np.uint64))
            yield batch.select(names).filter(pa.array(keep))

    return both.mapInArrow(run, lines.schema)


def drops(docs: DataFrame, counts: DataFrame | None = None, least: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, dropped array<int>: the numbers of the lines that go."""
    spark = docs.sparkSession
    python_batches(spark)
    counts = document_counts(docs, least) if counts is None else counts
    repeated = cut(counts.where(F.col("n_docs") >= min_docs), "line-keys")
    size = repeated.agg(F.count("*").alias("keys"), F.sum("n_docs").alias("postings")).first()
    n_keys, shards = size["keys"], max(1, -(-size["keys"] // SHARD_KEYS))
    filters = shard_filters(repeated, n_keys)
    if n_keys * 2 * SLOTS <= FILTER_BYTES:  # 2 bytes a slot, at most 4 slots a key at the usual load
        lines = marked_lines(docs, {r["shard"]: bytes(r["slots"]) for r in filters.collect()}, shards, least)
    else:
        lines = probed_by_shard(marked_lines(docs, None, shards, least), cut(filters, "line-filters"), shards)
    keys = repeated.select("h1", "h2", "max_doc", "n_docs")
    if n_keys <= BROADCAST_KEYS:
        hit = lines.join(F.broadcast(keys), ["h1", "h2"])
    else:
        hot = keys.where(F.col("n_docs") * BROADCAST_KEYS >= size["postings"])
        lines = cut(lines.join(F.broadcast(hot), ["h1", "h2"], "left"), "line-hits")
        cold = lines.where("max_doc is null").drop("max_doc", "n_docs").join(keys, ["h1", "h2"])
        hit = lines.where("max_doc is not null").unionByName(cold)
    return hit.where(F.col("doc_id") != F.col("max_doc")).groupBy("doc_id").agg(F.collect_set("pos").alias("dropped"))


def dedup_lines(docs: DataFrame, counts: DataFrame | None = None, least: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` freed of repeated lines, and ``n_lines``, ``n_dropped``.

    A key of at least ``least`` code points in ``min_docs`` documents stays only where doc_id is the
    largest that holds it. Null and empty texts are one empty line and stay empty (null becomes
    empty). Rows with equal doc_id are one document and are treated alike; rows without doc_id are
    none: they count for nothing and lose nothing. Other columns pass, whatever their names; own
    columns called n_lines or n_dropped are replaced."""
    gone = cut(drops(docs, counts, least, min_docs), "line-drops")
    few = (gone.agg(F.sum(F.size("dropped"))).first()[0] or 0) <= BROADCAST_LINES
    ident, dropped, lines, kept = fresh(docs, "ident", "dropped", "lines", "kept")
    gone = gone.select(F.col("doc_id").alias(ident), F.col("dropped").alias(dropped))
    out = docs.withColumn("text", text_of(docs)).join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col(ident), "left")
    out = out.withColumn(lines, F.split("text", "\n", -1))
    stay = F.filter(lines, lambda x, i: ~F.array_contains(F.col(dropped), i))
    out = out.withColumn(kept, F.when(F.col(dropped).isNull(), F.col(lines)).otherwise(stay))
    out = out.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": (F.size(lines) - F.size(kept)).cast("long"), "text": F.array_join(kept, "\n")})
    return out.drop(ident, dropped, lines, kept)


class LineIndex:
    """Reference counts and cuckoo filters that follow insertions and deletions of documents.

    ``folder`` (shared storage) holds an append-only log of postings with a sign, and versions of
    the filters, one row a shard. A filter holds the keys that some live document has: it tells
    most new lines apart without a look at the log. Deleting a document appends its postings with
    -1 and takes the keys that no document holds any more out of the filters, so every earlier
    state can be had again."""

    def __init__(self, spark: SparkSession, folder: str, shards: int = 8) -> None:
        self.spark, self.folder, self.shards = spark, folder, shards
        self.version = 0

    def _log(self) -> DataFrame:
        return self.spark.read.schema("doc_id long, h1 long, h2 long, sign int").parquet(f"{self.folder}/log")

    def filters(self) -> DataFrame:
        """shard, slots of the present version."""
        kind = "shard int, slots binary"
        if not self.version:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(f"{self.folder}/filters-{self.version}")

    def live(self) -> DataFrame:
        total = self._log().groupBy("doc_id", "h1", "h2").agg(F.sum("sign").alias("n"))
        return total.where("n > 0").drop("n")

    def _by_shard(self, keys: DataFrame) -> DataFrame:
        return keys.select("h1", "h2", F.pmod("h2", F.lit(self.shards)).cast("int").alias("shard"))

    def _change(self, keys: DataFrame, add: bool) -> None:
        """Write the next version of the filters, with the keys (distinct) put in or taken out. A
        filter that is full is made anew, twice as large, from the live keys of its shard."""

        def run(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            made = CuckooFilter(0, np.frombuffer(old["slots"].iloc[0], np.uint16).reshape(-1, SLOTS).copy()) if len(old) else CuckooFilter(16)
            full = False
            for h in new["h1"].to_numpy(np.int64).view(np.uint64) if len(new) else ():
                if not add:
                    made.remove(int(h))
                elif not made.add(int(h)):
                    full = True
                    break
            return pd.DataFrame({"shard": [key[0]], "slots": [made.table.tobytes()], "full": [full]})

        out = self.filters().groupBy("shard").cogroup(self._by_shard(keys).groupBy("shard")).applyInPandas(run, "shard int, slots binary, full boolean")
        out = cut(out, "line-filters")
        full = out.where("full").select("shard")
        if add and not full.isEmpty():
            every = keys if not self.version else keys.unionByName(self.live().select("h1", "h2").distinct())
            again = self._by_shard(every).join(F.broadcast(full), "shard").groupBy("shard").applyInPandas(_made, "shard int, slots binary")
            out = out.where("not full").drop("full").unionByName(again)
        out.select("shard", "slots").write.parquet(f"{self.folder}/filters-{self.version + 1}")
        self.version += 1

    def known(self, keys: DataFrame) -> DataFrame:
        """The keys (h1, h2) that a live document holds: the filters first, the log for the rest."""
        lines = keys.select("h1", "h2").distinct().select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("pos"), "h1", "h2")
        maybe = probed_by_shard(lines, self.filters(), self.shards, 1).select("h1", "h2")
        return maybe.join(self.live().select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")

    def insert(self, docs: DataFrame) -> None:
        posted = cut(postings(docs).where("doc_id is not null").distinct(), "line-inserts")
        keys = posted.select("h1", "h2").distinct()
        if self.version:
            posted = posted.join(self.live(), ["doc_id", "h1", "h2"], "left_anti")
            keys = keys.join(self.known(keys), ["h1", "h2"], "left_anti")
        posted, keys = cut(posted, "line-inserts"), cut(keys, "line-new-keys")
        self._change(keys, True)
        posted.withColumn("sign", F.lit(1)).write.mode("append").parquet(f"{self.folder}/log")

    def delete(self, ids: DataFrame) -> None:
        """``ids`` has doc_id; unknown ids change nothing."""
        gone = cut(self.live().join(ids.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("sign", F.lit(-1)), "line-deletes")
        gone.write.mode("append").parquet(f"{self.folder}/log")
        left = self.live().select("h1", "h2").distinct()
        self._change(cut(gone.select("h1", "h2").distinct().join(left, ["h1", "h2"], "left_anti"), "line-dead-keys"), False)

    def counts(self) -> DataFrame:
        return reference_counts(self.live())
