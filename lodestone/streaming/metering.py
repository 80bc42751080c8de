"""Streaming: daily metering, token buckets, idempotent ingest.

Late rows: metering keeps a day open for the watermark, later rows are left out; a token bucket
takes rows of a micro-batch in time order and never goes back in time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_usage(events: DataFrame, tenant: str = "user_id", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """tenant, day, n: a streaming (or batch) sum by day."""
    d = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = d.groupBy(F.col(tenant).alias("tenant"), F.window("_ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return out.select("tenant", F.to_date("w.start").alias("day"), "n")


def take(level: float, last: float, now: float, rate: float, cap: float, cost: float) -> tuple[bool, float, float]:
    """One request at a bucket: refill by the time passed, then spend if there is enough."""
    level = min(cap, level + max(0.0, now - last) * rate)
    last = max(last, now)
    return (True, level - cost, last) if level >= cost else (False, level, last)


def token_bucket(events: DataFrame, rate: float, cap: float, cost: float = 1.0, tenant: str = "user_id", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """key, tenant, accepted for each request of a stream; state per tenant is two numbers."""

    def run(who: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["t", "k"])
        level, last = state.get if state.exists else (cap, float(rows["t"].iloc[0]))
        out = []
        for t, k in zip(rows["t"], rows["k"], strict=True):
            ok, level, last = take(level, last, t, rate, cap, cost)
            out.append((k, who[0], ok))
        state.update((level, last))
        yield pd.DataFrame(out, columns=["k", "tenant", "accepted"])

    d = events.select(F.col(tenant).alias("tenant"), F.unix_micros(F.col(ts).cast("timestamp")).cast("double").alias("us"), F.col(key).alias("k")).withColumn("t", F.col("us") / 1e6)
    return d.groupBy("tenant").applyInPandasWithState(run, "k long, tenant long, accepted boolean", "level double, last double", "append", "NoTimeout")


def token_bucket_batch(events: DataFrame, rate: float, cap: float, cost: float = 1.0, tenant: str = "user_id", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """The same over a table: rows of a tenant are read in order, batch by batch, with the state
    carried, so a large tenant is never in memory at once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, level, last = None, cap, 0.0
        for pdf in frames:
            out = []
            for w, t, k in zip(pdf["tenant"], pdf["t"], pdf["k"], strict=True):
                if w != who:
                    who, level, last = w, cap, t
                ok, level, last = take(level, last, t, rate, cap, cost)
                out.append((k, w, ok))
            yield pd.DataFrame(out, columns=["k", "tenant", "accepted"])

    d = events.select(F.col(tenant).alias("tenant"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"), F.col(key).alias("k"))
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(n, "tenant").sortWithinPartitions("tenant", "t", "k").mapInPandas(run, "k long, tenant long, accepted boolean")


def stored(spark: SparkSession, path: str) -> bool:
    """Whether a folder has a table, in any store that Spark can reach."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.exists(place) and any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(place))


def next_rounds(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """path, hash, round of sources (path, hash) that are new or changed since their last round
    (manifest: path, hash, round): each goes to the round after the latest of all; frozen rounds are
    never written again."""
    last = manifest.groupBy("path").agg(F.max_by("hash", "round").alias("_h"))
    number = F.coalesce(F.max(F.substring("round", 2, 9).cast("int")), F.lit(0)) + 1
    following = manifest.agg(F.concat(F.lit("r"), F.lpad(number.cast("string"), 3, "0")).alias("round"))
    changed = present.join(last, "path", "left").where(~F.col("hash").eqNullSafe(F.col("_h"))).drop("_h")
    return changed.join(F.broadcast(following))  # one row


def ingest_once(stream: DataFrame, path: str, checkpoint: str, key: str = "doc_id"):
    """Append documents whose (key, hash) is not stored yet; a repeated batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        hashed = batch.withColumn("h", F.sha2("text", 256)).dropDuplicates([key, "h"])
        if stored(spark, path):  # the first batch has nothing to compare with
            hashed = hashed.join(spark.read.parquet(path).select(key, "h"), [key, "h"], "left_anti")
        hashed.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
