"""Streams: debounced sessions, and pages kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docgraph.functions import text as T


def sessions(events: DataFrame, at: str, keys: list[str], gap: str) -> DataFrame:
    """keys, started, ended, n: runs of events with less than `gap` between them. Works on streams with a watermark too."""
    time = F.col(at).cast("timestamp")
    rows = events.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    kind = events.schema[at].dataType
    return rows.select(*keys, F.col("w.start").cast(kind).alias("started"), F.col("w.end").cast(kind).alias("ended"), "n")


def debounced(changes: DataFrame, at: str = "ts", key: str = "path", gap: str = "150 milliseconds", late: str = "10 seconds") -> DataFrame:
    """A stream of changes as one row for each quiet period of a path."""
    return sessions(changes.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late), at, [key], gap)


def capped(rows: DataFrame, at: str, keys: list[str], gap_s: float, most_s: float) -> DataFrame:
    """Batches of a table of changes: a batch ends after `gap_s` of quiet, or `most_s` after its first change.

    Sessions by gap come first; a long one is cut by folding its times, as each cut depends on the one before."""
    time = F.col(at).cast("timestamp").cast("double")
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(at)
    new = F.coalesce(time - F.lag(time).over(w) > gap_s, F.lit(True)).cast("int")
    rows = rows.withColumn("__s", F.sum(new).over(w)).groupBy(*keys, "__s").agg(F.array_sort(F.collect_list(time)).alias("t"))
    start = F.struct(F.col("t")[0].alias("first"), F.filter("t", lambda x: F.lit(False)).alias("firsts"))
    fold = F.aggregate("t", start, lambda s, x: F.when((F.size(s["firsts"]) == 0) | (x - s["first"] > most_s), F.struct(x.alias("first"), F.concat(s["firsts"], F.array(x)).alias("firsts"))).otherwise(s))
    return rows.select(*keys, "t", F.explode(fold["firsts"]).alias("started")).select(*keys, "started", F.size(F.filter("t", lambda x: (x >= F.col("started")) & (x - F.col("started") <= most_s))).alias("n"))


def keep_current(stream: DataFrame, path: str, checkpoint: str, key: str = "path", columns: list[str] = ("body",)) -> StreamingQuery:
    """Follow a stream of page versions (key, version, columns): after each batch `path` holds every page's latest one.

    Each batch is written as a new folder, named by its number; a batch that runs again writes the same folder, and
    `current` picks the latest version of each key, so a failure in between loses and repeats nothing."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct("version", *columns), "version").alias("x")).select(key, "x.*")
        last.withColumn("fingerprint", T.fingerprint(*map(F.col, columns))).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, path: str, key: str = "path") -> DataFrame:
    rows = spark.read.parquet(path)
    names = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "version").alias("x")).select(key, "x.*")
