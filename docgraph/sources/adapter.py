"""The driver's tables as inputs of the operators: pages, notes, items, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages (id, path, title, kind, tags, body)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"),
        F.concat_ws("/", F.lit("docs"), F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"),
        F.lit("text").alias("kind"),
        F.array(F.coalesce("lang", F.lit("none")), F.concat(F.lit("src/"), F.coalesce("source", F.lit("none")))).alias("tags"),
        F.col("text").alias("body"),
    )


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as Markdown pages (path, text), turns as sections."""
    c = table(spark, sf_dir, "conversations")
    section = F.concat(F.lit("## "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", section.alias("s")))), lambda x: x["s"]), "\n\n").alias("text")).select(F.concat(F.lit("chats/conv_"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), "text")


def places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (src, dst): customers and suppliers to nations to regions."""
    c, s, n, r = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = c.select(key("c", "c_custkey").alias("id")).unionByName(s.select(key("s", "s_suppkey").alias("id"))).unionByName(n.select(key("n", "n_nationkey").alias("id"))).unionByName(r.select(key("r", "r_regionkey").alias("id")))
    edges = c.select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst")).unionByName(s.select(key("s", "s_suppkey").alias("src"), key("n", "s_nationkey").alias("dst"))).unionByName(n.select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst")))
    return nodes, edges


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as calls (src, dst): each type and the next one of the same user."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    nxt = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("event_type").alias("src"), nxt.alias("dst")).filter("dst is not null").distinct()
