"""A made-up corpus of linked pages from a seed, for tests of scale and determinism."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOPICS = ("storage", "indexing", "ranking", "parsing", "caching", "routing", "sharding", "scheduling", "logging", "tracing", "testing", "packaging")


def generate(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """n pages (path, content): a title, often a date and aliases, one to three sentences that name other topics.

    Every page draws from a hash of the seed and its own number, so that partitions make them alone."""
    draw = lambda k, m: F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(k)), F.lit(m)).cast("int")
    topics = F.array(*map(F.lit, TOPICS))
    title = F.concat(F.initcap(topics[F.col("id").cast("int") % len(TOPICS)]), F.when(F.col("id") >= len(TOPICS), F.concat(F.lit(" v"), (F.col("id").cast("int") / len(TOPICS)).cast("int") + 1)).otherwise(""))
    links = F.transform(F.sequence(F.lit(0), draw("links", 3)), lambda k: F.concat(F.lit("See also "), topics[F.pmod(F.xxhash64(F.lit(seed), "id", k), F.lit(len(TOPICS))).cast("int")], F.lit(".")))
    day = F.date_format(F.date_add(F.to_date(F.lit("2020-01-01")), draw("day", 2000)), "yyyy-MM-dd")
    head = F.when(draw("created", 10) < 7, F.concat(F.lit("created: "), day, F.lit("\n"))).otherwise("")
    alias = F.when(draw("alias", 10) < 4, F.concat(F.lit("aliases: "), F.lower(title), F.lit(" notes\n"))).otherwise("")
    rows = spark.range(n).select(F.format_string("topics/%05d.txt", "id").alias("path"), F.concat(F.lit("# "), title, F.lit("\n"), head, alias, F.array_join(links, " "), F.lit("\n")).alias("content"))
    return rows
