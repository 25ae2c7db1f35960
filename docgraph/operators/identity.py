"""Page identity: a unique, readable id for every path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgraph.functions import text as T
from docgraph.operators.order import free_numbers, numbered
from docgraph.sources.shared import cut

#: Ids that the catalog's own files have.
RESERVED = ("index", "llms", "agents", "graph")


def assign(pages: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """pages (name, path) with id, independent of their order.

    While several pages share an id and don't lie in one folder, they take one more folder in front; then all but
    the strictly least (source rank, number of dots) add the file's kind; pages that still share an id are numbered by
    path: the first keeps the id, unless it is reserved or taken, the others take the least numbers from 2 on that no
    page's id has. Shares are told by aggregates joined back, numbers by ranges: no group of pages has to fit into one task.

    A null name or path counts as an empty one; of pages that share a path and an id it is open which takes which number."""
    spark = pages.sparkSession
    parts = F.split(F.coalesce("path", F.lit("")), "/")
    rows = pages.withColumn("__path", F.coalesce("path", F.lit(""))).withColumn("__rank", T.source_rank("__path")).withColumn("id", T.slugify(F.coalesce("name", F.lit(""))))
    rows = cut(rows.withColumn("__dirs", F.slice(parts, 1, F.size(parts) - 1)).withColumn("__deep", F.lit(0)))
    while True:
        rows = rows.withColumn("__next", F.when(F.size("__dirs") > F.col("__deep"), F.element_at("__dirs", -(F.col("__deep") + 1))))
        apart = rows.groupBy("id").agg(F.min("__dirs").alias("__a"), F.max("__dirs").alias("__z")).filter("__a <> __z").select("id", F.lit(True).alias("__apart"))
        move = F.coalesce("__apart", F.lit(False)) & F.col("__next").isNotNull()
        rows = rows.join(apart, "id", "left").withColumn("__move", move).drop("__apart")
        rows = cut(rows.withColumn("id", F.when(F.col("__move"), F.concat(T.slugify("__next"), F.lit("_"), F.col("id"))).otherwise(F.col("id"))).withColumn("__deep", F.col("__deep") + F.col("__move").cast("int")))
        if rows.filter("__move").isEmpty():
            break
    # the file's kind, but not for the strict winner
    dotted = F.split(T.basename("__path"), r"\.")
    rows = rows.withColumn("__kind", F.struct("__rank", (F.size(F.split("__path", r"\.")) - 1).alias("dots")))
    counts = rows.groupBy("id", "__kind").agg(F.count("*").alias("__same"))
    least = counts.groupBy("id").agg(F.sum("__same").alias("__n"), F.min(F.struct("__kind", "__same")).alias("__least")).filter("__n > 1")
    ext = F.regexp_replace(T.slugify(F.concat_ws("_", F.lit("x"), F.slice(dotted, 2, F.greatest(F.size(dotted) - 1, F.lit(0))).cast("string"))), "^x_|^x$", "")
    wins = F.col("__n").isNull() | ((F.col("__kind") == F.col("__least.__kind")) & (F.col("__least.__same") == 1))
    rows = rows.join(least, "id", "left").withColumn("id", F.when(~wins & (ext != ""), F.concat("id", F.lit("_"), ext)).otherwise(F.col("id")))
    rows = cut(rows.drop("__n", "__least"))
    # numbers by path; taken and reserved ids count as claimed
    claimed = spark.createDataFrame([(r,) for r in RESERVED], "id string")
    if taken is not None:
        claimed = claimed.unionByName(taken.select("id")).distinct()
    shared = rows.groupBy("id").agg(F.count("*").alias("__n")).join(claimed.withColumn("__c", F.lit(True)), "id", "left").filter("__n > 1 or __c").select("id", F.coalesce("__c", F.lit(False)).alias("__c"))
    settled = rows.join(shared, "id", "left_anti")
    several = rows.join(shared, "id")
    order = [F.col("__path"), F.xxhash64(*pages.columns)]
    # the first of an id that nobody else has claimed keeps it
    placed = numbered(several, ["id"], order, "__nth").withColumn("__stays", (F.col("__nth") == 1) & ~F.col("__c"))
    number = F.regexp_extract("id", "^(.*)_([2-9]|[1-9][0-9]+)$", 2)
    held = rows.select("id").unionByName(claimed).distinct().filter(number != "").select(F.regexp_extract("id", "^(.*)_([0-9]+)$", 1).alias("id"), number.try_cast("long").alias("number")).filter("number is not null")
    rest = free_numbers(placed.filter("not __stays"), ["id"], [F.col("__nth")], held, 2, "__number")
    rest = rest.withColumn("id", F.concat("id", F.lit("_"), F.col("__number").cast("string")))
    columns = [*pages.columns, "id"]
    return settled.select(columns).unionByName(placed.filter("__stays").select(columns)).unionByName(rest.select(columns))


def ordinals(rows: DataFrame, slug: str, order: list[str]) -> DataFrame:
    """rows with id: the slug for the first of each, slug_2, slug_3, ... for the rest in order."""
    rn = F.row_number().over(W.partitionBy(slug).orderBy(*order))
    return rows.withColumn("id", F.when(rn == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("_"), rn.cast("string"))))


def remap_reserved(rows: DataFrame, id_: str = "id") -> DataFrame:
    """rows whose reserved ids take _page, or _page_2, _page_3, ... where that is taken, in order of id."""
    target = F.concat(F.col(id_), F.lit("_page"))
    odd = F.col(id_).isin(*RESERVED)
    taken = rows.filter(~odd).select(F.regexp_extract(id_, r"^(.*_page)(?:_([0-9]+))?$", 1).alias("__t"), F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(`{id_}`, '_page_([0-9]+)$', 1), '') as int)"), F.lit(1)).alias("__n")).filter("__t <> ''")
    held = taken.groupBy("__t").agg(F.collect_set("__n").alias("__held"))
    rows = rows.withColumn("__t", F.when(odd, target)).join(F.broadcast(held.filter(F.col("__t").isin(*[f"{r}_page" for r in RESERVED]))), "__t", "left")  # a row for each reserved id
    nth = F.row_number().over(W.partitionBy("__t").orderBy(id_))
    free = F.filter(F.sequence(F.lit(1), F.size(F.coalesce("__held", F.array().cast("array<int>"))) + nth), lambda k: ~F.array_contains(F.coalesce("__held", F.array().cast("array<int>")), k))
    n = F.get(free, nth - 1)
    new = F.when(n == 1, F.col("__t")).otherwise(F.concat("__t", F.lit("_"), n.cast("string")))
    return rows.withColumn("__new", F.when(F.col("__t").isNotNull(), new).otherwise(F.col(id_))).drop("__t", "__held", id_).withColumnRenamed("__new", id_)
