"""Outlines under a budget: for each page the least cut that fits, told by what it drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.operators.order import running_total
from docgraph.sources.shared import cut

#: What goes first, second and third.
DROPPED = ("test items", "docs", "imports")


def _tokens(chars: Column) -> Column:
    return F.floor(chars / 4)


def _marker(parts: Column, total: Column) -> Column:
    return F.concat(F.lit("… "), F.array_join(parts, "; "), F.lit(" — pass max_tokens: "), total.cast("string"), F.lit(" for all\n"))


def cuts(lines: DataFrame, most: int) -> DataFrame:
    """(page, level, shown, tokens, marker): how an outline of each page is cut to `most` tokens.

    lines: page, at (unique in a page), kind (head, import or item), test, size and doc_size (characters of the line, and of the doc on
    it). Levels: 0 as it is; then without test items (unless there are only those), docs and imports, as far as it takes; 4: what
    is left, up to the last item that fits, naming how many more there are; heads always stay, and so do the first item and the
    marker. A level that drops nothing is passed over. All totals are sums a page; only pages that need it take a running total of their lines."""
    test, item = F.coalesce("test", F.lit(False)), F.col("kind") == "item"
    size, doc = F.coalesce("size", F.lit(0)), F.coalesce("doc_size", F.lit(0))
    total = lambda c, w: F.coalesce(F.sum(F.when(w, c)), F.lit(0))
    sums = lines.groupBy("page").agg(
        total(size, ~item & (F.col("kind") != "import")).alias("head"), total(size, F.col("kind") == "import").alias("imports"), F.count_if(F.col("kind") == "import").alias("n_imports"),
        total(size, item & ~test).alias("plain"), total(size, item & test).alias("tests"), F.count_if(item & test).alias("n_tests"), F.count_if(item).alias("n_items"),
        total(doc, item & ~test).alias("plain_docs"), total(doc, item & test).alias("test_docs"), F.count_if(item & ~test & (doc > 0)).alias("n_plain_docs"), F.count_if(item & test & (doc > 0)).alias("n_test_docs"),
    )
    only = F.col("n_tests") == F.col("n_items")
    sums = sums.withColumn("only", only).withColumn("all", F.col("head") + F.col("imports") + F.col("plain") + F.col("tests") + F.col("plain_docs") + F.col("test_docs")).withColumn("whole", _tokens(F.col("all")))
    # what each level takes away, if anything, and what is there then
    gone = [F.when(~F.col("only"), F.col("n_tests")).otherwise(0), F.when(F.col("only"), F.col("n_test_docs")).otherwise(F.col("n_plain_docs")), F.col("n_imports")]
    less = [F.when(~F.col("only"), F.col("tests") + F.col("test_docs")).otherwise(0), F.when(F.col("only"), F.col("test_docs")).otherwise(F.col("plain_docs")), F.col("imports")]
    left, said = F.col("all"), F.array().cast("array<string>")
    choice = F.when(F.col("whole") <= most, F.struct(F.lit(0).alias("level"), F.col("all").alias("chars"), F.lit("").alias("marker")))
    for k in range(3):
        left = left - less[k]
        said = F.concat(said, F.when(gone[k] > 0, F.array(F.concat(gone[k].cast("string"), F.lit(f" {DROPPED[k]}")))).otherwise(F.array().cast("array<string>")))
        marker = _marker(F.array(F.concat(F.lit("dropped: "), F.array_join(said, ", "))), F.col("whole"))
        choice = choice.when((gone[k] > 0) & (_tokens(left + F.length(marker)) <= most), F.struct(F.lit(k + 1).alias("level"), left.alias("chars"), marker.alias("marker")))
    pages = cut(sums.withColumn("c", choice).withColumn("said", said))
    done = pages.filter("c is not null").select("page", F.col("c.level").alias("level"), F.when(F.col("c.level") == 0, F.col("n_items")).otherwise(F.when(F.col("only"), F.col("n_items")).otherwise(F.col("n_items") - F.col("n_tests"))).alias("shown"), _tokens(F.col("c.chars") + F.length("c.marker")).alias("tokens"), F.col("c.marker").alias("marker"))
    rest = pages.filter("c is null").select("page", "head", "only", "whole", "said", F.when(F.col("only"), F.col("n_items")).otherwise(F.col("n_items") - F.col("n_tests")).alias("n"))
    items = lines.filter(item).join(rest, "page").filter(F.col("only") | ~test).select("page", "at", size.alias("size"), "head", "whole", "said", "n")
    upto = running_total(running_total(items, ["page"], [F.col("at")], F.lit(1).cast("long"), "nth"), ["page"], [F.col("at")], size.cast("long"), "used")
    # cut before an item, whose line the marker names; the first line of all that is left out
    head = F.concat_ws("", F.when(F.size("said") > 0, F.concat(F.lit("dropped: "), F.array_join("said", ", "))))
    more = F.concat((F.col("n") - F.col("nth") + 1).cast("string"), F.lit(" more items from line "), F.col("at").cast("string"))
    marker = _marker(F.filter(F.array(head, more), lambda p: p != ""), F.col("whole"))
    tried = upto.withColumn("marker", marker).withColumn("tokens", _tokens(F.col("head") + F.col("used") - F.col("size") + F.length("marker"))).withColumn("before", F.col("nth") - 1)
    best = tried.filter((F.col("tokens") <= most) | (F.col("before") == 0)).groupBy("page").agg(F.max(F.struct(F.col("before").alias("shown"), "tokens", "marker")).alias("x"))
    cut_off = best.select("page", F.lit(4).alias("level"), "x.shown", "x.tokens", "x.marker")
    bare = rest.filter("n = 0").select("page", F.lit(4).alias("level"), F.lit(0).cast("long").alias("shown"), _tokens(F.col("head") + F.length(_marker(F.array(head), F.col("whole")))).alias("tokens"), _marker(F.array(head), F.col("whole")).alias("marker"))
    return done.unionByName(cut_off).unionByName(bare)
