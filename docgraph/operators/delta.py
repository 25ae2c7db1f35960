"""A catalog kept up to date: what changed between two sets of pages, and what of the catalog that touches.

Tables of a store (sources/store.py): pages (id, path, title, body, mark), links (id, targets: paths a page links to, whether or
not there is a page) and rendered (id, title, path, body, linked, linking, fingerprint, owner). A build compares marks, reads the
links of changed pages alone, and renders again only pages that changed or whose neighbours came, went, moved or took
another title. Of these, rows are written only where what they show differs. Rows of another owner are never
written over or taken away.

Edge cases: null titles, paths and bodies are texts of their own (not empty ones) when they change, and empty when shown; of pages
that share a path links mean the largest id; ids are taken to be distinct; an empty set of pages takes all own rows away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.functions import text as T
from docgraph.operators import graph
from docgraph.sources.shared import cut
from docgraph.sources.store import Store

KEYS = {"pages": "id", "links": "id", "rendered": "id"}
OWNER = "catalog"


def _marked(pages: DataFrame) -> DataFrame:
    # to_json tells null from empty
    return pages.select("id", "path", "title", "body").withColumn("mark", F.sha2(F.to_json(F.struct("path", "title", "body"), {"ignoreNullFields": "false"}), 256))


def _links(pages: DataFrame) -> DataFrame:
    """(id, targets) of pages; a page without links has none."""
    found = graph.links(pages, keep=("id",)).groupBy("id").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    return pages.select("id").join(found, "id", "left").select("id", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))


def _at(pages: DataFrame) -> DataFrame:
    """(target, dst, named): the page that a path means."""
    return pages.filter("path is not null").groupBy(F.col("path").alias("target")).agg(F.max(F.struct("id", F.coalesce("title", F.lit("")).alias("title"))).alias("x")).select("target", F.col("x.id").alias("dst"), F.col("x.title").alias("named"))


def rendered(pages: DataFrame, links: DataFrame, ids: DataFrame | None = None, owner: str = OWNER) -> DataFrame:
    """What the catalog shows of pages (of `ids` alone): text, titles that it links to and that link to it."""
    some = pages if ids is None else pages.join(ids, "id", "left_semi")
    at = _at(pages)
    edges = links.select(F.col("id").alias("src"), F.explode("targets").alias("target"))
    out_edges = edges if ids is None else edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    # only paths of the pages shown are of interest as targets
    in_edges = edges if ids is None else edges.join(some.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    linked = out_edges.join(at, "target").filter("src <> dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("named")).alias("linked"))
    titles = pages.select(F.col("id").alias("src"), F.coalesce("title", F.lit("")).alias("from"))
    linking = in_edges.join(at, "target").filter("src <> dst").join(titles, "src").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("from")).alias("linking"))
    none = F.array().cast("array<string>")
    rows = some.join(linked, "id", "left").join(linking, "id", "left")
    rows = rows.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "path", "body")], F.coalesce("linked", none).alias("linked"), F.coalesce("linking", none).alias("linking"))
    shown = [F.col("title"), F.col("path"), F.col("body"), F.to_json("linked"), F.to_json("linking")]
    return rows.withColumn("fingerprint", T.fingerprint(*shown)).withColumn("owner", F.lit(owner))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, was, now, old_path, new_path, moved) of pages (with mark) that came, went or differ; moved: others see it."""
    a = old.select("id", F.lit(True).alias("was"), F.col("path").alias("old_path"), F.col("title").alias("old_title"), F.col("mark").alias("old_mark"))
    b = new.select("id", F.lit(True).alias("now"), F.col("path").alias("new_path"), F.col("title").alias("new_title"), F.col("mark").alias("new_mark"))
    rows = a.join(b, "id", "full").filter(~F.col("old_mark").eqNullSafe(F.col("new_mark")))
    moved = ~F.col("was").eqNullSafe(F.col("now")) | ~F.col("old_path").eqNullSafe(F.col("new_path")) | ~F.col("old_title").eqNullSafe(F.col("new_title"))
    return rows.select("id", F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("now", F.lit(False)).alias("now"), "old_path", "new_path", moved.alias("moved"))


def build(store: Store, pages: DataFrame, owner: str = OWNER) -> dict[str, int]:
    """Bring a store's catalog to a set of pages (id, path, title, body); gives the rows written of each table."""
    new = cut(_marked(pages))
    old_pages, old_links, shown = (store.read(t) for t in ("pages", "links", "rendered"))
    no = F.lit(False)
    if old_pages is None or old_links is None:
        links = cut(_links(new))
        full = {"pages": new, "links": links, "rendered": rendered(new, links, owner=owner)}
        if shown is not None:  # others' rows
            full["rendered"] = full["rendered"].join(shown.select("id"), "id", "left_anti")
        return store.written(store.commit({t: r.withColumn("gone", no) for t, r in full.items()}))
    changed = cut(changes(old_pages, new))
    gone = changed.filter("not now").select("id")
    again = new.join(changed.filter("now").select("id"), "id", "left_semi")
    new_links = cut(_links(again))
    links = cut(old_links.join(changed.select("id"), "id", "left_anti").unionByName(new_links))
    # pages that link to a path where something came, went, moved or took another title ...
    paths = changed.filter("moved").select(F.explode(F.array("old_path", "new_path")).alias("target")).filter("target is not null").distinct()
    edges = links.select("id", F.explode("targets").alias("target"))
    touched = edges.join(paths, "target", "left_semi").select("id")
    # ... pages at these paths, as another may stand there now, and pages that changed ones link to or linked to
    before = old_links.join(changed.select("id"), "id", "left_semi").select(F.explode("targets").alias("target"))
    near = before.unionByName(new_links.select(F.explode("targets").alias("target"))).unionByName(paths).distinct()
    beside = new.join(near, F.col("path") == F.col("target"), "left_semi").select("id")
    affected = cut(changed.filter("now").select("id").unionByName(touched).unionByName(beside).distinct().join(new.select("id"), "id", "left_semi"))
    made = rendered(new, links, affected, owner)
    if shown is None:
        shown = made.limit(0)
    others = shown.filter(F.col("owner") != owner).select("id")
    prior = shown.filter(F.col("owner") == owner).select("id", F.col("fingerprint").alias("prior"))
    differs = made.join(others, "id", "left_anti").join(prior, "id", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("prior"))).drop("prior")
    stale = shown.filter(F.col("owner") == owner).join(gone, "id", "left_semi")
    delta = {
        "pages": again.withColumn("gone", no).unionByName(old_pages.join(gone, "id", "left_semi").withColumn("gone", ~no)),
        "links": new_links.withColumn("gone", no).unionByName(old_links.join(gone, "id", "left_semi").withColumn("gone", ~no)),
        "rendered": differs.withColumn("gone", no).unionByName(stale.withColumn("gone", ~no)),
    }
    return store.written(store.commit(delta))
