"""Queries on code, flows and generated pages. Their inputs are fixtures, so their SQL lists the rows expected of those."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgraph.functions import text as T
from docgraph.operators import extract as E
from docgraph.operators import flow as L
from docgraph.operators import graph as G
from docgraph.operators import identity as I
from docgraph.operators import resolve as R
from docgraph.plans.fixture_rows import ROWS
from docgraph.sources import files as S
from docgraph.sources import fixture
from docgraph.sources.generator import generate


def _files(spark):
    return S.scripts(fixture.files(spark))


def _items(files):
    return E.items(files).select("page_id", F.col("ix").cast("long").alias("ix"), "kind", "name", "owner", "signature", F.col("start_line").cast("long").alias("start"), F.col("end_line").cast("long").alias("end"), "doc", "public", F.col("least").cast("long").alias("least"), F.col("most").cast("long").alias("most"), "receiver")


def _calls(files):
    return E.calls(files).select("page_id", F.col("caller_ix").cast("long").alias("caller"), "name", "via", "qual", F.col("args").cast("long").alias("args"), F.col("line").cast("long").alias("line"))


def code_items(spark, sf):
    return _items(_files(spark))


def code_calls(spark, sf):
    return _calls(_files(spark))


def cpp_items(spark, sf):
    return _items(fixture.cpp_files(spark))


def cpp_calls(spark, sf):
    return _calls(fixture.cpp_files(spark))


def cpp_includes(spark, sf):
    return _edges(fixture.cpp_files(spark))


def cpp_pairs(spark, sf):
    """Declarations in headers with the definitions of the same owner, name and number of parameters, where both are single."""
    items = E.items(fixture.cpp_files(spark)).filter("kind in ('fn', 'method')").select(F.concat_ws("#", "page_id", F.col("ix").cast("string")).alias("id"), "page_id", F.coalesce(T.owner_key("owner"), F.lit("")).alias("owner"), "name", F.coalesce("most", F.lit(-1)).alias("most"))
    header = T.extension("page_id").isin(*T.HEADERS)
    return R.pair_unique(items.filter(header).withColumnRenamed("id", "declared"), items.filter(~header).withColumnRenamed("id", "defined"), ["owner", "name", "most"], "declared", "defined")


def code_import_edges(spark, sf):
    return _edges(_files(spark))


def _edges(files):
    pages = files.select(F.col("path").alias("id"), T.module_stem("path").alias("stem"), T.source_rank("path").alias("rank"))
    items = E.items(files).filter("public and owner is null").select("name", F.col("page_id").alias("id")).join(pages.select("id", "rank"), "id")
    stems = R.least_rank(pages.withColumn("path", F.col("id")), "stem", "id", "rank", "path").select("stem", "id")
    return R.file_edges(E.imports(files), files, stems, R.defined_fold(items, "name", "id", "rank"))


def code_call_edges(spark, sf):
    files = _files(spark)
    items = E.items(files)
    key = lambda p, k: F.concat_ws("#", p, F.col(k).cast("string"))
    family = F.substring_index("page_id", ".", -1)
    fns = items.filter("kind in ('fn', 'method')").select(key("page_id", "ix").alias("fn_id"), "page_id", "owner", "name", family.alias("family"), "least", "most", "receiver", F.lit(None).cast("string").alias("namespace"))
    sites = E.calls(files).withColumn("family", family).withColumn("caller", key("page_id", "caller_ix")).withColumn("site_id", F.concat_ws(":", "caller", "line", "name"))
    sites = sites.join(fns.select(F.col("fn_id").alias("caller"), "owner"), "caller")
    edges = code_import_edges(spark, sf)
    nodes = files.select(F.col("path").alias("id"))
    modules = files.select(F.col("path").alias("page_id"), T.module_stem("path").alias("stem"))
    return R.resolve_calls(sites, fns, G.sees(edges, nodes), modules).withColumn("tier", F.col("tier").cast("long"))


def code_ids(spark, sf):
    files = _files(spark)
    return I.assign(files.select(T.derive_name("path").alias("name"), "path"))


def _long(rows):
    """rows whose whole numbers are all long."""
    return rows.select(*[F.col(c).cast("long").alias(c) if kind == "int" else F.col(c) for c, kind in rows.dtypes])


def flow_steps(spark, sf):
    return _long(L.steps(_files(spark).filter(F.col("path").endswith(".py"))))


def flow_edges(spark, sf):
    return _long(L.chart_edges(_files(spark).filter(F.col("path").endswith(".py"))))


def flow_coverage(spark, sf):
    return L.coverage(flow_steps(spark, sf))


def generated_pages(spark, sf):
    return generate(spark, 500, 42)


QUERIES = {f.__name__: (f, ROWS.get(f.__name__)) for f in (code_items, code_calls, cpp_items, cpp_calls, cpp_includes, cpp_pairs, code_import_edges, code_call_edges, code_ids, flow_steps, flow_edges, flow_coverage, generated_pages)}
