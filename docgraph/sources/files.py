"""Source trees as rows (path, content), with ignore rules."""

from __future__ import annotations

import fnmatch
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never part of a corpus.
SKIPPED = ("superpowers", "third_party", "third-party", "vendor", "vendored", "node_modules")
SHEBANG = r"^#!.*\b(ba)?sh\b"


def ignored(path: str, rules: list[str], folder: bool = False) -> bool:
    """Whether the last matching ignore rule leaves a path out: * ? [], leading ! keeps, trailing / folders, inner / anchors."""
    out = False
    for rule in rules:
        rule = rule.rstrip()
        if not rule or rule.startswith("#"):
            continue
        keep, rule = rule.startswith("!"), rule.lstrip("!")
        only, rule = rule.endswith("/"), rule.rstrip("/")
        anchored, rule = "/" in rule, rule.lstrip("/")
        pattern = re.compile(fnmatch.translate(rule).replace("(?s:", "(?s:", 1))
        parts = path.split("/")
        ends = range(1, len(parts) + 1)
        hit = any(pattern.match("/".join(parts[:k]) if anchored else parts[k - 1]) and (k < len(parts) or folder or not only) for k in ends)
        if hit:
            out = not keep
    return out


def listing(root: str, respect: bool = True) -> list[str]:
    """Paths under a root in order, hidden and skipped folders pruned as a whole, its .gitignore files obeyed."""
    out, rules = [], []
    for folder, names, files in os.walk(root):
        rel = os.path.relpath(folder, root)
        rel = "" if rel == "." else rel.replace(os.sep, "/") + "/"
        if respect and ".gitignore" in files:
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                rules += [("!" if r.startswith("!") else "") + (f"/{rel}" if "/" in r.strip().rstrip("/") else "") + r.strip().lstrip("!").lstrip("/") if r.strip() and not r.startswith("#") else "" for r in f]
        names[:] = sorted(n for n in names if not n.startswith(".") and n not in SKIPPED and not (respect and ignored(f"{rel}{n}", rules, True)))
        out += [f"{rel}{n}" for n in sorted(files) if not n.startswith(".") and not (respect and ignored(f"{rel}{n}", rules))]
    return sorted(out)


def read_tree(spark: SparkSession, root: str, extensions: list[str] | None = None, respect: bool = True) -> DataFrame:
    """(path, content) of the text files under a root that the driver can list; executors read the bytes."""
    paths = [p for p in listing(root, respect) if not extensions or p.rpartition(".")[2].lower() in extensions or "." not in p.rpartition("/")[2]]
    if not paths:
        return spark.createDataFrame([], "path string, content string")
    base = "file://" + os.path.abspath(root) + "/"
    rows = spark.read.format("binaryFile").load([base + p for p in paths])
    path = F.substring(F.regexp_replace("path", "^file:/+", "/"), len(os.path.abspath(root)) + 2, 1 << 20)
    return rows.select(path.alias("path"), F.decode("content", "utf-8").alias("content"))


def scripts(files: DataFrame) -> DataFrame:
    """Files without extension that open with a shell's first line count as .sh."""
    plain = ~F.substring_index("path", "/", -1).contains(".")
    return files.withColumn("path", F.when(plain & F.substring("content", 1, 128).rlike(SHEBANG), F.concat("path", F.lit(".sh"))).otherwise(F.col("path")))


def skipped(paths: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(rule, files): how many files lie under each skipped folder, counted at the outermost one; `ignored` are further
    files that a listing obeying the ignore files (kept: path) does not have."""
    found = F.get(F.filter(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda p: p.isin(*SKIPPED)), 0)
    rows = paths.select("path", F.when(F.size(F.split("path", "/")) > 1, found).alias("rule"))
    if kept is not None:
        there = kept.select("path", F.lit(True).alias("there")).distinct()
        rows = rows.join(there, "path", "left").withColumn("rule", F.when(F.col("rule").isNull() & F.col("there").isNull(), "ignored").otherwise(F.col("rule")))
    return rows.filter("rule is not null").groupBy("rule").agg(F.count("*").alias("files"))


def relevant(changes: DataFrame, files: DataFrame, extensions: list[str]) -> DataFrame:
    """changes (path) that may alter a catalog of files (path): known files and folders; new files that a reader takes,
    and ignore files, in a known folder."""
    known = files.select("path").distinct()
    parts = F.split("path", "/")
    folders = known.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("path")).distinct()
    old = changes.join(known.unionByName(folders.filter("path <> ''")).distinct(), "path", "left_semi")
    name = F.substring_index("path", "/", -1)
    taken = F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)).isin(*extensions) | name.isin(".gitignore", ".ignore")
    new = changes.filter(taken).withColumn("__folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).join(folders.withColumnRenamed("path", "__folder"), "__folder", "left_semi").drop("__folder")
    return old.unionByName(new.select(old.columns)).distinct()
