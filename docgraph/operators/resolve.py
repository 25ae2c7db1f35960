"""Name and path resolution as equi-joins: suffixes are exploded, ties are minima, "only" is a count."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgraph.functions import text as T
from docgraph.sources.shared import cut

#: Roots of imports within a crate or package.
LOCAL_ROOTS = ("crate", "super", "self")


def least_rank(rows: DataFrame, key: str, pick: str, *order: str) -> DataFrame:
    """(key, pick): of each key the row least in `order`."""
    return rows.groupBy(key).agg(F.min_by(pick, F.struct(*order)).alias(pick))


def unique_keys(rows: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Rows whose key no other row has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in keep]).filter("__n = 1").drop("__n")


def pair_unique(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) of keys that are unique on both sides."""
    a, b = unique_keys(left, keys, [left_id]), unique_keys(right, keys, [right_id])
    on = [a[k].eqNullSafe(b[k]) for k in keys]
    return a.join(b, on).select(left_id, right_id)


def staged_pairs(left: DataFrame, right: DataFrame, stages: list[list[str]], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, stage): pairs by the keys of each stage in turn, the first stage that pairs a row counting.

    A key pairs where it is unique on both sides, counting rows that are paired already: what an earlier stage has paired
    still makes a later key ambiguous, and is never paired again. Rows with a null in a key pair by it like any other value."""
    claimed: DataFrame | None = None
    for k, keys in enumerate(stages):
        pairs = pair_unique(left, right, keys, left_id, right_id).withColumn("stage", F.lit(k))
        if claimed is not None:
            pairs = pairs.join(claimed.select(left_id), left_id, "left_anti").join(claimed.select(right_id), right_id, "left_anti")
            pairs = claimed.unionByName(pairs)
        claimed = cut(pairs)
    return claimed


DEPTH = 16


def inherited(asked: DataFrame, bases: DataFrame, methods: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(class, name, found, open) for asked (class, name): the class from which a class inherits a method, or null.

    Of the bases in their written order the first counts that has the method itself or inherits it: what is reached is
    known by the positions on the way to it, and the least way wins. open: a base from outside (null, but for `object`, which
    bases leaves out) stands before it on a way, or is too deep to look at, and may have the method first.

    bases: class, position, base; methods: class, name. Rounds going up gather, level by level, whose answer is wanted: each
    (class, name) once a level, whoever asks. Rounds coming down answer each from the answers of its bases, so that the work
    grows with classes and names, not with the ways between them."""
    up = cut(bases.select(F.col("class").alias("node"), F.col("position").cast("int").alias("position"), "base"))
    own = cut(methods.select(F.col("class").alias("base"), "name", F.lit(True).alias("has")).distinct())
    wanted = asked.select(F.col("class").alias("node"), "name").distinct()
    steps = []
    for level in range(depth + 1):
        step = wanted.join(up, "node")
        step = cut(step.join(own, ["base", "name"], "left") if level < depth else step.withColumn("has", F.lit(None).cast("boolean")))
        steps.append(step)
        further = step.filter("base is not null and has is null")
        if level == depth or further.isEmpty():
            break
        wanted = further.select(F.col("base").alias("node"), "name").distinct()
    answers = None
    for level, step in reversed(list(enumerate(steps))):
        way = F.array("position")
        best, out = F.when(F.col("has"), F.struct(way.alias("way"), F.col("base").alias("found"))), F.when(F.col("base").isNull() | F.lit(level >= depth), way)
        if answers is not None:
            step = step.join(answers.withColumnRenamed("node", "base"), ["base", "name"], "left")
            best = F.coalesce(best, F.when(F.col("b").isNotNull(), F.struct(F.concat(way, "b.way").alias("way"), F.col("b.found").alias("found"))))
            out = F.coalesce(out, F.concat(way, "o"))
        answers = step.groupBy("node", "name").agg(F.min(best).alias("b"), F.min(out).alias("o"))
        answers = answers.withColumn("o", F.when(F.col("b").isNull() | (F.col("o") < F.col("b.way")), F.col("o")))  # what stands after the found one never counts
    rows = asked.select("class", "name").distinct().join(answers.withColumnRenamed("node", "class"), ["class", "name"], "left")
    return rows.select("class", "name", F.col("b.found").alias("found"), F.col("o").isNotNull().alias("open"))


def _closed(start: DataFrame, edges: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """(key, node) of start and of all that its nodes lead to by edges (node, to), its key going along; keep: the (node, key2)
    a walk may enter. A row is walked from once."""
    keys = [c for c in start.columns if c != "node"]
    here = cut(start.distinct())
    parts = [here]
    while not here.isEmpty():
        step = here.join(edges, "node").select(*keys, F.col("to").alias("node"))
        if keep is not None:
            step = step.join(keep, keep.columns, "left_semi")
        here = cut(step.distinct().join(reduce(lambda a, b: a.unionByName(b), parts), [*keys, "node"], "left_anti"))
        parts.append(here)
    return reduce(lambda a, b: a.unionByName(b), parts)


def _heights(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(class, base, at), (class, base), top: the height of each class over the classes that are nobody's base, by taking
    these away time and again; what is left is on a loop or above one and has height top, like classes without bases."""
    rest, levels = edges, []
    while True:
        split = cut(rest.join(rest.select(F.col("base").alias("class"), F.lit(1).alias("held")).distinct(), "class", "left"))
        free, rest = split.filter("held is null"), split.filter("held = 1").select("class", "base")
        if free.isEmpty():
            break
        levels.append(free.select("class", "base", F.lit(len(levels)).alias("at")))
    return reduce(lambda a, b: a.unionByName(b), levels, rest.withColumn("at", F.lit(len(levels)))), rest, len(levels)


def overrides(asked: DataFrame, bases: DataFrame, methods: DataFrame) -> DataFrame:
    """(class, name, sub): other classes below a class, at any depth, that have the method asked for themselves.

    Walks up from the methods tell first which classes have a method of a name below them or themselves, each once; walks down
    from what is asked enter these alone, so that they lead to pairs of the result and the few classes between. The walks go
    down by height: whoever reaches a class has reached it when its turn comes, so that each level meets its own rows alone.
    Only among classes on loops and above them a round looks at all that was reached before."""
    asked = asked.select("class", "name").distinct()
    own = methods.select("class", "name").distinct().join(asked.select("name").distinct(), "name", "left_semi")
    edges = cut(bases.filter("base is not null and class <> base").select("class", "base").distinct())
    useful = cut(_closed(own.select("name", F.col("class").alias("node")), edges.select(F.col("class").alias("node"), F.col("base").alias("to"))))
    high, loops, top = _heights(edges.join(useful.select(F.col("node").alias("class")), "class", "left_semi"))
    heights = high.select(F.col("class").alias("node"), "at").distinct()
    below = high.select(F.col("base").alias("node"), F.col("class").alias("to"), F.col("at").alias("to_at")).join(heights, "node", "left").withColumn("at", F.coalesce("at", F.lit(top)))
    below = cut(below.join(useful.withColumnRenamed("node", "to"), "to").select("name", "node", "to", "to_at", "at"), "at")
    starts = asked.select("class", "name", F.col("class").alias("node")).join(useful, ["name", "node"], "left_semi").join(heights, "node", "left")
    parts = [cut(starts.select("class", "name", "node", F.coalesce("at", F.lit(top)).alias("at")), "at")]
    if not loops.isEmpty():
        around = _closed(parts[0].filter(F.col("at") == top).drop("at"), loops.select(F.col("base").alias("node"), F.col("class").alias("to")), useful)
        parts.append(around.withColumn("at", F.lit(top)))
    for at in range(top, 0, -1):
        here = reduce(lambda a, b: a.unionByName(b), [p.filter(F.col("at") == at) for p in parts]).drop("at")  # noqa: B023
        step = here.repartition("name", "node").distinct().join(below.filter((F.col("at") == at) & (F.col("to_at") < at)).drop("at"), ["name", "node"])
        parts.append(cut(step.select("class", "name", F.col("to").alias("node"), F.col("to_at").alias("at")), "at"))
    found = reduce(lambda a, b: a.unionByName(b), parts).filter("class <> node").select("class", "name", F.col("node").alias("sub"))
    return found.repartition("name", "sub").join(own.withColumnRenamed("class", "sub"), ["sub", "name"], "left_semi").select("class", "name", "sub").distinct()


def strict_winner(rows: DataFrame, group: str, order: list[str], pick: str) -> DataFrame:
    """(group, winner): the row strictly least in `order`, null where two tie."""
    key = F.struct(*order)
    best = rows.groupBy(group).agg(F.min(key).alias("__m"))
    return rows.join(best, group).groupBy(group).agg(F.when(F.count_if(key == F.col("__m")) == 1, F.min(F.when(key == F.col("__m"), F.col(pick)))).alias("winner"))


def defined_fold(rows: DataFrame, name: str = "name", id_: str = "id", rank: str = "rank") -> DataFrame:
    """(name, id): who defines a name, read in order of id. A claimant of a strictly lower rank takes over; one of equal
    rank ends the name's meaning for good (null)."""
    claims = rows.groupBy(name).agg(F.array_sort(F.collect_set(F.struct(F.col(id_).alias("id"), F.col(rank).alias("rank")))).alias("c"))
    first = F.col("c")[0]
    start = F.struct(first["id"].alias("id"), first["rank"].alias("rank"), F.lit(False).alias("dead"))

    def step(s: Column, x: Column) -> Column:
        return (
            F.when(s["dead"] | (x["rank"] > s["rank"]), s)
            .when(x["rank"] < s["rank"], F.struct(x["id"].alias("id"), x["rank"].alias("rank"), F.lit(False).alias("dead")))
            .otherwise(F.struct(s["id"].alias("id"), s["rank"].alias("rank"), F.lit(True).alias("dead")))
        )

    fold = F.aggregate(F.slice("c", 2, F.size("c")), start, step)
    return claims.select(name, F.when(~fold["dead"], fold["id"]).alias("id"))


def suffixes(path: Column) -> Column:
    """All ends of a path that begin at a folder or the file."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def suffix_join(wanted: DataFrame, pages: DataFrame, ending: str = "include", path: str = "path", id_: str = "id") -> DataFrame:
    """(ending, id, hits): the least page whose path ends in it, and how many do."""
    ends = pages.select(F.explode(suffixes(F.col(path))).alias(ending), F.col(id_).alias("id"))
    return wanted.select(ending).distinct().join(ends, ending).groupBy(ending).agg(F.min("id").alias("id"), F.count("*").alias("hits"))


def import_segments(imports: DataFrame, crates: list[str] = ()) -> DataFrame:
    """(src, import, segment): the parts of each import; an import with :: must start at a local root, which is dropped."""
    parts = F.filter(F.split("import", r"[./:{},\s]+"), lambda p: p != "")
    scoped = F.col("import").contains("::")
    local = F.element_at(parts, 1).isin(*LOCAL_ROOTS, *crates)
    kept = F.when(~scoped, parts).when(local, F.slice(parts, 2, F.size(parts)))
    return imports.filter("import <> ''").select("src", "import", F.explode(kept).alias("segment"))


def import_edges(imports: DataFrame, stems: DataFrame, defined: DataFrame, crates: list[str] = ()) -> DataFrame:
    """(src, dst): each segment by module stem, else by who alone defines the name."""
    seg = import_segments(imports, crates)
    by_stem = stems.select(F.col("stem"), F.col("id").alias("s_id"))
    by_name = defined.filter("id is not null").select(F.col("name"), F.col("id").alias("d_id"))
    out = seg.join(by_stem, F.lower("segment") == F.col("stem"), "left").join(by_name, F.col("segment") == F.col("name"), "left")
    return out.select("src", F.coalesce("s_id", "d_id").alias("dst")).filter("dst is not null and dst <> src").distinct()


def first_tier(candidates: DataFrame, site: list[str], tier: str = "tier", only: list[int] = ()) -> DataFrame:
    """Of each site the candidates of its first tier; tiers in `only` count only with a single candidate."""
    if only:
        k = F.count("*").over(W.partitionBy(*site, tier))
        candidates = candidates.withColumn("__k", k).filter(~F.col(tier).isin(*only) | (F.col("__k") == 1)).drop("__k")
    best = F.min(tier).over(W.partitionBy(*site))
    return candidates.withColumn("__best", best).filter(F.col(tier) == F.col("__best")).drop("__best")


def resolve_calls(sites: DataFrame, functions: DataFrame, visible: DataFrame, modules: DataFrame) -> DataFrame:
    """(site_id, callee): what a call may mean, by the first tier that has a candidate.

    sites: site_id, caller, page_id, owner, name, via (bare, self, path, member), qual, args, family; functions: fn_id,
    page_id, owner, name, family, least, most, receiver, namespace; visible: id, seen; modules: page_id, stem. One
    equi-join on name and family tags every candidate with its tiers; calls of a function to itself drop out after."""
    f = functions.select("fn_id", F.col("page_id").alias("f_page"), F.col("owner").alias("f_owner"), "name", "family", "least", "most", "receiver", "namespace")
    m = f.join(modules.select(F.col("page_id").alias("f_page"), "stem"), "f_page", "left")
    c = sites.join(m, ["name", "family"]).filter(T.arity_fits(F.col("args"), F.col("least"), F.col("most"), F.col("receiver") & (F.col("via") == "path")))
    seen = visible.select(F.col("id").alias("page_id"), F.col("seen").alias("f_page"), F.lit(True).alias("__seen"))
    c = c.join(seen, ["page_id", "f_page"], "left").withColumn("__seen", F.coalesce("__seen", F.lit(False)))
    own = F.col("owner").isNotNull() & (T.owner_key("owner") == T.owner_key("f_owner"))
    here, free = F.col("page_id") == F.col("f_page"), F.col("f_owner").isNull()
    qualified = (T.owner_key("f_owner") == F.col("qual")) | (free & ((F.col("stem") == F.lower("qual")) | (F.col("namespace") == F.col("qual"))))
    bare = F.when(own, 1).when(free & here, 2).when(free & F.col("__seen"), 3).when(~free & F.col("__seen"), 4).when(free, 5)
    on_self = F.when(own, 1).when(~free & F.col("__seen"), 4).when(~free, 6)
    rooted = F.when(free & here, 2).when(free & F.col("__seen"), 3).when(free, 5)
    via = F.col("via")
    tier = (
        F.when(via == "bare", bare)
        .when(via == "self", on_self)
        .when((via == "path") & (F.col("qual") == "Self") & own, 1)
        .when((via == "path") & F.col("qual").isin(*LOCAL_ROOTS), rooted)
        .when((via == "path") & qualified, 1)
        .when((via == "member") & qualified, 1)
        .when((via == "member") & ~free & F.col("__seen"), 4)
        .when((via == "member") & ~free, 6)
    )
    c = c.withColumn("tier", tier).filter("tier is not null").dropDuplicates(["site_id", "fn_id", "tier"])
    found = first_tier(c, ["site_id"], only=[5, 6])
    return found.filter("caller <> fn_id").select("site_id", F.col("fn_id").alias("callee"), "tier").distinct()


def target_form(candidates: Column, open_: Column) -> Column:
    """How surely a call's target is known: resolved, one_of, outside or hidden."""
    n = F.size(F.coalesce(candidates, F.array()))
    return F.when((n == 0) & open_, "outside").when(n == 0, "hidden").when((n == 1) & ~open_, "resolved").otherwise("one_of")


def same_name(items: DataFrame) -> DataFrame:
    """(id, other): the one other item of the name in another page, where there is just one."""
    a = items.select("id", "page_id", "name")
    b = items.select(F.col("id").alias("other"), F.col("page_id").alias("o_page"), "name")
    pages = items.groupBy("name").agg(F.count("*").alias("n"))
    few = a.join(pages.filter("n = 2"), "name", "left_semi")  # with more there is no single other
    return few.join(b, "name").filter("id <> other and page_id <> o_page").select("id", "other")


def supersedes(notes: DataFrame) -> DataFrame:
    """(id, superseded_by): what a note's `supersedes` names mean, by slug, title or alias, is retired by the least such
    note. notes: id, slug, title, aliases, supersedes, local; a note from elsewhere never retires a local one."""
    keys = notes.select("id", "local", F.explode(F.array_distinct(F.concat(F.array("slug", F.lower("title")), F.transform("aliases", F.lower)))).alias("key"))
    targets = keys.groupBy("key").agg(F.min(F.struct("id", "local")).alias("t")).select("key", F.col("t.id").alias("target"), F.col("t.local").alias("t_local"))
    said = notes.select(F.col("id").alias("by"), F.col("local").alias("by_local"), F.explode("supersedes").alias("s"))
    said = said.select("by", "by_local", F.explode(F.array_distinct(F.array(F.lower("s"), T.slugify("s")))).alias("key"))
    hits = said.join(targets, "key").filter("by <> target and (by_local or not t_local)")
    return hits.groupBy(F.col("target").alias("id")).agg(F.min("by").alias("superseded_by"))


def resolve_id(pages: DataFrame, wanted: str) -> DataFrame:
    """The page that a reader's words mean, by the first tier with one page: id, title, slug, path, end of a path."""
    w = wanted.strip()
    path = F.lower("path")
    tier = (
        F.when(F.col("id") == w, 1)
        .when(F.lower("title") == w.lower(), 2)
        .when(T.slugify("title") == T.slugify(F.lit(w)), 3)
        .when(path == w.lower(), 4)
        .when(path.endswith("/" + w.lower().lstrip("/")), 5)
    )
    rows = pages.withColumn("tier", tier).filter("tier is not null")
    counts = rows.groupBy("tier").agg(F.count("*").alias("n")).filter("n = 1")
    best = counts.agg(F.min("tier").alias("tier"))
    return rows.join(F.broadcast(best), "tier").drop("tier")


def folded(path: Column) -> Column:
    """A path with . and .. folded away; .. at the root is dropped."""
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, x: F.when((x == "") | (x == "."), done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
    )
    return F.array_join(parts, "/")


def source_join(sourced: DataFrame, files: DataFrame) -> DataFrame:
    """(path, literal, target): the file that a script's `source` line means.

    A path without expansions is read from the root, then from the script's folder. Else, or if neither is a file, what
    follows the last expansion must be the end of one file's path alone. sourced: path, literal; files: path."""
    bare = F.regexp_replace("literal", "[\"']", "")
    tail = F.regexp_replace(F.regexp_replace(bare, r"^.*\$(?:\w*)(?:.*[})])?", ""), r"^(?:\./)+|^/+", "")
    rows = sourced.select("path", "literal").distinct().withColumn("tail", F.regexp_replace(tail, "^/+", "")).filter("tail <> ''").withColumn("plain", ~bare.contains("$"))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rows = rows.withColumn("rooted", F.when(F.col("plain"), folded(F.col("tail")))).withColumn("beside", F.when(F.col("plain"), folded(F.concat(folder, F.lit("/"), F.col("tail")))))
    rows = rows.withColumn("tail", F.regexp_replace("tail", r"^(?:\.\./)+", ""))
    at = files.select("path").distinct()
    ends = at.select(F.explode(suffixes(F.col("path"))).alias("tail"), F.col("path").alias("t_path")).groupBy("tail").agg(F.min("t_path").alias("by_tail"), F.count("*").alias("n")).filter("n = 1").drop("n")
    rows = rows.join(at.select(F.col("path").alias("rooted"), F.col("path").alias("by_root")), "rooted", "left")
    rows = rows.join(at.select(F.col("path").alias("beside"), F.col("path").alias("by_folder")), "beside", "left").join(ends, "tail", "left")
    return rows.withColumn("target", F.coalesce("by_root", "by_folder", "by_tail")).filter("target is not null").select("path", "literal", "target")


def candidate_ids(pages: DataFrame, wanted: str, most: int = 5) -> DataFrame:
    """(id): what a reader may have meant when no page was found: ends of paths, else equal file names, else a shared word."""
    w = wanted.strip().lower()
    words = F.array(*[F.lit(x) for x in re.findall(r"[^\W_]+", w)]) if re.search(r"[^\W_]", w) else F.array().cast("array<string>")
    path = F.lower("path")
    tier = F.when(path.endswith("/" + w.lstrip("/")), 1).when(T.basename(path) == w.rpartition("/")[2], 2).when(F.arrays_overlap(F.concat(T.field_words("id"), T.field_words("title")), words), 3)
    rows = pages.withColumn("tier", tier).filter("tier is not null")
    best = F.broadcast(rows.agg(F.min("tier").alias("best")))  # one row
    return rows.join(best, F.col("tier") == F.col("best")).select("id").orderBy("id").limit(most)


def caller_count(calls: DataFrame, twins: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, callers): distinct callers of an item or of its twin, without the roots. calls: src, dst; twins: id, twin; roots: id."""
    both = twins.select("id", F.explode(F.array("id", "twin")).alias("dst")).filter("dst is not null")
    seen = calls.join(both, "dst").join(roots.select(F.col("id").alias("src")), "src", "left_anti")
    return seen.groupBy("id").agg(F.countDistinct("src").alias("callers"))


def stem_pages(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id): pages whose file is known by a name, in any case; never a note. pages: id, path, memory."""
    stems = pages.filter(~F.col("memory")).select(F.col("id"), T.module_stem("path").alias("stem"))
    return names.select("name", F.lower("name").alias("stem")).join(stems, "stem").select("name", "id")


def not_found(names: DataFrame, items: DataFrame, pages: DataFrame) -> DataFrame:
    """(name): asked names that neither an item (name, qualified) nor a page's file has."""
    has = items.select(F.explode(F.array("name", "qualified")).alias("name"))
    return names.join(has, "name", "left_anti").join(stem_pages(pages, names), "name", "left_anti").select("name")


def agreed(bindings: DataFrame, by: list[str], kind: str) -> DataFrame:
    """(by, kind): a local keeps its type only if all its bindings have the same one."""
    types = bindings.groupBy(*by).agg(F.min(kind).alias(kind), F.max(kind).alias("__max"), F.count_if(F.col(kind).isNull()).alias("__none"))
    return types.filter(f"`{kind}` = __max and __none = 0").select(*by, kind)


def file_edges(imports: DataFrame, files: DataFrame, stems: DataFrame, defined: DataFrame, crates: list[str] = ()) -> DataFrame:
    """(src, dst) of imports (src, import) whose src and dst are paths: what scripts source, headers that C and C++ include
    by the ends of paths, and modules by stem or defined name. files: path; stems: stem, id; defined: name, id."""
    ext = T.extension("src")
    shell, c = ext.isin("sh", "bash"), ext.isin("c", "cc", "cpp", "cxx", *T.HEADERS)
    sourced = source_join(imports.filter(shell).select(F.col("src").alias("path"), F.col("import").alias("literal")), files).select(F.col("path").alias("src"), F.col("target").alias("dst"))
    named = imports.filter(c & T.is_header_import("import")).select("src", F.regexp_replace("import", "^<|>$|^(?:\\.\\.?/)+", "").alias("include"))
    headers = suffix_join(named, files.select("path", F.col("path").alias("id")))
    included = named.join(headers.select("include", F.col("id").alias("dst")), "include").select("src", "dst")
    modules = import_edges(imports.filter(~shell & ~c), stems, defined, crates)
    return sourced.unionByName(included).unionByName(modules).filter("src <> dst").distinct()
