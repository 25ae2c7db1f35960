"""Labels of documents: headings and bold step names, their ranges, and the search over them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgraph.functions import text as T

FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
LEAD = re.compile(r"^\s*(?:(?:[-*+]|\d+[.)])\s+)?(?:\[[ xX]\]\s+)?")
ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s")
#: Fixed value: lines that a bold label may run on past its first.
WRAP = 3
MARKS = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
#: Words that do not tell labels apart.
STOP = {"a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "is", "of", "on", "or", "the", "to", "via", "with"}
SCHEMA = "doc string, start int, end int, level int, label string"


def bold(lines: list[str]) -> str | None:
    """The bold label that opens on the first of the lines: closed there, or further down in the same block.

    A block ends at a blank line, heading, list item or other bold line. Past the first line the closing marks must stand
    right after a word. A label that ends in a colon is a field."""
    start = LEAD.match(lines[0]).end()
    if not lines[0].startswith("**", start):
        return None
    text, closed, rest = lines[0][start + 2 :].partition("**")
    text = text.strip()
    if closed:
        return None if not text or text.endswith(":") or rest.lstrip().startswith(":") else text
    for line in lines[1 : 1 + WRAP]:
        if not line.strip() or HEADING.match(line) or ITEM.match(line) or line.startswith("**", LEAD.match(line).end()):
            return None
        part, closed, rest = line.partition("**")
        if closed:
            before, after = part[-1:], rest[:1]
            if not before or before.isspace() or before in MARKS and after and not after.isspace() and after not in MARKS:
                return None
            text = f"{text} {part.strip()}"
            return None if text.endswith(":") else text
        text = f"{text} {line.strip()}"
    return None


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, level, label) with lines from 1: headings have levels 1 to 6, bold names 7, indented ones 8.

    A label ends before the next one of its level or above. Fenced code has none; a bold name that ends in a colon is a
    field, not a label. An unclosed fence runs to the end."""
    lines, found, fence = text.split("\n"), [], None
    for k, line in enumerate(lines, 1):
        if m := FENCE.match(line):
            if fence is None:
                fence = m[1]
            elif m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = None
            continue
        if fence is not None:
            continue
        if (m := HEADING.match(line)) and m[2]:
            found.append((k, len(m[1]), m[2]))
        elif label := bold(lines[k - 1 : k + WRAP]):
            found.append((k, 8 if line[:1].isspace() else 7, label))
    # from the last to the first: the labels that may end one stand on a stack, the nearest on top
    out, after = [], []
    for start, level, label in reversed(found):
        while after and after[-1][1] > level:
            after.pop()
        out.append((start, after[-1][0] - 1 if after else len(lines), level, label))
        after.append((start, level))
    return out[::-1]


def labels(docs: DataFrame, doc: str = "path", text: str = "text") -> DataFrame:
    """(doc, start, end, level, label) of all documents."""

    def run(batches):
        for batch in batches:
            rows = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in find(t or "")]
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc", "start", "end", "level", "label"])

    return docs.select(F.col(doc).cast("string"), F.col(text).cast("string")).mapInArrow(run, SCHEMA)


#: Labels listed at most for an empty query, and for any other.
ALL_LABELS, SOME_LABELS = 200, 10
BOLD = 7
_WORD = r"[\p{L}\p{N}_.\-]+"


def _words(text: str) -> list[str]:
    return [w for w in (m.rstrip(".-") for m in re.findall(r"[\w.\-]+", text)) if w]


def _own(label: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(F.lower(label), F.lit(_WORD), F.lit(0)), lambda w: F.regexp_replace(w, r"[.\-]+$", "")), lambda w: w != "")


def _at(own: Column, wanted: list[str]) -> Column:
    """Where the wanted words stand in a row among a label's, from 0, or null."""
    line, text = F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" ")), f" {' '.join(wanted)} "
    at = F.locate(text, line)
    return F.when(at > 0, F.regexp_count(F.substring(line, F.lit(1), at), F.lit(" ")) - 1)


def _is_id(word: str) -> bool:
    """A word with a digit and a letter or a dot: 11.4 or T3a, not 7."""
    return any(c.isdigit() for c in word) and any(c.isalpha() or c == "." for c in word)


def _names(own: Column, run: list[str]) -> Column:
    """Where a part of a query names a label: a run opens it, an id may be its second word, a plain word is all of it."""
    wanted = F.array(*map(F.lit, run))
    if len(run) == 1 and not _is_id(run[0]):
        return F.when(own == wanted, 0)
    found = F.when(F.slice(own, 1, len(run)) == wanted, 0)
    return found.when(F.slice(own, 2, len(run)) == wanted, 1) if _is_id(run[0]) else found


def segments(found: DataFrame, words: list[str]) -> list[list[str]]:
    """The parts of a query that name labels: from each word the longest run that does; other words are left out.

    Which runs name a label is one pass over the labels; the answer has a row for each of the query's runs, at most."""
    runs = [(i, n) for i in range(len(words)) for n in range(1, len(words) - i + 1)]
    tried = F.array(*[F.when(_names(F.col("__own"), words[i : i + n]).isNotNull(), F.struct(F.lit(i).alias("i"), F.lit(n).alias("n"))) for i, n in runs])
    named = found.withColumn("__own", _own(F.col("label"))).select(F.explode(F.filter(tried, lambda r: r.isNotNull())).alias("r")).select("r.i", "r.n").groupBy("i").agg(F.max("n").alias("n"))
    longest = {r["i"]: r["n"] for r in named.collect()}
    parts, i = [], 0
    while i < len(words):
        if i in longest:
            parts.append(words[i : i + longest[i]])
        i += longest.get(i, 1)
    return parts


def _ranked(found: DataFrame, words: list[str]) -> DataFrame:
    """The labels that answer, with their place in the order (part, loose, bold, late), by the first reading that any answers to."""
    own, split = _own(F.col("label")), F.filter(F.flatten(F.transform(_own(F.col("label")), lambda w: F.split(w, "-"))), lambda w: w != "")
    loose_words = [x for w in words for x in w.split("-") if x]
    no, bold = F.lit(False), F.col("level") >= BOLD
    rows = found.withColumn("__at", _at(own, words)).withColumn("__loose", _at(split, loose_words) if len(loose_words) > 1 else F.lit(None).cast("int"))
    at = F.coalesce("__at", "__loose")
    rows = rows.filter(at.isNotNull()).withColumns({"part": F.lit(0), "loose": F.col("__at").isNull(), "bold": bold, "late": at > 0, "reading": F.lit("row")}).drop("__at", "__loose")
    if len(words) < 2 or not rows.isEmpty():
        return rows
    if len(parts := segments(found, words)) > 1:
        first = F.coalesce(*[F.when(_names(own, p).isNotNull(), F.struct(F.lit(k).alias("part"), _names(own, p).alias("at"))) for k, p in enumerate(parts)])
        several = found.withColumn("__first", first).filter("__first is not null").withColumns({"part": F.col("__first.part"), "loose": no, "bold": bold, "late": F.col("__first.at") > 0, "reading": F.lit("parts")}).drop("__first")
        if several.select("part").distinct().limit(2).count() > 1:
            return several
    if any(c.isdigit() for c in words[0]):
        place = F.array_position(F.slice(own, 1, 2), words[0])
        ids = found.withColumn("__at", place).filter("__at > 0").withColumns({"part": F.lit(0), "loose": no, "bold": bold, "late": F.col("__at") > 1, "reading": F.lit("id")}).drop("__at")
        if not ids.isEmpty():
            return ids
    need = [w for w in loose_words if w not in STOP]
    if len(need) > 1:
        every = F.size(F.array_except(F.array(*map(F.lit, need)), split)) == 0
        return found.filter(every).withColumns({"part": F.lit(0), "loose": no, "bold": bold, "late": no, "reading": F.lit("any order")})
    return rows


def search(found: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Labels that a query means, document by document; `cut` tells how many more there are than the limit lets through.

    Readings of a query, of which the first that finds any counts: its words in a row, if need be with words also split
    at hyphens; several labels one after the other; a leading id at the label's front; all words but the commonest in any
    order. Headings come before bold names, labels that begin with the words before others, then documents and
    lines. Where the limit cuts labels that a document repeats under one head (the text before a colon), those
    shown are the first, the last, the second, the last but one, ... of them. An empty query lists all labels.

    Only `limit` labels are sorted for; what repeats the head of one of these is looked up by it."""
    words = _words(query.lower())
    limit = limit or (SOME_LABELS if words else ALL_LABELS)
    if not words:
        rows = found.withColumn("cut", F.greatest(F.lit(0), F.lit(found.count()) - limit).cast("long"))
        return rows.withColumn("reading", F.lit("all")).orderBy("doc", "start").limit(limit)
    rows = _ranked(found, words)
    place = ["part", "loose", "bold", "late"]
    text = F.trim(F.when(F.instr("label", ": ") > 0, F.substring_index("label", ": ", 1)).otherwise(F.regexp_replace("label", ":$", "")))
    rows = rows.withColumn("head", F.lower(F.when(text == "", F.col("label")).otherwise(text)))
    # labels that several parts name are ordered as parts are, but share their heads across places
    keyed = rows.withColumn("__key", F.when(F.col("reading") == "parts", F.lit("")).otherwise(F.concat_ws(",", *[F.col(c).cast("string") for c in place])))
    order = [*place, "doc", "start"]
    top = keyed.orderBy(*order).limit(limit)
    slots = F.broadcast(top.groupBy("__key", "doc", "head").agg(F.count("*").alias("__slots")))  # `limit` rows at most
    shown = alternate(keyed.join(slots, ["__key", "doc", "head"]), ["__key", "doc", "head"], order, F.col("__slots"))
    total = F.broadcast(rows.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("cut")))
    return shown.crossJoin(total).orderBy("doc", *place, "start").select(*found.columns, "reading", "cut")


def alternate(rows: DataFrame, head: list[str], order: list[str], keep: int | Column) -> DataFrame:
    """Of labels with one head keep first, last, second, last but one, ... up to `keep`."""
    up = F.row_number().over(W.partitionBy(*head).orderBy(*order))
    down = F.row_number().over(W.partitionBy(*head).orderBy(*[F.desc(c) for c in order]))
    place = F.when(F.col("__up") <= F.col("__down"), 2 * F.col("__up") - 1).otherwise(2 * F.col("__down"))
    return rows.withColumn("__up", up).withColumn("__down", down).withColumn("place", place).filter(F.col("place") <= keep).drop("__up", "__down")


def table_rows(docs: DataFrame, query: str, doc: str = "path", text: str = "text") -> DataFrame:
    """(doc, line, row): rows of tables that hold the query's words in a row."""
    words = " ".join(re.findall(r"[\w.\-]+", query.lower()))
    lines = docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\n")).alias("line", "row")).filter(F.col("row").rlike(r"^\s*\|"))
    said = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower("row"), F.lit(r"[\p{L}\p{N}_.\-]+"), F.lit(0)), " "), F.lit(" "))
    return lines.filter(said.contains(f" {words} ")).select("doc", (F.col("line") + 1).alias("line"), "row")
