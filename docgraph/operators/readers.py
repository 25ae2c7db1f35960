"""Readers of text and Markdown files: rows (path, content) become pages."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.functions import text as T

PAGE = "path string, name string, kind string, aliases array<string>, tags array<string>, created string, updated string, supersedes array<string>, summary string, headings array<string>, body string"
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")


def mask_code(text: str) -> str:
    """Fenced blocks and inline spans as spaces of the same length; an unclosed fence runs to the end."""
    out, fence = [], None
    for line in text.split("\n"):
        m = FENCE.match(line)
        if fence is None and m and not (m[1][0] == "`" and "`" in m[2]):
            fence = m[1]
            out.append(" " * len(line))
        elif fence is not None:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = None
            out.append(" " * len(line))
        else:
            out.append(re.sub(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda s: " " * len(s[0]), line))
    return "\n".join(out)


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """Keys of the block between --- lines that opens a text, and the rest; an unclosed block is text."""
    if not re.match(r"---[ \t]*\n", text):
        return {}, text
    end = re.search(r"\n---[ \t]*(?:\n|$)", text)
    if not end:
        return {}, text
    fields: dict[str, str] = {}
    key = ""
    for line in text[: end.start()].split("\n")[1:]:
        if m := re.match(r"\s*([\w-]+)\s*:\s*(.*?)\s*$", line):
            key = m[1].lower()
            fields.setdefault(key, m[2])
        elif key and (m := re.match(r"\s*-\s+(.*?)\s*$", line)):
            fields[key] = f"{fields[key]},{m[1]}" if fields[key] else m[1]
    return fields, text[end.end() :]


def unquote(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def listed(text: str | None) -> list[str]:
    """A list written [a, b], a, b or as lines."""
    return [x for x in (unquote(p) for p in (text or "").strip().strip("[]").split(",")) if x]


def valid_day(text: str | None) -> str | None:
    from docgraph.functions.dates import QueryDate

    m = re.match(r"\s*[\"']?(\d{4})-(\d{2})-(\d{2})(?!\d)", text or "")
    return m[0].strip().strip("\"'") if m and QueryDate(int(m[1]), int(m[2]), int(m[3])).valid else None


def first_text(body: str) -> str | None:
    """First sentence of the first paragraph that is neither heading, list, quote nor code."""
    from docgraph.operators.extract import first_sentence

    for part in re.split(r"\n\s*\n", mask_code(body)):
        lines = [x.strip() for x in part.strip().split("\n") if x.strip() and not x.lstrip().startswith("#")]
        if lines and not re.match(r"[-*+>|<!\[]|\d+[.)]\s", lines[0]) and re.search(r"[^\W\d_]{2}", lines[0]):
            return first_sentence(" ".join(lines))
    return None


def _stem(path: str) -> str:
    return re.sub(r"[_-]", " ", path.rsplit("/", 1)[-1].split(".")[0]).title()


def markdown(path: str, text: str) -> tuple:
    fields, body = front_matter(text)
    masked = mask_code(body).split("\n")
    heads = [(len(m[1]), m[2]) for line in masked if (m := re.match(r"^ {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$", line)) and m[2]]
    first = next((re.sub(r"[*_`]|\[([^\]]*)\]\([^)]*\)", lambda m: m[1] or "", h) for level, h in heads if level == 1), None)
    day = next((d for k in ("updated", "modified", "date") if (d := valid_day(fields.get(k)))), None) or valid_day(path.rsplit("/", 1)[-1])
    tags = [t.strip().lstrip("#").rstrip("/").lower() for t in listed(fields.get("tags"))]
    name = unquote(fields.get("title", "")) or first or _stem(path)
    return (path, name, "markdown", listed(fields.get("aliases")), [t for t in tags if t], valid_day(fields.get("created")), day, listed(fields.get("supersedes")), unquote(fields.get("description", "")) or first_text(body), [h for level, h in heads if level == 2], body.strip())


def plain(path: str, text: str) -> tuple:
    name, aliases, created, body = None, [], None, []
    for k, line in enumerate(text.split("\n")):
        if name is None and (m := re.match(r"#\s+(.+)$", line)):
            name = m[1].strip()
        elif k == 0 and re.search(r"[^\W\d_]", line) and line == line.upper() and line != line.lower():
            name = line.strip().title()
        elif m := re.match(r"(?i)created:\s*(.*)$", line):
            created = valid_day(m[1])
        elif m := re.match(r"(?i)aliases:\s*(.*)$", line):
            aliases = listed(m[1])
        else:
            body.append(line)
    body = "\n".join(body).strip()
    return (path, name or _stem(path), "text", aliases, [], created, None, [], first_text(body), [], body)


READERS = {"md": markdown, "markdown": markdown, "txt": plain, "text": plain}


def register(extension: str, reader) -> None:
    READERS[extension] = reader


def pages(files: DataFrame) -> DataFrame:
    """Pages of the files whose extension has a reader; others give no row."""
    readers = dict(READERS)
    lists = pa.list_(pa.string())
    types = (pa.string(), pa.string(), pa.string(), lists, lists, pa.string(), pa.string(), lists, pa.string(), lists, pa.string())
    names = [c.split()[0] for c in PAGE.split(", ")]

    def run(batches):
        for batch in batches:
            got = [readers[e](p, t or "") for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (e := p.rpartition(".")[2].lower()) in readers]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate(types)], names)

    return files.select(F.col("path").cast("string"), F.col("content").cast("string")).mapInArrow(run, PAGE)


def sections(pages_: DataFrame) -> DataFrame:
    """(path, section, text): what stands under each second-level heading outside code; the last of equal names counts."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: dict[str, list[str]] = {}
                name = ""
                for line, masked in zip((body or "").split("\n"), mask_code(body or "").split("\n")):
                    if m := re.match(r"^## +(.+?)\s*$", masked):
                        name = m[1]
                        found[name] = []
                    else:
                        found.setdefault(name, []).append(line)
                rows += [(path, k, "\n".join(v).strip()) for k, v in found.items() if k or any(v)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["path", "section", "text"])

    return pages_.select("path", "body").mapInArrow(run, "path string, section string, text string")


def outline(pages_: DataFrame, items: DataFrame, most: int) -> DataFrame:
    """(path, outline): headings and item signatures of each page in order of lines, cut to `most` characters.

    Tests go first, then docs; lines beyond the budget are counted in a last line."""
    line = F.concat(F.lit("- "), T.clip(T.one_line("signature"), 120), F.when(F.col("doc").isNotNull(), F.concat(F.lit(" — "), "doc")).otherwise(""))
    rows = items.filter("not test").select(F.col("page_id").alias("path"), F.struct("start_line", "end_line", line.alias("line"), F.length(line).alias("n")).alias("x"))
    lists = rows.groupBy("path").agg(F.array_sort(F.collect_list("x")).alias("all"))
    fold = F.aggregate("all", F.struct(F.lit(0).alias("used"), F.lit("").alias("text"), F.lit(0).alias("left")), lambda s, x: F.when((s["left"] == 0) & (s["used"] + x["n"] + 1 <= most), F.struct((s["used"] + x["n"] + 1).alias("used"), F.concat(s["text"], x["line"], F.lit("\n")).alias("text"), s["left"].alias("left"))).otherwise(F.struct(s["used"].alias("used"), s["text"].alias("text"), (s["left"] + 1).alias("left"))))
    text = F.concat(fold["text"], F.when(fold["left"] > 0, F.concat(F.lit("("), fold["left"].cast("string"), F.lit(" more)"))).otherwise(""))
    return pages_.select("path").join(lists, "path").select("path", text.alias("outline"))


def content_text(sections_: DataFrame, chrome: tuple[str, ...]) -> DataFrame:
    """(path, text): section texts of each page in order of their names, without the sections that rendering adds."""
    kept = sections_.filter(~F.col("section").isin(*chrome))
    return kept.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "text"))), lambda x: x["text"]), "\n").alias("text"))
