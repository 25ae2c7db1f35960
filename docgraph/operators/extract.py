"""Code as rows: items, imports and call sites of source files.

Python is read with the standard library's syntax tree, C and C++ by a reader of tokens. Shell, Go, JavaScript,
TypeScript and Rust are read by line scanners, with comments and strings blanked, that know declarations at the top level
and in one type body: no more is claimed for them. A language is a
function from text to a File; `LANGUAGES` may be extended.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VALUE_LENGTH, DOC_LENGTH, TEXT_LENGTH = 48, 120, 1000


@dataclass
class Item:
    kind: str
    name: str
    owner: str | None
    signature: str
    start: int
    end: int
    doc: str | None = None
    doc_text: str | None = None
    public: bool = True
    nested: bool = False
    test: bool = False
    least: int | None = None
    most: int | None = None
    receiver: bool = False


@dataclass
class Call:
    item: int
    name: str
    via: str
    qual: str | None
    args: int | None
    line: int


@dataclass
class File:
    items: list[Item] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    calls: list[Call] = field(default_factory=list)


def first_paragraph(text: str | None) -> str | None:
    if not text or not text.strip():
        return None
    return " ".join(re.split(r"\n\s*\n", text.strip())[0].split())[:TEXT_LENGTH]


def first_sentence(text: str | None) -> str | None:
    if not text:
        return None
    m = re.match(r"(.*?(?<!\b[A-Z])[.!?])(?:\s|$)", text)
    text = m[1] if m else text
    return text if len(text) <= DOC_LENGTH else text[: DOC_LENGTH - 1] + "…"


def _exported(body: list[ast.stmt]) -> set[str] | None:
    """Names in __all__, if the last statement that touches it is a plain list of plain strings."""
    found = None
    for s in body:
        for n in ast.walk(s):
            if isinstance(n, ast.Name) and n.id == "__all__":
                found = s
    value = found.value if isinstance(found, (ast.Assign, ast.AnnAssign)) else None
    if isinstance(value, (ast.List, ast.Tuple)) and value.elts and all(isinstance(e, ast.Constant) and isinstance(e.value, str) and e.value for e in value.elts):
        return {e.value for e in value.elts}
    return None


def _call(node: ast.Call, item: int) -> Call | None:
    args = None if any(isinstance(a, ast.Starred) for a in node.args) or any(k.arg is None for k in node.keywords) else len(node.args) + len(node.keywords)
    f = node.func
    if isinstance(f, ast.Name):
        return Call(item, f.id, "bare", None, args, node.lineno)
    if isinstance(f, ast.Attribute):
        if isinstance(f.value, ast.Name):
            if f.value.id in ("self", "cls"):
                return Call(item, f.attr, "self", None, args, node.lineno)
            return Call(item, f.attr, "member", f.value.id, args, node.lineno)
        return Call(item, f.attr, "member", None, args, node.lineno)
    return None


def python(text: str) -> File:
    """Items of a Python file; one that does not parse has none."""
    out = File()
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return out
    lines = text.split("\n")
    exported = _exported(tree.body)

    def signature(node, header: str) -> str:
        marks = [f"@{ast.unparse(d)}" for d in node.decorator_list if isinstance(d, ast.Call)]
        return " ".join([*marks, header])[:TEXT_LENGTH]

    def public(name: str, top: bool) -> bool:
        return name in exported if top and exported is not None else not name.startswith("_")

    def visit(body: list[ast.stmt], owner: list[str], visible: bool, inside: int | None) -> None:
        for s in body:
            if isinstance(s, ast.ClassDef):
                if inside is None:
                    bases = ", ".join(map(ast.unparse, s.bases))
                    doc = first_paragraph(ast.get_docstring(s))
                    here = visible and public(s.name, not owner)
                    out.items.append(Item("type", s.name, ".".join(owner) or None, signature(s, f"class {s.name}({bases})" if bases else f"class {s.name}"), min([s.lineno, *(d.lineno for d in s.decorator_list)]), s.end_lineno, first_sentence(doc), doc, here, test=s.name.startswith("Test")))
                    visit(s.body, [*owner, s.name], here, None)
            elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = s.args
                plain = [*a.posonlyargs, *a.args]
                method = bool(owner) and inside is None
                names = {ast.unparse(d).split("(")[0] for d in s.decorator_list}
                bound = method and "staticmethod" not in names
                least, most = len(plain) - len(a.defaults) + sum(d is None for d in a.kw_defaults) - bound, len(plain) + len(a.kwonlyargs) - bound
                known = not names - {"staticmethod", "classmethod"}
                kind = "async def" if isinstance(s, ast.AsyncFunctionDef) else "def"
                returns = f" -> {ast.unparse(s.returns)}" if s.returns else ""
                doc = first_paragraph(ast.get_docstring(s))
                k = len(out.items)
                out.items.append(
                    Item("method" if method else "fn", s.name, ".".join(owner) or None if method else None, signature(s, f"{kind} {s.name}({ast.unparse(a)}){returns}"), min([s.lineno, *(d.lineno for d in s.decorator_list)]), s.end_lineno, first_sentence(doc), doc,
                         inside is None and visible and public(s.name, not owner), inside is not None, s.name.startswith("test"), least if known else None, most if known and not a.vararg and not a.kwarg else None, bound)
                )
                visit(s.body, owner, visible, k)
            elif isinstance(s, (ast.Assign, ast.AnnAssign)) and inside is None:
                targets = s.targets if isinstance(s, ast.Assign) else [s.target]
                for t in targets:
                    if isinstance(t, ast.Name) and t.id != "__all__" and s.value is not None:
                        value = ast.unparse(s.value)
                        note = f": {ast.unparse(s.annotation)}" if isinstance(s, ast.AnnAssign) else ""
                        shown = f" = {value}" if len(value) <= VALUE_LENGTH else "" if note else f" = {value[: VALUE_LENGTH - 1]}…"
                        out.items.append(Item("value", t.id, ".".join(owner) or None, f"{t.id}{note}{shown}", s.lineno, s.end_lineno, public=visible and public(t.id, not owner)))
            elif isinstance(s, (ast.If, ast.Try, ast.With, ast.AsyncWith, ast.For, ast.While, ast.Match)):
                for block in (getattr(s, "body", []), getattr(s, "orelse", []), getattr(s, "finalbody", []), *(h.body for h in getattr(s, "handlers", [])), *(c.body for c in getattr(s, "cases", []))):
                    visit(block, owner, visible, inside)

    visit(tree.body, [], True, None)
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out.imports.extend(n.name for n in node.names)
        elif isinstance(node, ast.ImportFrom):
            out.imports.extend([node.module] if node.module else [n.name for n in node.names])
        elif isinstance(node, ast.Call):
            spans = [(i.end - i.start, k) for k, i in enumerate(out.items) if i.kind in ("fn", "method") and i.start <= node.lineno <= i.end]
            if spans and (found := _call(node, min(spans)[1])):
                out.calls.append(found)
    out.imports = list(dict.fromkeys(out.imports))
    for i in out.items:
        if i.doc is None and (above := _comment_above(lines, i.start)):
            i.doc_text, i.doc = above, first_sentence(above)
    return out


def _comment_above(lines: list[str], start: int) -> str | None:
    """A block of # lines right above, unless it is a shebang, an encoding or a banner."""
    k, found = start - 2, []
    while k >= 0 and lines[k].strip().startswith("#"):
        found.append(lines[k].strip().lstrip("#").strip())
        k -= 1
    text = first_paragraph("\n".join(reversed(found)))
    return None if not text or text.startswith("!") or "coding:" in text or not re.search(r"[^\W\d_]{2}", text) else text


SHELL_FUNCTION = re.compile(r"^\s*(?:function\s+([\w:.+-]+)\s*(?:\(\s*\))?|([\w:.+-]+)\s*\(\s*\))\s*\{?")
SHELL_GLOBAL = re.compile(r"^(?:export\s+|readonly\s+|declare\s+(?:-\w+\s+)*)?([A-Z][A-Z0-9_]*)=(.*)$")
SHELL_SOURCE = re.compile(r"^\s*(?:source|\.)\s+[\"']?([^\"'\s;]+)")
SHELL_WORD = re.compile(r"(?:^|[;&|(]|\bthen\b|\bdo\b|\belse\b)\s*([A-Za-z_][\w:.+@-]*)")


def shell(text: str) -> File:
    """Functions to the } at the margin, globals by their first assignment, sourced files, calls of own functions."""
    out, lines, seen = File(), text.split("\n"), set()
    for k, line in enumerate(lines, 1):
        if m := SHELL_FUNCTION.match(line):
            one = line.rstrip().endswith("}")
            end = k if one else next((j for j in range(k + 1, len(lines) + 1) if lines[j - 1].startswith("}")), len(lines))
            doc = _comment_above(lines, k)
            out.items.append(Item("fn", m[1] or m[2], None, f"{m[1] or m[2]}()", k, end, first_sentence(doc), doc))
        elif (m := SHELL_GLOBAL.match(line)) and m[1] not in seen:
            seen.add(m[1])
            value = m[2].strip()
            out.items.append(Item("value", m[1], None, f"{m[1]}={value}" if len(value) <= VALUE_LENGTH else f"{m[1]}={value[: VALUE_LENGTH - 1]}…", k, k, nested=True))
        elif m := SHELL_SOURCE.match(line):
            out.imports.append(m[1])
    names = {i.name for i in out.items if i.kind == "fn"}
    for k, line in enumerate(lines, 1):
        spans = [(i.end - i.start, n) for n, i in enumerate(out.items) if i.kind == "fn" and i.start < k <= i.end]
        if spans and not line.lstrip().startswith("#"):
            out.calls.extend(Call(min(spans)[1], m[1], "bare", None, None, k) for m in SHELL_WORD.finditer(line) if m[1] in names)
    return out


#: Comments, and strings and characters in their quotes; a lone quote as of a lifetime is neither.
LITERAL = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\]|\\.)*\"|`(?:[^`\\]|\\.)*`|'(?:[^'\\\n]|\\[^\n]+?)'|'(?:[^'\\\n]|\\.)*'(?=[\s,;:)\]}+.])", re.S)


def blank(text: str) -> str:
    """Code with comments and what stands between quotes as spaces, at the same places."""
    space = lambda t: re.sub(r"[^\n]", " ", t)
    return LITERAL.sub(lambda m: space(m[0]) if m[0][0] == "/" else m[0][0] + space(m[0][1:-1]) + m[0][-1], text)


def _braces(lines: list[str], start: int) -> int:
    """Line of the brace that closes the first one opened at or after `start`; strings and comments may mislead it."""
    depth, opened = 0, False
    for k in range(start - 1, len(lines)):
        code = re.sub(r"//.*|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)'", "", lines[k])
        depth += code.count("{") - code.count("}")
        opened |= "{" in code
        if opened and depth <= 0 or not opened and code.rstrip().endswith(";"):
            return k + 1
    return len(lines)


def _scanner(patterns: list[tuple[str, str]], imports: str, public: Callable[[str, str], bool], comment: str = "//") -> Callable[[str], File]:
    """A scanner for languages with braces: patterns give kind and a regex with name, and owner if it can tell."""
    compiled = [(kind, re.compile(p)) for kind, p in patterns]
    importing, calling = re.compile(imports, re.M), re.compile(r"(?:\b(self|this|Self|\w+)(\.|::))?\b([A-Za-z_]\w*)\s*\(([^()]*)\)")

    def scan(text: str) -> File:
        out, lines, owners = File(), text.split("\n"), []
        code = blank(text).split("\n")
        for k, (line, bare) in enumerate(zip(lines, code), 1):
            owners = [o for o in owners if o[1] >= k]
            for kind, p in compiled:
                if m := p.match(bare):
                    d = m.groupdict()
                    end = _braces(code, k) if kind != "value" else k
                    owner = d.get("owner") or (owners[-1][0] if owners and line[:1].isspace() else None)
                    if kind in ("owner", "type"):
                        owners.append((d["name"], end))
                    if kind != "owner":
                        above, j = [], k - 2
                        while j >= 0 and lines[j].strip().startswith(comment):
                            above.append(lines[j].strip().lstrip("/!*# ").strip())
                            j -= 1
                        doc = first_paragraph("\n".join(reversed(above)))
                        out.items.append(Item("method" if kind == "fn" and owner else kind, d["name"], owner, " ".join(line.strip().rstrip("{").split()), k, end, first_sentence(doc), doc, public(line, d["name"]), test=j >= 0 and "#[test]" in lines[j]))
                    break
        for k, line in enumerate(code, 1):
            spans = [(i.end - i.start, n) for n, i in enumerate(out.items) if i.kind in ("fn", "method") and i.start < k <= i.end]
            if spans:
                for m in calling.finditer(line):
                    if m[3] not in ("if", "for", "while", "match", "switch", "return", "func", "fn", "function", "catch"):
                        via = "bare" if not m[2] else "path" if m[2] == "::" else "self" if m[1] in ("self", "this") else "member"
                        out.calls.append(Call(min(spans)[1], m[3], via, m[1] if via in ("path", "member") else None, len([a for a in m[4].split(",") if a.strip()]), k))
        out.imports = list(dict.fromkeys(next(g for g in m.groups() if g) for m in importing.finditer(text)))
        return out

    return scan


rust = _scanner(
    [("owner", r"^\s*(?:unsafe )?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+ for )?(?P<name>\w+)"), ("fn", r"^\s*(?:pub(?:\([^)]*\))? )?(?:const |async |unsafe )*fn (?P<name>\w+)"), ("type", r"^\s*(?:pub(?:\([^)]*\))? )?(?:struct|enum|trait|type|union) (?P<name>\w+)"), ("value", r"^\s*(?:pub(?:\([^)]*\))? )?(?:const|static) (?P<name>[A-Z_]\w*)\s*:")],
    r"^\s*(?:pub )?use ([^;]+);",
    lambda line, name: line.lstrip().startswith("pub "),
)
go = _scanner(
    [("fn", r"^func (?:\(\w*\s*\*?(?P<owner>\w+)[^)]*\) )?(?P<name>\w+)"), ("type", r"^type (?P<name>\w+) "), ("value", r"^(?:var|const) (?P<name>\w+)")],
    r"^\s*(?:import )?(?:\w+ )?\"([^\"]+)\"$",
    lambda line, name: name[:1].isupper(),
)
script = _scanner(
    [("type", r"^(?:export )?(?:default )?(?:abstract )?(?:class|interface|enum) (?P<name>\w+)"), ("fn", r"^(?:export )?(?:default )?(?:async )?function\*? (?P<name>\w+)"), ("fn", r"^\s+(?:public |static |async )*(?P<name>(?!if\b|for\b|while\b|switch\b|return\b|catch\b)\w+)\([^)]*\)[^;{]*\{"), ("value", r"^(?:export )?(?:const|let|var) (?P<name>\w+)")],
    r"(?:from|require\()\s*['\"]([^'\"]+)['\"]",
    lambda line, name: line.startswith("export "),
)
LANGUAGES: dict[str, tuple[str, Callable[[str], File]]] = {"py": ("python", python), "sh": ("shell", shell), "bash": ("shell", shell), "rs": ("rust", rust), "go": ("go", go), "js": ("javascript", script), "mjs": ("javascript", script), "jsx": ("javascript", script), "ts": ("typescript", script), "tsx": ("typescript", script)}

ITEMS = "page_id string, ix int, kind string, name string, owner string, signature string, start_line int, end_line int, doc string, doc_text string, public boolean, nested boolean, test boolean, least int, most int, receiver boolean"
CALLS = "page_id string, caller_ix int, name string, via string, qual string, args int, line int"


def register(extension: str, language: str, reader: Callable[[str], File]) -> None:
    LANGUAGES[extension] = (language, reader)


def _languages() -> dict[str, tuple[str, Callable[[str], File]]]:
    """The readers by extension, those of C and C++ among them unless others took their place."""
    from docgraph.operators.cpp import cpp

    c = {e: ("c", cpp) for e in ("c", "h")} | {e: ("cpp", cpp) for e in ("cc", "cpp", "cxx", "hh", "hpp", "hxx")}
    for e, reader in c.items():
        LANGUAGES.setdefault(e, reader)
    return LANGUAGES


def _read(path: str, text: str, languages: dict) -> File | None:
    ext = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if ext in languages:
        return languages[ext][1](text)
    return shell(text) if re.match(r"#!.*\b(?:ba)?sh\b", text[:128]) else None


def _table(files: DataFrame, schema: str, rows: Callable[[str, File], list[tuple]]) -> DataFrame:
    languages = dict(_languages())
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    names = [(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            got = [r for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (f := _read(p, t or "", languages)) for r in rows(p, f)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], t) for i, (_, t) in enumerate(names)], [n for n, _ in names])

    return files.select(F.col("path").cast("string"), F.col("content").cast("string")).mapInArrow(run, schema)


def items(files: DataFrame) -> DataFrame:
    """Items of files (path, content)."""
    return _table(files, ITEMS, lambda p, f: [(p, k, i.kind, i.name, i.owner, i.signature, i.start, i.end, i.doc, i.doc_text, i.public, i.nested, i.test, i.least, i.most, i.receiver) for k, i in enumerate(f.items)])


def imports(files: DataFrame) -> DataFrame:
    return _table(files, "src string, import string", lambda p, f: [(p, i) for i in f.imports])


def calls(files: DataFrame) -> DataFrame:
    return _table(files, CALLS, lambda p, f: [(p, c.item, c.name, c.via, c.qual, c.args, c.line) for c in f.calls])
