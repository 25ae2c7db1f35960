"""Decision flow of functions as flat rows: steps (a tree by parent and slot) and the edges of a chart. Python only.

A condition's calls come before its branch; an if without else, a match without a catch-all and a loop leave an open end.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT = 80
STEPS = "path string, fn string, step int, parent int, slot string, ord int, kind string, text string, line int"
EDGES = "path string, fn string, src int, dst int, label string"


def _clip(text: str) -> str:
    text = " ".join(text.split())
    return text if len(text) <= TEXT else text[: TEXT - 1] + "…"


class _Walk:
    """Steps of one function: (step, parent, slot, ord, kind, text, line); step 0 is the function."""

    def __init__(self, fn: ast.AST):
        self.steps = [(0, None, "", 0, "function", fn.name, fn.lineno)]
        self.body(fn.body, 0, "body")

    def add(self, parent: int, slot: str, ord_: int, kind: str, text: str, line: int) -> int:
        self.steps.append((len(self.steps), parent, slot, ord_, kind, _clip(text), line))
        return len(self.steps) - 1

    def calls(self, node: ast.AST | None, parent: int, slot: str) -> None:
        if node is None:
            return
        found = [n for n in ast.walk(node) if isinstance(n, ast.Call)]
        for n in sorted(found, key=lambda n: (n.end_lineno, n.end_col_offset)):
            self.add(parent, slot, self.count(parent, slot), "call", ast.unparse(n), n.lineno)

    def count(self, parent: int, slot: str) -> int:
        return sum(s[1] == parent and s[2] == slot for s in self.steps)

    def body(self, body: list[ast.stmt], parent: int, slot: str) -> None:
        for s in body:
            n = lambda: self.count(parent, slot)
            if isinstance(s, ast.If):
                self.calls(s.test, parent, slot)
                k = self.add(parent, slot, n(), "branch", ast.unparse(s.test), s.lineno)
                self.body(s.body, k, "yes")
                self.body(s.orelse, k, "no")
            elif isinstance(s, ast.Match):
                self.calls(s.subject, parent, slot)
                k = self.add(parent, slot, n(), "match", ast.unparse(s.subject), s.lineno)
                for c in s.cases:
                    arm = self.add(k, "arms", self.count(k, "arms"), "arm", ast.unparse(c.pattern) + (f" if {ast.unparse(c.guard)}" if c.guard else ""), c.pattern.lineno)
                    self.body(c.body, arm, "body")
            elif isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
                head = ast.unparse(s.test) if isinstance(s, ast.While) else f"{ast.unparse(s.target)} in {ast.unparse(s.iter)}"
                self.calls(s.test if isinstance(s, ast.While) else s.iter, parent, slot)
                endless = isinstance(s, ast.While) and isinstance(s.test, ast.Constant) and bool(s.test.value)
                k = self.add(parent, slot, n(), "endless" if endless else "loop", head, s.lineno)
                self.body(s.body, k, "body")
                self.body(s.orelse, k, "done")
            elif isinstance(s, (ast.Try, ast.TryStar)):
                k = self.add(parent, slot, n(), "try", "try", s.lineno)
                self.body(s.body, k, "body")
                for h in s.handlers:
                    arm = self.add(k, "arms", self.count(k, "arms"), "arm", f"except {ast.unparse(h.type)}" if h.type else "except", h.lineno)
                    self.body(h.body, arm, "body")
                self.body(s.orelse, k, "after")
                self.body(s.finalbody, k, "finally")
            elif isinstance(s, (ast.Return, ast.Raise, ast.Break, ast.Continue)):
                self.calls(getattr(s, "value", None) or getattr(s, "exc", None), parent, slot)
                self.add(parent, slot, n(), "exit", ast.unparse(s), s.lineno)
            elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                k = self.add(parent, slot, n(), "nested", s.name, s.lineno)
                self.body(s.body, k, "body")
            elif isinstance(s, (ast.With, ast.AsyncWith)):
                for i in s.items:
                    self.calls(i.context_expr, parent, slot)
                self.body(s.body, parent, slot)
            elif not isinstance(s, ast.ClassDef):
                self.calls(s, parent, slot)


def edges(steps: list[tuple]) -> list[tuple[int, int, str]]:
    """(src, dst, label) of a function's chart; step 0 starts it, -1 is its end."""
    kids: dict[tuple[int, str], list[tuple]] = {}
    for s in steps[1:]:
        kids.setdefault((s[1], s[2]), []).append(s)
    out: list[tuple[int, int, str]] = []

    def flow(parent: int, slot: str, ends: list[tuple[int, str]], loop) -> list[tuple[int, str]]:
        """Draw a list of steps after open ends (step, label); returns the ends it leaves open."""
        for s in kids.get((parent, slot), []):
            k, kind = s[0], s[4]
            if kind == "nested":
                flow_to(k)
                continue
            if not ends:
                break  # never reached
            if kind == "try":
                ends = try_(k, ends, loop)
                continue
            out.extend((a, k, label) for a, label in ends)
            ends = [(k, "")]
            if kind == "branch":
                ends = flow(k, "yes", [(k, "yes")], loop) + flow(k, "no", [(k, "no")], loop)
            elif kind == "match":
                ends, last = [], False
                for arm in kids.get((k, "arms"), []):
                    ends += flow(arm[0], "body", [(k, arm[5])], loop)
                    last = arm[5] == "_" or arm[5].isidentifier() and arm[5] not in ("None", "True", "False")
                if not last:
                    ends.append((k, "no"))
            elif kind in ("loop", "endless"):
                breaks: list[tuple[int, str]] = []
                back = flow(k, "body", [(k, "loop")], (k, breaks))
                out.extend((a, k, label) for a, label in back)
                ends = (flow(k, "done", [(k, "done")], loop) if kind == "loop" else []) + breaks
            elif kind == "exit":
                word = s[5].split()[0]
                if word == "break" and loop:
                    loop[1].append((k, ""))
                elif word == "continue" and loop:
                    out.append((k, loop[0], ""))
                else:
                    out.append((k, -1, word))
                ends = []
        return ends

    def try_(k: int, ends: list, loop) -> list:
        body = flow(k, "body", ends, loop)
        after = flow(k, "after", body, loop) if body else []
        for arm in kids.get((k, "arms"), []):
            after += flow(arm[0], "body", [(a, arm[5]) for a, _ in ends], loop)
        return flow(k, "finally", after, loop)

    def flow_to(k: int) -> None:
        out.extend((a, -1, label) for a, label in flow(k, "body", [(k, "")], None))

    flow_to(0)
    return sorted(set(out))


def functions(text: str) -> list[tuple[str, list[tuple]]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple[str, list[tuple]]] = []

    def visit(body: list[ast.stmt], prefix: str) -> None:
        for s in body:
            if isinstance(s, ast.ClassDef):
                visit(s.body, f"{prefix}{s.name}.")
            elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append((f"{prefix}{s.name}", _Walk(s).steps))

    visit(tree.body, "")
    return out


def _rows(files: DataFrame, schema: str, rows) -> DataFrame:
    kinds = {"string": pa.string(), "int": pa.int32()}
    names = [(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            got = [(p, fn, *r) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for fn, steps in functions(t or "") for r in rows(steps)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], t) for i, (_, t) in enumerate(names)], [n for n, _ in names])

    return files.select(F.col("path").cast("string"), F.col("content").cast("string")).mapInArrow(run, schema)


def steps(files: DataFrame) -> DataFrame:
    """Steps of the functions of Python files (path, content)."""
    return _rows(files, STEPS, lambda s: s)


def chart_edges(files: DataFrame) -> DataFrame:
    return _rows(files, EDGES, edges)


def coverage(steps_: DataFrame) -> DataFrame:
    """How many steps of each kind a function has."""
    return counts_by(steps_, ["path", "fn"], "kind", ("branch", "match", "loop", "endless", "try", "call", "exit", "nested"))


def counts_by(rows: DataFrame, by: list[str], kind: str, kinds: tuple[str, ...]) -> DataFrame:
    """(by, a column for each kind): how many rows of each kind a group has."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def mermaid(steps_: list[tuple], edges_: list[tuple[int, int, str]]) -> str:
    """A flowchart of one function."""
    shapes = {"branch": "{{{}}}", "match": "{{{}}}", "loop": "{{{}}}", "endless": "{{{}}}", "exit": "([{}])", "function": "([{}])"}
    safe = lambda t: '"' + t.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;") + '"'
    used = {x for a, b, _ in edges_ for x in (a, b)}
    lines = ["flowchart TD"] + [f"  s{s[0]}{shapes.get(s[4], '[{}]').format(safe(s[5]))}" for s in steps_ if s[0] in used or not s[0]]
    if -1 in used:
        lines.append('  end_(["end"])')
    name = lambda k: "end_" if k < 0 else f"s{k}"
    return "\n".join(lines + [f"  {name(a)} -->{'|' + safe(label) + '|' if label else ''} {name(b)}" for a, b, label in edges_])
