"""C and C++ as rows: a reader of tokens, without types or macros.

Comments, strings and preprocessor lines are taken out, the rest is read statement by statement: namespaces and bodies of
types are entered, bodies of functions are skipped for items and read for calls. Declarations and definitions of
functions, types, aliases and values of namespaces are items; an out-of-line definition is owned by its innermost
qualifier. What is declared within a function is no item.
"""

from __future__ import annotations

import re

from docgraph.operators.extract import TEXT_LENGTH, VALUE_LENGTH, Call, File, Item, first_paragraph, first_sentence

TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|R\"([^()\s]*)\(.*?\)\1\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'|^[ \t]*#(?:[^\n\\]|\\.|\\\n)*|[A-Za-z_]\w*|\d(?:[\w.']|(?<=[eEpP])[+-])*|::|->|\.\.\.|<<|>=|<=|==|!=|&&|\|\||[^\s]", re.S | re.M)
WORD = re.compile(r"[A-Za-z_]\w*$")
#: Words that a call or declaration can't be named.
KEYWORDS = {
    "if", "for", "while", "switch", "return", "sizeof", "alignof", "alignas", "catch", "throw", "new", "delete", "do", "else", "case", "goto", "decltype", "noexcept", "static_assert", "co_await",
    "co_return", "co_yield", "static_cast", "dynamic_cast", "const_cast", "reinterpret_cast", "typeid", "defined", "requires", "and", "or", "not", "void", "int", "char", "bool", "float", "double",
    "long", "short", "unsigned", "signed", "auto", "const", "asm", "__attribute__", "explicit",
}
TYPES = ("class", "struct", "union", "enum")
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def _tokens(text: str) -> tuple[list[tuple[str, int]], list[str], list[tuple[int, int, str]]]:
    """(token, line) of the code, included paths, and (first line, last line, text) of comments."""
    tokens, imports, comments, line, at = [], [], [], 1, 0
    for m in TOKEN.finditer(text):
        line += text.count("\n", at, m.start())
        at, t = m.start(), m[0]
        if t.startswith(("//", "/*")):
            comments.append((line, line + t.count("\n"), re.sub(r"^\s*\*+ ?", "", t[2:-2] if t[1] == "*" else t[2:].lstrip("/!<"), flags=re.M).strip("*! \t")))
        elif t.lstrip().startswith("#"):
            if found := re.match(r"\s*#\s*include\s*(?:\"([^\"]+)\"|(<[^>]+>))", t):
                imports.append(found[1] or found[2])
        else:
            tokens.append((t, line))
    return tokens, imports, comments


def _skip(tokens: list[tuple[str, int]], at: int) -> int:
    """Index after the bracket that closes the one at `at`."""
    depth = 0
    for k in range(at, len(tokens)):
        t = tokens[k][0]
        depth += (t in OPEN) - (t in CLOSE)
        if not depth:
            return k + 1
    return len(tokens)


def _angles(tokens: list[str], at: int) -> int:
    """Index after the > that closes the < at `at`, or at + 1 if none does."""
    depth = 0
    for k in range(at, len(tokens)):
        depth += (tokens[k] == "<") - (tokens[k] == ">")
        if not depth:
            return k + 1
        if tokens[k] in (";", "{"):
            break
    return at + 1


def _parts(tokens: list[str]) -> list[list[str]]:
    """Tokens between the commas outside brackets."""
    out, depth = [[]], 0
    for t in tokens:
        depth += (t in "([{<") - (t in ")]}>")
        if t == "," and depth <= 0:
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


def _shown(tokens: list[str]) -> str:
    text = " ".join(tokens)
    text = re.sub(r" ?(::|->|\.|~) ?", r"\1", text)
    text = re.sub(r" ([,;)\]>&*<]|\()", r"\1", text)
    return re.sub(r"([(\[<]) ", r"\1", text)[:TEXT_LENGTH]


def _function(head: list[str]) -> tuple[str, str | None, list[list[str]]] | None:
    """Name, owner written in the declarator and parameters of a function's header, or None if it is none."""
    k = _angles(head, 1) if head[:1] == ["template"] and head[1:2] == ["<"] else 0
    while k < len(head):
        t = head[k]
        if t == "<" and k and WORD.match(head[k - 1]):
            k = _angles(head, k)
            continue
        if t == "=" and "operator" not in head[:k]:
            return None
        if t == "(" and k:
            if head[k - 1] == "operator" and head[k + 1 : k + 2] == [")"]:
                k += 2
                continue
            break
        k += 1
    if k >= len(head) or head[k] != "(":
        return None
    at = k - 1
    if "operator" in head[:k]:
        start = len(head[:k]) - 1 - head[:k][::-1].index("operator")
        name = "operator" + ("" if not WORD.match(head[start + 1]) else " ") + "".join(head[start + 1 : k])
    else:
        while at >= 0 and head[at] == ">":  # a template's arguments
            depth = 0
            while at >= 0:
                depth += (head[at] == ">") - (head[at] == "<")
                at -= 1
                if not depth:
                    break
        start = at
        if at < 0 or not WORD.match(head[at]) or head[at] in KEYWORDS:
            return None
        name = head[at]
        if start and head[start - 1] == "~":
            name, start = "~" + name, start - 1
    owner = head[start - 2] if start > 1 and head[start - 1] == "::" and WORD.match(head[start - 2]) else None
    end = k
    depth = 0
    for j in range(k, len(head)):
        depth += (head[j] == "(") - (head[j] == ")")
        if not depth:
            end = j
            break
    first = start - 2 if owner else start
    # a constructor, destructor or conversion needs no type before it; another function does
    typed = first > 0 or owner is not None or name.startswith(("~", "operator"))
    return (name, owner, _parts(head[k + 1 : end])) if typed or name.isidentifier() else None


def _arity(params: list[list[str]]) -> tuple[int, int | None]:
    params = [p for p in params if p != ["void"]]
    return sum("=" not in p and "..." not in p for p in params), None if any("..." in p for p in params) else len(params)


def _calls(tokens: list[tuple[str, int]], item: int) -> list[Call]:
    out = []
    for k, (t, line) in enumerate(tokens[:-1]):
        if tokens[k + 1][0] != "(" or not WORD.match(t) or t in KEYWORDS:
            continue
        before, prior = (tokens[k - 1][0] if k else ""), (tokens[k - 2][0] if k > 1 else "")
        if WORD.match(before) and before not in KEYWORDS | {"else", "return"}:
            continue  # a declaration
        inner = [x for x, _ in tokens[k + 2 : _skip(tokens, k + 1) - 1]]
        args = None if "..." in inner else len(_parts(inner))
        if before in (".", "->"):
            out.append(Call(item, t, "self" if prior == "this" else "member", prior if WORD.match(prior) and prior != "this" else None, args, line))
        elif before == "::":
            out.append(Call(item, t, "path", prior if WORD.match(prior) else None, args, line))
        else:
            out.append(Call(item, t, "bare", None, args, line))
    return out


def cpp(text: str) -> File:
    """Items, includes and calls of a C or C++ file."""
    tokens, imports, comments = _tokens(text)
    out = File(imports=list(dict.fromkeys(imports)))

    def doc(line: int) -> tuple[str | None, str | None]:
        found, at = [], line - 1
        for first, last, said in reversed(comments):
            if last == at:
                found.append(said)
                at = first - 1
        about = first_paragraph("\n".join(reversed(found)))
        return (first_sentence(about), about) if about and re.search(r"[^\W\d_]{2}", about) else (None, None)

    def add(kind: str, name: str, owner: str | None, head: list[str], start: int, end: int, public: bool, params=None) -> int:
        about = doc(start)
        least, most = _arity(params) if params is not None else (None, None)
        out.items.append(Item(kind, name, owner, _shown(head), start, end, *about, public, least=least, most=most, receiver=kind == "method" and "static" not in head))
        return len(out.items) - 1

    def body(at: int, stop: int, owners: list[str], inside: bool, public: bool) -> None:
        """Statements between two braces; inside: of a type."""
        head: list[str] = []
        start = at
        while at < stop:
            t, line = tokens[at]
            if not head:
                start = line
            if inside and t in ("public", "protected", "private") and at + 1 < stop and tokens[at + 1][0] == ":":
                public, at = t == "public", at + 2
                continue
            if t in ("(", "["):
                end = _skip(tokens, at)
                head.extend(x for x, _ in tokens[at:end])
                at = end
                continue
            if t == ";":
                declaration(head, start, line, owners, inside, public)
                head, at = [], at + 1
                continue
            if t != "{":
                head.append(t)
                at += 1
                continue
            end = _skip(tokens, at)
            last = tokens[end - 1][1]
            plain = head[_angles(head, 1) :] if head[:2] == ["template", "<"] else head
            if "namespace" in plain or plain[:1] == ["extern"]:
                hidden = plain == ["namespace"]
                body(at + 1, end - 1, owners, inside, public and not hidden)
                head, at = [], end
            elif (kind := next((x for x in plain if x in TYPES), None)) and "(" not in plain and "=" not in plain:
                rest = [x for x in plain[plain.index(kind) + 1 :] if x not in TYPES]
                name = next((x for k, x in enumerate(rest) if WORD.match(x) and x != "final" and rest[k + 1 : k + 2] not in (["::"], ["("])), None)
                if name:
                    add("type", name, "::".join(owners) or None, head, start, last, public)
                if kind != "enum":
                    body(at + 1, end - 1, [*owners, name] if name else owners, True, kind != "class" and public)
                if name and end < stop and tokens[end][0] == ";":
                    head, at = [], end + 1
                else:
                    head, at = ["typedef", name or ""] if plain[:1] == ["typedef"] else [], end
            elif found := _function(_without_initialisers(head)):
                name, own, params = found
                chain = own or "::".join(owners) or None
                k = add("method" if chain else "fn", name, chain, _without_initialisers(head), start, last, public and not (chain is None and "static" in head), params)
                out.calls.extend(_calls(tokens[at:end], k))
                head, at = [], end
            else:
                head.append("{}")
                at = end
        return

    def declaration(head: list[str], start: int, end: int, owners: list[str], inside: bool, public: bool) -> None:
        plain = head[_angles(head, 1) :] if head[:2] == ["template", "<"] else head
        owner = "::".join(owners) or None
        if not plain or plain[0] in ("friend", "return", "static_assert") or plain[:1] == ["using"] and "=" not in plain:
            return
        if plain[0] == "using":
            add("type", plain[1], owner, head, start, end, public)
        elif plain[0] == "typedef":
            name = next((x for x in reversed(plain) if WORD.match(x)), None)
            if name:
                add("type", name, owner, head, start, end, public)
        elif found := _function(head):
            name, own, params = found
            add("method" if owner or own else "fn", name, own or owner, head, start, end, public and not (owner is None and "static" in head), params)
        elif not inside and len(plain) > 1 and plain[0] not in TYPES:
            cut = next((k for k, x in enumerate(plain) if x in ("=", "[", "{}", ":")), len(plain))
            name = next((x for x in reversed(plain[:cut]) if WORD.match(x)), None)
            if name and name not in KEYWORDS and cut > 1:
                value = _shown(plain[cut + 1 :]) if plain[cut : cut + 1] == ["="] else ""
                shown = plain[:cut] + (["=", value] if value and len(value) <= VALUE_LENGTH else ["=", value[: VALUE_LENGTH - 1] + "…"] if value else [])
                add("value", name, owner, shown, start, end, public and "static" not in plain)

    body(0, len(tokens), [], False, True)
    return out


def _without_initialisers(head: list[str]) -> list[str]:
    """A header without a constructor's list of initialisers."""
    depth = 0
    for k, t in enumerate(head):
        depth += (t == "(") - (t == ")")
        if t == ":" and not depth and ")" in head[:k]:
            return head[:k]
    return head
