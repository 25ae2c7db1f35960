"""Text scalars as column expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALNUM = r"\p{IsAlphabetic}\p{N}"
#: Characters that Unicode calls white space.
WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = f"[{WHITE}]+"
#: Extensions of C and C++ headers.
HEADERS = ("h", "hpp", "hh", "hxx")
#: File stems that stand for their directory.
DIRECTORY_STEMS = ("mod", "__init__", "index")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_edges(c: Column) -> Column:
    """Without what is not alphanumeric at either end."""
    return F.regexp_replace(F.regexp_replace(c, f"^[^{ALNUM}]+", ""), f"[^{ALNUM}]+$", "")


def tokenize(c: Column | str) -> Column:
    """Distinct lower-case words in order, edges trimmed, inner marks kept."""
    words = F.transform(F.split(F.lower(_col(c)), SPACE), trim_edges)
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def prompt_tokens(c: Column | str) -> Column:
    """tokenize without words of one character."""
    return F.filter(tokenize(c), lambda w: F.length(w) > 1)


def field_words(c: Column | str) -> Column:
    """Runs of alphanumeric characters of a lower-cased field."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(f"[{ALNUM}]+"), F.lit(0))


def word_count(c: Column | str) -> Column:
    """Number of words between white space; ! to ~ are told first, as most characters of most texts are among them."""
    return F.regexp_count(_col(c), F.lit(f"[!-~[^{WHITE}]]++"))


def name_words(c: Column | str) -> Column:
    """Words of an identifier: split at _ and -, at lower before upper, and before the last upper of a run."""
    cut = F.regexp_replace(_col(c), r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", "_")
    return F.filter(F.split(F.lower(cut), "[_-]"), lambda w: w != "")


#: Latin letters with marks by what they fold to.
LATIN = {
    "a": "àáâãäåāăą", "ae": "æ", "c": "çćĉċč", "d": "ďđð", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥħ", "i": "ìíîïĩīĭįı", "ij": "ĳ", "j": "ĵ", "k": "ķĸ", "l": "ĺļľŀł",
    "n": "ñńņňŉŋ", "o": "òóôõöøōŏő", "oe": "œ", "r": "ŕŗř", "s": "śŝşšſ", "ss": "ß", "t": "ţťŧ", "th": "þ", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}
#: Cyrillic letters (Ukrainian national system, Russian letters added).
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "h", "ґ": "g", "д": "d", "е": "e", "є": "ie", "ж": "zh", "з": "z", "и": "y", "і": "i", "ї": "i", "й": "i",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch",
    "ш": "sh", "щ": "shch", "ь": "", "ю": "iu", "я": "ia", "ё": "e", "ъ": "", "ы": "y", "э": "e",
}
LONGEST_SLUG = 200


def fold(c: Column | str) -> Column:
    """Lower case, Latin marks dropped, Cyrillic spelled in Latin letters."""
    table = {letter: out for out, letters in LATIN.items() for letter in letters} | CYRILLIC
    single = {k: v for k, v in table.items() if len(v) == 1}
    out = F.translate(F.lower(_col(c)), "".join(single), "".join(single.values()))
    for k, v in table.items():
        if k not in single:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def slugify(c: Column | str) -> Column:
    """Identifier of a name: folded, runs of other characters one underscore; empty or overlong ones carry a hash."""
    c = _col(c)
    slug = F.regexp_replace(F.regexp_replace(fold(F.regexp_replace(c, r"(?<=[Ѐ-ӿ])['’ʼ](?=[Ѐ-ӿ])|\p{M}", "")), "[^a-z0-9]+", "_"), "^_|_$", "")
    mark = F.substring(F.sha2(c, 256), 1, 16)
    return F.when(slug == "", F.concat(F.lit("page_"), mark)).when(F.length(slug) > LONGEST_SLUG, F.concat(F.regexp_replace(F.substring(slug, 1, LONGEST_SLUG), "_+$", ""), F.lit("_"), mark)).otherwise(slug)


def title_case(c: Column | str) -> Column:
    """Each word between white space: first letter upper, rest lower."""
    return F.initcap(_col(c))


def one_line(c: Column | str) -> Column:
    """Without terminal escapes, controls and direction marks; white space runs are one space."""
    c = F.regexp_replace(_col(c), "\\x1b\\[[0-9;?]*[ -/]*[@-~]", "")
    c = F.regexp_replace(c, r"[\p{Cc}&&[^\t\n\r\x0B\f]]|[‎‏‪-‮⁦-⁩]", "")
    return F.trim(F.regexp_replace(c, SPACE, " "))


def clip(c: Column | str, most: int) -> Column:
    """At most `most` characters, the last an ellipsis if cut."""
    c = _col(c)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def token_estimate(c: Column | str) -> Column:
    return F.floor(F.length(_col(c)) / 4).cast("long")


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def extension(path: Column | str) -> Column:
    """Lower-case extension of a file name, empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"[^.]\.([^.]+)$", 1))


def derive_name(path: Column | str) -> Column:
    """Name of a page without a title: the file name up to its first dot, in words."""
    return title_case(F.trim(F.translate(F.substring_index(basename(path), ".", 1), "_-", "  ")))


def module_stem(path: Column | str) -> Column:
    """Name of the module in a file: the file's stem, or its directory's for directory modules."""
    path = _col(path)
    stem = F.substring_index(basename(path), ".", 1)
    parent = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    return F.lower(F.when(stem.isin(*DIRECTORY_STEMS) & path.contains("/"), parent).otherwise(stem))


def source_rank(path: Column | str) -> Column:
    """Headers come before other headers before sources before scripts."""
    e = extension(path)
    return F.when(e == "h", 0).when(e.isin("hpp", "hh", "hxx"), 1).when(e.isin("sh", "bash"), 3).otherwise(2)


def is_test_path(path: Column | str) -> Column:
    return _col(path).rlike(r"(^|/)tests/|(^|/)test_[^/]*$|_tests?\.[^/]*$")


def owner_key(owner: Column | str) -> Column:
    """Last segment of an owner without its generic arguments."""
    return F.regexp_extract(F.regexp_replace(_col(owner), r"<.*$", ""), r"([^.:]*)$", 1)


def qualified_name(owner: Column | str, name: Column | str) -> Column:
    owner, name = _col(owner), _col(name)
    return F.when(owner.isNull(), name).otherwise(F.concat(owner, F.lit("::"), name))


def span(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def norm_path(path: Column | str) -> Column:
    """Path with . and .. resolved; null if it climbs above its root."""
    start = F.array().cast("array<string>")
    folded = F.aggregate(
        F.split(_col(path), "/"),
        start,
        lambda done, part: F.when(done.isNull() | (part == ".") | (part == ""), done)
        .when((part == "..") & (F.size(done) > 0), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(part == "..", F.lit(None).cast("array<string>"))
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.when(folded.isNotNull(), F.array_join(folded, "/"))


def resolve_link(source: Column | str, target: Column | str) -> Column:
    """Path that a relative link of a page means; null for other schemes, anchors and what climbs too high."""
    source, target = _col(source), F.regexp_replace(_col(target), r"[#?].*$", "")
    folder = F.regexp_extract(source, r"^(.*/)?[^/]*$", 1)
    joined = F.when(target.startswith("/"), target).otherwise(F.concat(folder, target))
    return F.when((target != "") & ~target.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:|^//"), norm_path(joined))


def link_target(c: Column | str) -> Column:
    """What a double-bracket link points to: before its first bar."""
    return F.trim(F.substring_index(_col(c), "|", 1))


def link_display(c: Column | str) -> Column:
    return F.trim(F.substring_index(_col(c), "|", -1))


def names_file(path: Column | str, token: Column | str) -> Column:
    """Whether a token with a dot in its last part is a path or the end of one."""
    path, token = F.lower(_col(path)), _col(token)
    return F.substring_index(token, "/", -1).contains(".") & ((path == token) | path.endswith(F.concat(F.lit("/"), token)))


def field_hit(words: Column, token: Column) -> Column:
    """Whether every alphanumeric part of the token begins some word of the field."""
    parts = F.regexp_extract_all(token, F.lit(f"[{ALNUM}]+"), F.lit(0))
    return F.forall(parts, lambda p: F.exists(words, lambda w: w.startswith(p)))


def literal_hit(words: Column, token: str) -> Column:
    """field_hit for a token known on the driver."""
    import re

    parts = [p for p in re.split(r"[\W_]+", token) if p]
    out = F.lit(True)
    for p in parts:
        out = out & _some_starts(words, p)
    return out


def _some_starts(words: Column, part: str) -> Column:
    return F.exists(words, lambda w: w.startswith(part))


STEM_TIER = 0.3


def field_tier(words: Column, stems: Column, token: Column, token_stems: Column) -> Column:
    """1 for a hit, STEM_TIER if every part's stem is a stem of the field, else 0."""
    return F.when(field_hit(words, token), 1.0).when(F.forall(token_stems, lambda s: F.array_contains(stems, s)), STEM_TIER).otherwise(0.0)


def occurrences(text: Column, word: str) -> Column:
    """Occurrences of a literal that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def snippet(text: Column | str, tokens: list[str], around: int = 60) -> Column:
    """Text about the first occurrence of any token, white space as single spaces, cuts marked; null without one."""
    text = _col(text)
    low = F.lower(text)
    at = [F.locate(t, low) for t in tokens]
    ends = F.array(*[F.struct(F.when(p > 0, p).alias("at"), F.lit(-len(t)).alias("n")) for p, t in zip(at, tokens)])
    best = F.array_min(F.filter(ends, lambda e: e["at"].isNotNull()))
    lo, hi = F.greatest(best["at"] - around, F.lit(1)), F.least(best["at"] - best["n"] + around, F.length(text) + 1)
    body = F.trim(F.regexp_replace(text.substr(lo, hi - lo), SPACE, " "))
    return F.when(best.isNotNull(), F.concat(F.when(lo > 1, F.lit("…")).otherwise(""), body, F.when(hi <= F.length(text), F.lit("…")).otherwise("")))


def first_sentence(c: Column | str) -> Column:
    """Up to the first . ! or ? before white space or the end that no capital initial precedes; else all."""
    text = F.trim(F.regexp_replace(_col(c), SPACE, " "))
    found = F.regexp_extract(text, r"^(.*?(?<!(?:^|[\s.])\p{Lu})[.!?])(?:\s|$)", 1)
    return F.when(found != "", found).otherwise(text)


def front_matter(c: Column | str, key: str) -> Column:
    """Value of a key in the block between --- lines that opens a page."""
    block = F.regexp_extract(_col(c), r"(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)", 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(block, rf"(?m)^{key}[ \t]*:[ \t]*(.*?)[ \t]*$", 1), "^[\"']|[\"']$", "")), F.lit(""))


def heading_level(line: Column | str) -> Column:
    """Level 1 to 6 of a heading line, else 0."""
    return F.length(F.regexp_extract(_col(line), r"^ {0,3}(#{1,6})[ \t]+\S", 1))


def heading_text(line: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(_col(line), r"^ {0,3}#{1,6}[ \t]+(.*)$", 1), r"(^|[ \t])#+[ \t]*$", ""))


def kind_filter(kind: Column | str, wanted: str, memory: Column | None = None) -> Column:
    """Rows of an exact kind, or of the groups `code` and `docs`; notes pass both groups."""
    kind = _col(kind)
    note = memory if memory is not None else F.lit(False)
    if wanted == "code":
        return kind.startswith("code:") | note
    if wanted == "docs":
        return kind.isin("markdown", "text") | note
    return kind == wanted


def tag_argument(tag: str) -> str:
    tag = tag.strip().lstrip("#").rstrip("/").lower()
    if not tag:
        raise ValueError("empty tag")
    return tag


def tag_filter(tags: Column | str, tag: str) -> Column:
    """Rows with the tag or a tag under it."""
    tag = tag_argument(tag)
    return F.exists(_col(tags), lambda t: (t == tag) | t.startswith(f"{tag}/"))


def arity_fits(args: Column, least: Column, most: Column, receiver: Column) -> Column:
    """Whether a call with so many arguments fits; unknown numbers fit."""
    return args.isNull() | least.isNull() | ((args >= least) & (most.isNull() | (args <= most + receiver.cast("int"))))


def is_identifier(word: str) -> bool:
    """Whether a query word is written like a name in code."""
    import re

    word = re.sub(r"^[^\w]+|[^\w]+$", "", word)
    return bool(word) and not word[0].isdigit() and all(re.fullmatch(r"\w+", p) for p in word.split("::")) and ("_" in word or "::" in word or any(c.isupper() for c in word[1:]))


def is_header_import(c: Column | str) -> Column:
    return _col(c).rlike(r"^<|\.(h|hpp|hh|hxx)>?$")


def refers_to_module(body: Column, stem: Column, ext: Column) -> Column:
    """Whether text mentions a module the way code does: stem::, ::stem, mod stem; or stem.ext."""
    quoted = F.concat(F.lit(r"\Q"), stem, F.lit(r"\E"))
    at, end = F.lit(r"(?<![A-Za-z0-9_])"), F.lit(r"(?![A-Za-z0-9_])")
    pattern = F.concat(at, quoted, F.lit("::|::"), quoted, end, F.lit(r"(?!\()|"), at, F.lit(r"mod\s+"), quoted, F.lit(r"\s*[;{]|"), at, quoted, F.lit(r"\.\Q"), ext, F.lit(r"\E"), end)
    return F.regexp_like(body, pattern)


def mermaid_label(c: Column | str) -> Column:
    """Text safe inside a quoted chart label."""
    out = _col(c)
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("#", "&num;"), ("\n", " ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def yaml_string(c: Column | str) -> Column:
    out = F.replace(F.replace(_col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), out, F.lit('"'))


def link_text(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"([\[\]\\])", r"\\$1")


def fingerprint(*parts: Column) -> Column:
    """Hash of the parts with their lengths, so that no two lists of parts read alike."""
    return F.sha2(F.concat(*[F.concat(F.length(F.coalesce(p.cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p.cast("string"), F.lit(""))) for p in parts]), 256)


def trust(origin: Column, edited: Column, mine: Column) -> Column:
    """How far a note is trusted: local, own or edited here, other."""
    return F.when(origin.isNull() | (origin == "local"), 1.0).when(mine | edited, 0.8).otherwise(0.5)


def map_slug(c: Column | str) -> Column:
    """Slug of a name on a map: runs of ASCII letters and digits joined by _, `fn` if there are none."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "_"), "^_|_$", "")
    return F.when(slug == "", "fn").otherwise(slug)


def unfence(c: Column | str) -> Column:
    """A code body without the fence lines around it."""
    return F.regexp_replace(_col(c), r"(?s)^\s*(`{3,}|~{3,})[^\n]*\n(.*?)\n?\1\s*$", "$2")
