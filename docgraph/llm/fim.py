"""Fill-in-middle: a text is cut into prefix, middle and suffix, which change places between sentinels.

A text becomes a rope (rope.py), is split at two ranks of its units, and the three parts are joined anew with the
sentinels as leaves. The way back makes a rope of the output, finds the sentinels in it, splits at them and joins the parts
in their first order. Forms: plain (as it was), psm (prefix, suffix, middle) and spm (suffix, prefix, middle). Texts that
hold a sentinel stay plain; no other text can give rise to one, as each begins with a sign that it doesn't hold again.

Where to cut and which form to take comes with each row, so that reruns agree. Each row is on its own: nothing is shuffled.

Edge cases: a null or empty text stays plain and comes out empty; a null draw leaves the text plain; cuts beyond the text's
end count as its end, and the smaller cut is the prefix's; a text of any length is taken whole; repeated rows and ids keep
their rows; an empty table gives no rows; other columns of docs come along, but for those called as columns of the result,
which these replace.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm import rope
from docgraph.llm.common import free_name, table

#: Before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED = 1


def transform(text: str, form: str | None, cuts: tuple[int | None, int | None], unit: re.Pattern | None = None, sentinels: tuple[str, str, str] = SENTINELS) -> tuple[str, str, int, int | None, int | None]:
    """(output, form, units, code points of the prefix, of the middle); cuts are ranks of units."""
    whole = rope.build(text, unit)
    if not text or form not in (PSM, SPM) or None in cuts or any(s in text for s in sentinels):
        return text, PLAIN, whole.units, None, None
    low, high = sorted(min(c, whole.units) for c in cuts)
    before, suffix = rope.split(whole, high)
    prefix, middle = rope.split(before, low)
    p, s, m = map(rope.Leaf, sentinels)
    out = rope.concat(p, prefix, s, suffix, m, middle) if form == PSM else rope.concat(s, suffix, p, prefix, m, middle)
    return rope.text_of(out), form, whole.units, prefix.points, middle.points


def restore(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text that transform() made this output of."""
    if form == PLAIN:
        return output
    p, s, m = sentinels
    parts, left = {}, rope.build(output)
    # the parts from the last to the first: each begins behind its sentinel
    for name in (m, s, p) if form == PSM else (m, p, s):
        at = rope.find(left, name)
        if at < 0:
            raise ValueError(f"no {name} in an output of form {form}")
        left, part = rope.split(left, at, by_units=False)
        _, parts[name] = rope.split(part, len(name), by_units=False)
    if left.points:
        raise ValueError("text before the first sentinel")
    return rope.text_of(rope.concat(parts[p], parts[m], parts[s]))


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema), *more])


def to_fim(docs: DataFrame, form: Column, low: Column, high: Column, unit: str | None = None, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs with fim_text, fim_form, fim_units, prefix_chars and middle_chars instead of text.

    form, low, high: the form and the two cuts that each row is to have; unit: a pattern whose matches aren't cut."""
    pattern = None if unit is None else re.compile(unit)
    names = []
    for name in ("form", "low", "high"):
        names.append(free_name([*docs.columns, *names], name))
    made = ("fim_text", "fim_form", "fim_units", "prefix_chars", "middle_chars")
    rest = docs.drop("text", *made)
    kept = rest.columns
    drawn = docs.withColumns({names[0]: form.cast("string"), names[1]: low.cast("long"), names[2]: high.cast("long")}).withColumn("text", F.col("text").cast("string"))

    def run(batches):
        for batch in batches:
            text, *draws = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", *names))
            out = [transform(t or "", f, (a, b), pattern, sentinels) for t, f, a, b in zip(text, *draws)]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            own = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([o[k] for o in out], t) for k, t in enumerate(kinds))], [*kept, *made])

    return drawn.mapInArrow(run, _schema(rest, "fim_text string", "fim_form string", "fim_units bigint", "prefix_chars bigint", "middle_chars bigint"))


def from_fim(fim: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """fim with the texts (`restored`) rebuilt from fim_text and fim_form."""

    fim = fim.drop("restored")

    def run(batches):
        for batch in batches:
            text, form = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("fim_text", "fim_form"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([restore(t, f, sentinels) for t, f in zip(text, form)], pa.string())], [*batch.schema.names, "restored"])

    return fim.mapInArrow(run, _schema(fim, "restored string"))


def draws(doc_id: Column, n: Column, seed: int = SEED) -> dict[str, Column]:
    """Form and cuts by the SHA-256 of seed and doc_id (null: no characters): nine in ten, of which one in five is spm."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    return {"form": F.when(h[2] % 100 >= 90, PLAIN).when(h[3] % 100 < 20, SPM).otherwise(PSM), "low": h[0] % (n + 1), "high": h[1] % (n + 1)}


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fim = to_fim(docs, **draws(F.col("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return from_fim(fim).select(
        "doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), "prefix_chars", "middle_chars", digest("fim_text").alias("output_sha256"), digest("restored").alias("restored_sha256")
    )


#: The same by substrings.
ORACLE_SQL = """
with h as (select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n, sha256('1:' || coalesce(doc_id::varchar, '')) as x from documents),
c as (
  select *, ('0x' || x[1:8])::bigint % (n + 1) as a, ('0x' || x[9:16])::bigint % (n + 1) as b, case
    when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || x[17:24])::bigint % 100 >= 90 then 'plain'
    when ('0x' || x[25:32])::bigint % 100 < 20 then 'spm' else 'psm' end as form
  from h),
p as (select *, t[:least(a, b)] as pre, t[least(a, b) + 1 : greatest(a, b)] as mid, t[greatest(a, b) + 1 :] as suf from c)
select doc_id, n, form, case when form <> 'plain' then least(a, b) end as prefix_chars, case when form <> 'plain' then greatest(a, b) - least(a, b) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256
from p
"""
