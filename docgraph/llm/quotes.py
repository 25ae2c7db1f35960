"""Quotation linking for chat formatting, with DataFrame functions only.

A line's quote level is the number of '>' before its text. Consecutive lines of one level above 0 form a quoted
passage. Passages and their lines are normalised (lower case, runs of white space as one space, trimmed) and hashed;
so are the lines, paragraphs and whole bodies that messages say themselves. A passage is linked to the earliest
message of its conversation that says it and comes before the quoting one. A message replies to the message of its
lowest-level, then longest, then latest linked unit. A conversation is ordered by thread (the turn its chain of
replies starts from), then by turn, so that every reply comes after what it answers and beside its thread.

Edge cases: a null text is an empty body; rows with a null conv_id or turn are kept, linked with nothing and each
its own thread; rows equal in conv_id, turn, role and text are one message; two messages of one turn are ordered by
role and text; lines without text match nothing; an empty table gives no rows; other columns don't matter. An
introducing line ("... wrote:") right before a quoted line belongs to the quote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgraph.llm.common import materialize, table

QUOTED = r"^[ \t]*(>[ \t]*)+"
INTRO = r"(wrote|écrit|schrieb|escribió) ?:[ \t]*$"
BLANK = r"[ \t\n\r\f\x0B]+"


def _norm(c):
    return F.trim(F.regexp_replace(F.lower(c), BLANK, " "))


def _strip(c):
    return F.regexp_replace(F.regexp_replace(c, r"^[ \t\n\r\f\x0B]+", ""), r"[ \t\n\r\f\x0B]+$", "")


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, max_level, n_passages, n_linked, reply_to, thread, position for each message."""
    base = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    base = base.withColumn("mid", F.md5(F.concat_ws("\x1f", F.coalesce("role", F.lit("\x1e")), "text")))
    has = F.col("text").rlike(r"(^|\n)[ \t]*>")
    plain = base.filter(~has).withColumn("body", _strip(F.col("text"))).withColumn("max_level", F.lit(0)).withColumn("n_passages", F.lit(0).cast("long"))

    lines = base.filter(has).select("conv_id", "turn", "role", "mid", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    marks = F.regexp_extract("line", QUOTED, 0)
    lines = lines.withColumn("level", F.length(F.regexp_replace(marks, r"[ \t]", ""))).withColumn("said", F.expr("substr(line, length(regexp_extract(line, '^[ \\\\t]*(>[ \\\\t]*)+', 0)) + 1)"))
    order = W.partitionBy("conv_id", "turn", "mid").orderBy("ln")
    lines = lines.withColumn("next", F.lead("level").over(order)).withColumn("change", (F.col("level") != F.coalesce(F.lag("level").over(order), F.lit(-1))).cast("int"))
    lines = lines.withColumn("island", F.sum("change").over(order.rowsBetween(W.unboundedPreceding, 0)))
    own = (F.col("level") == 0) & ~((F.coalesce("next", F.lit(0)) > 0) & F.col("line").rlike("(?i)" + INTRO))
    quoting = lines.groupBy("conv_id", "turn", "role", "mid").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(own, F.struct("ln", "line")))), lambda x: x["line"]), "\n").alias("body"),
        F.max("level").alias("max_level"),
        F.countDistinct(F.when(F.col("level") > 0, F.col("island"))).alias("n_passages"),
    )
    quoting = quoting.withColumn("body", _strip(F.col("body")))
    keep = ["conv_id", "turn", "role", "mid", "body", "max_level", "n_passages"]
    said = plain.select(keep).unionByName(quoting.select(keep))

    passages = lines.filter("level > 0").groupBy("conv_id", "turn", "mid", "island", "level").agg(F.sort_array(F.collect_list(F.struct("ln", "said"))).alias("parts"))
    units = passages.withColumn("whole", F.array_join(F.transform("parts", lambda x: x["said"]), " "))
    units = units.select("conv_id", "turn", "mid", "island", "level", F.explode(F.array_union(F.array("whole"), F.transform("parts", lambda x: x["said"]))).alias("unit"))
    units = units.withColumn("unit", _norm(F.col("unit"))).filter("unit != ''").withColumn("hash", F.md5("unit")).withColumn("size", F.length("unit"))

    # a row for each thing said and conversation, whoever repeats it
    talk = said.join(units.select("conv_id").distinct(), "conv_id", "left_semi")
    things = F.array_union(F.array("body"), F.array_union(F.split("body", r"\n[ \t\r]*\n"), F.split("body", "\n")))
    originals = talk.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(things, lambda x: F.md5(_norm(x))))).alias("hash"))
    originals = originals.groupBy("conv_id", "hash").agg(F.min("turn").alias("from_turn"))
    linked = units.join(originals, ["conv_id", "hash"]).filter("from_turn < turn")
    best = F.struct(-F.col("level"), F.col("size"), F.col("from_turn").alias("from_turn"))
    links = linked.groupBy("conv_id", "turn", "mid").agg(F.max(best)["from_turn"].alias("reply_to"), F.countDistinct("island").alias("n_linked"))
    l = links.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("mid").alias("m"), "reply_to", "n_linked")
    out = said.join(l, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")) & (F.col("mid") == F.col("m")), "left").drop("c", "t", "m")
    out = out.withColumn("n_linked", F.coalesce("n_linked", F.lit(0).cast("long")))
    out = _ordered(_threads(materialize(out, "linked")))
    return out.select("conv_id", "turn", "role", "body", "max_level", "n_passages", "n_linked", "reply_to", "thread", "position")


def _threads(out: DataFrame) -> DataFrame:
    """Add thread: the turn at the start of the chain of replies, by doubling the jumps along it."""
    step = out.filter("reply_to is not null").groupBy("conv_id", "turn").agg(F.min("reply_to").alias("to"))
    step = materialize(step, "step")
    while True:
        up = step.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("to").alias("further"))
        # `to` of a turn that itself has a `to` jumps twice as far
        moved = materialize(step.join(up, (F.col("conv_id") == F.col("c")) & (F.col("to") == F.col("t")), "left").select("conv_id", "turn", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "step")
        if moved.filter("moved").isEmpty():
            break
        step = moved.drop("moved")
    ends = step.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "to")
    # a message of a turn takes its own reply's end, not that of another message of the same turn
    root = out.join(ends, (F.col("conv_id") == F.col("c")) & (F.col("reply_to") == F.col("t")), "left")
    return root.withColumn("thread", F.coalesce("to", "reply_to", "turn")).drop("c", "t", "to")


def _ordered(out: DataFrame) -> DataFrame:
    """Add position within the conversation, from 1, counted in three levels so that no conversation is one task's."""
    out = out.withColumn("b1", F.expr("thread div 256")).withColumn("b2", F.expr("turn div 4096"))
    fine = out.groupBy("conv_id", "b1", "thread", "b2").agg(F.count("*").alias("n"))
    w2 = W.partitionBy("conv_id", "b1").orderBy("thread", "b2").rowsBetween(W.unboundedPreceding, 0)
    fine = fine.withColumn("off2", F.sum("n").over(w2) - F.col("n"))
    w1 = W.partitionBy("conv_id").orderBy("b1").rowsBetween(W.unboundedPreceding, 0)
    coarse = fine.groupBy("conv_id", "b1").agg(F.sum("n").alias("n1")).withColumn("off1", F.sum("n1").over(w1) - F.col("n1"))
    coarse = coarse.select(F.col("conv_id").alias("c"), F.col("b1").alias("cb"), "off1")
    fine = fine.join(coarse, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("b1").eqNullSafe(F.col("cb")))
    fine = fine.select(F.col("conv_id").alias("c"), F.col("thread").alias("t"), F.col("b2").alias("tb"), (F.col("off1") + F.col("off2")).alias("off"))
    rank = F.row_number().over(W.partitionBy("conv_id", "thread", "b2").orderBy("turn", "role", "mid"))
    out = out.withColumn("rn", rank).join(fine, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("thread").eqNullSafe(F.col("t")) & F.col("b2").eqNullSafe(F.col("tb")))
    return out.withColumn("position", (F.col("off") + F.col("rn")).cast("long"))


def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


ORACLE_SQL = r"""
with recursive base as (
  select distinct conv_id, turn, role, coalesce(text, '') as text from conversations),
msg as (select *, md5(concat_ws(chr(31), coalesce(role, chr(30)), text)) as mid from base),
l0 as (
  select conv_id, turn, role, mid, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as ln from msg),
l1 as (
  select *, regexp_extract(line, '^[ \t]*(>[ \t]*)+') as marks from l0),
l2 as (
  select *, length(regexp_replace(marks, '[ \t]', '', 'g')) as level, substr(line, length(marks) + 1) as said from l1),
l3 as (
  select *, lead(level) over w as nxt, case when level <> coalesce(lag(level) over w, -1) then 1 else 0 end as chg
  from l2 window w as (partition by conv_id, turn, mid order by ln)),
lines as (select *, sum(chg) over (partition by conv_id, turn, mid order by ln) as island from l3),
said as (
  select conv_id, turn, role, mid,
    regexp_replace(regexp_replace(coalesce(string_agg(case when level = 0 and not (coalesce(nxt, 0) > 0 and regexp_matches(line, '(?i)(wrote|écrit|schrieb|escribió) ?:[ \t]*$')) then line end, chr(10) order by ln), ''),
      '^[ \t\n\r\f\x0B]+', ''), '[ \t\n\r\f\x0B]+$', '') as body,
    max(level) as max_level, count(distinct case when level > 0 then island end) as n_passages
  from lines group by all),
passages as (
  select conv_id, turn, mid, island, level, string_agg(said, ' ' order by ln) as whole, list(said order by ln) as parts
  from lines where level > 0 group by all),
units as (
  select conv_id, turn, mid, island, level, trim(regexp_replace(lower(u), '[ \t\n\r\f\x0B]+', ' ', 'g')) as unit
  from (select *, unnest(list_append(parts, whole)) as u from passages)),
things as (
  select distinct conv_id, turn, trim(regexp_replace(lower(u), '[ \t\n\r\f\x0B]+', ' ', 'g')) as unit
  from (select conv_id, turn, unnest(list_concat([body], list_concat(string_split_regex(body, '\n[ \t\r]*\n'), string_split(body, chr(10))))) as u from said)),
originals as (select conv_id, unit, min(turn) as from_turn from things group by all),
linked as (
  select u.*, o.from_turn, row_number() over (partition by u.conv_id, u.turn, u.mid order by level, length(u.unit) desc, o.from_turn desc) as rn
  from units u join originals o using (conv_id, unit) where unit <> '' and o.from_turn < u.turn),
links as (
  select conv_id, turn, mid, max(case when rn = 1 then from_turn end) as reply_to, count(distinct island) as n_linked from linked group by all),
m as (
  select s.*, l.reply_to, coalesce(l.n_linked, 0) as n_linked
  from said s left join links l on s.conv_id = l.conv_id and s.turn = l.turn and s.mid = l.mid),
step as (select conv_id, turn, min(reply_to) as up from m where reply_to is not null group by all),
chain(conv_id, turn, mid, hop) as (
  select conv_id, turn, mid, coalesce(reply_to, turn) from m
  union
  select c.conv_id, c.turn, c.mid, s.up from chain c join step s on s.conv_id = c.conv_id and s.turn = c.hop where c.hop <> c.turn),
root as (select conv_id, turn, mid, min(hop) as thread from chain group by all)
select m.conv_id, m.turn, m.role, m.body, m.max_level::int as max_level, m.n_passages, m.n_linked, m.reply_to, r.thread,
  row_number() over (partition by m.conv_id order by r.thread, m.turn, m.role, m.mid) as position
from m join root r on m.conv_id is not distinct from r.conv_id and m.turn is not distinct from r.turn and m.mid = r.mid
"""
