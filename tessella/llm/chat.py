"""Multi-party dialogues from every participant's perspective, in DataFrame operations only.

For each participant of a conversation the whole dialogue is rendered once: that participant's turns as the assistant's, the
others' as turns of named users, system turns as they are. The mask holds the places of the assistant's words, which are
what a model is trained on. Places come from running sums over the turns of one rendering, so a dialogue of any length
costs no more than its turns. Who needs rows of bounded size asks for pieces; their places still count from the start of
the dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..numbering import numbered
from .scratch import Scratch

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """A text that can't open a sign: every "<|" gets a blank after its "<"."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate_perspectives(conversations: DataFrame, piece: int | None = None) -> DataFrame:
    """One row for each conversation and participant: conv_id, participant, n_turns, rendered, mask, n_masked.

    Participants are all roles but ``system``; a conversation without any has no rows. Turns are ordered by turn, then
    role, then text; nulls come first. mask joins "start-end" by commas: the characters of the participant's own words with
    their closing sign; n_masked counts those characters. A null role is a participant without a name (its ``participant``
    is null), a null text is empty, all rows with a null conv_id are one conversation. Rows that repeat all four columns
    count once. A text or a role that holds the opening of a sign ("<|") gets a blank after the "<", and line breaks in a
    role become blanks, so neither can forge a turn. Further columns are ignored; an empty table stays empty.

    With ``piece``, a row holds that many turns at most; a column piece numbers them, and rendered texts in this order,
    put together, are the dialogue, into which the places of the mask still point.
    """
    scratch = Scratch(conversations.sparkSession, "chat")
    text = escaped(F.coalesce(F.col("text"), F.lit(""))).alias("text")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", text).distinct()
    rows, _ = numbered(rows, ["conv_id", "turn", "role", "text"], scratch, "number")
    rows = scratch.cut(rows)
    begins = scratch.cut(rows.groupBy("conv_id").agg(F.min("number").alias("begin")))
    people = rows.where(~F.col("role").eqNullSafe("system")).select(F.col("conv_id").alias("conv"), F.col("role").alias("participant")).distinct()
    people = people.join(begins, F.col("conv").eqNullSafe(F.col("conv_id"))).drop("conv_id")
    turns = rows.join(scratch.cut(people), F.col("conv_id").eqNullSafe(F.col("conv")))
    own = F.col("role").eqNullSafe(F.col("participant"))
    name = F.concat(F.lit("user name="), escaped(F.regexp_replace("role", "[\r\n]", " ")))
    title = F.when(own, "assistant").when(F.col("role").isNull(), "user").when(F.col("role") == "system", "system").otherwise(name)
    turns = turns.select("conv_id", "participant", (F.col("number") - F.col("begin")).alias("nth"), own.alias("own"), F.concat(F.lit(OPEN), title, F.lit("\n")).alias("head"), F.concat("text", F.lit(CLOSE)).alias("body"))
    earlier = Window.partitionBy("conv_id", "participant").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    head, body = F.length("head").cast("long"), F.length("body").cast("long")
    placed = turns.withColumn("begin", F.coalesce(F.sum(head + body + 1).over(earlier), F.lit(0).cast("long")) + head)
    span = F.when(F.col("own"), F.concat_ws("-", F.col("begin"), F.col("begin") + body))
    keys = ["conv_id", "participant"]
    if piece:
        placed, keys = placed.withColumn("piece", F.call_function("div", F.col("nth"), F.lit(piece))), [*keys, "piece"]
    line = F.struct("nth", F.concat("head", "body", F.lit("\n")).alias("line"), span.alias("span"))
    grouped = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("t"), F.sum(F.when(F.col("own"), body).otherwise(0)).alias("n_masked"))
    spans = F.array_join(F.transform("t", lambda x: x["span"]), ",")  # nulls are left out
    return grouped.select(*keys, F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["line"]), "").alias("rendered"), spans.alias("mask"), "n_masked")


def oracle() -> str:
    """DuckDB SQL for the rows of rotate_perspectives(conversations)."""
    return f"""with r as (select distinct conv_id, turn::bigint as turn, role, replace(coalesce(text, ''), '<|', '< |') as text from conversations),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text) - 1 as nth from r),
p as (select distinct conv_id, role as participant from o where role is distinct from 'system'),
t as (select o.conv_id, p.participant, o.nth, o.role is not distinct from p.participant as own, o.text || '{CLOSE}' as body,
  '{OPEN}' || case when o.role is not distinct from p.participant then 'assistant' when o.role is null then 'user' when o.role = 'system' then 'system'
    else 'user name=' || replace(regexp_replace(o.role, '[\\r\\n]', ' ', 'g'), '<|', '< |') end || chr(10) as head
  from o join p on o.conv_id is not distinct from p.conv_id),
s as (select *, coalesce(sum(length(head) + length(body) + 1) over (partition by conv_id, participant order by nth rows between unbounded preceding and 1 preceding), 0) + length(head) as begin_at from t)
select conv_id, participant, count(*)::bigint as n_turns, string_agg(head || body || chr(10), '' order by nth) as rendered,
  coalesce(string_agg(case when own then begin_at::bigint::varchar || '-' || (begin_at + length(body))::bigint::varchar end, ',' order by nth), '') as mask,
  sum(case when own then length(body) else 0 end)::bigint as n_masked
from s group by conv_id, participant"""
