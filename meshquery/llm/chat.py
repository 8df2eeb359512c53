"""Operator 8, multi-party perspective rotation. DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that speaker as the assistant, every other
participant as a named user, and the loss mask on the speaker's own messages (text and end marker). Messages of
context roles (``system``) are context in every rendering and nobody's perspective.

A rendering is stored in parts of ``part_turns`` messages. Every participant of the conversation has every part, spoken
in it or not: a speaker's parts in order, put together, are exactly the rendering of the whole dialogue. ``start`` says
where a part begins in it, and spans are places in the whole rendering, so nothing depends on where parts are cut.

Plan: messages are numbered on narrow rows (keys and lengths, no texts): a range sort of the whole table, whose
partitions cut a long conversation anywhere, and one base per conversation and partition. Texts move twice, to
their numbers and to their part. Running lengths of a speaker's parts are summed in two levels. The group key is
(conversation, part), never the whole conversation.

Defined results: messages are ordered by turn (null first), then role (null first), then the MD5 of the text; repeated
rows are one message; null text is empty; speakers are told apart by the role as it stands, a null role is a speaker of
its own without a name; white space, ``%`` and marker openings in a shown name are percent-encoded, marker openings inside
a text are broken by a blank; null conv_id is a conversation of its own; an empty table gives no rows; further columns
are ignored. Mask spans are [start, end) in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions_for, saved, table

PART_TURNS, CONTEXT = 64, ("system",)
#: Parts whose running lengths are summed in one task.
PART_BLOCK = 4096
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ESCAPES = {"%": "%25", " ": "%20", "\t": "%09", "\n": "%0A", "\x0b": "%0B", "\x0c": "%0C", "\r": "%0D", "<|": "<%7C"}
KEYS = ("conv", "dated", "turn", "who", "tie")


def _heads(who: Column, context: tuple[str, ...]) -> tuple[Column, Column]:
    """A message's head for its own speaker and for everyone else; ``who`` is ``=`` and the role, or empty."""
    role = F.substring(who, 2, 1 << 30)
    shown = role
    for plain, coded in ESCAPES.items():
        shown = F.replace(shown, F.lit(plain), F.lit(coded))
    name = F.when(who == "", F.lit("user")).otherwise(F.concat(F.lit("user name="), shown))
    is_context = role.isin(*context) & (who != "")
    head = lambda kind: F.concat(F.lit(OPEN), kind, F.lit("\n"))
    return head(F.when(is_context, role).otherwise(F.lit("assistant"))), head(F.when(is_context, role).otherwise(name))


def _messages(conversations: DataFrame) -> DataFrame:
    """Rows with null-free keys, and the text as it is shown."""
    null_free = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.col("turn").cast("long")
    return conversations.select(
        "conv_id", null_free("conv_id").alias("conv"), turn.isNotNull().alias("dated"), F.coalesce(turn, F.lit(0)).alias("turn"), null_free("role").alias("who"),
        F.md5(text).alias("tie"), F.replace(text, F.lit("<|"), F.lit("< |")).alias("text"),
    )


def _numbered(messages: DataFrame, part_turns: int, context: tuple[str, ...]) -> DataFrame:
    """(KEYS, place, part, own, other): each message's place in its conversation, and its lengths as seen by its speaker and by others."""
    mine, theirs = _heads(F.col("who"), context)
    body = F.col("chars") + len(CLOSE)
    narrow = messages.groupBy(*KEYS).agg(F.max(F.length("text")).cast("long").alias("chars")).select(*KEYS, (F.length(mine) + body).alias("own"), (F.length(theirs) + body).alias("other"))
    ranged = narrow.repartitionByRange(partitions_for(messages.sparkSession), *KEYS).sortWithinPartitions(*KEYS)
    rows = saved(ranged.withColumn("id", F.monotonically_increasing_id()), "chat-order").withColumn("piece", F.shiftright("id", 33))
    pieces = rows.groupBy("conv", "piece").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    pieces = pieces.withColumn("base", F.sum("n").over(W.partitionBy("conv").orderBy("piece")) - F.col("n")).drop("n")
    placed = rows.join(pieces, ["conv", "piece"]).withColumn("place", F.col("base") + F.col("id") - F.col("first"))
    return saved(placed.select(*KEYS, "place", F.floor(F.col("place") / part_turns).alias("part"), "own", "other"), "chat-places")


def _renderings(numbered: DataFrame, context: tuple[str, ...]) -> DataFrame:
    """(conv, part, speaker, start) for every participant and every part of the conversation."""
    sizes = numbered.groupBy("conv", "part").agg(F.sum("other").alias("size"))
    counts = numbered.groupBy("conv").agg((F.max("part") + 1).alias("parts"))
    talkers = numbered.where(~F.col("who").isin([f"={c}" for c in context])).select("conv", F.col("who").alias("speaker")).distinct()
    blocks = talkers.join(counts, "conv").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("parts") - 1) / PART_BLOCK))))
    low = F.col("block") * PART_BLOCK
    dense = blocks.select("conv", "speaker", "block", F.explode(F.sequence(low, F.least(low + PART_BLOCK, F.col("parts")) - 1)).alias("part"))
    spoken = numbered.groupBy("conv", "part", F.col("who").alias("speaker")).agg(F.sum(F.col("own") - F.col("other")).alias("more"))
    lengths = dense.join(sizes, ["conv", "part"]).join(spoken, ["conv", "part", "speaker"], "left").withColumn("length", F.col("size") + F.coalesce("more", F.lit(0)))
    inside = W.partitionBy("conv", "speaker", "block").orderBy("part")
    within = lengths.select("conv", "speaker", "block", "part", (F.sum("length").over(inside) - F.col("length")).alias("at"), "length")
    whole = lengths.groupBy("conv", "speaker", "block").agg(F.sum("length").alias("all"))
    bases = whole.select("conv", "speaker", "block", (F.sum("all").over(W.partitionBy("conv", "speaker").orderBy("block")) - F.col("all")).alias("base"))
    return within.join(bases, ["conv", "speaker", "block"]).select("conv", "part", "speaker", (F.col("base") + F.col("at")).alias("start"))


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """(conv_id, part, speaker, n_turns, start, text, spans array<struct<start, end>>) for every participant and part."""
    messages = _messages(conversations)
    numbered = _numbered(messages, part_turns, context)
    # Copies of a message meet in the map-side set of their part, which has part_turns members at most.
    parts = messages.join(numbered, list(KEYS)).groupBy("conv", "part").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_set(F.struct("place", "who", "text"))).alias("lines"))
    seen = parts.join(saved(_renderings(numbered, context), "chat-renderings"), ["conv", "part"])

    def said(line: Column) -> Column:
        mine, theirs = _heads(line["who"], context)
        own = line["who"] == F.col("speaker")
        return F.struct(own.alias("own"), F.when(own, mine).otherwise(theirs).alias("head"), F.concat(line["text"], F.lit(CLOSE)).alias("body"))

    def step(got: Column, x: Column) -> Column:
        lo = got["at"] + F.length(x["head"])
        hi = lo + F.length(x["body"])
        span = F.array(F.struct(lo.alias("start"), hi.alias("end")))
        return F.struct(hi.alias("at"), F.when(x["own"], F.concat(got["spans"], span)).otherwise(got["spans"]).alias("spans"))

    shown = seen.withColumn("said", F.transform("lines", said))
    begin = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    return shown.select(
        "conv_id", "part", F.when(F.col("speaker") != "", F.substring("speaker", 2, 1 << 30)).alias("speaker"), F.size("lines").alias("n_turns"), "start",
        F.array_join(F.transform("said", lambda x: F.concat(x["head"], x["body"])), "").alias("text"),
        F.aggregate("said", begin, step)["spans"].alias("spans"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate(table(spark, sf_dir, "conversations"))
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("conv_id", "part", "speaker", F.col("n_turns").cast("long").alias("n_turns"), "start", "text", shown.alias("spans"))


SQL = r"""
WITH l AS (
  SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS raw, replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS body FROM conversations),
m AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(raw)) - 1 AS place,
    CASE WHEN role = 'system' THEN 'system' WHEN role IS NULL THEN 'user' ELSE 'user name=' || replace(replace(replace(replace(replace(replace(replace(replace(
      role, '%', '%25'), ' ', '%20'), chr(9), '%09'), chr(10), '%0A'), chr(11), '%0B'), chr(12), '%0C'), chr(13), '%0D'), '<|', '<%7C') END AS shown
  FROM l),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM l WHERE role IS DISTINCT FROM 'system'),
x AS (
  SELECT m.conv_id, s.speaker, m.place, m.place // 64 AS part, m.role IS NOT DISTINCT FROM s.speaker AS own, body,
    '<|im_start|>' || CASE WHEN m.role IS NOT DISTINCT FROM s.speaker THEN 'assistant' ELSE shown END || chr(10) AS head
  FROM m JOIN s ON m.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (SELECT *, (sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY place))::BIGINT AS stop FROM x)
SELECT conv_id, part::BIGINT AS part, speaker, count(*) AS n_turns, min(stop - length(head) - length(body))::BIGINT AS start,
       string_agg(head || body, '' ORDER BY place) AS text,
       coalesce(string_agg((stop - length(body))::VARCHAR || ':' || stop::VARCHAR, ',' ORDER BY place) FILTER (own), '') AS spans
FROM o GROUP BY conv_id, part, speaker
"""
