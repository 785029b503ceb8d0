"""Chat formatting by quotation linking.

Every message is parsed into passages: runs of lines of one quote level (leading '>' signs). Quoted passages are
normalised (signs, case and white space) and hashed, whole and by line. The hashes are joined with those of what messages
say themselves: the whole body, its paragraphs and its lines. A message answers the one that its shallowest quotes name,
the best match by the words quoted: within its conversation the earliest such message before it, else the earliest such
message at all if that comes before by (conversation, turn). Without a link it answers the turn before it. A conversation
whose first message answers one of another conversation continues that one, so `thread_id` names the conversation where
all began. The rows come sorted by
(thread_id, conv_id, turn): a conversation with all that continue it stands together, every message after the one that it
answers. The sort deals rows out by range, so a long conversation is cut over tasks instead of being gathered. `text` is the message
without its quotes between role marks; marks inside bodies are escaped.

Hashes that many messages share are reduced to their earliest message before the join, so no pairs arise within a group,
and no conversation is gathered in one task.

Defined results: a null text is an empty body; a null role is `unknown`; rows with a null conv_id or turn answer nothing,
are answered by nothing and keep their conversation; repeated rows stay, alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, durable, pieces, spread_join

LEVEL = re.compile(r"^[ \t]*((?:>[ \t]*)+)")
INTRODUCES = re.compile(r"(?:wrote|schrieb|a écrit|escribió)\s*:$")
#: Turns in a stretch of a conversation; the turn before is looked up stretch by stretch.
STRETCH = 1000


def normal(text: str) -> str:
    return " ".join(text.split()).casefold()


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def parse(text: str | None) -> tuple[str, list[tuple[int, int, int]], list[tuple[int, int]], int]:
    """(body without quotes, quoted (level, hash, words), own hashes (hash, words), deepest level)."""
    runs: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        m = LEVEL.match(line)
        level = m.group(1).count(">") if m else 0
        if m is None or not runs or runs[-1][0] != level:
            if level and runs and runs[-1][0] == 0 and runs[-1][1] and INTRODUCES.search(runs[-1][1][-1].rstrip()):
                runs[-1][1].pop()
            if not runs or runs[-1][0] != level:
                runs.append((level, []))
        runs[-1][1].append(line[m.end() :] if m else line)
    quoted: dict[tuple[int, int], int] = {}
    for level, lines in runs:
        if level:
            for part in {normal(" ".join(lines)), *map(normal, lines)} - {""}:
                quoted[(level, digest(part))] = len(part.split())
    body = "\n".join("\n".join(lines) for level, lines in runs if not level).strip()
    own = {normal(body), *map(normal, re.split(r"\n\s*\n", body)), *map(normal, body.split("\n"))} - {""}
    return body, [(a, h, n) for (a, h), n in quoted.items()], [(digest(x), len(x.split())) for x in own], max((x[0] for x in runs), default=0)


def parsed(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, body, quoted, own, deepest) per message."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quoted = pa.list_(pa.struct([("level", pa.int32()), ("h", pa.int64()), ("n", pa.int32())]))
        own = pa.list_(pa.int64())
        for batch in (p for b in batches for p in pieces(b)):
            got = [parse(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("conv", "turn", "role")),
                    pa.array([x[0] for x in got]),
                    pa.array([[dict(zip(("level", "h", "n"), q, strict=True)) for q in x[1]] for x in got], quoted),
                    pa.array([[h for h, _ in x[2]] for x in got], own),
                    pa.array([x[3] for x in got], pa.int32()),
                ],
                ["conv", "turn", "role", "body", "quoted", "own", "deepest"],
            )

    rows = df.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "conv long, turn long, role string, body string, quoted array<struct<level: int, h: long, n: int>>, own array<long>, deepest int")


def quote_links(messages: DataFrame) -> DataFrame:
    """(conv, turn, to_conv, to_turn, words): for each quoting message the one that it answers."""
    keyed = messages.filter("conv IS NOT NULL AND turn IS NOT NULL")
    quotes = keyed.select("conv", "turn", F.explode("quoted").alias("q")).select("conv", "turn", "q.level", "q.h", "q.n").distinct()
    # Both aggregates are combined before their shuffles, so what everybody says costs no task more than what few say.
    here = keyed.select("conv", "turn", F.explode("own").alias("h")).groupBy("conv", "h").agg(F.min("turn").alias("here"))
    anywhere = here.groupBy("h").agg(F.min(F.struct("conv", F.col("here").alias("turn"))).alias("first"))
    anywhere = durable(anywhere.join(quotes.groupBy("h").agg(F.count(F.lit(1)).alias("size")), "h"))
    found = spread_join(quotes, anywhere, ["h"], "size").join(here, ["conv", "h"], "left")
    inside = F.when(F.col("here") < F.col("turn"), F.struct(F.col("conv"), F.col("here").alias("turn")))
    before = F.when(F.col("first") < F.struct("conv", "turn"), F.col("first"))
    found = found.select("conv", "turn", "level", "n", F.coalesce(inside, before).alias("to")).filter("to IS NOT NULL")
    # A message's own quotes: as many rows as it has quotes.
    best = found.groupBy("conv", "turn", "level", "to").agg(F.sum("n").alias("words")).groupBy("conv", "turn").agg(F.min(F.struct("level", (-F.col("words")).alias("less"), "to")).alias("b"))
    return best.select("conv", "turn", F.col("b.to.conv").alias("to_conv"), F.col("b.to.turn").alias("to_turn"), (-F.col("b.less")).alias("words"))


def turn_before(messages: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(conv, turn, before): the greatest smaller turn of the conversation, or null."""
    turns = messages.filter("conv IS NOT NULL AND turn IS NOT NULL").select("conv", "turn").distinct().withColumn("part", F.floor(F.col("turn") / stretch))
    inside = F.max("turn").over(Window.partitionBy("conv", "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    parts = turns.groupBy("conv", "part").agg(F.max("turn").alias("last"))
    parts = parts.select("conv", "part", F.lag("last").over(Window.partitionBy("conv").orderBy("part")).alias("earlier"))
    return turns.withColumn("inside", inside).join(parts, ["conv", "part"]).select("conv", "turn", F.coalesce("inside", "earlier").alias("before"))


def threads(firsts: DataFrame) -> DataFrame:
    """(conv, thread) from (conv, to): conversations that continue others, which always have smaller numbers. Doubles the steps each round."""
    now = durable(firsts.select("conv", "to"))
    while True:
        onward = now.select(F.col("conv").alias("to"), F.col("to").alias("next"))
        after = durable(now.join(onward, "to", "left").select("conv", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        if not after.filter("moved").limit(1).count():
            return after.select("conv", F.col("to").alias("thread"))
        now = after.select("conv", "to")


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per message: conv_id, turn, role, thread_id, reply_conv, reply_turn, by_quote, n_quotes, quote_depth, body, text."""
    messages = durable(parsed(df, conv, turn, role, text))
    links = durable(quote_links(messages))
    before = turn_before(messages)
    starts = before.filter("before IS NULL").select("conv", "turn")
    onward = threads(links.join(starts, ["conv", "turn"]).filter("to_conv <> conv").groupBy("conv").agg(F.min("to_conv").alias("to")))
    slim = messages.select("conv", "turn", "role", "body", F.size("quoted").alias("n_quotes"), "deepest")
    out = slim.join(before, ["conv", "turn"], "left").join(links, ["conv", "turn"], "left").join(onward, "conv", "left")
    safe = F.replace(F.col("body"), F.lit("<|"), F.lit("<\\|"))
    return out.select(
        F.col("conv").alias("conv_id"),
        "turn",
        "role",
        F.coalesce("thread", "conv").alias("thread_id"),
        F.coalesce("to_conv", F.when(F.col("before").isNotNull(), F.col("conv"))).alias("reply_conv"),
        F.coalesce("to_turn", "before").alias("reply_turn"),
        F.col("to_conv").isNotNull().alias("by_quote"),
        F.col("n_quotes").cast("long").alias("n_quotes"),
        F.col("deepest").cast("long").alias("quote_depth"),
        "body",
        F.concat(F.lit("<|"), F.replace(F.col("role"), F.lit("|"), F.lit("/")), F.lit("|>\n"), safe, F.lit("<|end|>\n")).alias("text"),
    ).orderBy("thread_id", "conv_id", "turn")


def op9_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


