"""Chat formatting: quotations are parsed, linked to the messages they quote, and taken out.

``link`` works on messages (conversation, turn, role, text) with DataFrame functions only.

1. Each line has a quote level, its number of leading '>' signs; lines of one level in a row form a
   passage. A line such as "On Monday X wrote:" right before a quotation belongs to it.
2. Passages are normalised (lower case, white space folded) and hashed, whole and line by line; so
   are the message's own words, whole, by passage and by line.
3. A hash that is quoted points to the latest earlier turn of the same conversation that has it of
   its own. Turns are searched in ranges of ``RANGE``: inside a range by a window, before it by the
   last turn of each range, so no passage of a long conversation gathers in one task.
4. A message replies to the turn that the most quoted characters of its least quoted level point to,
   of equal ones the latest. Replies are followed to the first message of their thread by pointer
   doubling.

The result is in reply order: by conversation, thread (the turn of its first message) and turn, so
that each reply stands after what it replies to.

Defined cases: a null text is an empty one; a message without quotations keeps its text as it is;
quotations that nobody wrote before are taken out and link nowhere; messages of one conversation
and turn are one place in the order, with one link; a null conversation or turn links nowhere;
repeated rows stay repeated; other columns pass through; columns named like an output raise
``ValueError``; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import kept, text_or_empty

RANGE = 1_024
SIGNS = r"^(?:[ \t]*>)+"
#: Fixed value: how mail programs introduce a quotation.
ATTRIBUTION = r"^\s*(?:on|le|am|el)\b.{0,200}\b(?:wrote|écrit|schrieb|escribió)\s*:\s*$"
OUTPUTS = ("own_text", "n_quotes", "n_linked", "reply_to", "thread", "formatted")


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _units(passages: Column) -> Column:
    """Normalised passages of (level, lines), whole and line by line, with their levels; empty ones left out."""
    whole = F.transform(passages, lambda p: F.struct(p["level"].alias("level"), _normal(F.array_join(p["lines"], " ")).alias("unit")))
    lines = F.flatten(F.transform(passages, lambda p: F.transform(p["lines"], lambda x: F.struct(p["level"].alias("level"), _normal(x).alias("unit")))))
    return F.filter(F.array_distinct(F.concat(whole, lines)), lambda u: u["unit"] != "")


def parsed(messages: DataFrame, text: str = "text") -> DataFrame:
    """``messages`` with own_text, n_quotes, and the units _own (strings) and _quoted (level, unit)."""
    lines = F.split(text_or_empty(text), r"\r\n|\r|\n")
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, SIGNS, 0), "[^>]", ""))
    step = messages.withColumn("_lines", F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, SIGNS + " ?", "").alias("body"))))
    step = step.withColumn("_n", F.size("_lines"))
    turns = lambda i: F.when(i == 1, True).otherwise(F.element_at("_lines", i)["level"] != F.element_at("_lines", i - 1)["level"])
    step = step.withColumn("_at", F.filter(F.sequence(F.lit(1), F.col("_n")), turns))

    def passage(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_at", k + 1), F.col("_n") + 1)
        bodies = F.slice(F.col("_lines.body"), start, end - start)
        own = F.element_at("_lines", start)["level"] == 0
        introduces = own & (end <= F.col("_n")) & F.lower(F.element_at("_lines", end - 1)["body"]).rlike(ATTRIBUTION)
        kept_lines = F.when(introduces, F.slice(bodies, F.lit(1), end - start - 1)).otherwise(bodies)
        return F.struct(F.element_at("_lines", start)["level"].alias("level"), kept_lines.alias("lines"))

    step = step.withColumn("_passages", F.transform("_at", passage))
    own, quoted = F.filter("_passages", lambda p: p["level"] == 0), F.filter("_passages", lambda p: p["level"] > 0)
    step = step.withColumns({"_self": own, "_quotes": quoted})
    words = F.regexp_replace(F.array_join(F.flatten(F.col("_self.lines")), "\n"), r"^\s+|\s+$", "")
    step = step.withColumns(
        {
            "own_text": F.when(F.size("_quotes") == 0, text_or_empty(text)).otherwise(words),
            "n_quotes": F.size("_quotes").cast("bigint"),
        }
    )
    mine = F.array_distinct(F.concat(F.array(_normal(F.col("own_text"))), _units(F.col("_self"))["unit"]))
    return step.withColumns({"_own": F.filter(mine, lambda u: u != ""), "_quoted": _units(F.col("_quotes"))}).drop("_lines", "_n", "_at", "_passages", "_self", "_quotes")


def sources(quotes: DataFrame, own: DataFrame) -> DataFrame:
    """(conv, turn, hash, source): the latest turn before each of ``quotes`` (conv, turn, hash) among ``own``."""
    asked = quotes.select("conv", "turn", "hash").distinct()
    known = own.join(asked.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi").distinct()
    ranged = asked.withColumn("source", F.lit(None).cast("bigint")).unionByName(known.withColumn("source", F.col("turn")))
    ranged = ranged.withColumns({"asks": F.col("source").isNull(), "part": F.floor(F.col("turn") / RANGE)})
    # of one turn, the question stands before the turn's own words
    inside = Window.partitionBy("conv", "hash", "part").orderBy("turn", F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    near = ranged.withColumn("source", F.when(F.col("asks"), F.max("source").over(inside)))
    before = Window.partitionBy("conv", "hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    last = ranged.groupBy("conv", "hash", "part").agg(F.max("source").alias("m")).withColumn("far", F.max("m").over(before)).drop("m")
    return near.where("asks").join(last, ["conv", "hash", "part"]).select("conv", "turn", "hash", F.coalesce("source", "far").alias("source"))


def threads(replies: DataFrame) -> DataFrame:
    """(conv, turn, root) from (conv, turn, reply_to): where the chain of replies begins."""
    now = kept(replies.select("conv", "turn", F.col("reply_to").alias("root")))
    while True:
        further = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"))
        moved = kept(now.join(further, ["conv", "root"], "left").select("conv", "turn", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = moved.drop("moved")
        if moved.where("moved").limit(1).count() == 0:
            return now


def link(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``messages`` with their own words and links, in reply order."""
    helpers = ("_lines", "_n", "_at", "_passages", "_self", "_quotes", "_own", "_quoted", "_conv", "_turn")
    if {*OUTPUTS, *helpers} & set(messages.columns):
        raise ValueError(f"the columns {', '.join((*OUTPUTS, *helpers))} are the operator's")
    read = parsed(messages, text)
    keyed = read.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), "_own", "_quoted").where("conv is not null and turn is not null")
    # outer explodes: the filter that Spark infers for inner ones would repeat the parsing for every line
    quoted = keyed.select("conv", "turn", F.explode_outer("_quoted").alias("q")).where("q is not null")
    quoted = kept(quoted.select("conv", "turn", "q.level", F.xxhash64("q.unit").alias("hash"), F.length("q.unit").alias("chars")).distinct())
    own = keyed.select("conv", "turn", F.explode_outer("_own").alias("unit")).where("unit is not null").select("conv", "turn", F.xxhash64("unit").alias("hash"))
    found = quoted.join(sources(quoted, own), ["conv", "turn", "hash"]).where("source is not null")
    weights = found.groupBy("conv", "turn", "level", "source").agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))
    best = F.min(F.struct("level", -F.col("chars"), -F.col("source")))
    replies = kept(weights.groupBy("conv", "turn").agg(best.alias("best"), F.sum("n").alias("n_linked")).select("conv", "turn", (-F.col("best")["col3"]).alias("reply_to"), "n_linked"))
    placed = replies.join(threads(replies), ["conv", "turn"]).withColumnsRenamed({"conv": "_conv", "turn": "_turn"})
    joined = read.join(placed, (F.col(conversation) == F.col("_conv")) & (F.col(turn) == F.col("_turn")), "left")
    rest = [c for c in messages.columns if c != text]
    shown = joined.select(
        *rest,
        F.col("own_text").alias(text),
        "n_quotes",
        F.coalesce("n_linked", F.lit(0).cast("bigint")).alias("n_linked"),
        "reply_to",
        F.coalesce("root", turn).alias("thread"),
        F.concat(F.lit("<|"), F.coalesce(F.col(role), F.lit("")), F.lit("|>\n"), F.col("own_text")).alias("formatted"),
    )
    return shown.orderBy(conversation, "thread", turn)
