"""Chat formatting by quotation linking.

Lines that begin with ``>`` marks are quotes, one level per mark (``>> x`` and ``> > x`` alike). Consecutive lines of a level,
up to a blank one, are a passage; a passage and, if it has several, each of its lines are normalised (lower case, white
space to single spaces) and hashed. Unquoted passages of every message are the originals; for every hash the first message
of each conversation that has it is kept, so a passage that a third of all messages share is one row a conversation.
Quoted hashes join them by (hash, conversation), earlier turns only, and by hash alone where their conversation has none.

A message replies to the message of its conversation that its outermost quotes match most (ties: the later one). Threads
are followed to their roots by pointer doubling, and (conv_id, root_turn, turn) orders the messages: every message follows
the one it answers, and threads stay together. Quotes, and the line that introduces one ("... wrote:"), leave the text.

Defined cases: a null text stays null and quotes nothing; a quote without original gives no parent; a message without
parent is its own root; a null conv_id or turn is kept and neither replied to nor replying; repeated rows stay; empty
tables give no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

_QUOTE = re.compile(r"^((?:[ \t]{0,3}>)+)[ \t]?(.*)$", re.DOTALL)
_INTRO = re.compile(r"^.*\b(wrote|writes|said)\s*:\s*$", re.IGNORECASE)


def quote_level(line: str) -> tuple[int, str]:
    """How many marks a line begins with, and the rest of it."""
    m = _QUOTE.match(line)
    return (m.group(1).count(">"), m.group(2)) if m else (0, line)


def passages(text: str) -> list[tuple[int, list[str]]]:
    """(level, lines) of the passages of a text."""
    out: list[tuple[int, list[str]]] = []
    open_level = None
    for line in text.split("\n"):
        level, rest = quote_level(line)
        if not rest.strip():
            open_level = None
            continue
        if open_level == level:
            out[-1][1].append(rest)
        else:
            out.append((level, [rest]))
            open_level = level
    return out


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def units(text: str) -> list[tuple[int, str]]:
    """(level, normalised passage or line) to be hashed; one-line passages count once."""
    out = []
    for level, lines in passages(text):
        whole = normal(" ".join(lines))
        out.append((level, whole))
        if len(lines) > 1:
            out.extend((level, normal(x)) for x in lines)
    return out


def without_quotes(text: str) -> str:
    """The text without quoted lines and the lines that introduce them; runs of blank lines become one."""
    lines = text.split("\n")
    levels = [quote_level(x)[0] for x in lines]
    if not any(levels):
        return text
    kept: list[str] = []
    for i, line in enumerate(lines):
        if levels[i] or (_INTRO.match(line) and i + 1 < len(lines) and levels[i + 1]):
            continue
        if line.strip() or (kept and kept[-1].strip()):
            kept.append(line)
    return "\n".join(kept).strip("\n")


def link_quotes(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) -> one row each, in columns that order them by reply."""
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(c, t, level, u) for c, t, text in zip(frame["conv_id"], frame["turn"], frame["text"], strict=True) for level, u in units(text)]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "level", "unit"])

    known = base.where("conv_id is not null and turn is not null and text is not null")
    parsed = known.mapInPandas(parse, "conv_id long, turn long, level int, unit string")
    parsed = staged(parsed.select("conv_id", "turn", "level", F.xxhash64("unit").alias("h")).groupBy("conv_id", "turn", "level", "h").agg(F.count("*").alias("n")), "quote-units")
    quoted = parsed.where("level > 0").select("conv_id", "turn", "level", "h")
    asked = quoted.select("h").distinct()
    originals = parsed.where("level = 0").groupBy("h", "conv_id").agg(F.min("turn").alias("at")).join(asked, "h", "left_semi")
    here = quoted.join(originals, ["h", "conv_id"], "left").withColumn("at", F.when(F.col("at") < F.col("turn"), F.col("at")))
    anywhere = originals.groupBy("h").agg(F.min(F.struct("conv_id", "at")).alias("first")).select("h", F.col("first.conv_id").alias("other_conv"), F.col("first.at").alias("other_at"))
    links = here.join(anywhere, "h", "left")
    links = links.withColumn("elsewhere", F.col("at").isNull() & F.col("other_conv").isNotNull() & (F.col("other_conv") != F.col("conv_id")))
    counted = links.groupBy("conv_id", "turn", "level", "at").agg(F.count("*").alias("n"), F.min(F.when(F.col("elsewhere"), F.struct("other_conv", "other_at"))).alias("other"))
    per = counted.groupBy("conv_id", "turn").agg(
        F.min(F.when(F.col("at").isNotNull(), F.struct("level", (-F.col("n")).alias("n"), (-F.col("at")).alias("at")))).alias("best"),
        F.min("other").alias("other"),
        F.max("level").alias("quote_depth"),
        F.sum("n").alias("quotes"),
        F.sum(F.when(F.col("at").isNotNull(), F.col("n")).otherwise(0)).alias("linked"),
    )
    per = per.select("conv_id", "turn", "quote_depth", "quotes", "linked", (-F.col("best.at")).alias("parent_turn"), F.col("other.other_conv").alias("quoted_conv"), F.col("other.other_at").alias("quoted_turn"))
    per = staged(per, "quote-parents")

    active = per.where("parent_turn is not null").select("conv_id", "turn", F.col("parent_turn").alias("root"))
    settled = None
    while True:  # pointer doubling, as many rounds as the logarithm of the deepest thread; what has reached its root rests
        known = active if settled is None else active.unionByName(settled)
        up = known.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"))
        step = staged(active.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "quote-roots")
        rest, active = (step.where(c).drop("moved") for c in ("not moved", "moved"))
        settled = rest if settled is None else settled.unionByName(rest)
        if active.isEmpty():
            break

    def strip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["text"] = [None if t is None else without_quotes(t) for t in frame["text"]]
            yield frame

    clean = base.mapInPandas(strip, base.schema)
    out = clean.join(per, ["conv_id", "turn"], "left").join(settled, ["conv_id", "turn"], "left")
    zero = F.lit(0)
    return out.select("conv_id", F.coalesce("root", "turn").alias("root_turn"), "turn", "role", "text", "parent_turn", "quoted_conv", "quoted_turn", F.coalesce("quote_depth", zero).alias("quote_depth"), F.coalesce("quotes", zero).cast("long").alias("quotes"), F.coalesce("linked", zero).cast("long").alias("linked"))


def formatted(linked: DataFrame) -> DataFrame:
    """One chat turn of markup per message, to be read in the order (conv_id, root_turn, turn)."""
    turn = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return linked.select("conv_id", "root_turn", "turn", turn.alias("markup"))
