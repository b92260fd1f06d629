"""Chat formatting by quotation linking, in DataFrame operations only.

Lines that begin with ``>`` marks are quoted, as deep as there are marks.  A
run of lines of one level is a passage; a hash of its normalised words links
it to the message of the same conversation that first wrote it, before the
one that quotes it.  The latest message that a reply quotes at the first level
is what it answers; conversations are threads of such replies, in order and
without the quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

QUOTE = r"^[\x20\x09]*(>[\x20\x09]*)+"


def passages(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, level, passage, hash)`` for each run of lines of one quote level.

    Levels are told per message by array functions, so no message's lines are
    shuffled.  Blank lines end a passage.  Case, punctuation and spacing don't
    count; a passage without letters or digits is left out.  Repeated messages
    count once.
    """
    messages = messages.withColumn("_m", F.xxhash64("role", "text")).dropDuplicates(["conv_id", "turn", "_m"])
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    prefix = lambda line: F.regexp_extract(line, QUOTE, 0)
    levelled = F.transform(lines, lambda line: F.struct(F.length(F.regexp_replace(prefix(line), "[^>]", "")).alias("level"), F.regexp_replace(line, QUOTE, "").alias("body")))
    rows = messages.select("conv_id", "turn", F.posexplode(levelled).alias("at", "line"), "_m")
    rows = rows.withColumn("blank", ~F.col("line.body").rlike(r"[\p{L}\p{N}]"))
    w = Window.partitionBy("conv_id", "turn", "_m").orderBy("at")
    starts = F.col("blank") | F.coalesce(F.lag("blank").over(w), F.lit(True)) | (F.col("line.level") != F.coalesce(F.lag("line.level").over(w), F.lit(-1)))
    rows = rows.withColumn("run", F.sum(starts.cast("int")).over(w)).filter(~F.col("blank"))
    return normalised(rows.groupBy("conv_id", "turn", "_m", "run").agg(F.first("line.level").alias("level"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line.body"))), lambda x: x["body"]), " ").alias("passage")))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def normalised(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", "level", "passage", F.md5(normal(F.col("passage"))).alias("hash"))


def unquoted(text: Column) -> Column:
    """The message's own lines, trimmed."""
    own = F.filter(F.split(text, r"\r?\n"), lambda line: ~line.rlike(QUOTE))
    return F.trim(F.regexp_replace(F.array_join(own, "\n"), r"\n{3,}", "\n\n"), F.lit(" \t\r\n"))


def link(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, reply_to)`` for each turn that quotes an earlier one of its conversation.

    Quoted passages are matched whole.  One row of each hash and conversation
    stands for the originals, so a passage that thousands repeat joins to one.
    """
    quoting = messages.filter(F.col("text").rlike("(?m)" + QUOTE)).filter("conv_id is not null and turn is not null")
    quoted_in = quoting.select("conv_id").distinct()
    inside = messages.filter("conv_id is not null and turn is not null").join(quoted_in, "conv_id", "left_semi")
    parts = passages(inside)
    quotes = parts.filter("level = 1").select("conv_id", "hash", "turn").distinct()
    first = parts.filter("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("said"))
    return quotes.join(first, ["conv_id", "hash"]).filter("said < turn").groupBy("conv_id", "turn").agg(F.max("said").alias("reply_to"))


def threads(links: DataFrame) -> DataFrame:
    """``(conv_id, turn, reply_to, root, depth)`` by pointer doubling: as many joins as the depth has bits."""
    rows = cut(links.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        ahead = rows.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        joined = rows.join(ahead, ["conv_id", "root"], "left")
        if not joined.filter("_root is not null").limit(1).count():
            return rows
        rows = cut(joined.select("conv_id", "turn", "reply_to", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")))


def format_chat(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, reply_to, root, depth, content)``, one row per message.

    ``root`` is the turn that opens the message's thread (its own where it
    answers nothing), and ``(conv_id, root, turn)`` orders messages by reply.
    Roles are lower-cased; ``content`` is the message without its quotes in
    the form ``<|role|>\\n...``.  A null text has empty content, a null role is
    ``user``, a null conversation or turn is linked with nothing, and repeated
    rows stay repeated.
    """
    messages = messages.select("conv_id", "turn", F.lower(F.coalesce(F.col("role").cast("string"), F.lit("user"))).alias("role"), F.col("text").cast("string").alias("text"))
    found = threads(link(messages))
    rows = messages.join(found, ["conv_id", "turn"], "left")
    content = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.coalesce(unquoted(F.col("text")), F.lit("")))
    return rows.select("conv_id", "turn", "role", "reply_to", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), content.alias("content"))
