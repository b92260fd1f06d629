"""Line dedup by a log-template tree, in DataFrame operations only.

A line's variable fields are the tokens that hold a digit.  The tree has a
fixed depth: token count, then the first ``DEPTH`` tokens; a leaf holds as many
templates as its lines make.  A line is generalised at several levels: at each,
the tokens that as many of the leaf's lines have in that place stay and the
others become variable, so that two variable fields are told from the fixed
words between them however common their values are.  A line belongs to a
recurring template if its masked form, or one of its generalised forms that
keeps most of its tokens, is found in enough unrelated documents.  Of the documents that hold a line,
each is judged by its other lines: it counts as one in ``m``, the median over a
sketch of those lines of how many of the documents hold them too.  One that
shares less than half of its other lines counts in full, whatever headers they
have in common, and a group of copies or near copies counts as about one, so
that copied documents are left to the near-duplicate stage, whole, and only
lines that travel between documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, cut

DEPTH = 3
#: Lines of a document, those with the smallest hashes, by which it is told from others.
SKETCH = 8
#: Unrelated documents from which a template recurs, and their least share of a group of copies that is to lose it too.
MIN_DOCS, MIN_SHARE = 4, 0.2
#: Least numbers of a leaf's lines with a token for it to stay, and the share of its tail that a line must keep.
LEVELS, AGREES = tuple(4**k for k in range(1, 16)), 0.75
#: Bits by which documents are told that need not be moved, in words of 64.
SLOTS = 1 << 24
#: For sums of fractions that should reach a whole number.
SLACK = 1e-6


def masked(text: Column) -> Column:
    """The text with each token that holds a digit as ``<*>``."""
    return F.regexp_replace(text, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+", "<*>")


def tokens(line: Column) -> Column:
    return F.filter(F.split(line, SPACE), lambda t: t != "")


def _form(line: Column) -> Column:
    """A line masked and with single spaces; most lines need neither."""
    line = F.when(line.rlike("[0-9]"), masked(line)).otherwise(line)
    return F.when(line.rlike(r"[\x09-\x0D]|  |^ | $"), F.trim(F.regexp_replace(line, SPACE, " "))).otherwise(line)


def _forms(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _form)


def _once(value: Column) -> Column:
    """A generator of one row: what is above reads the value and can't work it out again."""
    return F.explode(F.array(value))


def _lines(docs: DataFrame, id_col: str, text_col: str, *carry: str) -> DataFrame:
    """``(_id, _doc, _forms, _hashes)`` and columns carried along; documents with the same forms share ``_doc``."""
    formed = docs.select(F.col(id_col).alias("_id"), *carry, _once(F.filter(F.array_distinct(_forms(F.col(text_col))), lambda f: f != "")).alias("_forms"))
    return formed.withColumn("_hashes", _once(F.transform("_forms", lambda f: F.xxhash64(f)))).withColumn("_doc", F.xxhash64("_hashes"))


def _recurs(rows: DataFrame, key: str, sketches: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """``(key, _doc)`` from ``(key, _doc, _line)``: the keys found in enough unrelated documents, and those documents.

    A member of a group of copies is left out where the unrelated documents are
    fewer than ``min_share`` of the group; other documents don't depend on it.
    Counts are partly summed before they are dealt, and documents with the same
    lines are one row, so that no key's rows meet.
    """
    held = rows.groupBy(key, "_doc").agg(F.min("_line").alias("_own")).join(sketches, "_doc")
    enough = held.groupBy(key).agg(F.sum("_n").alias("_rows")).filter(F.col("_rows") >= min_docs)
    others = F.array_remove("_sketch", F.col("_own"))
    others = F.when(F.size(others) > 0, others).otherwise(F.array(F.lit(0).cast("long")))
    held = cut(held.join(enough.select(key), key, "left_semi").select(key, "_doc", "_n", others.alias("_others")))
    spread = held.select(key, "_doc", "_n", F.explode("_others").alias("_other"))
    shared = spread.groupBy(key, "_other").agg(F.sum("_n").alias("_with")).filter("_with > 1")
    judged = spread.join(shared, [key, "_other"], "left").groupBy(key, "_doc", "_n").agg(F.sort_array(F.collect_list(F.coalesce("_with", F.lit(1).cast("long")))).alias("_withs"))
    judged = cut(judged.select(key, "_doc", "_n", F.element_at("_withs", F.floor((F.size("_withs") + 1) / 2).cast("int")).alias("_m")))
    found = judged.groupBy(key).agg(F.sum(F.col("_n") / F.col("_m")).alias("_unrelated")).filter(F.col("_unrelated") >= min_docs - SLACK)
    return judged.join(found, key).filter(F.col("_unrelated") >= min_share * F.col("_m") - SLACK).select(key, "_doc")


def _among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose key is none of ``ids``; a table of bits as large for any input tells them."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    bit = F.expr("shiftleft(1L, cast(_slot % 64 as int))")
    words = ids.select(slot("_id").alias("_slot")).groupBy(F.floor(F.col("_slot") / 64).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    placed = rows.withColumn("_slot", slot(key)).withColumn("_word", F.floor(F.col("_slot") / 64))
    return placed.join(F.broadcast(words), "_word").filter(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def _at_least(tokens: str, n: int) -> Column:
    return F.filter(tokens, lambda x: x["_n"] >= n)


def recurring(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_share: float) -> DataFrame:
    """``(_id, _drop)``: per document id the hashes of the line forms to drop."""
    formed = _lines(docs, id_col, text_col)
    by_line = formed.select("_id", "_doc", F.slice(F.sort_array("_hashes"), 1, SKETCH).alias("_sketch"), F.posexplode("_forms").alias("_at", "_form"))
    tokens_ = _once(F.split("_form", " ")).alias("_tokens")
    leaf = F.xxhash64(F.size("_tokens"), F.slice("_tokens", 1, DEPTH))
    by_line = by_line.select("_id", "_doc", F.when(F.col("_at") == 0, F.col("_sketch")).alias("_sketch"), "_form", tokens_)
    every = cut(by_line.select("_id", "_doc", "_sketch", (F.size("_tokens") > DEPTH).alias("_tailed"), F.xxhash64("_form").alias("_line"), leaf.alias("_leaf")))  # hashes only
    sketches = cut(every.filter("_sketch is not null").groupBy("_doc").agg(F.first("_sketch").alias("_sketch"), F.count("*").alias("_n")))
    lines = every.drop("_sketch")

    # merged at any size: what grows with the table is not to be broadcast in a small one only
    def held(rows: DataFrame, key: str) -> DataFrame:
        """Those rows whose key is in ``min_docs`` rows at all."""
        return cut(rows.join(rows.groupBy(key).agg(F.count("*").alias("_rows")).filter(F.col("_rows") >= min_docs).select(key).hint("merge"), key, "left_semi"))

    often = held(lines, "_line")
    recurs = cut(_recurs(often, "_line", sketches, min_docs, min_share))
    exact = often.join(recurs.hint("merge"), ["_line", "_doc"], "left_semi").select("_id", "_line")

    # other lines of leaves that recur: generalise their tails; a shorter line is a leaf of its own
    rest = held(lines.filter("_tailed").join(recurs.hint("merge"), ["_line", "_doc"], "left_anti"), "_leaf")
    open_ = rest.join(_recurs(rest, "_leaf", sketches, min_docs, min_share), ["_leaf", "_doc"], "left_semi")
    wanted = cut(open_.groupBy("_id").agg(F.collect_set("_line").alias("_open")))
    again = docs.select(F.col(id_col).alias("_key"), F.col(text_col).cast("string").alias("_text"))
    some = _lines(_among(again, "_key", wanted).join(wanted.hint("merge"), F.col("_key").eqNullSafe(F.col("_id"))), "_key", "_text", "_open")
    some = some.select("_id", "_doc", F.explode(F.filter("_forms", lambda f: F.array_contains("_open", F.xxhash64(f)))).alias("_form")).withColumn("_tokens", F.split("_form", " "))
    busy = cut(some.select("_id", "_doc", F.xxhash64("_form").alias("_line"), leaf.alias("_leaf"), F.slice(F.col("_tokens"), DEPTH + 1, F.size("_tokens")).alias("_tail")))
    counts = busy.select("_leaf", F.posexplode("_tail").alias("_pos", "_token")).groupBy("_leaf", "_pos", "_token").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min(LEVELS))
    placed = busy.select("_id", "_doc", "_line", "_leaf", F.size("_tail").alias("_size"), F.posexplode("_tail").alias("_pos", "_token"))
    often_here = placed.join(counts.hint("merge"), ["_leaf", "_pos", "_token"])
    lines_ = often_here.groupBy("_id", "_doc", "_line", "_leaf", "_size").agg(F.sort_array(F.collect_list(F.struct("_pos", "_token", "_n"))).alias("_often"))
    stays = [_at_least("_often", n) for n in LEVELS]
    forms_ = F.array(*(F.when(F.size(x) >= AGREES * F.col("_size"), F.xxhash64("_leaf", F.transform(x, lambda y: F.struct(y["_pos"], y["_token"])))) for x in stays))
    agreeing = cut(lines_.select("_id", "_doc", "_line", F.explode(F.array_distinct(F.filter(forms_, lambda x: x.isNotNull()))).alias("_template")))
    general = agreeing.join(_recurs(agreeing, "_template", sketches, min_docs, min_share), ["_template", "_doc"], "left_semi").select("_id", "_line")
    return exact.unionByName(general).groupBy("_id").agg(F.collect_set("_line").alias("_drop"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """``(row, text, n_lines, n_dropped)``: each row as a struct, its text without recurring lines.

    Lines are separated by ``\\n``; what stays keeps its order and bytes.
    Blank lines always stay.  A null text stays null with no lines; an empty
    one has one line.  Rows that share an id, a null one too, are each judged
    by the lines that recur under that id; repeated rows count as copies.  A
    line repeated within a document counts once and goes each time.  An empty
    table gives no rows.
    """
    drops = recurring(docs, id_col, text_col, min_docs, min_share)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("_key"))
    rows = rows.join(drops, F.col("_key").eqNullSafe(F.col("_id")), "left")
    text = F.col(f"row.`{text_col}`")
    lines, forms = F.split(text, "\n"), _forms(text)
    # the drops in as many parts as each has drops, so that many lines with many drops don't take their product
    parts = F.ceil(F.sqrt(F.size("_drop"))).cast("int")
    parted = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.filter("_drop", lambda h: F.pmod(h, parts) == i))
    rows = rows.withColumn("_parts", F.when(F.size("_drop") > 0, parted))
    goes = lambda h: F.array_contains(F.element_at("_parts", (F.pmod(h, F.size("_parts")) + 1).cast("int")), h)
    kept = F.transform(F.filter(F.arrays_zip(lines.alias("l"), forms.alias("f")), lambda x: ~goes(F.xxhash64(x["f"]))), lambda x: x["l"])
    rows = rows.withColumn("_kept", F.when(F.col("_parts").isNotNull(), kept))
    n_lines = F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1).cast("long")
    n_kept = F.when(F.col("_kept").isNull(), n_lines).otherwise(F.size("_kept")).cast("long")
    return rows.select("row", F.coalesce(F.array_join("_kept", "\n"), text).alias("text"), n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"))
