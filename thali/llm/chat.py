"""Chat formatting as relational expressions (native).

Turns are sorted structs; adjacent turns of one role merge into one block; the
formatted text is a concatenation.  A block is

    <|im_start|>ROLE\\n TEXT [<|im_sep|> TEXT ...] <|im_end|>\\n

and the texts of a merged block stay apart by ``<|im_sep|>``.  In roles and
texts every ``<|`` (with any backslashes between) gets one more backslash, so
no control string of theirs survives, and taking one backslash away gives the
original back.  In a role, a newline becomes ``&nl;`` and ``&`` ``&amp;``.

A conversation of any length is first cut in chunks of ``CHUNK`` turn numbers,
which are collected and formatted in tasks of their own; rows repeated whole
travel as one row with a count.  Only chunk results meet per conversation.

Defined results: turns sort by number, role, text, nulls first; null role and
null text are empty; repeated rows are turns of their own; a null conversation
id is a conversation; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LEARNED = "assistant"
CHUNK = 256


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", "<$1|")


def escaped_role(c: Column) -> Column:
    return escaped(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("\n"), F.lit("&nl;")))


def unescaped_role(c: Column) -> Column:
    return F.replace(F.replace(unescaped(c), F.lit("&nl;"), F.lit("\n")), F.lit("&amp;"), F.lit("&"))


def _merge(blocks: Column) -> Column:
    """Adjacent blocks of one role as one block with all their texts: a block
    that starts a run takes the texts up to the next start."""
    starts = F.filter(F.transform(blocks, lambda b, i: F.when(
        (i == 0) | (F.get(blocks, i - 1)["role"] != b["role"]), i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(blocks)))
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: F.struct(
        F.get(blocks, r["a"])["role"].alias("role"),
        F.flatten(F.transform(F.slice(blocks, r["a"] + 1, r["b"] - r["a"]), lambda x: x["texts"])).alias("texts")))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, segments, text): the formatted text, and the same cut into
    segments with ``learn`` true on the texts under the loss mask."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce(turns["role"], F.lit("")).alias("role"), F.coalesce(turns["text"], F.lit("")).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    rows = rows.withColumn("role", escaped_role(F.col("role"))).withColumn("text", escaped(F.col("text")))
    chunk = F.floor(F.col("turn") / CHUNK)
    parts = rows.groupBy("conv_id", chunk.alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "copies"))).alias("turns"))
    parts = parts.withColumn("blocks", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), F.array_repeat(t["text"], t["copies"]).alias("texts"))))
    parts = parts.select("conv_id", "chunk", "blocks").withColumn("merged", _merge(F.col("blocks")))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "merged"))).alias("chunks"))
    whole = whole.select("conv_id", F.flatten(F.transform("chunks", lambda c: c["merged"])).alias("blocks"))
    whole = whole.withColumn("merged", _merge(F.col("blocks"))).select("conv_id", "merged")

    def segment(text: Column, learn: Column) -> Column:
        return F.struct(text.alias("text"), learn.alias("learn"))

    def laid_out(b: Column) -> Column:
        learn = unescaped_role(b["role"]) == LEARNED
        said = F.flatten(F.transform(b["texts"], lambda t, i: F.array(
            segment(F.when(i > 0, F.lit(SEP)).otherwise(F.lit("")), F.lit(False)), segment(t, learn))))
        return F.concat(F.array(segment(F.concat(F.lit(START), b["role"], F.lit("\n")), F.lit(False))), said,
                        F.array(segment(F.lit(END), F.lit(False))))

    out = whole.withColumn("segments", F.flatten(F.transform("merged", laid_out)))
    return out.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("text"))


def read_back(text: Column) -> Column:
    """The turns (role, text) of a formatted text, in order."""
    blocks = F.filter(F.split(text, r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.char_length(head) + 2)
        role = unescaped_role(F.substr(head, F.lit(len(START) + 1)))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(shaped: DataFrame) -> DataFrame:
    """One row a conversation with what its formatted text says."""
    out = shaped.withColumn("turns", read_back(F.col("text")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["learn"]), lambda s: unescaped(s["text"])), "")
    out = out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                     loss.alias("loss"), F.char_length("text").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"),
                      F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
