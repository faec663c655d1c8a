"""Quality rules: a threshold table compiled into one projection (native).

Every rule is a row of ``RULES``: a measure with the least and the greatest
value that passes.  Measures are columns made of Spark's own functions over
the whole text, so the operator neither shuffles nor runs Python.

Defined results: a null text has no words and fails the base rule, like an
empty one; repeated rows are judged alike; extra columns stay; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thali.llm.common import BLANKS, fenced, nested, words

# Common words of the four languages.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by are this at from "
    "der die und in den von zu das sich mit des auf für ist im nicht dem ein eine als "
    "de la le et les en des un du une que est pour par dans avec qui pas sur au "
    "de la que el en y los las se del un por con no una su para es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    measure: str
    least: float | None = None
    most: float | None = None


#: Fails by contract.
BASE_RULES = (Rule("n_words", least=50), Rule("repeat_percent", most=50))
#: The verdict of the method beside the base.
RULES = (
    Rule("mean_word_chars", least=2, most=25),
    Rule("symbols_per_word", most=0.3),
    Rule("stop_share", least=0.04),
    Rule("duplicate_line_share", most=0.4),
    Rule("bullet_line_share", most=0.9),
    Rule("ellipsis_line_share", most=0.3),
)

_POS_BITS = 30  # a text has fewer than 2^30 words, as a string has fewer than 2^31 bytes


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns that the rules read, as ``_m.<name>``."""
    n = F.size("_w")
    gap = F.lit((1 << _POS_BITS) - 1).cast("long")

    def packed(word: Column, i: Column) -> Column:
        h = F.xxhash64(F.get(F.col("_w"), i), F.get(F.col("_w"), i + 1), word)
        return F.shiftleft(h, _POS_BITS).bitwiseOR(i.cast("long"))

    def same_hash(x: Column, i: Column) -> Column:
        up, down = F.get(F.col("_p"), i + 1), F.get(F.col("_p"), i - 1)
        code = F.shiftright(x, _POS_BITS)
        return code.eqNullSafe(F.shiftright(up, _POS_BITS)) | code.eqNullSafe(F.shiftright(down, _POS_BITS))

    def window(x: Column) -> Column:
        at = x.bitwiseAND(gap).cast("int")
        return F.struct(F.concat_ws(" ", *[F.get(F.col("_w"), at + k) for k in range(3)]).alias("g"), at.alias("p"))

    def same_text(s: Column, i: Column) -> Column:
        up, down = F.get(F.col("_g"), i + 1), F.get(F.col("_g"), i - 1)
        return s["g"].eqNullSafe(up["g"]) | s["g"].eqNullSafe(down["g"])

    out = docs.withColumn("_t", F.coalesce(docs["text"], F.lit("")))
    out = out.withColumns({
        "_w": words(F.col("_t")),
        "_l": F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0),
    })
    # windows by hash and place, sorted; equal windows have equal hashes, the texts then decide
    out = out.withColumn("_p", F.sort_array(F.transform(F.slice("_w", F.lit(3), F.greatest(n - 2, F.lit(0))), packed)))
    out = out.withColumn("_g", F.sort_array(F.transform(F.filter("_p", same_hash), window)))
    out = out.withColumn("_r", F.transform(F.filter("_g", same_text), lambda s: s["p"]))
    covered = F.array_distinct(F.flatten(F.array("_r", F.transform("_r", lambda p: p + 1), F.transform("_r", lambda p: p + 2))))
    stop = F.size(F.filter("_w", lambda w: w.isin(sorted({f(x) for x in STOP_WORDS for f in (str.lower, str.capitalize, str.upper)}))))
    lines = F.size("_l")
    start = F.lit(r"^[\x20\x09]*[-*•·‣]")
    out = out.withColumn("_c", fenced(F.struct(
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.regexp_replace("_t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (lines - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
        stop.cast("long").alias("n_stop_words"),
        lines.cast("long").alias("n_lines"),
        F.size(F.filter("_l", lambda x: F.rlike(x, start))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_l", lambda x: F.rlike(x, F.lit(r"(\.\.\.|…)[\x20\x09\x0D]*$")))).cast("long").alias("n_ellipsis_lines"),
    )))
    per_word = lambda c: F.col(f"_c.{c}") / F.greatest(F.col("_c.n_words"), F.lit(1))
    per_line = lambda c: F.col(f"_c.{c}") / F.greatest(F.col("_c.n_lines"), F.lit(1))
    return out.withColumn("_m", F.struct(
        "_c.*",
        (100 * per_word("n_repeat_words")).alias("repeat_percent"),
        per_word("word_chars").alias("mean_word_chars"),
        per_word("n_symbols").alias("symbols_per_word"),
        per_word("n_stop_words").alias("stop_share"),
        per_line("n_dup_lines").alias("duplicate_line_share"),
        per_line("n_bullet_lines").alias("bullet_line_share"),
        per_line("n_ellipsis_lines").alias("ellipsis_line_share"),
    )).drop("_t", "_w", "_l", "_p", "_g", "_r", "_c")


def passes(rules: tuple[Rule, ...]) -> Column:
    """True where every rule holds."""
    ok = F.lit(True)
    for r in rules:
        value = F.col(f"_m.{r.measure}")
        if r.least is not None:
            ok = ok & (value >= r.least)
        if r.most is not None:
            ok = ok & (value <= r.most)
    return ok


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``_m`` (all measures), ``base_failed`` and ``kept``."""
    out = measured(docs).withColumn("_base_ok", passes(BASE_RULES))
    return out.withColumns({"base_failed": ~F.col("_base_ok"), "kept": F.col("_base_ok") & passes(rules)}).drop("_base_ok")


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a document with its counts, ``base_failed`` and ``kept``."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judge(docs.select("doc_id", "text"), rules).select(
        "doc_id", *[f"_m.{c}" for c in counts], "base_failed", "kept",
        "_m.n_stop_words", "_m.mean_word_chars", "_m.symbols_per_word", "_m.stop_share", "_m.duplicate_line_share")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    return judge(nested(docs, "text"), rules).where("kept").select("_row.*")
