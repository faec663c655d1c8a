"""Mixing sources to target weights.

Each source's words are packed, in a pseudorandom order of its documents, into
blocks of ``BLOCK`` words.  For every output shard the counts of blocks by
source are drawn from a multinomial over what the targets still lack, so the
totals meet the targets.  The j-th slot of a source takes the block that the
source's permutation for round ``j // blocks`` puts at place ``j % blocks``;
slots and blocks are joined by (source, block).

A source's cap of 3 times its size leaves at most 3 slots a block, so no
document is taken more than 3 times.

Driver data: one row a source, and ``OUTPUT_SHARDS`` draws a source.

Defined results: null, empty and blank texts have size 0 and are not taken; a
null source is a source and comes last; repeated rows are documents of their
own; an empty table gives an empty result; extra columns are ignored by
``spans`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thali.llm.common import fenced, nested, stored, words

WEIGHTS = (5.0, 2.0, 1.0)
MOST_TIMES = 3
BLOCK = 32
OUTPUT_SHARDS = 64
#: Parts of a source that are laid out one after the other.
RUNS = 1024
SEED = 20240229


def targets(sizes: list[int], weights: list[float], most_times: float = MOST_TIMES) -> list[float]:
    """Words wanted of each source: shares of all words by weight, each at
    most ``most_times`` its size, the excess shared again by weight."""
    out = [0.0] * len(sizes)
    open_, left = [i for i, n in enumerate(sizes) if n > 0], float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most_times * sizes[i]]
        for i in full or open_:
            out[i] = float(most_times * sizes[i]) if full else unit * weights[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)] if full else []
    return out


def _key(text: Column) -> Column:
    """Rows of one key have one text; a null text is an empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def laid_out(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key, nth, run, start): ``start`` is the document's
    first word within its run of its source, ``nth`` its number among rows of one
    id, source and text, by the hash of the whole row."""
    size = F.size(words(F.coalesce(docs["text"], F.lit("")))).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), _key(docs["text"]).alias("key"),
                       F.xxhash64(F.struct(*[docs[c] for c in docs.columns])).alias("row"))
    rows = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "key"), F.lit(RUNS)).cast("int"))
    order = Window.partitionBy("source", "run").orderBy("doc_id", "key", "row")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    equal = Window.partitionBy("source", "run", "doc_id", "key").orderBy("row")
    return rows.withColumns({"start": F.coalesce(F.sum("size").over(before), F.lit(0)), "nth": F.row_number().over(equal)}).drop("row")


def draws(blocks: list[int], wanted: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source in each output shard: multinomial over what is
    still wanted, the last shard taking the rest."""
    left = np.array(wanted, dtype=np.int64)
    out = np.zeros((shards, len(blocks)), dtype=np.int64)
    rng = np.random.default_rng(seed)
    for k in range(shards):
        n = int(left.sum()) // (shards - k)
        if k == shards - 1 or n == 0:
            got = left.copy() if k == shards - 1 else np.zeros_like(left)
        else:
            got = np.minimum(rng.multinomial(n, left / left.sum()), left)
        out[k], left = got, left - got
    return out


def permuted(place: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where the permutation of ``[0, n)`` named by ``key`` sends ``place``:
    a four-round Feistel network on the next even power of two, walked until
    the value is below ``n``."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = place.astype(np.uint64), np.ones(len(place), dtype=bool)
    while todo.any():
        v, h, m, k = x[todo], half[todo], mask[todo], key[todo]
        a, b = v >> h, v & m
        for r in range(4):
            f = (b + k + np.uint64(r * 0x632BE5AB)) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & m)
        x[todo] = (a << h) | b
        todo[todo] = x[todo] >= n[todo].astype(np.uint64)
    return x.astype(np.int64)


def slots(spark, plan: list[tuple[int, int]], counts: np.ndarray, seed: int) -> DataFrame:
    """(shard, place, source_no, round, block): one row a block of the mix.

    ``plan`` has (source_no, blocks) of every source."""
    number = np.array([p[0] for p in plan], dtype=np.int64)
    blocks = np.array([p[1] for p in plan], dtype=np.int64)
    flat, columns = counts.reshape(-1), counts.shape[1]
    ends = np.cumsum(flat)
    firsts = np.vstack([np.zeros((1, columns), dtype=np.int64), np.cumsum(counts, axis=0)[:-1]]).reshape(-1)

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            i = f["id"].to_numpy()
            cell = np.searchsorted(ends, i, side="right")
            shard, s = cell // columns, cell % columns
            j = firsts[cell] + i - (ends[cell] - flat[cell])
            times, at = j // blocks[s], j % blocks[s]
            key = (np.uint64(seed) + number[s].astype(np.uint64) * np.uint64(1_000_003) + times.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            starts = ends.reshape(-1, columns)[:, -1] - counts.sum(axis=1)
            yield pd.DataFrame({"shard": shard.astype(np.int32), "place": i - starts[shard], "source_no": number[s].astype(np.int32),
                                "round": times.astype(np.int32), "block": permuted(at, blocks[s], key)})

    total = int(ends[-1]) if len(ends) else 0
    return spark.range(total).mapInPandas(drawn, "shard int, place long, source_no int, round int, block long")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, shards: int = OUTPUT_SHARDS,
          seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, spans).

    rows: doc_id, source, size, source_size, target, source_no, offset, one a
    document.  spans: shard, place, source_no, round, offset (of the document
    in its source), from_word, n_words; one a document and block of the mix.
    """
    spark = docs.sparkSession
    rows = stored(laid_out(docs), "laid-out")
    runs = rows.groupBy("source", "run").agg(F.sum("size").alias("words"))
    # one row a source on the driver
    found = runs.groupBy("source").agg(F.sum("words").alias("words")).collect()
    found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["words"] for r in found]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(found))])
    n_blocks = [-(-n // block) for n in sizes]
    wanted = [min(MOST_TIMES * b, round(b * g / n)) if n else 0 for b, g, n in zip(n_blocks, goals, sizes)]
    plan = [(i, b) for i, b in enumerate(n_blocks) if b]
    counts = draws([b for _, b in plan], [wanted[i] for i, _ in plan], shards, seed)

    table = spark.createDataFrame([(i, r["source"], sizes[i], goals[i]) for i, r in enumerate(found)],
                                  "source_no int, of string, source_size long, target double")
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select(F.col("source").alias("_s"), F.col("run").alias("_r"),
                        F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    placed = (rows.join(bases, rows["source"].eqNullSafe(bases["_s"]) & (rows["run"] == bases["_r"]))
              .join(table, F.col("source").eqNullSafe(F.col("of")))
              .select("doc_id", "source", "size", "key", "nth", "source_size", "target", "source_no",
                      (F.col("base") + F.col("start")).alias("offset")))

    first, last = F.col("offset"), F.col("offset") + F.col("size")
    cut = (placed.where("size > 0").select("source_no", "offset", "size", F.explode(F.sequence(
        F.floor(first / block), F.floor((last - 1) / block))).alias("block")))
    cut = cut.select("source_no", "block", "offset", F.greatest(F.col("block") * block - F.col("offset"), F.lit(0)).alias("from_word"),
                     F.least((F.col("block") + 1) * block - F.col("offset"), F.col("size")).alias("to_word"))
    spans = (slots(spark, plan, counts, seed).join(cut, ["source_no", "block"])
             .select("shard", "place", "source_no", "round", "offset", "from_word", (F.col("to_word") - F.col("from_word")).alias("n_words")))
    return placed, spans


def taken(docs: DataFrame, **how) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, source."""
    rows, spans = mixed(docs, **how)
    got = spans.groupBy("source_no", "offset").agg(F.sum("n_words").alias("taken")).withColumn("_some", F.lit(True))
    return (rows.withColumn("_some", F.col("size") > 0).join(got, ["source_no", "offset", "_some"], "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents with the columns of ``docs``.

    A round takes a document whole or some spans of its words.  Taken whole,
    the row stays as it is; else its text is the taken words with one space
    between, a line for each unbroken run.  A document taken in three rounds
    gives three rows; one taken in none gives no row.  ``n_chars``, where
    there, is the new text's length.
    """
    rows, spans = mixed(docs, **how)
    got = spans.groupBy("source_no", "offset", "round").agg(
        F.sum("n_words").alias("got"), F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("parts"))
    # a document of n words has at most n / BLOCK + 2 spans a round
    got = rows.where("size > 0").join(got, ["source_no", "offset"]).select(
        *[F.col(c).alias(f"_{c}") for c in ("doc_id", "size", "source", "key", "nth", "got", "parts")])
    whole = nested(docs, "doc_id", "text", "source").withColumn("_of", _key(F.col("text")))
    # each row meets its own spans: rows of one id, source and text are numbered as they were laid out
    equal = Window.partitionBy(F.coalesce("doc_id", F.lit(0)), F.isnull("doc_id"), "source", "_of").orderBy(F.xxhash64("_row"))
    met = whole.withColumn("_n", F.row_number().over(equal)).join(
        got, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source"))
        & (F.col("_of") == F.col("_key")) & (F.col("_n") == F.col("_nth")))
    # only texts that are cut are split, once each
    met = met.withColumn("_words", fenced(F.when(F.col("_got") != F.col("_size"), words(F.col("text")))))
    # spans that follow one another are one run
    starts = F.filter(F.transform(F.col("_parts"), lambda p, i: F.when((i == 0) | (
        F.get(F.col("_parts"), i - 1)["from_word"] + F.get(F.col("_parts"), i - 1)["n_words"] < p["from_word"]),
        p["from_word"])), lambda x: x.isNotNull())
    ends = F.filter(F.transform(F.col("_parts"), lambda p, i: F.when(
        F.coalesce(F.get(F.col("_parts"), i + 1)["from_word"] > p["from_word"] + p["n_words"], F.lit(True)),
        p["from_word"] + p["n_words"])), lambda x: x.isNotNull())
    cut = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: F.array_join(
        F.slice(F.col("_words"), (r["a"] + 1).cast("int"), (r["b"] - r["a"]).cast("int")), " ")), "\n")
    met = met.withColumn("_text", F.when(F.col("_got") == F.col("_size"), F.col("text")).otherwise(cut))
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    return met.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
