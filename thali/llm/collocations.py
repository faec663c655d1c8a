"""Phrase collocations by set-oriented relational mining (SETM).

The occurrence relation holds every word of every text by (document, piece,
position), sorted, as 64-bit word keys; a document's occurrences are one row, a
0 between pieces, so neighbours in the relation are neighbours in a piece.  The
relation of length k+1 is the merge join of that of length k with the words: an
occurrence joins the word at the next position of its piece.  Each length is
group-counted; its frequent groups (``least`` or more) semi-join the
occurrences before they are extended.

A word's key is the XXH64 of its lang and text under a seed for which no two
words of the corpus share a key (checked against all of them; the next seed is
tried otherwise), so counting by keys is exact.

Pairs are counted in two steps, as few of them are frequent: all by one hash
(pairs of one hash together, so no frequent one is missed), then those in
question by their words.  Longer groups are counted by their words at once, as
their parts have left few.  The semi-join
inside tasks is a bit table of fixed size (``BITS``) that may pass too much and
never too little; the joins with the counts decide.

Defined results: null and empty texts and pieces without words have no words; a
null lang is ``und``, like one that is called so; repeated rows count each
time; extra columns are ignored; ties in score go by count, then by phrase in
UTF-8 order; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thali.llm.common import slices, stored

LONGEST, LEAST, INSIDE, TOP = 3, 10, 50, 2000
# Characters that end a piece; the rest of the white space parts words.
STOPS = b".,;:!?\n\x0b\x0c\r"
#: Bits of the table that a task tests groups against: 8 MB whatever the input.
BITS = 1 << 26
#: Words that a task numbers at once, and occurrences that it groups at once.
WORDS_AT_ONCE = 1 << 19
AT_ONCE = 1 << 17
_TO_BREAK = bytes.maketrans(STOPS, b"\n" * len(STOPS))
_BREAK = b"\n"


def marked_words(text: str | None) -> list[bytes]:
    """Words of a text in order, A-Z lowered, a line feed after each piece."""
    out: list[bytes] = []
    for piece in (text or "").encode().lower().translate(_TO_BREAK).split(_BREAK):
        own = piece.split()  # only blanks and tabs are left to part words
        if own:
            out += own
            out.append(_BREAK)
    return out


def word_key(lang: bytes, word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(b"%d:%b%b" % (len(lang), lang, word), seed) or 1


def read(docs: DataFrame, seed: int = 0) -> DataFrame:
    """One pass over the texts.  Rows are either a document (keys: its words by
    piece and position, 0 after each piece) or a word that a task met (lang,
    word, key, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emptied():
            number = itertools.count(1)
            return defaultdict(lambda: defaultdict(number.__next__)), [], 0

        code, held, size = emptied()  # lang: word: its number in this task

        def flushed():
            named = [(n, lang, word) for lang, own in code.items() for word, n in own.items() if word != _BREAK]
            keys = np.zeros(1 + sum(map(len, code.values())), dtype=np.uint64)  # 0 for a break
            keys[[n for n, _, _ in named]] = [word_key(lang, word, seed) for _, lang, word in named]
            flat = np.concatenate(held)
            ends = np.cumsum([len(x) for x in held])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(keys[flat].view(np.int64)))
            none = lambda t, n: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays([none(pa.string(), len(held)), none(pa.string(), len(held)), none(pa.int64(), len(held)), none(pa.int64(), len(held)), lists], names)
            times = np.bincount(flat, minlength=len(keys))
            for at in range(0, len(named), 1 << 16):
                part = named[at:at + (1 << 16)]
                place = np.array([n for n, _, _ in part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for _, x, _ in part], pa.binary()).cast(pa.string()), pa.array([x for _, _, x in part], pa.binary()).cast(pa.string()),
                     pa.array(keys[place].view(np.int64)), pa.array(times[place]), none(pa.list_(pa.int64()), len(part))], names)

        for part in slices(batches, size=1 << 20):
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                own = code[lang.encode()]
                own[_BREAK]  # has a number too, whose key is 0
                words = marked_words(text)
                held.append(np.fromiter(map(own.__getitem__, words), dtype=np.int64, count=len(words)))
                size += len(words)
                if size >= WORDS_AT_ONCE:
                    yield from flushed()
                    code, held, size = emptied()
        if held:
            yield from flushed()

    names = ["lang", "word", "key", "n", "keys"]
    rows = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    return stored(rows.mapInArrow(run, "lang string, word string, key long, n long, keys array<long>"), "read", "zstd")


def occurrences(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sorted occurrence relation (keys), one row a document, and all words
    (lang, word, key, n), under a seed for which no two words share a key."""
    for seed in range(100):
        rows = read(docs, seed)
        words = stored(rows.where("word is not null").groupBy("lang", "word", "key").agg(F.sum("n").alias("n")), "words", "zstd")
        if words.groupBy("key").count().where("count > 1").isEmpty():
            return rows.where("keys is not null").select("keys"), words
    raise ValueError("no seed tells the words apart")


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of each group."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for c in columns:
        h = (h ^ c.view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


class BitTable:
    """A set of hashes as bits of a table of fixed size; two bits a hash."""

    def __init__(self, bits: np.ndarray | None = None):
        self.bits = np.zeros(BITS >> 3, dtype=np.uint8) if bits is None else bits

    @staticmethod
    def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.uint64(BITS - 1)
        return hashes & size, (hashes >> np.uint64(33)) & size

    def add(self, hashes: np.ndarray) -> None:
        for place in self._places(hashes):
            np.bitwise_or.at(self.bits, place >> np.uint64(3), (np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for place in self._places(hashes):
            found &= (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def bit_table(hashes: DataFrame) -> np.ndarray:
    """The table's bits of the ``h`` of all rows.  Each task sets its own, and
    they meet by slices of the table, so no task or driver holds more than the
    fixed size."""
    slice_bytes = 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = BitTable()
        for batch in batches:
            table.add(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        rows = [(i, part.tobytes()) for i, part in enumerate(table.bits.reshape(-1, min(slice_bytes, len(table.bits)))) if part.any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["i", "bits"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, bits in zip(*(c.to_pylist() for c in batch.columns)):
                new = np.frombuffer(bits, dtype=np.uint8)
                own[i] = own[i] | new if i in own else new
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([x.tobytes() for x in own.values()], pa.binary())], ["i", "bits"])

    n = max(1, (BITS >> 3) // slice_bytes)
    parts = hashes.select("h").mapInArrow(run, "i int, bits binary").repartition(n, "i").mapInArrow(joined, "i int, bits binary")
    table = BitTable().bits.reshape(n, -1)
    for i, bits in parts.collect():
        table[i] = np.frombuffer(bits, dtype=np.uint8)
    return table.reshape(-1)


def counted_groups(relation: DataFrame, length: int, frequent: list, exact: bool) -> DataFrame:
    """Counts of the groups of ``length`` words, by hash ``h`` or, if ``exact``,
    by their words.  ``frequent`` holds a broadcast table for each length
    below, and for this one too if ``exact``: an occurrence counts only if every
    part of it is in its table."""
    columns = [f"w{i + 1}" for i in range(length)] if exact else ["h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [BitTable(f.value) for f in frequent]

        def grouped(keys: np.ndarray) -> pa.RecordBatch:
            # merge joins of the sorted relation with itself: place i, next position
            ok = keys != 0
            if tables:
                ok &= tables[0].has(_mixed([keys]))
            starts = np.flatnonzero(ok)
            for k in range(1, length):
                starts = np.flatnonzero(ok[:-1] & ok[1:])  # both parts, one position apart
                if k < len(tables):  # the semi-join with this length's frequent groups
                    starts = starts[tables[k].has(_mixed([keys[starts + j] for j in range(k + 1)]))]
                ok = np.zeros(len(keys), dtype=bool)
                ok[starts] = True
            words = [keys[starts + j] for j in range(length)]
            h = _mixed(words)
            if exact:
                order = np.lexsort(words[::-1])
                words = [w[order] for w in words]
                new = np.ones(len(order), dtype=bool)
                new[1:] = np.any([w[1:] != w[:-1] for w in words], axis=0) if len(order) else False
                firsts = np.flatnonzero(new)
                n = np.diff(firsts, append=len(order))
                return pa.RecordBatch.from_arrays([pa.array(w[firsts]) for w in words] + [pa.array(n.astype(np.int64))], [*columns, "n"])
            h, n = np.unique(h, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        held, size = [], 0
        for part in (batch.slice(at, 512) for batch in batches for at in range(0, batch.num_rows, 512)):
            lists = part.column(0)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
            held.append(np.insert(values, ends, 0))  # texts do not touch
            size += len(held[-1])
            if size >= AT_ONCE:
                yield grouped(np.concatenate(held))
                held, size = [], 0
        if held:
            yield grouped(np.concatenate(held))

    schema = ", ".join(f"{c} long" for c in columns) + ", n long"
    return relation.mapInArrow(run, schema).groupBy(*columns).agg(F.sum("n").alias("n"))


def _hash_rows(counts: DataFrame, length: int) -> DataFrame:
    """The hash ``h`` of each group of words."""
    columns = [f"w{i + 1}" for i in range(length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array(_mixed(words).view(np.int64))], ["h"])

    return counts.select(*columns).mapInArrow(run, "h long")


def frequent_phrases(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """All words (lang, word, n), and for each length 1..longest the frequent
    phrases (w1.., n)."""
    spark = docs.sparkSession
    relation, words = occurrences(docs)
    often = stored(words.where(F.col("n") >= least).select(F.col("key").alias("w1"), "lang", "word", "n"), "frequent")
    found, tables = [often], [spark.sparkContext.broadcast(bit_table(_hash_rows(often, 1)))]
    for length in range(2, longest + 1):
        if length == 2:  # most pairs of words are rare: what may be frequent is found by hash first
            rough = stored(counted_groups(relation, length, tables, exact=False).where(F.col("n") >= least).select("h"), "rough")
            tables.append(spark.sparkContext.broadcast(bit_table(rough)))
        found.append(stored(counted_groups(relation, length, tables, exact=True).where(F.col("n") >= least), f"phrases_{length}"))
        if 2 < length < longest:
            tables.append(spark.sparkContext.broadcast(bit_table(_hash_rows(found[-1], length))))
    for t in tables:
        t.unpersist()
    return words, found


def top_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's ``top`` phrases."""
    words, found = frequent_phrases(docs, longest, least)
    out = None
    for length in range(2, longest + 1):
        own = [f"w{i + 1}" for i in range(length)]
        rows = found[length - 1].withColumnRenamed("n", "a")
        for k in range(1, length):  # counts of the parts of each cut
            for part, name in ((own[:k], f"l{k}"), (own[k:], f"r{k}")):
                counts = found[len(part) - 1].select(*[F.col(f"w{i + 1}").alias(w) for i, w in enumerate(part)], F.col("n").alias(name))
                rows = rows.join(counts, part)
        # exact: 10^6 a^2 has fewer than 38 digits for any count below 10^16
        a = F.col("a").cast("decimal(20,0)")
        cuts = []
        for k in range(1, length):
            over = F.col(f"l{k}").cast("decimal(19,0)") * F.col(f"r{k}").cast("decimal(19,0)")
            score = F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * a * a, over)
            cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        rows = rows.withColumn("cut", F.array_min(F.array(*cuts)))
        # longer candidates around this one
        for longer in range(length + 1, longest + 1):
            around = found[longer - 1]
            parts = F.array(*[F.struct(*[F.col(f"w{i + j + 1}").alias(own[j]) for j in range(length)]) for i in range(longer - length + 1)])
            around = around.select(F.explode(parts).alias("p"), "n").select("p.*", "n")
            most = around.groupBy(*own).agg(F.max("n").alias("most"))
            rows = rows.join(most, own, "left").where(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a"))).drop("most")
        for w in own:
            text = found[0].select(F.col("w1").alias(w), F.col("word").alias(f"{w}_text"), *([F.col("lang")] if w == "w1" else []))
            rows = rows.join(text, w)
        rows = rows.select("lang", F.concat_ws(" ", *[f"{w}_text" for w in own]).alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
        out = rows if out is None else out.unionByName(rows)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    n = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return out.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

