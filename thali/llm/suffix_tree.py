"""LM scoring with a probabilistic suffix tree.

A text is its tokens: words, A-Z lowered, each with a space after, then an end
mark.  The tree's symbols are the bytes of that stream (a text starts after an
end mark), so a token's probability is the product of its bytes', and the
text's that of its tokens'.

Contexts of up to ``DEPTH`` symbols are counted over all learned texts, each
depth from the counts of the next deeper one.  A context is a state if it was
seen ``LEAST`` times or more and its next-symbol distribution diverges from its
suffix's by more than it costs to describe: its count times the Kullback-Leibler
divergence, in nats, is at least half its distinct symbols times the logarithm
of its count, plus ``MARGIN``.  Neither bound depends on the size of the corpus,
so a context that once is a state stays one when unrelated text is added, and
the tree grows with what is learned.  A state's distribution is smoothed towards
its longest suffix state's with as much weight as it has distinct symbols; the
root adds 1/2 to each of 257 symbols.  A symbol is scored by the longest state
that is a suffix of what precedes it.

States are a stored table of any size.  A chunk of texts (``CHUNK_TOKENS``
tokens, within one task) asks for the contexts that it has, once each, and gets
those that are states; so it does for the counts of its words, which the base
score needs.  Rows follow the distinct contexts and words of a chunk, not its
tokens, and no task or driver holds the tree.  What a task of the join has for a
chunk goes there as one row of arrays.

Defined results: a null text is an empty one, which has the end mark alone; a
null ``doc_id`` hashes as an empty string; repeated rows are texts of their
own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from thali.llm.common import slices, stored

DEPTH = 5
LEAST = 16
MARGIN = 3.0
CHUNK_TOKENS = 5_000_000
SYMBOLS = 257
_BITS = 9
_MASK = (1 << _BITS) - 1
_COUNT = 48  # a symbol and its count in one long
#: Distinct grams that a task holds before it hands them on.
_HELD = 1 << 20
#: Bytes of text that are counted or scored at once, symbols whose keys are made
#: at once, symbols whose states are looked up at once, and longs that a task
#: holds before it hands them on as arrays.
_AT_ONCE = 1 << 22
_IN_CACHE = 1 << 16
_LOOKED_UP = 1 << 24
_PACKED = 1 << 21
#: A text's number beside a key in one long.
_TEXT_BITS = 63 - _BITS * (DEPTH + 1)


def split_words(texts: pa.Array) -> pa.ListArray:
    """The words of each text, as they are written; a null text has none."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = parts.flatten()
    has = pc.greater(pc.binary_length(flat), 0)  # none before the first space or after the last
    ends = np.concatenate([[0], np.cumsum(has.to_numpy(zero_copy_only=False))])
    offsets = parts.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(ends[offsets - offsets[0]], pa.int32()), flat.filter(has))


class Words:
    """The words of a chunk, numbered by first place once all are added."""

    def __init__(self):
        self.parts: list[pa.Array] = []

    def add(self, words: pa.Array) -> np.ndarray:
        """The place of each word among the distinct ones that are added with it."""
        own = words.view(pa.binary()).dictionary_encode()
        self.parts.append(own.dictionary.cast(pa.large_binary()))
        return own.indices.to_numpy()

    def numbered(self) -> tuple[pa.Array, list[np.ndarray]]:
        """All words by number, and for each ``add`` the numbers by place."""
        both = pa.concat_arrays([pa.array([], pa.large_binary()), *self.parts]).dictionary_encode()
        return both.dictionary, np.split(both.indices.to_numpy(), np.cumsum([len(x) for x in self.parts])[:-1])


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def squeezed(text: bytes) -> bytes:
    return len(text).to_bytes(8, "little") + _codec().compress(text, asbytes=True)


def restored(data: bytes) -> bytes:
    return _codec().decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def stream(joined: bytes) -> bytes:
    return b"\n" + joined + b" \n" if joined else b"\n\n"


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each distinct value of a sorted array starts."""
    new = np.ones(len(keys), dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[runs(keys)]


def is_learned(doc_id: Column) -> Column:
    """Whether a document is learned from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 1


def low(depth: int) -> int:
    """A mask of the newest ``depth`` symbols."""
    return (1 << _BITS * depth) - 1


def gram_keys(streams: list[bytes]) -> np.ndarray:
    """(context, symbol) of each symbol but the first of each stream: up to
    ``DEPTH`` + 1 symbols, the newest in the low bits; a context ends at its
    text's start mark."""
    sizes = np.fromiter(map(len, streams), dtype=np.int64, count=len(streams))
    apart = b"\0" * DEPTH  # before each stream; no symbol there
    data = np.frombuffer(apart + apart.join(streams), dtype=np.uint8).astype(np.int32)
    data += 1
    starts = np.cumsum(sizes + DEPTH) - sizes
    data[(starts[:, None] - np.arange(1, DEPTH + 1)).ravel()] = 0
    out = np.empty(len(data) - DEPTH, dtype=np.int64)
    for at in range(0, len(out), _IN_CACHE):
        key = out[at:at + _IN_CACHE]
        part = data[at:at + len(key) + DEPTH]
        three = (part[:-2] << 2 * _BITS) | (part[1:-1] << _BITS) | part[2:]  # half a key
        key[:] = three[:len(key)]
        key <<= 3 * _BITS
        key |= three[3:]
    scored = np.ones(len(out), dtype=bool)  # neither between the streams nor their first symbols
    scored[starts - DEPTH] = False
    after = (starts + sizes)[:-1, None] - DEPTH + np.arange(DEPTH)
    scored[after.ravel()] = False
    return out[scored]


def contexts_of(keys: np.ndarray) -> np.ndarray:
    """All contexts, of any depth from 1, that the keys have."""
    full = distinct(keys >> _BITS)
    return distinct(np.concatenate([full, *(distinct(full & low(d)) for d in range(1, DEPTH))]))


class Grams:
    """Distinct grams so far, with how often they were learned."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, streams: list[bytes], learn: bool) -> None:
        keys = gram_keys(streams)
        keys.sort()
        starts = runs(keys)
        n = np.diff(starts, append=len(keys)) if learn else np.zeros(len(starts), np.int64)
        self.parts.append((keys[starts], n))
        self.size += len(starts)
        if self.size > 4 * _HELD:  # what many parts share counts once
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        """The grams in order, and their counts."""
        if len(self.parts) > 1:
            keys, n = (np.concatenate(x) for x in zip(*self.parts))
            order = np.argsort(keys)
            keys = keys[order]
            starts = runs(keys)
            self.parts = [(keys[starts], np.add.reduceat(n[order], starts))]
            self.size = len(starts)
        return self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def read_chunks(docs: DataFrame) -> DataFrame:
    """One pass over the texts.  Rows by ``kind``: a document (chunk, its number
    there, doc_id, learned, its words), a word of a chunk (chunk, its number by
    first place, word, learned count), a context that a chunk has (chunk,
    context), a gram (key, learned count)."""
    ids = docs.select("doc_id").schema["doc_id"]
    id_type = to_arrow_type(ids.dataType)
    schema = StructType([StructField("kind", StringType()), StructField("chunk", LongType()), StructField("number", LongType()),
                         StructField("doc_id", ids.dataType), StructField("learned", BooleanType()), StructField("data", BinaryType()),
                         StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, seen = TaskContext.get().partitionId() << 24, 0
        words, learned = Words(), []
        grams, asked, texts = Grams(), np.zeros(0, np.int64), 0
        waiting: dict[bool, list[bytes]] = {True: [], False: []}
        size = {True: 0, False: 0}

        def rows(kind, number, data=None, n=None, doc_id=None, learned=None):
            many = len(number)
            nulls = lambda t: pa.nulls(many, t)
            return pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(kind), many), pa.repeat(pa.scalar(chunk, pa.int64()), many), pa.array(number, pa.int64()),
                 nulls(id_type) if doc_id is None else doc_id, nulls(pa.bool_()) if learned is None else learned,
                 nulls(pa.binary()) if data is None else pa.array(data, pa.binary()), nulls(pa.int64()) if n is None else pa.array(n, pa.int64())],
                ["kind", "chunk", "number", "doc_id", "learned", "data", "n"])

        def count(learn):
            if waiting[learn]:
                grams.add(waiting[learn], learn)
                waiting[learn], size[learn] = [], 0

        def counted():
            nonlocal asked
            keys, times = grams.merge()
            grams.parts, grams.size = [], 0
            asked = distinct(np.concatenate([asked, contexts_of(keys)]))
            yield rows("gram", keys[times > 0], n=times[times > 0])

        def ended():
            nonlocal asked, words
            count(True)
            count(False)
            yield from counted()
            spelled, numbers = words.numbered()
            n = np.zeros(len(spelled), np.int64)
            for own, times in zip(numbers, learned):
                n[own] += times  # the words of a part are distinct
            for at in range(0, len(spelled), 1 << 16):
                part = spelled[at:at + (1 << 16)]
                yield rows("word", np.arange(at, at + len(part)), part.cast(pa.binary()), n[at:at + len(part)])
            yield rows("ask", asked)
            words, asked = Words(), asked[:0]
            learned.clear()

        for part in slices(batches):
            data = []
            own = split_words(pc.ascii_lower(part.column(1)))
            places = words.add(own.values)
            of_learned = np.repeat(part.column(2).to_numpy(zero_copy_only=False), np.diff(own.offsets.to_numpy()))
            learned.append(np.bincount(places[of_learned], minlength=len(words.parts[-1])))
            seen += len(places)
            for joined, learn in zip(pc.binary_join(own, " ").view(pa.binary()).to_pylist(), part.column(2).to_pylist()):
                data.append(squeezed(joined))
                waiting[learn].append(stream(joined))
                size[learn] += len(waiting[learn][-1])
                if size[learn] > _AT_ONCE:
                    count(learn)
            yield rows("doc", np.arange(texts, texts + len(data)), data, doc_id=part.column(0), learned=part.column(2))
            texts += len(data)
            if grams.size > 2 * _HELD and len(grams.parts) == 1:
                yield from counted()
            if seen >= CHUNK_TOKENS:
                yield from ended()
                chunk, seen, texts = chunk + 1, 0, 0
        yield from ended()

    return docs.select("doc_id", "text", is_learned(F.col("doc_id")).alias("learned")).mapInArrow(run, schema)


def _at_depth(depth: int) -> Column:
    """A context of exactly that many symbols."""
    return F.col("context") > low(depth - 1) if depth else F.col("context") == 0


def tree(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The states but the root (context, next), and the root's counts
    (symbol, n).  ``next`` has a long for each next symbol, its count in the low
    bits.  ``grams``: key, n."""
    level = grams.groupBy("key").agg(F.sum("n").alias("n"))
    level = stored(level.select(F.shiftright("key", _BITS).alias("context"), F.col("key").bitwiseAND(_MASK).alias("symbol"), "n"), "grams")
    count = lambda x: x.bitwiseAND((1 << _COUNT) - 1)
    states = None
    for depth in range(DEPTH, 0, -1):
        own = (level.where(_at_depth(depth)).groupBy("context")
               .agg(F.sum("n").alias("total"), F.collect_list(F.shiftleft("symbol", _COUNT).bitwiseOR(F.col("n"))).alias("next"))
               .where(F.col("total") >= LEAST))  # a list has at most 257 symbols
        level = stored(level.groupBy(F.col("context").bitwiseAND(low(depth - 1)).alias("context"), "symbol").agg(F.sum("n").alias("n")), f"grams_{depth - 1}")
        suffix = (level.where(_at_depth(depth - 1)).groupBy(F.col("context").alias("suffix"))
                  .agg(F.sum("n").alias("total_s"), F.map_from_entries(F.collect_list(F.struct("symbol", "n"))).alias("next_s")))
        both = own.withColumn("suffix", F.col("context").bitwiseAND(low(depth - 1))).join(suffix, "suffix")

        def gain(x: Column) -> Column:
            n, n_s = count(x), F.col("next_s")[F.shiftrightunsigned(x, _COUNT)]
            return n * F.log((n / F.col("total")) / (n_s / F.col("total_s")))

        gained = F.aggregate("next", F.lit(0.0), lambda s, x: s + gain(x))
        cost = 0.5 * F.size("next") * F.log("total") + MARGIN
        kept = both.where(gained >= cost).select("context", "next")
        states = kept if states is None else states.unionByName(kept)
    return stored(states, "states", "zstd"), level.select("symbol", "n")


def in_arrays(rows: DataFrame) -> DataFrame:
    """``rows`` (chunk, key, value: a long or a list of longs, first: counted or
    null) with a row a chunk, or a few, in each task: keys, sizes of the lists and
    values as arrays of longs."""
    schema = StructType([StructField("chunk", LongType()), StructField("keys", BinaryType()), StructField("sizes", BinaryType()),
                         StructField("values", BinaryType()), StructField("firsts", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def ended():
            nonlocal size
            chunk = np.concatenate([b.column("chunk").to_numpy() for b in held])
            order = np.argsort(chunk, kind="stable")
            table = pa.Table.from_batches(held).take(pa.array(order)).combine_chunks()
            held.clear()
            size = 0
            chunk, keys = chunk[order], table.column("key").to_numpy()
            first = pc.fill_null(table.column("first"), False).to_numpy()
            value = table.column("value").chunk(0)
            lists = pa.types.is_list(value.type)
            offsets = value.offsets.to_numpy() if lists else np.arange(len(value) + 1)
            values = (value.values if lists else value).to_numpy()
            starts = runs(chunk)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(chunk)]):
                sizes = np.diff(offsets[a:b + 1]).astype(np.int64).tobytes() if lists else None
                own = [int(chunk[a]), keys[a:b].tobytes(), sizes, values[offsets[a]:offsets[b]].tobytes(), int(first[a:b].sum())]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(own, (pa.int64(), *[pa.binary()] * 3, pa.int64()))], schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            value = batch.column("value")
            size += len(value.flatten()) if pa.types.is_list(value.type) else len(value)
            if size > _PACKED:
                yield from ended()
        if held:
            yield from ended()

    return rows.select("chunk", "key", "value", "first").mapInArrow(run, schema)


def longs(column: pa.ChunkedArray) -> np.ndarray:
    """What the rows' arrays hold, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int64)


class States:
    """The states that a chunk has, and how they score grams."""

    def __init__(self, root: np.ndarray, contexts: np.ndarray, sizes: np.ndarray, values: np.ndarray):
        self.root = root
        order = np.argsort(contexts)
        self.contexts = contexts[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        of = np.repeat(place, sizes)
        cells = of << _BITS | values >> _COUNT
        by_cell = np.argsort(cells)
        self.cells, self.n = cells[by_cell], (values & ((1 << _COUNT) - 1))[by_cell]
        self.total = np.bincount(of, weights=values & ((1 << _COUNT) - 1), minlength=len(order))
        self.kinds = np.bincount(of, minlength=len(order)).astype(np.float64)

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Place of each key in a sorted table, -1 for none."""
        if not len(table):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol after its context; the keys are
        sorted and distinct."""
        symbol = keys & _MASK
        p = self.root[symbol]
        contexts = keys >> _BITS
        starts = runs(contexts)
        of = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(keys)))
        contexts = contexts[starts]
        for depth in range(1, DEPTH + 1):
            own = contexts & low(depth)
            state = np.where(own > low(depth - 1), self._find(self.contexts, own), -1)[of]
            rows = np.flatnonzero(state >= 0)
            state = state[rows]
            cell = self._find(self.cells, state << _BITS | symbol[rows])
            n = np.where(cell >= 0, self.n[cell], 0) if len(self.n) else np.zeros(len(rows))
            p[rows] = (n + self.kinds[state] * p[rows]) / (self.total[state] + self.kinds[state])
        return np.log10(p)


def score(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score."""
    chunks = stored(read_chunks(docs), "chunks", "zstd")
    states, root_counts = tree(chunks.where("kind = 'gram'").select(F.col("number").alias("key"), "n"))
    root = np.full(SYMBOLS, 0.5)
    for r in root_counts.collect():  # a row a symbol
        root[r["symbol"]] += r["n"]
    root /= root.sum()

    # every word's count, at each chunk that has it; a word has a row a chunk
    same = Window.partitionBy("word")
    words = chunks.where("kind = 'word'").select("chunk", F.col("number").alias("code"), F.col("data").alias("word"), "n")
    counted = words.select("chunk", F.col("code").alias("key"), F.sum("n").over(same).alias("value"),
                           (F.row_number().over(same.orderBy("chunk")) == 1).alias("first"))
    counted = stored(in_arrays(counted.where("value > 0")), "words", "zstd")
    ends = chunks.where("kind = 'doc' and learned").count()
    n_all = (chunks.where("kind = 'word'").agg(F.sum("n")).first()[0] or 0) + ends
    n_distinct = (counted.agg(F.sum("firsts")).first()[0] or 0) + (ends > 0)

    # each chunk's states, words and texts side by side: one shuffle, no join of groups
    ids_type = docs.select("doc_id").schema["doc_id"].dataType
    none = {"keys": F.lit(None).cast("binary"), "sizes": F.lit(None).cast("binary"), "values": F.lit(None).cast("binary"),
            "number": F.lit(None).cast("long"), "doc_id": F.lit(None).cast(ids_type), "learned": F.lit(None).cast("boolean"),
            "data": F.lit(None).cast("binary")}

    def rows(df: DataFrame, order: int, *own: str) -> DataFrame:
        return df.select("chunk", F.lit(order).alias("order"), *[F.col(c) if c in own else v.alias(c) for c, v in none.items()])

    answers = chunks.where("kind = 'ask'").select("chunk", F.col("number").alias("context")).join(states, "context")
    answers = answers.select("chunk", F.col("context").alias("key"), F.col("next").alias("value"), F.lit(None).cast("boolean").alias("first"))
    texts = chunks.where("kind = 'doc'")
    all_rows = (rows(in_arrays(answers), 0, "keys", "sizes", "values").unionByName(rows(counted, 1, "keys", "values"))
                .unionByName(rows(texts, 2, "number", "doc_id", "learned", "data")))
    all_rows = all_rows.repartition("chunk").sortWithinPartitions("chunk", "order", "number")
    ids = docs.select("doc_id").schema["doc_id"]
    id_type = to_arrow_type(ids.dataType)
    schema = StructType([ids, StructField("held_out", BooleanType()), StructField("n_tokens", LongType()), StructField("n_known", LongType()),
                         StructField("train_tokens", LongType()), StructField("base_score", DoubleType()), StructField("score", DoubleType())])

    def scores_of(rows: pa.Table) -> list[pa.RecordBatch]:
        """A chunk's documents, from all rows of the chunk in order."""
        first, second = np.searchsorted(rows.column("order").to_numpy(), (1, 2)).tolist()
        of_states, of_words, texts = rows.slice(0, first), rows.slice(first, second - first), rows.slice(second)
        tree_ = States(root, *(longs(of_states.column(c)) for c in ("keys", "sizes", "values")))
        codes, values = longs(of_words.column("keys")), longs(of_words.column("values"))
        c = np.zeros(int(codes.max(initial=-1)) + 2)  # by number; the last for all words that have none
        c[codes] = values
        log = np.log10((np.append(c, ends) + 0.5) / (n_all + 0.5 * (n_distinct + 1)))
        words = Words()  # numbered as they were
        said: list[tuple[np.ndarray, np.ndarray]] = []
        n_tokens, n_known, base, scores = [], [], [], []
        held: list[tuple[np.ndarray, int]] = []
        part: list[bytes] = []
        waiting = looked_up = 0

        def keyed():
            own = split_words(pa.array(part, pa.binary()).view(pa.string()))
            said.append((np.diff(own.offsets.to_numpy()), words.add(own.values)))
            streams = [stream(x) for x in part]
            keys = gram_keys(streams) << _TEXT_BITS
            keys |= np.repeat(np.arange(len(part)), np.fromiter(map(len, streams), dtype=np.int64, count=len(part)) - 1)
            keys.sort()
            held.append((keys, len(part)))
            part.clear()

        def scored():
            starts = [runs(keys >> _TEXT_BITS) for keys, _ in held]
            grams = [keys[at] >> _TEXT_BITS for (keys, _), at in zip(held, starts)]
            every = distinct(np.concatenate(grams))
            logs = tree_.logs(every)
            for (keys, n), at, own in zip(held, starts, grams):
                each = np.repeat(logs[np.searchsorted(every, own)], np.diff(at, append=len(keys)))
                scores.append(np.bincount(keys & ((1 << _TEXT_BITS) - 1), weights=each, minlength=n))
            held.clear()

        for x in texts.column("data").to_pylist():
            part.append(restored(x))
            waiting += len(part[-1])
            if waiting > _AT_ONCE or len(part) == 1 << _TEXT_BITS:
                looked_up, waiting = looked_up + waiting, 0
                keyed()
                if looked_up > _LOOKED_UP:
                    scored()
                    looked_up = 0
        if part:
            keyed()
        if held:
            scored()
        if not texts.num_rows:
            return []
        for (sizes, places), number in zip(said, words.numbered()[1]):
            of = np.repeat(np.arange(len(sizes)), sizes)
            codes = np.minimum(number, len(c) - 1)[places]
            n_tokens.append(sizes + 1)
            n_known.append(np.bincount(of[c[codes] > 0], minlength=len(sizes)) + (ends > 0))
            base.append(np.bincount(of, weights=log[codes], minlength=len(sizes)) + log[-1])
        out = pa.table({"doc_id": texts.column("doc_id").cast(id_type), "held_out": pc.invert(texts.column("learned")),
                        "n_tokens": pa.array(np.concatenate(n_tokens), pa.int64()), "n_known": pa.array(np.concatenate(n_known), pa.int64()),
                        "train_tokens": pa.array([n_all] * texts.num_rows, pa.int64()), "base_score": pa.array(np.concatenate(base), pa.float64()),
                        "score": pa.array(np.concatenate(scores), pa.float64())})
        return out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk = batch.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for low_, high in zip(cuts, cuts[1:]):
                if held and held[-1].column("chunk")[0].as_py() != chunk[low_]:
                    yield from scores_of(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(low_, high - low_))
        if held:
            yield from scores_of(pa.Table.from_batches(held))

    return all_rows.mapInArrow(run, schema)
