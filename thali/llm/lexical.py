"""Ranked lexical search by Block-Max MaxScore over an inverted index in shards.

Index: a shard is a run of at most ``SHARD_TERMS`` term occurrences of
documents that one task read.  Each term of a shard has one row: its postings in
blocks of ``BLOCK`` documents, each block packed by itself, and for each
block the last document and the impacts (most occurrences by least length: the
pairs that no other pair of the block beats).  The whole corpus is indexed; N, L
and df are sums over the index.

Search: a query's terms are looked up in every shard.  Bounds of each list are
its best impact under the corpus-wide weights, those of a block likewise.
Terms are ordered by bound; with the twentieth best score so far as threshold,
the longest prefix of the order whose bounds together stay below it is
non-essential: a document with such terms alone cannot enter.  Candidates come
from the essential lists, a range of documents at a time, and are completed list
by list from the strongest non-essential one down.  Before a list is read, a
candidate whose score, with the block maximum of its block there and the bounds
of the weaker lists, does not reach the threshold is rejected, and only blocks
that hold a candidate left are unpacked.  The shards' best ``top`` of each
query are merged by rank.

Scores are 64-bit integers and the bounds are exact, so the result is that of
scoring every document.  Ties with the last are kept until they are ordered by
id, so they are cut off as a full sort would.

Defined results: null and empty texts have no terms and are never found, nor
are they counted in N; an item without terms, or whose terms no document holds,
has no row; a null ``doc_id`` comes after all others among equal scores;
rows of one ``item_id``, null included, are one query; repeated rows are documents of their own; extra columns are ignored; an empty
table on either side gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from thali.llm.common import slices, stored

TOP = 20
BLOCK = 128
#: Term occurrences of a shard, and documents; a longer text is a shard alone.
SHARD_TERMS = 5_000_000
SHARD_DOCS = 50_000  # below 65,536, so a gap fits two bytes
#: Documents of a shard that are scored before the threshold is looked at anew.
RANGE = 1024
#: Queries that a task holds at once.
QUERIES_AT_ONCE = 512
# A term is a run of these, A-Z lowered.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    """Letters of other scripts are bytes above 0x7F in UTF-8, so a run of
    such bytes is a run of such characters."""
    return _TERM.findall((text or "").encode().lower())


def block_impacts(block: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of the postings that are their block's impacts: the (occurrences,
    length) pairs that none with as many occurrences and no more length beats.
    ``block`` is sorted."""
    wide = int(length.max()) + 1
    order = np.lexsort(((int(tf.max()) - tf) * wide + length, block))
    # running least length within a block: earlier blocks lie above later ones
    above = length[order] + (block[-1] - block[order]) * wide
    least = np.minimum.accumulate(above)
    keep = np.ones(len(order), dtype=bool)
    keep[1:] = above[1:] < least[:-1]
    return order[keep]


def _binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary values that lie one after another in ``data``, by their ends in
    bytes."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def posting_lists(terms: list[bytes], codes: np.ndarray, lengths: np.ndarray) -> list[pa.Array]:
    """Columns (term, df, heads, impacts, postings) of a shard's lists, by term.
    ``codes``: the terms of all documents, one after another, as places in
    ``terms``; ``lengths``: how many each document has.  ``heads``: for each block
    first and last document, where its postings and its impacts end.  A posting
    is the gap to the one before in its block and the occurrences."""
    rank = np.empty(len(terms), dtype=np.int64)
    by_term = sorted(range(len(terms)), key=terms.__getitem__)
    rank[by_term] = np.arange(len(terms))
    n_docs = len(lengths)
    doc = np.repeat(np.arange(n_docs), lengths)
    both, tf = np.unique(rank[codes] * n_docs + doc, return_counts=True)
    term, doc = both // n_docs, both % n_docs
    df = np.bincount(term, minlength=len(terms))
    ends = np.cumsum(df)
    place = np.arange(len(doc)) - np.repeat(ends - df, df)
    new = place % BLOCK == 0
    block = np.cumsum(new) - 1
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(doc)) - 1
    gap = np.diff(doc, prepend=0)
    gap[firsts] = 0
    count = "<u2" if tf.max() < 1 << 16 else "<u4"
    postings = np.empty(len(doc), dtype=[("gap", "<u2"), ("tf", count)])
    postings["gap"], postings["tf"] = gap, tf
    best = block_impacts(block, tf, lengths[doc])
    pairs = np.stack([tf[best], lengths[doc][best]], axis=1).astype("<u4")
    # per term: blocks, and what of its list and impacts the blocks end at
    n_blocks = -(-df // BLOCK)
    block_ends = np.cumsum(n_blocks)
    best_ends = np.cumsum(np.bincount(block[best], minlength=len(firsts)))
    of_term = np.repeat(np.arange(len(df)), n_blocks)
    before = np.concatenate(([0], best_ends))[block_ends - n_blocks]
    heads = np.stack([doc[firsts], doc[lasts], place[lasts] + 1, best_ends - before[of_term]], axis=1).astype("<u4")
    return [pa.array([terms[i] for i in by_term], pa.binary()), pa.array(df.astype(np.int64)), _binary(block_ends * 16, heads),
            _binary(best_ends[block_ends - 1] * 8, pairs), _binary(ends * postings.itemsize, postings)]


def build_index(docs: DataFrame) -> DataFrame:
    """Rows of the index: (shard, term, df, heads, impacts, postings), and one
    row a shard with a null term, where df is its documents with a term, heads
    their lengths and ``ids`` their ids."""
    ids = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    schema = f"shard string, term binary, df long, heads binary, impacts binary, postings binary, ids array<{ids}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, number = TaskContext.get(), 0
        id_type = None
        columns = ["shard", "term", "df", "heads", "impacts", "postings", "ids"]

        def shard():
            name = f"{context.partitionId()}-{context.taskAttemptId()}-{number}"
            length = np.array(lengths, dtype=np.int64)
            whole = posting_lists(list(code), np.concatenate(codes), length)
            for at in range(0, len(whole[0]), 1 << 15):
                part = [c.slice(at, 1 << 15) for c in whole]
                many = len(part[0])
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name), many), *part, pa.nulls(many, pa.list_(id_type))], columns)
            held = pa.concat_arrays(names)
            none = pa.nulls(1, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), none, pa.array([len(length)], pa.int64()), pa.array([length.astype("<u4").tobytes()], pa.binary()), none, none,
                 pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)], columns)

        code, codes, names, lengths, seen = defaultdict(itertools.count().__next__), [], [], [], 0
        for part in slices(batches):
            id_type = part.column(0).type
            with_terms = []
            for i, text in enumerate(part.column(1).to_pylist()):
                found = terms_of(text)
                if found:
                    codes.append(np.fromiter(map(code.__getitem__, found), dtype=np.int32, count=len(found)))  # a new term takes the next number
                    lengths.append(len(found))
                    with_terms.append(i)
                    seen += len(found)
            if with_terms:
                names.append(part.column(0).take(pa.array(with_terms)))
            if seen >= SHARD_TERMS or len(lengths) >= SHARD_DOCS:
                yield from shard()
                code, codes, names, lengths, seen = defaultdict(itertools.count().__next__), [], [], [], 0
                number += 1
        if lengths:
            yield from shard()

    return stored(docs.select("doc_id", "text").mapInArrow(run, schema), "index", "zstd")


class Postings:
    """A term's list in one shard."""

    def __init__(self, df: int, heads: bytes, best: bytes, postings: bytes, mean: tuple[int, int]):
        self.mean = mean
        self.first, self.last, self.ends, many = np.frombuffer(heads, dtype="<u4").astype(np.int64).reshape(-1, 4).T
        self.postings = np.frombuffer(postings, dtype=[("gap", "<u2"), ("tf", f"<u{len(postings) // df - 2}")])
        tf, length = np.frombuffer(best, dtype="<u4").astype(np.int64).reshape(-1, 2).T
        self.most = np.maximum.reduceat(part_score(tf, length, mean), np.concatenate(([0], many[:-1])))
        self.bound = int(self.most.max())
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and occurrences of a block, unpacked when first needed."""
        if i not in self.read:
            packed = self.postings[self.ends[i - 1] if i else 0:self.ends[i]]
            self.read[i] = self.first[i] + np.cumsum(packed["gap"].astype(np.int64)), packed["tf"].astype(np.int64)
        return self.read[i]

    def within(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Postings of documents from ``low`` to below ``high``."""
        a, b = np.searchsorted(self.last, low), np.searchsorted(self.first, high)
        parts = [self.block(i) for i in range(a, b)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, tf = (np.concatenate(x) for x in zip(*parts))
        i, j = np.searchsorted(docs, (low, high))
        return docs[i:j], tf[i:j]

    def maxima(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document the block that would hold it (-1: none) and the
        most it could score there; no block is read."""
        at = np.searchsorted(self.last, docs)
        there = at < len(self.last)
        there[there] = self.first[at[there]] <= docs[there]
        return np.where(there, at, -1), np.where(there, self.most[np.where(there, at, 0)], 0)

    def occurrences(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Occurrences in the documents, which lie in the given blocks."""
        out = np.zeros(len(docs), dtype=np.int64)
        for i in np.unique(blocks[blocks >= 0]).tolist():
            of = np.flatnonzero(blocks == i)
            own, tf = self.block(i)
            at = np.minimum(np.searchsorted(own, docs[of]), len(own) - 1)
            out[of] = np.where(own[at] == docs[of], tf[at], 0)
        return out


def part_score(tf: np.ndarray, length: np.ndarray, mean: tuple[int, int]) -> np.ndarray:
    """What an occurrence count is worth in a document, before the weight."""
    n, total = mean
    m = 75 + (25 * length * n) // total
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def best_of_shard(lists: list[tuple[Postings, int]], length: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the shard's ``top`` and of ties with the last of
    them.  ``lists``: each term's postings and weight."""
    lists = sorted(lists, key=lambda x: x[0].bound * x[1])
    upto = np.cumsum([p.bound * w for p, w in lists])  # of the weakest lists together
    docs_kept, scores_kept, threshold = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for low in range(0, len(length), RANGE):
        high = min(low + RANGE, len(length))
        # lists whose bounds together stay below the threshold are not essential
        essential = int(np.searchsorted(upto, threshold))
        if essential == len(lists):
            break
        score = np.zeros(high - low, dtype=np.int64)
        for p, w in lists[essential:]:
            docs, tf = p.within(low, high)
            if len(docs):
                score[docs - low] += w * part_score(tf, length[docs], p.mean)
        docs = np.flatnonzero(score) + low
        score = score[docs - low]
        for i in range(essential - 1, -1, -1):
            p, w = lists[i]
            blocks, most = p.maxima(docs)
            left = score + w * most + (int(upto[i - 1]) if i else 0) >= threshold
            docs, score, blocks = docs[left], score[left], blocks[left]
            if not len(docs):
                break
            score = score + w * part_score(p.occurrences(docs, blocks), length[docs], p.mean)
        left = (score >= threshold) & (score > 0)
        docs_kept, scores_kept = np.concatenate((docs_kept, docs[left])), np.concatenate((scores_kept, score[left]))
        if len(scores_kept) >= top:
            threshold = int(np.partition(scores_kept, len(scores_kept) - top)[len(scores_kept) - top])
            left = scores_kept >= threshold
            docs_kept, scores_kept = docs_kept[left], scores_kept[left]
    return docs_kept, scores_kept


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times)."""
    ids = items.select("item_id").schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            at, terms, times = [], [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                for term, n in Counter(terms_of(text)).items():
                    at.append(i)
                    terms.append(term)
                    times.append(n)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.binary()), pa.array(times, pa.int64())],
                                             ["item_id", "term", "times"])

    return items.select("item_id", "text").mapInArrow(run, f"item_id {ids}, term binary, times long")


def search_index(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item."""
    item, doc = items.schema["item_id"].dataType, index.schema["ids"].dataType.elementType
    mean = n_docs, _ = corpus_totals(index)
    asked = stored(query_terms(items), "query_terms")
    # of the index, the lists that any query needs
    lists = stored(index.where("term is not null").drop("ids").join(asked.select("term").distinct(), "term"), "sought", "zstd")
    df = lists.groupBy("term").agg(F.sum("df").alias("df"))
    weights = df.select("term", F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"))
    # queries in blocks of about QUERIES_AT_ONCE; a list goes once to each block that needs it, with the items that do
    blocks = max(1, -(-items.count() // QUERIES_AT_ONCE))
    queries = (asked.join(weights, "term").where("w > 0")
               .groupBy(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block"), "term")
               .agg(F.collect_list("item_id").alias("items"), F.collect_list(F.col("w") * F.col("times")).alias("weights")))
    lists = lists.join(queries, "term").select("shard", "block", "term", "df", "heads", "impacts", "postings", "items", "weights")
    about = index.where("term is null").select("shard", F.col("heads").alias("lengths"), "ids")
    about = about.join(lists.select("shard", "block").distinct(), "shard").select(
        F.col("shard").alias("of_shard"), F.col("block").alias("of_block"), "lengths", "ids")

    def run(lists: pa.Table, about: pa.Table) -> pa.Table:
        out_items, out_docs, out_scores = [], [], []
        if about.num_rows and lists.num_rows:
            length = np.frombuffer(about.column("lengths")[0].as_py(), dtype="<u4").astype(np.int64)
            ids = about.column("ids")[0].values
            of: dict = {}
            for row in lists.select(["df", "heads", "impacts", "postings", "items", "weights"]).to_batches():
                for df, heads, best, postings, own, weights in zip(*(c.to_pylist() for c in row.columns)):
                    p = Postings(df, heads, best, postings, mean)
                    for i, w in zip(own, weights):
                        of.setdefault(i, []).append((p, w))
            for i, own in of.items():
                docs, scores = best_of_shard(own, length, top)
                named = list(zip((-scores).tolist(), ids.take(pa.array(docs)).to_pylist()))
                named.sort(key=lambda x: (x[0], x[1] is None, x[1]))
                for score, name in named[:top]:
                    out_items.append(i)
                    out_docs.append(name)
                    out_scores.append(-score)
        return pa.table({"item_id": pa.array(out_items, item_type), "doc_id": pa.array(out_docs, doc_type), "score": pa.array(out_scores, pa.int64())})

    item_type, doc_type = to_arrow_type(item), to_arrow_type(doc)
    schema = StructType([StructField("item_id", item), StructField("doc_id", doc), StructField("score", LongType())])
    found = lists.groupBy("shard", "block").cogroup(about.groupBy("of_shard", "of_block")).applyInArrow(run, schema)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The best ``top`` of all ``docs`` for each of ``items`` (item_id, text)."""
    return search_index(build_index(docs), items, top)


def corpus_totals(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and their terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(np.frombuffer(x, dtype="<u4").sum(dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64())], ["n", "l"])

    row = index.where("term is null").select("df", "heads").mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return row[0] or 0, row[1] or 0
