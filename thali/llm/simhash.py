"""SimHash near-dedup by multi-index hashing.

Fingerprint: a text's words (A-Z lowered) give ``SHINGLE``-word shingles,
repeats included; a bit is 1 where more than half of the shingles' XXH64
hashes have it.

Search: the 64 bits are cut in three segments.  Two fingerprints within 2 bits
agree in two segments, or agree in one and differ by one bit in each of the
others.  So the index has a table for each pair of segments, and a fingerprint
asks each table for its own key and for the keys of the ball of radius 1 around
one segment; of two keys that differ in a bit, the one with 0 asks.  Keys fix
42 or 43 bits.  Matches are verified on all 64 bits.  Only distinct
fingerprints are searched, so copies make no pairs.

Defined results: null and wordless texts have fingerprint 0, linked like any
other; a text of fewer words is one shingle; repeated rows share a fingerprint;
extra columns are ignored by ``groups`` and kept by ``drop_near_copies``; a
null ``doc_id`` is grouped but cannot name a component while its fingerprint
has another id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thali.llm.common import lookup, nested, slices, stored
from thali.llm.components import smallest_reachable

SHINGLE = 3
MOST_BITS = 2
SEED = 42
#: (shift, bits) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A table's segments: the ball is around the first, the second is exact.
TABLES = ((0, 2), (1, 0), (2, 1))
_CHUNK = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text as an unsigned integer."""
    words = text.encode().lower().split()  # bytes: A-Z only, ASCII white space only
    n = len(words) - shingle + 1
    if n < 1:
        n, shingle = min(1, len(words)), max(1, len(words))
    if not n:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:n - 1])).tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    counts, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + _CHUNK], stops[at:at + _CHUNK])], dtype="<u8")
        lanes = h.view(np.uint8).reshape(-1, 8)
        for lane in range(8):
            counts[8 * lane:8 * lane + 8] += np.bincount(lanes[:, lane], minlength=256) @ _BITS
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp): an MD5 of the text, and the fingerprint as a signed
    64-bit integer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fp = np.array([fingerprint(t, shingle) if t else 0 for t in part.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(fp.view(np.int64))], ["doc_id", "text_key", "fp"])

    rows = docs.select("doc_id", "text", _text_key(F.col("text")).alias("text_key"))
    return rows.mapInArrow(run, rows.select("doc_id", "text_key", F.lit(0).cast("long").alias("fp")).schema)


def _text_key(text: Column) -> Column:
    """Rows of one id and one key have one fingerprint."""
    return F.md5(F.coalesce(text, F.lit("")))


def _segment(c: Column, s: int) -> Column:
    shift, bits = SEGMENTS[s]
    return F.shiftrightunsigned(c, shift).bitwiseAND(F.lit((1 << bits) - 1))


def _key(table: int, ball: Column, exact: Column) -> Column:
    return F.shiftleft(F.shiftleft(F.lit(table).cast("long"), 22).bitwiseOR(ball), 22).bitwiseOR(exact)


def _asked(fp: Column, table: int) -> Column:
    """What a fingerprint asks a table for: its own key, then the ball's."""
    ball, exact = TABLES[table]
    own, other = _segment(fp, ball), _segment(fp, exact)
    bits = F.array(*[F.lit(1 << i).cast("long") for i in range(SEGMENTS[ball][1])])
    flips = F.filter(bits, lambda bit: own.bitwiseAND(bit) == 0)
    near = F.transform(flips, lambda bit: F.struct(_key(table, own.bitwiseOR(bit), other).alias("key"), F.lit(False).alias("own")))
    return F.concat(F.array(F.struct(_key(table, own, other).alias("key"), F.lit(True).alias("own"))), near)


def near_pairs(fps: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b): the pairs of the distinct ``fps.fp`` at most ``most_bits`` apart."""
    if most_bits > 2:
        raise ValueError("three segments find at most 2 differing bits")
    fp = F.col("fp")
    index = fps.select(fp.alias("held"), F.explode(F.array(*[
        _key(t, _segment(fp, ball), _segment(fp, exact)) for t, (ball, exact) in enumerate(TABLES)])).alias("key"))
    asks = fps.select(fp.alias("asking"), F.inline(F.concat(*[_asked(fp, t) for t in range(len(TABLES))])))
    met = asks.join(index, "key").where(~F.col("own") | (F.col("asking") < F.col("held")))
    close = met.where(F.bit_count(F.col("asking").bitwiseXOR(F.col("held"))) <= most_bits)
    return close.select(F.least("asking", "held").alias("a"), F.greatest("asking", "held").alias("b")).distinct()


def groups(docs: DataFrame, shingle: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """One row a document: doc_id, text_key, fp, component (a fingerprint of it),
    component_id, component_size (documents)."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_rows")), "classes")
    linked = smallest_reachable(near_pairs(classes.select("fp"), most_bits))
    # a component's id: the smallest doc_id of its fingerprints
    members = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = members.groupBy("component").agg(F.min("rep").alias("component_id"), F.sum("n_rows").alias("component_size"))
    placed = members.select("fp", "n_rows", "component").join(ids, "component").select("fp", "n_rows", "component", "component_id", "component_size")
    return lookup(rows, placed, "fp", "n_rows", rows.count())


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """One row of ``docs`` of each component, with all its columns: that of the
    smallest ``doc_id`` (a null one last), of several texts under that id the one
    whose key comes first, of equal rows any."""
    found = groups(docs, shingle, most_bits)
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_key")).alias("k")
    keep = found.groupBy("component").agg(first).select(F.col("k.doc_id").alias("_keep"), F.col("k.text_key").alias("_of"))
    rows = nested(docs, "doc_id", "text").withColumn("_key", _text_key(F.col("text")))
    rows = rows.join(keep, F.col("doc_id").eqNullSafe(F.col("_keep")) & (F.col("_key") == F.col("_of")), "left_semi")
    same = Window.partitionBy(F.coalesce("doc_id", F.lit(0)), F.isnull("doc_id"), "_key").orderBy(F.xxhash64("_row"))
    return rows.withColumn("_n", F.row_number().over(same)).where("_n = 1").select("_row.*")
