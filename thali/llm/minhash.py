"""MinHash near-dedup: universal hash minima, banding, signatures verified,
links confirmed on full sets, components by alternating stars.

A document's set is its distinct ``shingle``-word shingles (words of A-Z
lowered), as XXH64 hashes; fewer words make one shingle, no word an empty set.
Documents of one set are one class.  Each class has ``HASHES`` minima of
universal hashes a*x+b mod 2^32: the first ``BANDS`` x ``ROWS`` are cut in bands,
and two bits of each make the signature.  Two sets of Jaccard similarity 0.8
share a band but for a chance of 5e-8.

A bucket (classes that share a band) is not paired out.  Its hubs are the
members whose buckets are the most crowded, which in a group of copies with
edits are the ones nearest to all.  Members are verified against the first hub
and linked, then, where they are not with them yet, against the others.
Then only members of one bucket whose components still differ are compared:
in the join itself, by their signatures, once a pair (in the first band that
they share).  Who passes is confirmed on the full sets, so no link between
different texts is lost and few pairs leave a join.

Defined results: null, empty and wordless texts have no shingles, their own id
as component and stay; equal and repeated rows are one class; a null ``doc_id``
is grouped, and names a component only where no member has an id (the component
is null then); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from thali.llm.common import lookup, slices, stored
from thali.llm.components import smallest_reachable

SHINGLE = 5
PERCENT = 80
SEED = 42
HASHES = 1024
BANDS, ROWS = 32, 4
#: Hubs of a bucket.
HUBS = 4
#: Two bits a hash, 32 hashes a long.
LANES = HASHES // 32
#: Standard deviations that a linked pair's signature may lie below its mean.
SLACK = 4.5
_AT_ONCE = 256
_EVEN = 0x5555555555555555


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The set of a text: distinct hashes in order."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    n = len(words) - shingle + 1
    if n < 1:
        n, shingle = min(1, len(words)), max(1, len(words))
    if not n:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = memoryview(b" ".join(words)), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:n - 1])).tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), dtype=np.uint64, count=n))


class Hashes:
    """The family of hash functions, and what they make of a set."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.a = rng.integers(0, 1 << 31, HASHES, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
        self.room = np.empty((HASHES, _AT_ONCE), dtype=np.uint32)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
        x = hashes.astype(np.uint32)
        for at in range(0, len(x), _AT_ONCE):
            part = x[at:at + _AT_ONCE]
            room = self.room[:, :len(part)]
            np.multiply(self.a, part, out=room)
            np.add(room, self.b, out=room)
            np.minimum(least, room.min(axis=1), out=least)
        return least

    @staticmethod
    def bands(least: np.ndarray) -> np.ndarray:
        """A 64-bit key of each band."""
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for row in least[:BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS).T:
            key = (key ^ row) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        return key.view(np.int64)

    @staticmethod
    def bits(least: np.ndarray) -> np.ndarray:
        """Two bits of each minimum, packed."""
        two = (least.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(62)
        return np.bitwise_or.reduce(two.reshape(LANES, 32) << np.arange(0, 64, 2, dtype=np.uint64), axis=1).view(np.int64)


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """One row a document: rid, doc_id, text_key, n_shingles, digest of the set
    (null if empty), bands, bits."""
    rows = docs.select("doc_id", "text", F.md5("text").alias("text_key"))
    id_field = rows.schema["doc_id"]
    longs = ArrayType(LongType(), False)
    schema = StructType([StructField("rid", LongType()), id_field, StructField("text_key", rows.schema["text_key"].dataType),
                         StructField("n_shingles", LongType()), StructField("digest", BinaryType()), StructField("bands", longs), StructField("bits", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Hashes()
        for part in slices(batches):
            n, digests, bands, bits = [], [], [], []
            for text in part.column(2).to_pylist():
                own = shingle_hashes(text, shingle)
                n.append(len(own))
                digests.append(xxhash.xxh128_digest(own.tobytes(), SEED) if len(own) else None)
                least = family.minima(own) if len(own) else None
                bands.append(None if least is None else family.bands(least))
                bits.append(None if least is None else family.bits(least))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(3), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(bands, pa.list_(pa.field("element", pa.int64(), False))), pa.array(bits, pa.list_(pa.field("element", pa.int64(), False)))],
                schema=arrow)

    arrow = pa.schema([("rid", pa.int64()), ("doc_id", _arrow_type(id_field)), ("text_key", pa.string()), ("n_shingles", pa.int64()),
                       ("digest", pa.binary()), ("bands", pa.list_(pa.field("element", pa.int64(), False))),
                       ("bits", pa.list_(pa.field("element", pa.int64(), False)))])
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", "text_key")
    return stored(rows.mapInArrow(run, schema), "signatures")


def _arrow_type(field: StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def most_differing(percent: int) -> int:
    """Two-bit lanes in which the signatures of a linked pair may differ."""
    p = 0.75 * (1 - percent / 100)
    return math.floor(HASHES * p + SLACK * math.sqrt(HASHES * p * (1 - p)))


def _differing(a: str, b: str) -> Column:
    """Lanes in which two signatures differ."""
    def lanes(x: Column, y: Column) -> Column:
        bits = x.bitwiseXOR(y)
        return F.bit_count(bits.bitwiseOR(F.shiftrightunsigned(bits, 1)).bitwiseAND(F.lit(_EVEN)))

    # as a loop: written out, the condition is too long a method for the JIT compiler
    return F.aggregate(F.zip_with(a, b, lanes), F.lit(0), lambda s, n: s + n)


def _first_shared(a: str, b: str) -> Column:
    """The first band in which two classes agree."""
    return F.array_position(F.zip_with(a, b, lambda x, y: x == y), True) - 1


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are similar enough."""
    both = (pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(cls: int, text: str) -> np.ndarray:
            found = held.pop(cls, None)
            held[cls] = found = shingle_hashes(text, shingle) if found is None else found
            if len(held) > 64:
                held.popitem(last=False)
            return found

        for part in slices(batches):
            a, b, text_a, text_b = (c.to_pylist() for c in part.columns)
            keep = []
            for i, (x, y) in enumerate(zip(a, b)):
                s, t = of(x, text_a[i]), of(y, text_b[i])
                common = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * common >= percent * (len(s) + len(t) - common):
                    keep.append(i)
            yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def class_links(classes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, component) of the linked classes.  ``classes``: cls, text_key,
    bands, bits; ``texts``: text_key, text."""
    index = classes.select("cls", F.posexplode("bands").alias("band", "key"))
    shared = index.groupBy("key").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    crowded = stored(index.join(shared, "key"), "buckets")
    # texts of classes that share a bucket with any other, one a class
    involved = crowded.select("cls").distinct().join(classes.select("cls", "text_key"), "cls")
    own_text = stored(involved.join(texts, "text_key").select("cls", "text"), "texts")
    # each bucket's hubs, and the members' links to them
    score = crowded.groupBy("cls").agg(F.sum("crowd").alias("score"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "cls"))
    hubs = crowded.select("key", "cls").join(score, "cls").withColumn("place", place).where(F.col("place") <= HUBS)
    hubs = stored(hubs.select("key", F.col("cls").alias("hub"), "place"), "hubs")
    own, most = classes.select("cls", "bits"), most_differing(percent)

    def near(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose signatures pass."""
        return (pairs.distinct().join(own.select(F.col("cls").alias("a"), F.col("bits").alias("bits_a")), "a")
                .join(own.select(F.col("cls").alias("b"), F.col("bits").alias("bits_b")), "b")
                .where(_differing("bits_a", "bits_b") <= most).select("a", "b"))

    def star(rows: DataFrame, which: Column) -> DataFrame:
        return rows.join(hubs.where(which), "key").where("cls <> hub")

    def tree(placed: DataFrame) -> DataFrame:
        return placed.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))

    def with_component(placed: DataFrame) -> DataFrame:
        return (crowded.select("key", "band", "cls").join(placed.withColumnRenamed("node", "cls"), "cls", "left")
                .withColumn("component", F.coalesce("component", "cls")))

    first = stored(near(star(crowded.select("key", "cls"), F.col("place") == 1).select(F.col("cls").alias("a"), F.col("hub").alias("b"))), "near_hub")
    placed = smallest_reachable(stored(confirmed(first, own_text, shingle, percent), "hub_links"))
    # members that are not with their bucket's other hubs yet
    of_hub = placed.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    others = star(with_component(placed), F.col("place") > 1).join(of_hub, "hub", "left").where(F.col("component") != F.coalesce("hub_component", "hub"))
    second = stored(near(others.select(F.col("cls").alias("a"), F.col("hub").alias("b"))), "near_hubs")
    placed = smallest_reachable(stored(tree(placed).union(confirmed(second, own_text, shingle, percent)), "hub_links"))
    # members of one bucket in different components
    member = with_component(placed)
    split = member.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    rest = member.join(split, "key", "left_semi").join(classes.select("cls", "bits", F.transform("bands", lambda x: F.shiftright(x, 32).cast("int")).alias("tags")), "cls")
    a = rest.select("key", "band", *[F.col(c).alias(f"{c}_a") for c in ("cls", "component", "bits", "tags")])
    b = rest.select("key", *[F.col(c).alias(f"{c}_b") for c in ("cls", "component", "bits", "tags")])
    met = a.join(b, (a["key"] == b["key"]) & (F.col("component_a") < F.col("component_b"))
                 & (_differing("bits_a", "bits_b") <= most) & (_first_shared("tags_a", "tags_b") == F.col("band")))
    more = confirmed(met.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")), own_text, shingle, percent)
    return smallest_reachable(stored(tree(placed).union(more), "links"))


def groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, component_size
    (documents), kept."""
    if percent < 80:
        raise ValueError("the bands find similarities of 80 percent or more")
    rows = signed(docs, shingle)
    classes = (rows.where("n_shingles > 0").groupBy("digest")
               .agg(F.min("rid").alias("cls"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_rows")))
    classes = stored(classes, "classes")
    heads = stored(rows.select(F.col("rid").alias("cls"), "text_key", "bands", "bits").join(classes.select("cls"), "cls", "left_semi"), "heads")
    # equal texts meet within a task before the shuffle
    texts = docs.where("text is not null").select(F.md5("text").alias("text_key"), "text").groupBy("text_key").agg(F.first("text").alias("text"))
    linked = class_links(heads, texts, shingle, percent)
    members = classes.join(linked.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    ids = members.groupBy("component").agg(F.min("rep").alias("component_id"), F.sum("n_rows").alias("component_size"))
    placed = members.select("digest", "n_rows", "component").join(ids, "component").select("digest", "n_rows", "component_id", "component_size")
    out = lookup(rows.select("rid", "doc_id", "n_shingles", "digest"), placed, "digest", "n_rows", rows.count())
    alone = F.col("n_shingles") == 0
    out = out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                     F.when(alone, 1).otherwise(F.col("component_size")).cast("long").alias("component_size"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
