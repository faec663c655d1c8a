"""Byte-level BPE by monoid tree reduction.

A text is halved down to leaves of ``LEAF`` characters.  A leaf is cut into
pattern matches, and each match is encoded.  Two neighbours join by cutting a
window around their boundary anew, which grows until its cuts meet the right
neighbour's own; from there on both scans agree, as the pattern looks neither
behind a match nor more than two characters past its end.  A long match is
encoded the same way one level down: halves join by merging a window of tokens
anew, which grows until each of its ends forms a stable pair with the token
outside.  Tokens whose neighbours are all stable pairs are the whole encoding.
In a run that repeats a short unit (a ruled line, padding) no pair need be
stable, so its window is the whole run from the start; its few distinct pairs
are merged everywhere at once.  Decoding concatenates up the same tree.

The rank file is read on the driver and sent to the tasks (under 1 MB).  What a
task remembers (matches, pairs) is bounded in bytes and dropped at its end;
texts are encoded in slices of at most ``AT_ONCE`` bytes, a longer one alone.

Defined results: null and empty texts have no tokens and decode to no bytes;
repeated rows are encoded alike; other columns stay, but those named like an
output are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import struct
import sys
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thali.llm.common import slices

LEAF = 4096
PIECE_LEAF = 32
IDS_LEAF = 4096
#: Bytes of remembered matches a task holds at most; a longer match is not kept.
KNOWN_BYTES = 48 << 20
KNOWN_CHARS = 64
#: Remembered pairs a task holds at most, of some 150 bytes each.
KNOWN_PAIRS = 150_000
#: Bytes of text encoded at once.
AT_ONCE = 1 << 20
#: Units of repeated runs, in bytes, and distinct pairs that are merged everywhere at once.
PERIOD = 64
FEW_PAIRS = 256
NONE = 1 << 40  # above any rank


def load_ranks(raw: bytes) -> dict[bytes, int]:
    """Rank of each token in a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class _Pairs(dict):
    """Rank of what two tokens (packed in one integer) make, found once."""

    def __init__(self, ranks: dict[bytes, int], tokens: dict[int, bytes]):
        self.ranks, self.tokens = ranks, tokens

    def __missing__(self, pair: int) -> int:
        if len(self) >= KNOWN_PAIRS:
            self.clear()
        rank = self.ranks.get(self.tokens[pair >> 32] + self.tokens[pair & 0xFFFFFFFF], NONE)
        self[pair] = rank
        return rank


def repeats(data: bytes) -> bool:
    """Whether a long run repeats a unit of at most ``PERIOD`` bytes."""
    return len(data) > 8 * PERIOD and any(data[p:3 * p] == data[:2 * p] and data[p:] == data[:-p] for p in range(1, PERIOD + 1))


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """Encoder and decoder for one rank file and splitting pattern."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = load_ranks(raw)
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.byte = [self.ranks[bytes([i])] for i in range(256)]
        self.cut = regex.compile(pattern).findall
        self.pairs = _Pairs(self.ranks, self.tokens)
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        self.settled: dict[int, bool] = {}

    # tokens of one match

    def merged(self, data: bytes) -> list[int]:
        """Tokens of a short run of bytes: the lowest rank merges first, the
        leftmost of equal ones.  A token's id is its rank."""
        if len(data) > 8 * PIECE_LEAF:
            everywhere = self.merged_everywhere(data)
            return self.merged_by_heap(data) if everywhere is None else everywhere
        ids, rank = [self.byte[x] for x in data], self.pairs.__getitem__
        pairs = [rank(a << 32 | b) for a, b in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) < NONE:
            i = pairs.index(best)
            ids[i] = best
            del ids[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(best << 32 | ids[i + 1])
            if i:
                pairs[i - 1] = rank(ids[i - 1] << 32 | best)
        return ids

    def merged_by_heap(self, data: bytes) -> list[int]:
        """The same for a long window that did not settle sooner: pairs wait
        in a heap by rank and place, and a merged place is skipped."""
        ids, rank = [self.byte[x] for x in data], self.pairs.__getitem__
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank(ids[i] << 32 | ids[i + 1]), i, ids[i], ids[i + 1]) for i in range(n - 1)]
        heapq.heapify(heap)
        while heap and heap[0][0] < NONE:
            made, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = made, -1, right[j]
            if right[i] < n:
                left[right[i]] = i
                heapq.heappush(heap, (rank(made << 32 | ids[right[i]]), i, made, ids[right[i]]))
            if left[i] >= 0:
                k = left[i]
                heapq.heappush(heap, (rank(ids[k] << 32 | made), k, ids[k], made))
        return [x for x in ids if x >= 0]

    def merged_everywhere(self, data: bytes) -> list[int] | None:
        """The same for a run of few distinct pairs: the lowest pair merges at
        all its places at once, from the left.  None if the pairs are many, or
        if a merge made a lower pair, which would have gone first."""
        ids = np.array(self.byte, dtype=np.int64)[np.frombuffer(data, dtype=np.uint8)]
        last = -1
        while len(ids) > 1:
            packed_pairs = ids[:-1] << 32 | ids[1:]
            pairs = np.unique(packed_pairs)
            if len(pairs) > FEW_PAIRS:
                return None
            ranks = [self.pairs[p] for p in pairs.tolist()]
            made = min(ranks)
            if made == NONE:
                break
            if made < last or ranks.count(made) > 1:
                return None
            last, pair = made, pairs[ranks.index(made)]
            places = np.flatnonzero(packed_pairs == pair)
            if pair >> 32 == pair & 0xFFFFFFFF:  # of overlapping places, every other one
                firsts = np.flatnonzero(np.diff(places, prepend=-2) != 1)
                of = np.repeat(firsts, np.diff(firsts, append=len(places)))
                places = places[(np.arange(len(places)) - of) % 2 == 0]
            ids[places] = made
            ids = np.delete(ids, places + 1)
        return ids.tolist()

    def run(self, data: bytes) -> list[int]:
        """Tokens of a run of bytes of any length, by halves."""
        if len(data) <= PIECE_LEAF or repeats(data):
            return self.merged(data)
        half = len(data) // 2
        return self.join_runs(self.run(data[:half]), self.run(data[half:]))

    def join_runs(self, left: list[int], right: list[int]) -> list[int]:
        wide = 2
        while True:
            a, b = max(0, len(left) - wide), min(len(right), wide)
            new = self.merged(self.decode(left[a:] + right[:b]))
            if (a == 0 or self.stable(left[a - 1], new[0])) and (b == len(right) or self.stable(new[-1], right[b])):
                return left[:a] + new + right[b:]
            wide *= 2

    def stable(self, a: int, b: int) -> bool:
        pair = a << 32 | b
        known = self.settled.get(pair)
        if known is None:
            if len(self.settled) >= KNOWN_PAIRS:
                self.settled.clear()
            known = self.settled[pair] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def piece(self, data: bytes) -> list[int]:
        """Ids of one match."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.run(data)

    # matches of one text

    def pieces(self, text: str) -> list[str]:
        if len(text) <= LEAF:
            return self.cut(text)
        half = len(text) // 2
        return self.join_pieces(self.pieces(text[:half]), self.pieces(text[half:]))

    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        # what of the left may still change: a match that ends, or starts, too near the boundary
        a, after = len(left), 0
        while a and (after < 2 or after + len(left[a - 1]) < 3):
            a -= 1
            after += len(left[a])
        tail, b = "".join(left[a:]), 4
        while True:
            b = min(b, len(right))
            window, whole = tail + "".join(right[:b]), b == len(right)
            new, end, size = self.cut(window), 0, len(window)
            starts, at = {}, len(tail)
            for i in range(b):
                starts[at] = i
                at += len(right[i])
            for k, piece in enumerate(new):
                if end in starts:  # both scans start a match here
                    return left[:a] + new[:k] + right[starts[end]:]
                start, end = end, end + len(piece)
                if not whole and max(end + 2, start + 3) > size:
                    break
            else:
                return left[:a] + new + right[b:]
            b *= 2

    def encode(self, text: str) -> bytes:
        known, out = self.known, []
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = packed(self.piece(piece.encode()))
                if len(piece) <= KNOWN_CHARS:
                    if self.known_bytes > KNOWN_BYTES:
                        known.clear()
                        self.known_bytes = 0
                    known[piece] = ids
                    self.known_bytes += sys.getsizeof(piece) + sys.getsizeof(ids) + 120  # with its place in the table
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= IDS_LEAF:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def decode_packed(self, ids: bytes | None) -> bytes:
        return self.decode(memoryview(ids).cast("I").tolist()) if ids else b""


def _codec(spark, rank_file: str, pattern: str):
    raw = spark.sparkContext.broadcast(Path(rank_file).read_bytes())
    return lambda: Codec(raw.value, pattern)


# Columns that the operator makes.
_OWN = ("text", "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")


def encode(docs: DataFrame, rank_file: str, pattern: str, and_back: bool = False) -> DataFrame:
    """``docs`` without ``text``, with ``ids``: little-endian unsigned 32-bit
    integers in one binary value; ``and_back`` also decodes those ids to
    ``decoded`` in the same pass."""
    make = _codec(docs.sparkSession, rank_file, pattern)
    rest = [f for f in docs.schema.fields if f.name not in _OWN]
    made = ["ids", "decoded"] if and_back else ["ids"]
    schema = docs.select(*[docs[f.name] for f in rest], *[F.lit(b"").alias(c) for c in made]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for part in slices(batches, size=AT_ONCE):
            ids = [codec.encode(t) if t else b"" for t in part.column(part.num_columns - 1).to_pylist()]
            columns = [*part.columns[:-1], pa.array(ids, pa.binary())]
            if and_back:
                columns.append(pa.array([codec.decode_packed(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], *made])

    return docs.select(*[docs[f.name] for f in rest], docs["text"]).mapInArrow(run, schema)


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of the ids."""
    make = _codec(encoded.sparkSession, rank_file, pattern)
    schema = encoded.withColumn("decoded", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for part in slices(batches, size=AT_ONCE):
            back = [codec.decode_packed(x) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(back, pa.binary())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``docs`` without ``text``, with n_tokens, ids and the digests of the
    ids and of what they decode to."""
    out = encode(docs, rank_file, pattern, and_back=True)
    return out.select(*[c for c in out.columns if c not in ("ids", "decoded")],
                      (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")
