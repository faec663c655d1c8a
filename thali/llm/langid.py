"""Language ID by a byte convolutional network.

UTF-8 bytes are embedded; filters of several widths run over fixed-length
windows, each filter keeps its largest response in the window, and a softmax
layer names the language.  The network is trained in numpy on the driver on at
most ``SAMPLE_ROWS`` labelled texts a language, one passage of
``SAMPLE_CHARS`` characters from a pseudorandom place of each.  Prediction
cuts every whole text into windows, runs them in batches, and averages the
windows' probabilities by their bytes.

Defined results: a text that is null or has no letter is ``und`` with score 0;
with no labelled text to learn from every text is ``und``; a null ``doc_id``
counts as held out; repeated rows get equal predictions; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thali.llm.common import slices

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 4
PAD = 256
SAMPLE_ROWS = 500
SAMPLE_CHARS = 512
SPARE = 4
STEPS, BATCH, RATE = 500, 96, 0.02
#: Windows that go through the filters at once.
AT_ONCE = 1024
TEXTS_AT_ONCE = 256
SEED = 7


def held_out() -> Column:
    """Whether a document is never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def has_letter() -> Column:
    return F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(lang, passage): at most ``rows`` a language, those of least hash.

    Counts by language (one row each) give the share of hashes that holds
    about ``SPARE * rows`` documents of a language, so few more than the sample
    meet in a task however large the language is.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return []
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, SPARE * rows / n))]), F.col("lang"))
    mark = F.xxhash64("doc_id", "text")
    known = known.where((F.pmod(mark, F.lit(1 << 30)) < share * (1 << 30)) & has_letter())
    room = F.greatest(F.char_length("text") - chars, F.lit(0)) + 1
    known = known.select("lang", mark.alias("mark"), F.substr(F.col("text"), (F.pmod(mark, room) + 1).cast("int"), F.lit(chars)).alias("passage"))
    first = known.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("mark", "passage"))).where(F.col("n") <= rows)
    return sorted((r["lang"], r["passage"]) for r in first.select("lang", "passage").collect())


def windows(data: bytes) -> np.ndarray:
    """The bytes as rows of ``WINDOW``, the last one filled with ``PAD``."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.full(n * WINDOW, PAD, dtype=np.int16)
    out[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, WINDOW)


class Network:
    """Embedding, filters by width, and a softmax layer."""

    def __init__(self, labels: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.labels = labels
        self.p = {"embed": draw(PAD + 1, EMBED), "out": draw(len(WIDTHS) * FILTERS, len(labels)), "out_b": np.zeros(len(labels), np.float32)}
        for k in WIDTHS:
            self.p[f"w{k}"], self.p[f"b{k}"] = draw(k * EMBED, FILTERS), np.zeros(FILTERS, np.float32)

    def features(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Pooled responses of each row of ``x``; ``keep`` gets what the
        backward pass needs."""
        e = self.p["embed"][x]
        found = []
        for k in WIDTHS:
            n = WINDOW - k + 1
            patches = np.concatenate([e[:, j:j + n] for j in range(k)], axis=2)
            r = (patches.reshape(-1, k * EMBED) @ self.p[f"w{k}"]).reshape(len(x), n, FILTERS)
            top = r.max(axis=1) + self.p[f"b{k}"]
            if keep is not None:
                keep.append((patches, r.argmax(axis=1), top))
            found.append(np.maximum(top, 0))
        return np.concatenate(found, axis=1)

    def softmax(self, f: np.ndarray) -> np.ndarray:
        z = f @ self.p["out"] + self.p["out_b"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        keep: list = []
        f = self.features(x, keep)
        d = self.softmax(f)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"out": f.T @ d, "out_b": d.sum(axis=0), "embed": np.zeros_like(self.p["embed"])}
        back = d @ self.p["out"].T
        rows = np.arange(len(x))[:, None]
        for i, (k, (patches, at, top)) in enumerate(zip(WIDTHS, keep)):
            db = back[:, i * FILTERS:(i + 1) * FILTERS] * (top > 0)
            chosen = patches[rows, at]  # (batch, filter, k * EMBED)
            g[f"w{k}"], g[f"b{k}"] = np.einsum("bfe,bf->ef", chosen, db), db.sum(axis=0)
            spread = np.einsum("bf,ef->bfe", db, self.p[f"w{k}"]).reshape(len(x), FILTERS, k, EMBED)
            for j in range(k):
                np.add.at(g["embed"], x[rows, at + j], spread[:, :, j])
        return g

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(label number, probability) of each text."""
        parts = [windows(t) for t in texts]
        owner = np.repeat(np.arange(len(parts)), [len(w) for w in parts])
        x = np.concatenate(parts) if parts else np.zeros((0, WINDOW), np.int16)
        total = np.zeros((len(parts), len(self.labels)))
        for at in range(0, len(x), AT_ONCE):
            part = x[at:at + AT_ONCE]
            weight = (part != PAD).sum(axis=1)[:, None] + 1e-9
            np.add.at(total, owner[at:at + AT_ONCE], self.softmax(self.features(part)) * weight)
        total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
        return total.argmax(axis=1), total.max(axis=1) if len(total) else np.zeros(0)


def train(rows: list[tuple[str, str]], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Network | None:
    """The network after ``steps`` of Adam on batches with each language as
    often as any other."""
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    net, rng = Network(labels, seed), np.random.default_rng(seed)
    by = [np.concatenate([windows(t.encode()) for lang, t in rows if lang == name]) for name in labels]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for step in range(1, steps + 1):
        y = rng.integers(len(labels), size=batch)
        x = np.stack([by[c][rng.integers(len(by[c]))] for c in y])
        for k, g in net.gradients(x, y).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            fall = rate * (1 - step / (steps + 1))
            net.p[k] -= (fall * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return net


def identify(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score."""
    net = train(sample(docs))
    schema = docs.select("doc_id", held_out().alias("held_out"), F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, TEXTS_AT_ONCE):
            texts = part.column(2).to_pylist()
            spell = [i for i, t in enumerate(texts) if t is not None and net is not None]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            for i, best, p in zip(spell, *(net.predict([texts[i].encode() for i in spell]) if spell else ((), ()))):
                lang[i], score[i] = net.labels[best], float(p)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    spelled = F.when(has_letter(), F.col("text"))
    return docs.select("doc_id", held_out().alias("held_out"), spelled.alias("text")).mapInArrow(run, schema)
