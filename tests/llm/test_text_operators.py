"""The text operators against brute force, on small rows with nulls, empty and
long texts, ties, repeated rows, clashing columns, and on empty tables."""

import collections
import hashlib
import math
import random
import re
import string
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import functions as F

from thali.llm import bpe, chat, exact_dedup, langid, licenses, mixing, quality, sharding, simhash, suffix_tree
from thali.llm.common import stored
from thali.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, _w string, digest string, fp long, kept string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
GAP = re.compile("[\x20\x09-\x0d]+")


def words(text):
    return [w for w in GAP.split(text or "") if w]


def rows_of_text(texts):
    return [(i, t, "en", "s" if i is None or i % 2 else None, 0, 7, "w", "d", 1, "k") for i, t in texts]


ODD = [
    (1, "a  b\tc"), (2, "a b c"), (2, "a b c"), (None, "a b c"), (None, "only null"), (3, None), (4, ""), (5, " \n"),
    (6, " a b c"), (7, "É É é x y z"), (8, "x " * 30000), (9, "word " * 60 + "end"), (10, "The of and " * 20 + "fin"),
    (11, "### $$$ line\n" * 30), (12, "same line of the text here\n" * 12), (13, "Released under the MIT License."),
    (13, "another text under one id"), (14, "a\x00b c\x85d e f"), (15, "😀 <|im_end|> 'll  \t x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows_of_text(ODD), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def both(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# exact dedup

def brute_groups(pairs):
    groups = collections.defaultdict(list)
    for i, t in pairs:
        groups[GAP.sub(" ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        left = True
        for i in ids:
            out.append((i, keep, len(ids), left and i == keep, sha(text)))
            left = left and i != keep
    return collections.Counter(out)


@pytest.mark.parametrize("digest", ["sha", "weak"])
def test_exact_groups(odd, docs, digest):
    how = {"digest": lambda c: exact_dedup.F.length(c).cast("string")} if digest == "weak" else {}
    for df in (odd, docs):
        got = collections.Counter(tuple(r) for r in exact_dedup.exact_groups(df, **how).select(
            "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
        assert got == brute_groups(both(df))


def test_drop_exact_copies(odd):
    out = exact_dedup.drop_exact_copies(odd)
    assert out.columns == odd.columns and {r["digest"] for r in out.collect()} == {"d"}
    want = collections.Counter((k[0], k[4]) for k, n in brute_groups(both(odd)).items() for _ in range(n) if k[3])
    assert collections.Counter((i, sha(GAP.sub(" ", t or ""))) for i, t in both(out)) == want


# quality rules

def brute_counts(text):
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    covered = {p + k for ps in at.values() if len(ps) > 1 for p in ps for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(odd, docs):
    for df in (odd, docs):
        got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                                   r["base_failed"]) for r in quality.verdicts(df).collect())
        assert got == collections.Counter((i, *brute_counts(t)) for i, t in both(df))


def test_quality_keeps_clean_and_all_columns(spark, odd, docs):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert not {1, 3, 8, 11, 12} & {i for i, _ in both(kept)}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality.verdicts(docs).join(labels, "doc_id").where("not base_failed")
    assert judged.where("quality = 1 and not kept").count() == 0
    assert judged.where("quality = 0 and kept").count() == 0


def test_quality_filter_is_not_pushed_below_its_projection(odd):
    plan = quality.keep_good(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 3


# sharding

def test_sharding_by_bytes(odd, docs):
    for df in (odd, docs):
        out = sharding.shard_by_bytes(df, 40).collect()
        want = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in both(df))
        assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
        places = collections.defaultdict(list)
        for r in out:
            places[r["shard"]].append(r["slot"])
        assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(40))
        by_slot = collections.defaultdict(set)
        for r in out:
            by_slot[r["virtual_slot"]].add(r["shard"])
        assert all(len(s) == 1 for s in by_slot.values())
        # the map in use is the first one edited: what was not moved stays where it was dealt
        assert all(r["map_version"] == 2 and r["moved"] == (r["shard"] != r["virtual_slot"] % 40) for r in out)


def test_sharding_with_a_hot_id(spark):
    """A third of the rows under one id, and a third equal in all columns."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.lit(8)).otherwise(F.col("id")).cast("long").alias("doc_id"),
        F.when(F.col("id") % 3 == 1, F.lit("same text of all")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    out = sharding.shard_by_bytes(rows, 40).groupBy("shard").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.max("slot").alias("last")).collect()
    mean = sum(r["b"] for r in out) / 40
    assert len(out) == 40 and all(0.95 * mean < r["b"] < 1.05 * mean and r["last"] == r["n"] - 1 for r in out)


def test_a_kept_map_is_edited(docs, scratch):
    """New documents and one more shard: only moved slots change."""
    sharding.save_map(docs.sparkSession, sharding.first_map(4, 256), f"{scratch}/map")
    four = {r["doc_id"]: r["shard"] for r in sharding.shard_by_bytes(docs, 4, 256, f"{scratch}/map").collect()}
    five = sharding.shard_by_bytes(docs, 5, 256, f"{scratch}/map").collect()
    assert {r["map_version"] for r in five} == {3} and any(r["moved"] for r in five)
    assert all((four[r["doc_id"]] != r["shard"]) == r["moved"] for r in five if not r["moved"])
    assert {r["shard"] for r in five} == set(range(5))


def test_rebalance_edits_the_map(spark, scratch):
    rng = random.Random(5)
    bytes_ = {s: rng.randint(1, 1000) for s in range(512)}
    first = sharding.rebalance(sharding.first_map(8, 512), bytes_, 8)
    load = lambda m: [sum(b for s, b in bytes_.items() if m.shard_of[s] == k) for k in range(m.n_shards)]
    assert max(load(first)) - min(load(first)) <= 2000
    grown = sharding.rebalance(first, bytes_, 9)
    moved = [s for s in range(512) if grown.shard_of[s] != first.shard_of[s]]
    assert grown.version == 3 and all(grown.shard_of[s] == 8 for s in moved)
    assert max(load(grown)) - min(load(grown)) <= 2000
    less = sharding.rebalance(grown, bytes_, 5)
    assert set(less.shard_of) == set(range(5)) and max(load(less)) - min(load(less)) <= 2000
    for m in (first, grown, less):
        sharding.save_map(spark, m, f"{scratch}/map")
    assert sharding.load_map(spark, f"{scratch}/map") == less and sharding.load_map(spark, f"{scratch}/map", 3) == grown


# near-dedup

def brute_fingerprint(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    fps = [brute_fingerprint(t) if t is None or len(t) < 5000 else simhash.fingerprint(t) for _, t in pairs]
    distinct = np.array(sorted(set(fps)), dtype=np.uint64)
    parent = list(range(len(distinct)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(distinct)):
        for j in np.nonzero(np.bitwise_count(distinct ^ distinct[i]) <= 2)[0].tolist():
            parent[find(j)] = find(i)
    root = {int(x): find(i) for i, x in enumerate(distinct)}
    least = {}
    for (i, _), fp in zip(pairs, fps):
        if i is not None:
            least[root[fp]] = min(least.get(root[fp], i), i)
    return [(i, fp, least.get(root[fp])) for (i, _), fp in zip(pairs, fps)]


def test_fingerprint_of_a_long_text():
    text = " ".join(f"w{i % 977} É" for i in range(40000))
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_simhash_groups(spark, odd, docs):
    near = [(100 + i, "one two three four five six seven eight nine ten " * 9 + "x" * (i % 40)) for i in range(80)]
    for df in (odd, docs, spark.createDataFrame(rows_of_text(near), DOCS)):
        got = collections.Counter((r["doc_id"], r["fp"] % 2 ** 64, r["component_id"]) for r in simhash.groups(df).collect())
        assert got == collections.Counter(brute_components(both(df)))


def test_pairs_within_two_bits(spark):
    rng = random.Random(3)
    fps = {0}
    for _ in range(20):
        base = rng.getrandbits(64)
        for _ in range(30):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = lambda x: x - 2 ** 64 if x >> 63 else x
    got = {(r["a"], r["b"]) for r in simhash.near_pairs(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()}
    assert got == {(signed(a), signed(b)) for a in fps for b in fps if signed(a) < signed(b) and bin(a ^ b).count("1") <= 2}


def test_components_of_a_chain(spark):
    from thali.llm.components import smallest_reachable

    n = 60
    links = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000)]
    got = {r["node"]: r["component"] for r in smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_drop_near_copies(odd):
    """One row of each component: of its smallest id."""
    out = simhash.drop_near_copies(odd)
    assert out.columns == odd.columns
    components = collections.defaultdict(list)
    for r in simhash.groups(odd).collect():
        components[r["component"]].append(r["doc_id"])
    least = [min((i for i in ids if i is not None), default=None) for ids in components.values()]
    assert collections.Counter(i for i, _ in both(out)) == collections.Counter(least)


def test_drop_near_copies_of_an_id_in_two_components(spark):
    rows = [(0, "a b c d e f g h", "x"), (1, "a b c d e f g h", "y"), (1, "quite another text of some words", "z"), (None, "quite another text of some words", "n"),
            (None, "a third text that is only here", "o")]
    out = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, component string"))
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)


@pytest.mark.parametrize("digest", ["sha", "weak"])
def test_drop_exact_copies_compares_contents(spark, digest):
    how = {"digest": lambda c: exact_dedup.F.length(c).cast("string")} if digest == "weak" else {}
    rows = [(1, "aa bb", "x"), (1, "bb aa", "y"), (2, "aa  bb", "z"), (2, "bb aa", "u"), (3, "cc cc", "v")]
    out = exact_dedup.drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string, digest string"), **how)
    assert sorted(tuple(r) for r in out.collect()) == [rows[0], rows[1], rows[4]]


# LM scoring

def brute_scores(pairs):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    token_counts, seen = collections.Counter(), collections.defaultdict(collections.Counter)
    split = lambda t: words((t or "").translate(LOWER))
    spelled = lambda t: b"\n" + b"".join(w.encode() + b" " for w in split(t)) + b"\n"
    learned = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
    for i, t in pairs:
        if learned(i):
            token_counts.update([*split(t), "\n"])
            b = spelled(t) if split(t) else b"\n\n"
            for j in range(1, len(b)):
                for k in range(min(suffix_tree.DEPTH, j) + 1):
                    seen[b[j - k:j]][b[j]] += 1
    total = {k: sum(v.values()) for k, v in seen.items()}
    n, v = sum(token_counts.values()), len(token_counts)

    def is_state(k):
        if k not in total or total[k] < suffix_tree.LEAST:
            return False
        gain = sum(c * math.log(c / total[k] / (seen[k[1:]][x] / total[k[1:]])) for x, c in seen[k].items())
        return gain >= 0.5 * len(seen[k]) * math.log(total[k]) + suffix_tree.MARGIN

    memo = {}

    def shares(k):
        if k not in memo:
            if not k:
                memo[k] = [(seen[k][x] + 0.5) / (total.get(k, 0) + 0.5 * 257) for x in range(256)]
            elif is_state(k):
                back, w = shares(k[1:]), len(seen[k])
                memo[k] = [(seen[k][x] + w * back[x]) / (total[k] + w) for x in range(256)]
            else:
                memo[k] = shares(k[1:])
        return memo[k]

    base_of = lambda w: (token_counts[w] + 0.5) / (n + 0.5 * (v + 1))
    out = []
    for i, t in pairs:
        b = spelled(t) if split(t) else b"\n\n"
        score = sum(math.log10(shares(b[max(0, j - suffix_tree.DEPTH):j])[b[j]]) for j in range(1, len(b)))
        own = [*split(t), "\n"]
        out.append((i, not learned(i), len(own), sum(token_counts[w] > 0 for w in own), n, sum(math.log10(base_of(w)) for w in own), score))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[6]))


def test_suffix_tree_scores(docs):
    got, want = ordered(tuple(r) for r in suffix_tree.score(docs).collect()), ordered(brute_scores(both(docs)))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_suffix_tree_in_small_chunks(odd, monkeypatch):
    monkeypatch.setattr(suffix_tree, "CHUNK_TOKENS", 40)
    monkeypatch.setattr(suffix_tree, "_HELD", 50)
    monkeypatch.setattr(suffix_tree, "_AT_ONCE", 300)
    got, want = ordered(tuple(r) for r in suffix_tree.score(odd).collect()), ordered(brute_scores(both(odd)))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_suffix_tree_in_small_parts(odd, monkeypatch):
    for name, size in (("CHUNK_TOKENS", 40), ("_AT_ONCE", 30), ("_LOOKED_UP", 60), ("_PACKED", 10)):
        monkeypatch.setattr(suffix_tree, name, size)
    got, want = ordered(tuple(r) for r in suffix_tree.score(odd).collect()), ordered(brute_scores(both(odd)))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_suffix_tree_sends_arrays(spark, monkeypatch):
    """A chunk gets the counts of its words in a row a task, not in a row a word."""
    kept = {}
    monkeypatch.setattr(suffix_tree, "stored", lambda df, name, *a: kept.setdefault(name, stored(df, name, *a)))
    rows = [(i, " ".join(f"w{i * 100 + k}" for k in range(100))) for i in range(30)]
    got = suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert len(got) == 30 and 0 < kept["words"].count() <= 8


def test_suffix_tree_words():
    texts = ["a  b\tc", None, "", " \n", " x\x0by\x0c z\r", "\x00 \x1c \x85 \xa0 \u2003", "É é  "]
    got = suffix_tree.split_words(pa.array(["cut", *texts], pa.string())[1:]).to_pylist()
    assert got == [[w.decode() for w in (t or "").encode().split()] for t in texts]


def test_suffix_tree_keeps_large_ids(spark):
    ids = [2 ** 53 + k for k in (1, 3, 5, 7, 9, 11)] + [None, 2 ** 62 + 1]
    df = spark.createDataFrame([(i, f"text of number {k}") for k, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    got = suffix_tree.score(df).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(ids)
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 1)


def test_suffix_tree_grows_and_keeps_its_states(spark):
    """A context's state does not go when unrelated text is added, however much."""
    some = [(i, "zq zqx zq zqx") for i in range(40)]
    more = [(i, " ".join(f"w{i * 50 + k}" for k in range(400))) for i in range(40, 240)]

    def contexts(rows):
        chunks = suffix_tree.read_chunks(spark.createDataFrame(rows, "doc_id long, text string"))
        states, _ = suffix_tree.tree(chunks.where("kind = 'gram'").selectExpr("number as key", "n"))
        return {r["context"] for r in states.select("context").collect()}

    few, many = contexts(some), contexts(some + more)
    spelled = lambda b: sum((x + 1) << 9 * k for k, x in enumerate(reversed(b)))
    assert spelled(b"q") in few and spelled(b"q") in many and len(many) > 3 * len(few)


def test_suffix_tree_odd_rows(odd):
    got = suffix_tree.score(odd).collect()
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in got) == collections.Counter((i, len(words(t)) + 1) for i, t in ODD)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_unknown_words_pay_for_their_spelling(spark):
    rng = random.Random(3)
    junk = {n: "".join(rng.choices(string.ascii_letters + string.digits, k=n)) for n in (10, 100, 1000)}
    out_of = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    rows = [(i, "the cat sat on the mat and the dog sat by the door") for i in range(100) if i not in out_of]
    rows += list(zip(out_of, junk.values()))
    got = {r["doc_id"]: r for r in suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({got[i]["base_score"] for i in out_of}) == 1
    for i, n in zip(out_of, junk):  # a byte that no state expects costs a digit at least
        assert math.isfinite(got[i]["score"]) and got[i]["score"] < got[i]["base_score"] and got[i]["score"] < -n


# language ID

def test_language_id(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    assert len(got) == 1000 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd.where("doc_id in (3, 4, 5, 11, 9)")).collect()}
    assert out[3] == out[4] == out[5] == "und"
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", exact_dedup.F.lit(None).cast("string"))).collect()} == {"und"}


def test_network_gradients():
    net = langid.Network(["a", "b", "c"], 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 257, (5, langid.WINDOW)), np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.log(net.softmax(net.features(x))[np.arange(5), y]).mean()
    for name, g in net.gradients(x, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = loss()
        net.p[name][at] = old - 1e-5
        assert (up - loss()) / 2e-5 == pytest.approx(g[at], rel=1e-3, abs=1e-7)
        net.p[name][at] = old


# BPE

def codec_and_library():
    raw = open(RANKS, "rb").read()
    return bpe.Codec(raw, public_tokenizers.PATTERN), tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(raw), special_tokens={})


@pytest.fixture(scope="module")
def codecs():
    return codec_and_library()


def ids_of(data):
    return memoryview(data).cast("I").tolist() if data else []


def test_bpe_matches_the_library(codecs, monkeypatch):
    ours, library = codecs
    monkeypatch.setattr(bpe, "LEAF", 7)
    monkeypatch.setattr(bpe, "PIECE_LEAF", 6)
    rng = random.Random(1)
    bits = ["a", "b", "the", "'", "s", "'ll", " ", "  ", "\n", "\t", "é", "中", "1", "23", "!", "##", "'re", "in", "tion", "<|endoftext|>", "😀", "\x00"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        ids = ids_of(ours.encode(text))
        assert ids == library.encode_ordinary(text) and ours.decode(ids) == text.encode()
    for text in ("a" * 4000, "abc" * 1500, "".join(rng.choice("aeinst") for _ in range(4000)), " " * 3000 + "x"):
        assert ids_of(ours.encode(text)) == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 3001, "-" * 5000, "abc" * 777 + "x" * 1001 + "q", "=" * 700 + "-" * 900, "\u65e5\u672c" * 900, "ha" * 400 + "he" * 600])
def test_bpe_of_repeated_units(text):
    codec, library = codec_and_library()
    assert list(memoryview(codec.encode(text)).cast("I")) == library.encode_ordinary(text)


def test_bpe_of_very_long_runs():
    codec, _ = codec_and_library()
    for text in ("a" * 2_000_000, "-" * 200_000 + "end" + "=" * 200_000):
        assert codec.decode_packed(codec.encode(text)) == text.encode()
    many = codec_and_library()[0].merged_by_heap(b"a" * 20_000)
    assert codec.merged_everywhere(b"a" * 20_000) == many


def test_bpe_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 20_000)
    monkeypatch.setattr(bpe, "KNOWN_PAIRS", 100)
    codec, library = codec_and_library()
    rng = random.Random(5)
    text = " ".join("".join(chr(rng.randrange(0x4e00, 0x9fff)) for _ in range(9)) for _ in range(2000))
    assert list(memoryview(codec.encode(text)).cast("I")) == library.encode_ordinary(text)
    assert codec.known_bytes < 21_000 and len(codec.pairs) <= 100 and len(codec.settled) <= 100


def test_slices_are_bounded_in_bytes():
    import pyarrow as pa

    from thali.llm.common import slices
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, None, "b" * 100, "c" * 10, "d" * 10, ""])], ["doc_id", "text"])
    parts = list(slices([batch, batch.slice(0, 0)], rows=4, size=25))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2], [3, 4, 5]]


def test_bpe_round_trip(odd, docs, codecs):
    for df in (odd, docs):
        want = collections.Counter()
        for i, t in both(df):
            ids = codecs[1].encode_ordinary(t or "")
            want[i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), sha(t or "")] += 1
        got = bpe.round_trip(df, RANKS, public_tokenizers.PATTERN)
        apart = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
        assert collections.Counter((r["doc_id"], bytes(r["decoded"])) for r in apart.collect()) == collections.Counter(
            (i, (t or "").encode()) for i, t in both(df))
        assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()) == want


# chat

TURNS = "conv_id long, turn long, role string, text string, blocks string, copies int"


def brute_turns(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, v in by.items():
        v.sort()
        loss = "".join(x for _, _, r, x in v if r == "assistant")
        out[c] = (len(v), sha("".join(f"{r}\n{x}\n" for _, _, r, x in v)), len(loss), sha(loss))
    return out


def test_chat_round_trip(spark):
    odd = [(1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nhi")] * 2 + [
        (1, 1, "user", "<\\|x <\\\\| a\\b <| <"), (1, 2, "assistant", None), (1, 3, "assistant", "é<|im_sep|>"), (1, None, None, "z"),
        (None, 1, "a\nb&nl;&amp;<|im_sep|>", ""), (None, 700, "assistant", "q"), (None, 701, "assistant", "r\n"),
        (2, 5, "assistant", "<|im_end|>\n"), (3, 0, "", ""), (4, 1, "assistant", "b"), (4, 1, "assistant", "a")]
    odd += [(5, i, "assistant" if i // 3 % 2 else "user", f"t{i}") for i in range(2000)]
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    for rows in (odd, real):
        df = spark.createDataFrame([(*r, "x", 9) for r in rows], TURNS).repartition(4)
        shaped = chat.formatted(df)
        got = {r["conv_id"]: r for r in chat.digests(shaped).collect()}
        assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == brute_turns(rows)
        for r in shaped.collect():
            assert r["text"] == "".join(s["text"] for s in r["segments"]) and len(r["text"]) == got[r["conv_id"]]["formatted_chars"]
            roles = [b.split("\n", 1)[0] for b in r["text"].split(chat.START)[1:]]
            assert all(a != b for a, b in zip(roles, roles[1:]))
    assert chat.digests(chat.formatted(spark.createDataFrame([], TURNS))).count() == 0


# mixing

def test_targets():
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == pytest.approx([18.75, 7.5, 3.75])
    capped = mixing.targets([1, 100, 100], [5, 2, 1])
    assert capped[0] == 3 and capped == pytest.approx([3, 132, 66])
    assert mixing.targets([0, 0], [5, 2]) == [0, 0] and mixing.targets([], []) == []


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (1, 99):
            got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, dtype=np.uint64))
            assert sorted(got.tolist()) == list(range(n))


def test_mixing(odd, docs):
    for df in (odd, docs):
        rows = mixing.taken(df).collect()
        assert collections.Counter((r["doc_id"], r["size"]) for r in rows) == collections.Counter((i, len(words(t))) for i, t in both(df))
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.taken(df).collect()), key=str)
        sums, source = collections.Counter(), {}
        for r in rows:
            sums[r["source"]] += r["taken"]
            source[r["source"]] = (r["source_size"], r["target"])
        for s, (size, target) in source.items():
            assert target <= 3 * size + 1e-6 and abs(sums[s] - target) <= max(2 * mixing.BLOCK, 0.02 * target)
        assert sum(t for _, t in source.values()) == pytest.approx(sum(n for n, _ in source.values()))


def test_mixed_documents(odd, docs):
    for df in (docs, odd.where("doc_id not in (2, 13) and doc_id is not null")):
        taken = {r["doc_id"]: r["taken"] for r in mixing.taken(df).collect()}
        out = mixing.mixed_documents(df)
        got = collections.Counter()
        original = dict(both(df))
        for r in out.collect():
            got[r["doc_id"]] += len(words(r["text"]))
            assert r["n_chars"] == len(r["text"])
            left, at = words(original[r["doc_id"]]), 0
            for w in words(r["text"]):  # in the document's order
                at = left.index(w, at) + 1
        assert out.columns == df.columns and got == collections.Counter({k: v for k, v in taken.items() if v})


def test_mixed_documents_keep_each_row_its_own(spark):
    """Rows of one id and text, and texts of one id, come back with their own columns."""
    rows = [(1, "a b c", "s", "x"), (1, "a b c", "s", "y"), (1, "d e f g", "s", "z"), (None, "a b c", None, "n"), (None, "a b c", None, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key string")
    want = collections.Counter()
    mix, spans = mixing.mixed(df)
    for r in mix.join(spans, ["source_no", "offset"]).select("doc_id", "nth", "key", "round").distinct().collect():
        want[r["doc_id"], bytes(r["key"])] += 1
    got = collections.Counter((r["doc_id"], hashlib.sha256(r["text"].encode()).digest()) for r in mixing.mixed_documents(df).collect())
    assert got == want
    extra = {(r["doc_id"], r["text"]): set() for r in mixing.mixed_documents(df).collect()}
    for r in mixing.mixed_documents(df).collect():
        extra[r["doc_id"], r["text"]].add(r["key"])
    assert extra[1, "a b c"] == {"x", "y"}


# licenses

def brute_licenses(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def brute_matches(text, threshold):
    """Labels by the definition: runs of words, at most 1.5 times as long as the
    template, every start tried."""
    tokens = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate(LOWER))
    w, runs = tokens(text or ""), []
    for k, (label, t) in enumerate(licenses.TEMPLATES):
        own, reach = set(tokens(t)), int(1.5 * len(tokens(t)))
        found = []
        for i in range(len(w)):
            if w[i] in own:
                seen, last = set(), i
                for j in range(i, min(i + reach, len(w))):
                    if w[j] in own - seen:
                        seen.add(w[j])
                        last = j
                if len(seen) >= threshold * len(own) - 1e-9:
                    found.append((i, last, len(seen)))
        found = [r for r in found if not any(o[0] > r[0] and o[1] <= r[1] and o[2] >= r[2] for o in found)]
        runs += [(k, label, own, *r) for r in found]
    return {label for _, label, own, a, b, _ in runs if not any(own < o and c <= a and d >= b for _, _, o, c, d, _ in runs)}


def test_licenses(spark, odd, docs):
    notice = licenses.TEMPLATES[1][1]
    half = notice.split()
    more = [(30, "x\n" + " ".join(half[:9]) + "\n" + " ".join(half[9:]) + "\ny"), (31, " ".join(half[:12])), (32, "gnu General\nPUBLIC  license; MIT-license cc\nby"),
            (33, "MIT licensesK mit licenseé cc byte"), (34, "Licensed under CC BY-NC 4.0"), (35, "Licensed under the Apache License, Version 2")]
    for df in (odd, docs, spark.createDataFrame(rows_of_text(more), DOCS)):
        got = collections.Counter()
        want = collections.Counter()
        for r in licenses.scan(df).collect():
            got[r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]] += 1
            assert 0 <= r["score"] <= 1
        for i, t in both(df):
            base = brute_licenses(t)
            labels = {x for x in base[-1].split(",") if x} | brute_matches(t, licenses.THRESHOLD)
            want[(i, *base, ",".join(sorted(labels)))] += 1
        assert got == want


def found_labels(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in licenses.scan(rows).collect()}


def stated_labels(texts):
    """The labels of the SQL statement."""
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(i, t) for i, (t, _) in enumerate(texts)])
    return {i: set(x.split(",")) - {""} for i, x in con.execute(f"select doc_id, labels from ({ORACLE['op10_licenses']})").fetchall()}


def test_wrapped_licenses(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files, to deal in the Software without restriction").split()
    texts = [
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy", {"mpl-2.0"}),
        ("licensed under a Creative Commons Attribution 4.0\nInternational License", {"cc-by-4.0"}),
        ("// licensed under the GNU General Public\n// License, version 3", {"gpl", "gpl-3.0"}),
        ("x\n" * 500 + "Released\nunder\n\nthe\nMIT\nLicense\n" + "y\n" * 500, {"mit"}),
        (" * " + "\n * ".join(mit), {"mit"}), ("\n\n".join(mit), {"mit"}), ("\n\n".join(mit[:20]), set())]
    # a run over every place of the pieces that a text is cut in
    texts += [("z " * n + "Released under\nthe MIT License", {"mit"}) for n in range(0, 140, 7)]
    got, stated = found_labels(spark, texts), stated_labels(texts)
    for i, (text, want) in enumerate(texts):
        assert got[i] == want == stated[i], text[:80]
        assert brute_matches(text, 0.9) | (want & {"gpl"}) == want


def test_licenses_need_their_words_near(spark):
    by, nc, far = "Licensed under CC BY 4.0", "Licensed under CC BY-NC 4.0", "word " * 100
    texts = [
        (f"this is free and {'word ' * 9000} software released {'word ' * 9000} into the public domain", set()),
        (far.join(["released ", "under ", "the ", "mit ", "license"]), set()),
        ("word " * 5000 + "Released under the MIT License " + "word " * 5000, {"mit"}),
        (f"{by} {far} {nc}", {"cc-by", "cc-by-4.0", "cc-by-nc-4.0"}), (f"{nc} {far} {by}", {"cc-by", "cc-by-4.0", "cc-by-nc-4.0"}),
        (f"{by}, the images are {nc}", {"cc-by", "cc-by-4.0", "cc-by-nc-4.0"}), (f"{by} {nc}", {"cc-by", "cc-by-4.0", "cc-by-nc-4.0"}),
        (nc, {"cc-by", "cc-by-nc-4.0"}), (f"{nc} and {nc}", {"cc-by", "cc-by-nc-4.0"}), (f"{nc} {far} {nc}", {"cc-by", "cc-by-nc-4.0"})]
    got, stated = found_labels(spark, texts), stated_labels(texts)
    for i, (text, want) in enumerate(texts):
        assert got[i] == want == stated[i], text[:80]


# all

def test_empty_tables(spark, none):
    empty = [
        exact_dedup.exact_groups(none), exact_dedup.drop_exact_copies(none), quality.verdicts(none), quality.keep_good(none),
        sharding.shard_by_bytes(none, 40), simhash.groups(none), simhash.drop_near_copies(none), suffix_tree.score(none), langid.identify(none),
        bpe.round_trip(none, RANKS, public_tokenizers.PATTERN), mixing.taken(none), mixing.mixed_documents(none), licenses.scan(none)]
    for df in empty:
        assert df.count() == 0


@pytest.mark.parametrize("key", sorted(set(QUERIES) - {"op12_collocations", "op13_lexical"}))
def test_query_runs_over_its_whole_table(spark, key):
    out = QUERIES[key](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count() if "chat" not in key else (
        spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1)
    assert out.count() == n


@pytest.mark.parametrize("key", ["op6_quality_rules", "op7_chat_format", "op9_exact_dedup", "op10_licenses"])
def test_native_queries_run_no_python(spark, key):
    plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
