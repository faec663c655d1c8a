"""MinHash groups, collocations and lexical search against brute force."""

import collections
import math
import random
import re
import string

import numpy as np
import pytest

from thali.llm import collocations, lexical, minhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, cls long, w1 long, n long, shard string, key long, rid string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def rows_of_text(texts):
    return [(i, t, lang, 5, 1, 2, "x", 3, "r") for i, t, lang in texts]


ODD = [
    (1, "a b c d e f g", "en"), (2, "A  b\tc d e F g", "en"), (2, "a b c d e f g", "en"), (None, "a b c d e f g", "en"), (None, "only null here now", None),
    (3, None, "en"), (4, "", None), (5, " \n,.", "de"), (6, "two words", "en"), (7, "Two  Words", "und"), (8, "x " * 30000, "en"),
    (9, "\u00c9 \u00e9. word;word word? A b c", "fr"), (10, "a\x00b c\x85d e f", "fr"), (2 ** 53 + 1, "two words", None), (2 ** 53 + 2, "big id", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows_of_text(ODD), DOCS).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# MinHash

def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(pairs, k, percent=80):
    """(doc_id, number of shingles, component) of each row."""
    sets = [shingles(t, k) for _, t in pairs]
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j]:
                common = len(a & sets[j])
                if 100 * common >= percent * (len(a) + len(sets[j]) - common):
                    parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return collections.Counter((doc, len(sets[i]), doc if not sets[i] else least.get(find(i))) for i, (doc, _) in enumerate(pairs))


def components(df, k):
    return collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.groups(df, k).collect())


def test_minhash_groups(odd, docs):
    for df in (odd, docs):
        pairs = [(r["doc_id"], r["text"]) for r in df.collect()]
        assert components(df, 4) == brute_components(pairs, 4)


def test_minhash_kept_is_the_component_itself(odd):
    for r in minhash.groups(odd, 4).collect():
        assert r["kept"] == (r["doc_id"] == r["component_id"]) and r["component_size"] >= 1


def test_minhash_group_of_edited_copies(spark):
    """A chain of edits around one text: pairs lie on both sides of 0.8, and
    many members share a bucket with others that they are not linked to."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = [(0, " ".join(base))]
    for i in range(1, 180):
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = f"e{i}x{rng.randrange(10 ** 6)}"
        texts.append((i, " ".join(own)))
    df = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string").repartition(4)
    want = brute_components(texts, 4)
    assert len({k[2] for k in want}) > 20
    assert components(df, 4) == want


def test_minhash_signatures_estimate_similarity():
    family, rng = minhash.Hashes(), np.random.default_rng(1)
    both = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    a, b = np.unique(both[:850]), np.unique(both[50:])
    x, y = (family.minima(s) for s in (a, b))
    assert abs((x == y).mean() - 800 / 900) < 0.06
    differing = sum(bin((p | p >> 1) & 0x5555555555555555).count("1") for p in (family.bits(x) ^ family.bits(y)).view(np.uint64).tolist())
    assert differing <= minhash.most_differing(80)


def test_minhash_of_an_empty_table(spark):
    assert minhash.groups(spark.createDataFrame([], DOCS), 4).collect() == []


# collocations

def brute_phrases(rows, longest=3, least=10, inside=50, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    most = collections.Counter()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                most[lang, p[i:i + k]] = max(a, most[lang, p[i:i + k]])
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if (lang, p) in most and 100 * most[lang, p] >= inside * a:
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s)
                  for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


@pytest.mark.parametrize("longest, least, top", [(3, 10, 2000), (4, 3, 50)])
def test_collocations(odd, docs, longest, least, top):
    for df in (odd, docs):
        got = sorted(tuple(r) for r in collocations.top_phrases(df, longest, least, 50, top).collect())
        assert got == brute_phrases([(r["lang"], r["text"]) for r in df.collect()], longest, least, 50, top)


def test_collocation_parts_and_exact_products(spark):
    """Phrases inside longer ones go, unless these are rare; words that overlap
    count; a full table of bits changes nothing."""
    texts = ["new york city"] * 12 + ["new york"] * 3 + ["go go go go"] * 5 + ["of the"] * 15 + ["the of"] * 4 + ["of the sea"] * 3
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = sorted(tuple(r) for r in collocations.top_phrases(df, 3, 3, 50, 100).collect())
    assert got == brute_phrases([(None, t) for t in texts], 3, 3, 50, 100)
    assert not any(r[2] == "new york" for r in got) and any(r[2] == "of the" for r in got)


def test_bit_table_never_loses(monkeypatch, docs):
    monkeypatch.setattr(collocations, "BITS", 1 << 10)
    got = sorted(tuple(r) for r in collocations.top_phrases(docs).collect())
    assert got == brute_phrases([(r["lang"], r["text"]) for r in docs.collect()])


def test_collocations_of_an_empty_table(spark):
    assert collocations.top_phrases(spark.createDataFrame([], DOCS)).collect() == []


def test_seed_that_tells_words_apart(docs, monkeypatch):
    own = collocations.word_key
    monkeypatch.setattr(collocations, "word_key", lambda lang, word, seed: own(lang, word, seed) if seed else 1 + len(word))
    relation, words = collocations.occurrences(docs)
    assert words.count() == words.select("key").distinct().count() > 1000 and relation.count() == docs.count()


def test_small_parts_change_nothing(odd, monkeypatch):
    monkeypatch.setattr(collocations, "AT_ONCE", 5)
    monkeypatch.setattr(collocations, "WORDS_AT_ONCE", 7)
    got = sorted(tuple(r) for r in collocations.top_phrases(odd, 3, 2, 50, 100).collect())
    assert got == brute_phrases([(r["lang"], r["text"]) for r in odd.collect()], 3, 2, 50, 100)


# lexical search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(pairs, items, top=20):
    held = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in pairs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scores = collections.Counter(TERM.findall((text or "").translate(LOWER))), []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                        for t, times in asked.items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:top])]
    return collections.Counter(out)


ITEMS = [(1, "a b c word"), (2, "two two words"), (3, None), (4, ""), (5, "unknown thing"), (6, "x A \u00e9 big id null"), (7, "x")]


@pytest.mark.parametrize("top, block, span", [(20, 128, 1024), (3, 2, 4)])
def test_search(spark, odd, docs, monkeypatch, top, block, span):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "RANGE", span)
    monkeypatch.setattr(lexical, "SHARD_TERMS", 3000)
    monkeypatch.setattr(lexical, "QUERIES_AT_ONCE", 3)
    small = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("term", lexical.F.lit("clash"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for df, items in ((odd, small), (docs, bench), (docs, small)):
        got = collections.Counter(tuple(r) for r in lexical.search(df, items, top).collect())
        assert got == brute_search([(r["doc_id"], r["text"]) for r in df.collect()], [(r["item_id"], r["text"]) for r in items.collect()], top)


def lists_of(documents, mean):
    """A shard of documents (lists of terms) as postings by term."""
    code = {t: i for i, t in enumerate(dict.fromkeys(t for d in documents for t in d))}
    lengths = np.array([len(d) for d in documents])
    columns = lexical.posting_lists(list(code), np.array([code[t] for d in documents for t in d], dtype=np.int32), lengths)
    return {t: lexical.Postings(df, h, b, p, mean) for t, df, h, b, p in zip(*(c.to_pylist() for c in columns))}, lengths


def test_search_rejects_before_it_unpacks():
    """With a strong list and a weak one, blocks of the weak one without a
    candidate are never read."""
    documents = [[b"common"] * (1 + d % 3) + ([b"rare"] * 30 if d in (5, 11, 17) else []) for d in range(20_000)]
    lists, lengths = lists_of(documents, (20_000, sum(map(len, documents))))
    docs, _ = lexical.best_of_shard([(lists[b"rare"], 9000), (lists[b"common"], 1)], lengths, 3)
    assert docs.tolist() == [5, 11, 17]
    assert len(lists[b"common"].first) > 150 and len(lists[b"common"].read) <= lexical.RANGE // lexical.BLOCK + 1


def test_postings_and_block_maxima():
    rng = random.Random(2)
    documents = [[b"t%d" % rng.randrange(1 + rng.randrange(40)) for _ in range(rng.randint(1, 60))] for _ in range(700)]
    documents[300] = [b"t1"] * 70_000  # more occurrences than two bytes hold
    for mean in ((10, 100), (1000, 7), (3, 90_000)):
        lists, lengths = lists_of(documents, mean)
        for t, p in lists.items():
            docs, tf = (np.concatenate(x) for x in zip(*(p.block(i) for i in range(len(p.first)))))
            assert [(d, n) for d, n in zip(docs.tolist(), tf.tolist())] == [(d, x.count(t)) for d, x in enumerate(documents) if t in x]
            worth = lexical.part_score(tf, lengths[docs], mean)
            assert p.most.tolist() == [int(worth[i:i + lexical.BLOCK].max()) for i in range(0, len(docs), lexical.BLOCK)]


def test_search_in_empty_tables(spark, docs):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(none, items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
