"""The pipeline: stages on odd rows, and its rows against stage-wise brute force."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from test_text_operators import DOCS, ODD, brute_components, brute_counts, brute_groups, rows_of_text, sha, GAP
from thali.llm import bpe
from thali.llm.common import stored

SF = "/root/testdata/sf0.001"


def both(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    done = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), name)
        done[name] = (both(before), both(docs) if "text" in docs.columns else docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    before, after = done["quality_rules"]
    assert not any(brute_counts(t)[-1] for _, t in after) and len(after) > 0.7 * len(before)
    before, after = done["exact_dedup"]
    assert collections.Counter((i, sha(GAP.sub(" ", t or ""))) for i, t in after) == collections.Counter(
        (k[0], k[4]) for k in brute_groups(before) if k[3])
    before, after = done["simhash_near_dedup"]
    assert {i for i, _ in after} == {i for i, _, c in brute_components(before) if i == c} and len(after) == len({i for i, _ in after})
    before, after = done["byte_bpe"]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.load_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()))
    want = collections.Counter((i, hashlib.sha256(np.array(library.encode_ordinary(t), dtype="<u4").tobytes()).hexdigest(), sha(t)) for i, t in before)
    assert collections.Counter((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in after) == want


@pytest.mark.parametrize("rows", [rows_of_text(ODD), []], ids=["odd", "empty"])
def test_stages_on_odd_rows(spark, rows):
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(rows, DOCS)
        out = stage(spark, docs, SF)
        out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
