import base64
import random

import numpy as np
import pytest

from tracewright.llm import encoding as E
from tracewright.session import tokenizer_path

VOCAB = tokenizer_path("byte_bpe_50k.tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_against_reference_encoder(reference):
    r = random.Random(5)
    texts = ["".join(r.choice(" \n\t  ' 　'stmdrevellLL a1,.!é中👍​\x1c\x85²Ⅷ½́") for _ in range(r.randint(0, 80))) for _ in range(3000)]
    texts += ["it's we've I'LL 's '' !'s x's's 're", " " * 4000 + "x", "a" * 20000, "<|endoftext|>", "", None, "\r\n\r\n x", "ab " * 3000]
    ids, counts, offsets, pieces = E.encode_texts(texts, VOCAB)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    m = E.merger(VOCAB)
    for t, p in zip(texts, parts):
        assert p.tolist() == reference.encode_ordinary(t or "")
        assert m.decode(p.tolist()) == (t or "")
    assert pieces.sum() == len(offsets)


def test_scan_equals_sequential():
    r = np.random.RandomState(1)
    cls = r.randint(0, 8, 5000).astype(np.uint8)
    cls[0] = 8
    state, want = 0, []
    for c in cls.tolist():
        want.append(state)
        state = E._step(c % 8, 0 if c >= 8 else state)[0]
    got = E.scan_states(cls)
    live = np.arange(len(cls)) > 0
    assert (got[live] == np.array(want)[live]).all()


def test_query_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (3, "Hello world", None)], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in E.encode(df, "doc_id", "text").collect())
    assert got == [(1, [15496, 995]), (2, []), (3, []), (3, [15496, 995])]
    assert E.encode(df.limit(0), "doc_id", "text").collect() == []
    off = {r.doc_id: list(r.offsets) for r in E.encode(df.where("doc_id = 1"), "doc_id", "text", with_offsets=True).collect()}
    assert off == {1: [0, 5]}
    counts = sorted((r.doc_id, r.tokens) for r in E.count_tokens(df, "doc_id", "text", keep=("ids",)).collect())
    assert counts == [(1, 2), (2, 0), (3, 0), (3, 2)]
