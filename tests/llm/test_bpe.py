import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.fixtures import clashing, documents, empty

from rasterloom.llm import bpe as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
with open(PATH, "rb") as f:
    RANKS = B.read_ranks(f.read())
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = B.Encoder(RANKS, public_tokenizers.PATTERN, B.WORDS)
PLAIN = B.Encoder(RANKS, public_tokenizers.PATTERN, None)
TOKENS = B.Tokens(RANKS)
ASCII = [t.decode() for t in RANKS if max(t) < 128]
text = st.text(st.characters(exclude_categories=["Cs"])) | st.lists(st.sampled_from(ASCII), max_size=12).map("".join) | st.text("ab \n\t\r\x1c\x85\u2003'stéñ1", max_size=40)


@settings(max_examples=400, deadline=None)
@given(text)
def test_the_library_encodes_alike(t):
    want = LIBRARY.encode_ordinary(t)
    for encoder in (ENCODER, PLAIN):
        assert np.frombuffer(encoder.ids(t), np.int32).tolist() == want
    assert B._text(np.array(want, np.int32), TOKENS) == t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "aa", "ab", "ba", "bb", "aab", "abb", "baa", "abab"]), max_size=6).map("".join), st.permutations(["aa", "ab", "ba", "bb", "aab", "abb", "baa", "abab"]))
def test_contested_merges(t, merges):
    """Vocabularies of overlapping merges: pairs that may not follow each other, tokens that merges never make."""
    # as in any trained vocabulary, a token comes after the two that it joins
    ranks = {bytes([i]): i for i in range(256)} | {m.encode(): 256 + k for k, m in enumerate(sorted(merges, key=len))}
    transducer = B.Transducer(ranks)
    want = [ranks[t.encode()]] if t.encode() in ranks else [ranks[p] for p in transducer.merged(t.encode())]
    assert transducer.encode(t.encode()) == want


def test_long_piece_and_bounds(monkeypatch):
    long = "ab" * 20000 + "é" * 500
    assert np.frombuffer(ENCODER.ids(long), np.int32).tolist() == LIBRARY.encode_ordinary(long)
    monkeypatch.setattr(B, "CACHED_STATES", 3)
    monkeypatch.setattr(B, "CACHED_PAIRS", 2)
    monkeypatch.setattr(B, "CACHED_PIECES", 1)
    monkeypatch.setattr(B, "LONG", 5)
    small = B.Encoder(RANKS, public_tokenizers.PATTERN, B.WORDS)
    t = "some text that is longer than all bounds, größer als alles"
    assert np.frombuffer(small.ids(t), np.int32).tolist() == LIBRARY.encode_ordinary(t)
    with pytest.raises(ValueError, match="bytes"):
        B.Transducer({b"a": 0})
    with pytest.raises(ValueError, match="joins"):
        B.Transducer({bytes([i]): i for i in range(256)} | {b"abc": 256, b"ab": 257})


@given(st.binary(max_size=40), st.integers(1, 5))
def test_streaming_decode_is_whole_decode(data, step):
    machine = B.Utf8Stream()
    parts = [machine.feed(data[i : i + step]) for i in range(0, len(data), step)]
    assert "".join(parts) + machine.close() == data.decode("utf-8", "replace")


def test_the_query(spark):
    docs = clashing(documents(spark, 30))
    got = sorted((tuple(r) for r in B.op10_bpe_transducer(docs).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = LIBRARY.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(r["text"] or "")))
    assert got == sorted(want, key=repr) and B.op10_bpe_transducer(empty(docs)).count() == 0


def test_decode_operator(spark):
    rows = spark.createDataFrame([(1, LIBRARY.encode_ordinary("größe 中")), (2, None), (3, [])], "k int, ids array<int>")
    assert [r["decoded"] for r in B.decode(rows, PATH).orderBy("k").collect()] == ["größe 中", None, ""]
    bad = spark.createDataFrame([(1, [60000])], "k int, ids array<int>")
    with pytest.raises(Exception, match="vocabulary"):
        B.decode(bad, PATH).collect()
