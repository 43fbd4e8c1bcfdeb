import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm.fixtures import clashing, documents, empty
from tokenizers import Tokenizer

from rasterloom.llm import packing as P
from rasterloom.llm import word_bpe
from rasterloom.llm.word_bpe import WordBPE

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def test_pieces_and_sequences(spark):
    docs = clashing(documents(spark, 90)).where("doc_id is not null and doc_id <> 1006")
    got = P.op7_pack(docs).collect()
    texts = {r["doc_id"]: ids_of(r["text"]) for r in docs.collect()}
    pieces, sequences = {}, {}
    for r in got:
        own = np.array(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(texts[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for spans, size in [(s, len(texts[i])) for i, s in pieces.items()] + [(s, None) for s in sequences.values()]:
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end == size if size else end <= 4096
    fill = sum(n for s in sequences.values() for _, n in s)
    assert fill / (4096 * len(sequences)) > 0.9 and sorted(sequences) == list(range(len(sequences)))


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 50 + [(None, None)] * 3, "doc_id long, text string")
    got = P.op7_pack(docs).collect()
    assert len(got) == 53 and len({(r["sequence_id"], r["offset"]) for r in got}) == 53
    assert P.op7_pack(empty(docs)).count() == 0


CHARS = st.text(st.characters(exclude_categories=["Cs"]))
PLAIN = st.text(st.sampled_from("abestABESTaaaÀÉßÿÞ×÷.,'!%# "))
FILE = open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()
KEPT = WordBPE(FILE)


@settings(deadline=None, max_examples=300)
@given(st.lists(CHARS | PLAIN | st.sampled_from(["don't. x!!", "ABC., É.. a1, x.y", "a\x1cb\x85c\u2003d", "<|endoftext|> x", "e\u0301 \u0301a", "ΣΑΣ. İ.", "aaaaaaaaaaa!!!!!!!", ""])))
def test_together_is_the_library(texts):
    assert KEPT.fast
    for _ in range(2):  # new, then kept
        ids, size = KEPT.encode(pa.array([*texts, None], pa.string()), 2)
        want = [ids_of(t) for t in [*texts, None]]
        assert size.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_more_words_than_are_kept(monkeypatch):
    monkeypatch.setattr(word_bpe, "KNOWN", 4)
    own = WordBPE(FILE)
    for text in ("a b c", "c d e f g a", "g c\u0301 1 x.y", " a  g "):
        assert own.encode(pa.array([text]), 2)[0].tolist() == ids_of(text)


def test_other_files_go_through_the_library():
    other = json.loads(FILE)
    other["normalizer"] = None
    own = WordBPE(json.dumps(other).encode())
    assert not own.fast
    assert own.encode(pa.array(["ab cd."]), 2)[0].tolist() == [*Tokenizer.from_str(json.dumps(other)).encode("ab cd.", add_special_tokens=False).ids, 2]


def test_lanes(spark, monkeypatch):
    monkeypatch.setattr(P, "LANE", 7)
    pieces = spark.createDataFrame([(i, 1 + i % 3, "mine") for i in range(100)], "doc_id long, length int, _lane string").withColumn("_rank", F.lit("mine"))
    got = P.pack(pieces, 8).collect()
    assert len({r["doc_id"] for r in got}) == 100 and {(r["_lane"], r["_rank"]) for r in got} == {("mine", "mine")}
    places = sorted((r["sequence_id"], at) for r in got for at in range(r["offset"], r["offset"] + r["length"]))
    assert len(set(places)) == len(places) == 199 and all(at < 8 for _, at in places)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200)), st.just(64))
def test_patterns_place_everything(histogram, capacity):
    placed = dict.fromkeys(histogram, 0)
    found = P.patterns(histogram, capacity)
    for count, entries in found:
        assert 0 < sum(length * times for length, times in entries) <= capacity
        for length, times in entries:
            placed[length] += count * times
    assert placed == histogram and len(found) <= 2 * len(histogram) + 1


def test_lengths_must_fit():
    with pytest.raises(ValueError):
        P.patterns({65: 1}, 64)
    assert P.padding(4096) == P.padding(1024) == 0 and P.padding(1000) == 3096
