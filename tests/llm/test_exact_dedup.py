import hashlib
from collections import defaultdict

import pytest
from tests.llm.fixtures import clashing, documents, empty

from rasterloom.llm import exact_dedup as D


def brute(docs, keep):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        out += [(i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr), len(groups)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_against_brute_force(spark, keep):
    docs = clashing(documents(spark, 150))
    got = D.exact_dedup(docs, keep=keep).collect()
    want, groups = brute(docs, keep)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == groups == len({r["text_sha256"] for r in kept}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_a_run_over_many_partitions(spark):
    rows = [(i, "hot text") for i in range(900)] + [(1000 + i, f"text {i % 40}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = D.exact_dedup(docs, keep="largest").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = [r for r in got if r["doc_id"] < 900]
    assert {(r["keep_id"], r["group_size"]) for r in hot} == {(899, 900)} and [r["doc_id"] for r in hot if r["kept"]] == [899]
    assert brute(docs, "largest")[0] == sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr)


def test_dropping(spark):
    docs = clashing(documents(spark, 100))
    kept = D.drop_copies(docs, keep="largest")
    assert kept.columns == docs.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({r["text"] or "" for r in docs.collect()})
    assert D.drop_copies(empty(docs)).count() == 0 and D.op2_content_sort(empty(docs)).count() == 0


def test_other_columns_stay(spark):
    docs = clashing(documents(spark, 12))
    kept = D.drop_copies(docs)
    assert kept.columns == docs.columns and {r["_key"] for r in kept.collect()} == {"x"}
