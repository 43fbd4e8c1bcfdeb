import math
from collections import Counter

import pytest
from tests.llm.fixtures import clashing, documents, empty

from rasterloom.llm import lm_score as L


def brute(rows, order, backoff):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    docs = [(i, low(t).split()) for i, t in rows]
    grams = lambda w, n: Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total = [None] + [sum((grams(w, n) for _, w in docs), Counter()) for n in range(1, order + 1)]
    corpus = sum(len(w) for _, w in docs)
    out = []
    for i, w in docs:
        own = [None] + [grams(w, n) for n in range(1, order + 1)]
        rest = corpus - len(w)
        there = lambda g: total[len(g)][g] - own[len(g)][g]  # noqa: B023, E731
        seen, logs = 0, []
        for k in range(len(w)):
            top = min(order, k + 1)
            for n in range(top, 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if there(g):
                    seen += n == top
                    logs.append(math.log(there(g) / (there(g[:-1]) if n > 1 else rest)) + (top - n) * math.log(backoff))
                    break
            else:
                logs.append(top * math.log(backoff) - math.log(rest + 1))
        out.append((i, len(w), seen, None if not logs else round(sum(logs) / len(logs), 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("order", "chunk"), [(1, 500), (2, 6 << 20), (3, 700)])
def test_against_brute_force(spark, order, chunk, tmp_path):
    clashing(documents(spark, 50)).repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    got = L.backoff_scores(docs, order, 0.4, 5, chunk_bytes=chunk).collect()
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], order, 0.4)
    got = sorted(((r["doc_id"], r["n_words"], r["n_seen"], None if r["score"] is None else round(r["score"], 6)) for r in got), key=repr)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)


def test_empty_and_single(spark):
    docs = documents(spark, 3, awkward=False)
    assert L.op9_stupid_backoff(empty(docs)).count() == 0
    one = L.op9_stupid_backoff(docs.where("doc_id = 1")).first()
    assert one["n_seen"] == 0 and one["score"] < 0
    with pytest.raises(ValueError):
        L.backoff_scores(docs, 0)
