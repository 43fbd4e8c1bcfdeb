import re

import numpy as np
import pytest
import xxhash
from tests.llm.fixtures import clashing, documents, empty

from rasterloom.llm import near_dedup as N
from rasterloom.llm import simhash as S
from rasterloom.llm.components import connected_components


def brute_fingerprint(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)) if h else 0


def components(fps, near):
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = list(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if near(fps[i], fps[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_against_brute_force(spark):
    near = [(3000 + k, "one two three four five six seven eight nine ten" + (" eleven" if k else ""), None, None, 0) for k in range(2)]
    docs = documents(spark, 80).where("doc_id is not null").unionByName(spark.createDataFrame(near, "doc_id long, text string, lang string, source string, n_chars long"))
    got = S.op5_simhash(clashing(docs)).collect()
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    want = components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert len(got) == docs.count()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert want[1001] == want[1002] == 1000  # texts without words link to each other


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (None, "other words here")], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["component_id"]) for r in S.op5_simhash(docs).collect()), key=repr) == [(5, 5), (None, 5), (None, None)]
    assert S.op5_simhash(empty(docs)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 7])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.concatenate([base[rng.integers(0, 40, 500)] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) for _ in range(1)])
    buckets = np.sort(rng.integers(0, 5, 500))
    got = {(int(a), int(b)) for x, y in S.matches(fps, buckets, radius) for a, b in zip(x, y, strict=True)}
    want = {(i, j) for i in range(500) for j in range(i + 1, 500) if buckets[i] == buckets[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}
    assert got == want


def test_split_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL", 5)
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 2**62, 6)}
    for _ in range(3):
        fps |= {f ^ (1 << int(b)) for f in list(fps)[:20] for b in rng.integers(0, 62, 2)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in connected_components(S.near_links(df)).collect()}
    want = components({f: f for f in sorted(fps)}, lambda a, b: (a ^ b).bit_count() <= 2)
    assert {f: got.get(f, f) for f in fps} == want


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100), (201, 200), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 200: 200, 201: 200}


def test_near_copies_are_dropped(spark):
    docs = documents(spark, 40, awkward=True)
    long = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] < 40]
    copies = [(2000 + i, t.replace(".", "", 1) if i % 2 else t + " tail") for i, t in long if len(t.split()) > 100]
    more = docs.unionByName(spark.createDataFrame(copies, "doc_id long, text string"), allowMissingColumns=True)
    kept = N.drop_near_copies(clashing(more))
    got = {r["doc_id"] for r in kept.collect()}
    sets = {r["doc_id"]: set(N.shingles(r["text"], 5).tolist()) for r in more.collect() if r["doc_id"] is not None}
    want = components(dict(sorted(sets.items())), lambda a, b: bool(a) and len(a & b) >= 0.8 * len(a | b) > 0)
    assert got - {None} == {i for i, root in want.items() if i == root} and None in got
    assert kept.columns == clashing(more).columns and N.drop_near_copies(empty(docs)).count() == 0
    assert len(copies) > 5 and not got & {c[0] for c in copies}


def swapped(words, places):
    """The words with others at the places: each takes part in five shingles."""
    return " ".join(f"{w}x{p}" if (p := places.get(k)) else w for k, w in enumerate(words))


def left(spark, texts):
    return {r["doc_id"] for r in N.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def brute_left(texts):
    sets = {i: set(N.shingles(t, 5).tolist()) for i, t in enumerate(texts)}
    roots = components(sets, lambda a, b: bool(a) and len(a & b) >= 0.8 * len(a | b))
    return {i for i, root in roots.items() if i == root}


def test_bridges_between_tight_groups_are_found(spark, monkeypatch):
    rng, texts = np.random.default_rng(1), []
    for g in range(12):
        base = [f"w{g}q{k}" for k in range(204)]
        for far in (0, 1):  # 200 shingles; the groups differ in 4 words, and members in one more or none
            places = {20 * (k + 1): "f" for k in range(4)} if far else {}
            texts += [swapped(base, places | {int(rng.integers(110, 200)): f"m{far}{c}"}) for c in range(12)] + [swapped(base, places)]
    want = brute_left(texts)
    assert left(spark, texts) == want and len(want) == 12
    monkeypatch.setattr(N, "CELL", 5)  # blocks in parts lose nothing
    assert left(spark, texts) == want


def test_how_often_a_passage_repeats_does_not_matter(spark):
    texts = []
    for g in range(20):
        words, passage = [f"a{g}b{k}" for k in range(254)], " ".join(f"p{g}r{k}" for k in range(54))
        texts += [" ".join(words) + " " + " ".join([passage] * n) for n in (1, 20)]
    assert brute_left(texts) == left(spark, texts) == set(range(0, 40, 2))


def test_pairs_at_the_threshold_are_found(spark):
    texts = []
    for g in range(150):  # 4 of 5 shingles shared: a text of 8 words, and the same with one more
        short = [f"s{g}t{k}" for k in range(9)]
        texts += [" ".join(short[:8]), " ".join(short)]
    for g in range(150):  # 80 of 100 shingles shared
        words = [f"l{g}m{k}" for k in range(94)]
        texts += [" ".join(words), " ".join(words + [f"l{g}n{k}" for k in range(10)]), " ".join([f"l{g}o{k}" for k in range(12)] + words)]
    want = brute_left(texts)
    assert left(spark, texts) == want and len(want) < len(texts) - 250


def test_texts_of_a_repeated_id_are_documents_of_their_own(spark):
    one, two, other = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    rows = [(1, one), (1, other), (1, other), (2, one + " end"), (3, two), (3, two + " end"), (None, two), (4, other + " end"), (5, one.upper())]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in N.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [r for r in got if r[0] != 3] == [(0, two), (1, one), (1, other), (1, other)]
    assert sum(r[0] == 3 for r in got) == 1  # of near copies with one id, one stays


def test_every_link_comes_through_fingerprint_buckets(spark, monkeypatch):
    words = [f"e{k}" for k in range(200)]
    texts = [" ".join(words), " ".join(words + ["end"]), " ".join(words).upper()]
    own = N.shingles(texts[0], 5)
    hashed = [[int(x) for x in N._spread(own ^ seed)] for seed in N._seeds(5)]
    want = [int(2 * sum(h >> b & 1 for h in word) + (word[0] >> b & 1) > len(own)) for word in hashed for b in range(64)]
    assert N.wide_fingerprint(own, 300).tolist() == want[:300]
    monkeypatch.setattr(N, "BUCKET", 1)  # several bits and tables, though the documents are few
    assert left(spark, texts) == {0}
    monkeypatch.setattr(N, "RADIUS", 0)  # then only equal fingerprints are joined
    assert left(spark, texts) == {0, 1}


def test_a_large_group_makes_few_links_for_a_document(spark, monkeypatch):
    rng, base, asked = np.random.default_rng(5), [f"g{k}" for k in range(124)], []
    texts = [swapped(base, {int(p): f"c{c}" for p in rng.choice(120, int(rng.integers(1, 6)), replace=False)}) for c in range(240)]
    monkeypatch.setattr(N, "connected_components", lambda edges: (asked.append(edges.collect()), connected_components(edges))[1])
    monkeypatch.setattr(N, "BUCKET", 16)  # 4 bits and 33 tables
    assert N.layout(len(texts)) == (4, 33)
    assert left(spark, texts) == brute_left(texts)
    nodes = {x for row in asked[0] for x in row}
    assert len(nodes) == len(texts) and len(nodes) - 1 <= len(asked[0]) <= 2 * len(nodes)


def test_block_links_connect_what_the_buckets_do(spark):
    rng = np.random.default_rng(6)
    sets = [sorted({int(x) for x in rng.integers(0, 300, 4)}) for _ in range(60)]
    near = [(x, own[0], own[-1]) for own in sets for x in own]
    got = {r["node"]: r["root"] for r in connected_components(N.block_links(spark.createDataFrame(near, "node long, least long, centre long"))).collect()}
    want = components({x: x for x in range(300)}, lambda a, b: any(a in own and b in own for own in sets))
    assert got == {x: root for x, root in want.items() if any(x in own and len(own) > 1 for own in sets)}
