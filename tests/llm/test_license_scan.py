import math
import re

from tests.llm.fixtures import clashing, documents, empty

from rasterloom.llm import license_scan as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "Some prose.\nReleased under the MIT License.", "ALL RIGHTS RESERVED all rights reserved", "CC BY cc by", "ccby cc byte", "This work is licensed under the GNU General Public License, version 3.",
    "licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.", "general  public\nlicense", "KİT Kelvin all rightſ reserved all\x00rights reserved", "Rights reserved, all.", "cc by cc by cc by",
]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(i, text):
    text = text or ""
    w = WORD.findall(low(text))
    found = []
    for phrase, label in S.PHRASES.items():
        p = phrase.split()
        found += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    own, best = set(), 0.0
    for label, template in S.TEMPLATES:
        want = WORD.findall(low(template))
        width = math.ceil(len(want) / 0.9 - 1e-9)
        for k in range(len(w)):
            share = len(set(w[k : k + width]) & set(want)) / len(set(want))
            if share >= 0.9 - 1e-12:
                own.add(label)
                best = max(best, share)
    base = {b for _, b in found}
    return (i, len(w), len(found), min((k for k, _ in found), default=None), max((k for k, _ in found), default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if found else best)


def test_against_brute_force(spark):
    docs = documents(spark, 20).where("doc_id is null or doc_id <> 1005").unionByName(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"), allowMissingColumns=True)
    got = sorted((tuple(r) for r in S.op3_license_scan(clashing(docs)).collect()), key=repr)
    assert got == sorted((brute(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert any(r[6] for r in got) and any("mit" in r[6] for r in got)


def test_no_python_in_the_plan(spark):
    plan = S.op3_license_scan(documents(spark, 5))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_own_names_and_matches(spark):
    notice = "x y\n" + S.TEMPLATES[6][1] + "\nz " + S.TEMPLATES[6][1].replace("Creative", "Great")
    docs = spark.createDataFrame([(1, notice, "mine", "mine"), (1, notice, "mine", "mine"), (2, None, None, None)], "doc_id long, text string, _words string, _digest string")
    got = S.scan(docs).orderBy("doc_id").collect()
    n = len(WORD.findall(S.TEMPLATES[6][1]))
    assert [r["_words"] for r in got] == [r["_digest"] for r in got] == ["mine", "mine", None] and got[2]["matches"] == got[2]["places"] == []
    assert got[0] == got[1] and {(m["label"], m["share"] == 1.0) for m in got[0]["matches"]} == {("cc-by-sa", True), ("cc-by-sa", False)}
    assert all(m["start"] in range(0, 2 + n + 2 + n) for m in got[0]["matches"])


def test_empty(spark):
    assert S.op3_license_scan(empty(documents(spark, 5))).count() == 0


def test_templates_are_found_in_their_own_text_plain_and_wrapped(spark):
    texts, want = [], []
    for label, template in S.TEMPLATES:
        w = template.split()
        for width in (len(w), 13, 8, 3):
            lines = "\n".join(" ".join(w[k : k + width]) for k in range(0, len(w), width))
            texts += [lines, f"# Some words before. {lines}\nand words after"]
            want += [label] * 2
    got = S.op3_license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r["doc_id"], texts[r["doc_id"]]) for r in got if want[r["doc_id"]] not in r["labels"].split(",")] == [] and len(got) == len(texts)
