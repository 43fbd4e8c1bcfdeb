"""Small document tables that hold the awkward cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and house river stone walking under light small".split(), "de": "der die und straße fluß größe über schön klein wald".split(), "fr": "le la été forêt rivière où garçon être petit nuage".split()}


def prose(lang: str, n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", "", ".", ","]) for _ in range(n))


def documents(spark, n: int = 60, awkward: bool = True):
    """Prose in three languages with copies, and awkward rows: null and empty texts, no letters, one long text, a null id, repeats."""
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        base = i if i % 7 else i % 14  # some texts repeat
        rows.append((i, prose(("en", "de", "fr")[base % 3], 40 + base % 5 * 30, base), lang if i % 11 else None, "s", 0))
    if awkward:
        rows += [(1000, None, "en", "s", 0), (1001, "", "en", None, 0), (1002, "  \n\t ", None, "s", 0), (1003, "123 ... !!!", "en", "s", 0), (1004, "a", "en", "s", 0), (1005, prose("en", 30000, 5), "en", "s", 0)]
        rows += [(None, "one without a number", "en", "s", 0), (1006, "twice the same row", "en", "s", 0), (1006, "twice the same row", "en", "s", 0), (1007, "İstanbul ΣΑΣ ﬁn 中文字 \U0001f600 e\u0301", None, "s", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(docs):
    """The same rows with columns of the names that operators make."""
    names = ["id", "hash", "prefix", "fp", "ids", "decoded", "lang_pred", "score", "n_words", "places", "matches", "size", "shard", "rank", "key", "count", "sequence_id", "offset", "seen", "text_sha256", "_key", "_kept", "_words", "_lane", "_rank", "_seen", "_gone", "_digest", "_plain"]
    return docs.withColumns({n: F.lit("x") for n in names})


def empty(docs):
    return docs.where("false")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
