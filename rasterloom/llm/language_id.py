"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and everything but letters becomes a space; n-grams of 1 to ``MAX_N`` characters hash into ``BINS``
bins. Training counts bins by language in each partition and adds them up in Spark, so the driver gets at most
languages * BINS sums. The log-probability matrix (BINS x languages) is broadcast; scoring takes the rows of the
matrix at a text's bins and sums them by document, in numpy, over whole texts in blocks of bounded size.

The training sample is bounded: at most about ``per_language`` labelled rows of each language (chosen by a hash of the id,
at a rate known from the language counts). Everything is scored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import release, ship

BINS = 1 << 16
MAX_N = 4
MAX_LANGUAGES = 256
BLOCK = 1 << 18  # characters that numpy handles at a time
UND = "und"

_MIX = np.uint32(0x9E3779B1)
_SPACE = np.uint32(32)


@functools.cache
def _fold_table() -> np.ndarray:
    """For each code point, the lower-case letter it counts as, or a space."""
    table = np.full(0x110000, _SPACE, dtype=np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            table[c] = ord(low) if len(low := x.lower()) == 1 else c
    return table


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(folded code points, document of each) over blocks of at most BLOCK characters; a space parts documents.

    A text longer than a block goes on in the next one, which repeats its last MAX_N - 1 characters as context.
    """
    table, points, owner, held = _fold_table(), [], [], 0
    for d, text in enumerate(texts):
        if not text:
            continue
        whole = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        for at in range(0, len(whole), BLOCK):
            part = whole[max(0, at - MAX_N + 1) : at + BLOCK]
            if held + len(part) > BLOCK and held:
                yield np.concatenate(points), np.concatenate(owner)
                points, owner, held = [], [], 0
            fresh = len(part) if not at else len(part) - MAX_N + 1  # context alone gets no owner
            points += [np.full(1, _SPACE, np.uint32), part]
            owner += [np.full(1, -1, np.int32), np.full(len(part) - fresh, -1, np.int32), np.full(fresh, d, np.int32)]
            held += len(part) + 1
    if held:
        yield np.concatenate(points), np.concatenate(owner)


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bin) of every n-gram that ends on a letter or on the first space after one, block by block.

    An n-gram never reaches over a space into the word before, other than to hold that one space at its start.
    """
    for points, owner in _blocks(texts):
        letter = points != _SPACE
        before = np.concatenate(([False], letter[:-1]))
        ends = (letter | before) & (owner >= 0)
        hashed = np.zeros(len(points), np.uint32)
        alive = ends
        for n in range(1, MAX_N + 1):
            # the n-gram ending at i: mix in the character n - 1 places back
            shifted = np.full(len(points), _SPACE, np.uint32)
            shifted[n - 1 :] = points[: len(points) - n + 1]
            hashed = (hashed ^ (shifted + np.uint32(n))) * _MIX
            hashed ^= hashed >> np.uint32(15)
            if n > 1:
                inner = np.zeros(len(points), bool)  # the characters between are letters
                if n == 2:
                    inner[:] = True
                else:
                    inner[n - 2 :] = letter[: len(points) - n + 2]
                alive = alive & inner
            picked = np.flatnonzero(alive & letter if n == 1 else alive)
            yield owner[picked], (hashed[picked] >> np.uint32(16)) & np.uint32(BINS - 1)


def _count(codes: dict[str, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums = np.zeros((len(codes), BINS), np.int64)
        for b in batches:
            label = np.array([codes[x] for x in b.column("label").to_pylist()], np.int64)
            for owner, bins in features(b.column("text").to_pylist()):
                sums += np.bincount(label[owner] * BINS + bins, minlength=sums.size).reshape(sums.shape)
        label, bins = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(bins, pa.int32()), pa.array(sums[label, bins], pa.int64())], ["label", "bin", "n"])

    return run


class Model:
    """Log probabilities, BINS x languages, and the languages' names."""

    def __init__(self, names: list[str], sums: np.ndarray) -> None:
        self.names = names
        smooth = sums.astype(np.float64) + 0.5
        self.log_p = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], np.ndarray]:
        """Names, scores and counts of n-grams. Classes have equal priors. The score is the softmax of the log
        likelihoods divided by the square root of the n-gram count, since n-grams overlap and are not independent."""
        total, seen = np.zeros((len(texts), len(self.names))), np.zeros(len(texts), np.int64)
        for owner, bins in features(texts):
            if len(owner):
                starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                total[owner[starts]] += np.add.reduceat(self.log_p[bins], starts, axis=0, dtype=np.float64)
                seen += np.bincount(owner, minlength=len(texts))
        names, scores = [], []
        for row, n in zip(total, seen, strict=True):
            if not n or not self.names:
                names.append(UND)
                scores.append(0.0)
                continue
            best = int(row.argmax())
            names.append(self.names[best])
            scores.append(float(1 / np.exp((row - row[best]) / np.sqrt(n)).sum()))
        return names, scores, seen


def fit(labelled: DataFrame, per_language: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows with a language; rows without one, and null texts, teach nothing. No rows: a model that says ``und``.

    More than ``MAX_LANGUAGES`` languages are an error, as the matrix that is broadcast grows with them.
    """
    ship(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().orderBy("label").limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(counts)
    if not names:
        return Model([], np.zeros((0, BINS)))
    # a rate of the hash for each language keeps about per_language rows of it
    rate = F.create_map(*[F.lit(x) for name in names for x in (name, min(1.0, per_language / counts[name]))])
    sample = rows.where(F.pmod("h", F.lit(1 << 20)) < rate[F.col("label")] * (1 << 20)).select("text", "label")
    parts = sample.mapInArrow(_count({x: i for i, x in enumerate(names)}), "label int, bin int, n long")
    sums = np.zeros((len(names), BINS), np.int64)
    for label, b, n in parts.groupBy("label", "bin").agg(F.sum("n").alias("n")).toArrow().to_pandas().itertuples(index=False):
        sums[label, b] = n
    return Model(names, sums)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (columns of those names are replaced); the text alone decides.

    A null text, or one without a letter, is ``und`` with score 0; of languages that are equally likely the first by name is
    told. Very long texts are read whole, in blocks. Rows are neither dropped nor joined, and an empty table stays empty.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)  # BINS * MAX_LANGUAGES float32 at most: 64 MB
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            names, scores, _ = held.value.predict(b.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text is 2 modulo 4 (a null id is not)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_naive_bayes_language(docs: DataFrame) -> DataFrame:
    """The contract's columns: trained on the rows that are not held out, every row predicted from its text."""
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows whose language is told with a score of ``least`` or more, columns unchanged; null texts and texts without a letter go."""
    return identify(docs, fit(docs.where(~held_out()))).where((F.col("lang_pred") != UND) & (F.col("score") >= least)).select(*docs.columns)
