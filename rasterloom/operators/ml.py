"""A binary logistic classifier by full-batch gradient descent."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError


def fit_rows(x: list[list[float]], y: list[int], iterations: int = 200, lr: float = 0.05) -> dict:
    """Weights and bias from zero, without regularisation."""
    a, b = np.asarray(x, float), np.asarray(y, float)
    if a.ndim != 2 or len(a) != len(b) or not len(a):
        raise GraphError("x must be a matrix with a label for each row")
    w, bias = np.zeros(a.shape[1]), 0.0
    for _ in range(iterations):
        miss = 1 / (1 + np.exp(-(a @ w + bias))) - b
        w, bias = w - lr * (a.T @ miss) / len(a), bias - lr * miss.mean()
    return {"weights": w.tolist(), "bias": float(bias)}


def fit_frame(rows: DataFrame, features: str = "x", label: str = "y", iterations: int = 200, lr: float = 0.05) -> dict:
    """The same over a table of any size: each iteration is one aggregate of (width + 1) sums."""
    held = rows.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y")).persist()
    try:
        first = held.select(F.size("x")).first()
        if first is None:
            raise GraphError("there are no rows")
        width = first[0]
        w, bias = [0.0] * width, 0.0
        for _ in range(iterations):
            miss = held.select("x", (probability({"weights": w, "bias": bias}, F.col("x")) - F.col("y")).alias("m"))
            sums = miss.agg(F.count("*"), F.sum("m"), *(F.sum(F.col("x")[i] * F.col("m")) for i in range(width))).first()
            n = sums[0]
            bias -= lr * sums[1] / n
            w = [a - lr * g / n for a, g in zip(w, sums[2:], strict=True)]
    finally:
        held.unpersist()
    return {"weights": w, "bias": bias}


def probability(model: dict, features: Column) -> Column:
    weights = F.array(*(F.lit(float(v)) for v in model["weights"]))
    dot = F.aggregate(F.zip_with(weights, features, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return 1 / (1 + F.exp(-(dot + float(model["bias"]))))


def predict(model: dict, features: Column) -> Column:
    """1 where the probability is 0.5 or more; the model may be wrapped in ``{"model": ...}``."""
    model = model.get("model", model)
    return (probability(model, features) >= 0.5).cast("int")


def predict_rows(model: dict, x: list[list[float]]) -> list[int]:
    model = model.get("model", model)
    return [int(1 / (1 + np.exp(-(np.dot(r, model["weights"]) + model["bias"]))) >= 0.5) for r in x]


def accuracy(predicted: Column, label: Column) -> Column:
    """An aggregate: the share that is equal, 0 without rows."""
    return F.coalesce(F.avg((predicted == label).cast("double")), F.lit(0.0))
