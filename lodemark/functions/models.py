"""Model outputs: votes, confidences and steps from predictions to prices; training with Spark's ML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the three learners, and factors for one, two or three different top labels.
WEIGHTS, AGREEMENT, LABELS = (0.30, 0.40, 0.30), (1.2, 1.0, 0.7), ("UP", "DOWN", "SIDEWAYS")


def top_label(votes: dict[str, Column]) -> Column:
    """The label with the most weight; of equal ones the first of UP, DOWN, SIDEWAYS."""
    best = F.greatest(*votes.values())
    return F.when(votes["UP"] == best, "UP").when(votes["DOWN"] == best, "DOWN").otherwise("SIDEWAYS")


def ensemble(learners: list[dict[str, Column]]) -> dict[str, Column]:
    """Weighted vote of three learners, its label, and a confidence by how many of them differ."""
    votes = {k: sum((w * m[k] for w, m in zip(WEIGHTS[1:], learners[1:], strict=True)), WEIGHTS[0] * learners[0][k]) for k in LABELS}
    tops = F.size(F.array_distinct(F.array(*(top_label(m) for m in learners))))
    mean = sum((F.greatest(*m.values()) for m in learners[1:]), F.greatest(*learners[0].values())) / len(learners)
    factor = F.when(tops == 1, AGREEMENT[0]).when(tops == 2, AGREEMENT[1]).otherwise(AGREEMENT[2])
    return votes | {"label": top_label(votes), "confidence": F.least(F.greatest(mean * factor, F.lit(0.0)), F.lit(1.0))}


def slope_votes(diff: Column) -> dict[str, Column]:
    """0.6, 0.2, 0.2 by the sign of a forecast's last step."""
    return {"UP": F.when(diff > 0, 0.6).otherwise(0.2), "DOWN": F.when(diff < 0, 0.6).otherwise(0.2), "SIDEWAYS": F.when(diff == 0, 0.6).otherwise(0.2)}


def one_hot(cls: Column, n: int = 3) -> Column:
    held = F.least(F.greatest(cls.cast("int"), F.lit(0)), F.lit(n - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == held).cast("int"))


def predicted_price(price: Column, label: Column, confidence: Column) -> Column:
    """A move of confidence x 1 % in the label's direction."""
    return price * (1 + confidence * 0.01 * F.when(label == "UP", 1).when(label == "DOWN", -1).otherwise(0))


def interval_confidence(low: Column, high: Column, price: Column) -> Column:
    return F.least(F.greatest(1 - (high - low) / (2 * F.greatest(F.abs(price), F.lit(1e-9))), F.lit(0.0)), F.lit(1.0))


def train_direction(frame: DataFrame, columns: list[str], label: str = "label", trees: int = 20, depth: int = 4, seed: int = 3):
    """A forest of Spark's ML for the direction of the next bar."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    steps = [VectorAssembler(inputCols=columns, outputCol="features"), RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=steps).fit(frame)


def train_each(frame: DataFrame, key: str, columns: list[str], target: str, least_rows: int = 60, ridge: float = 1e-9) -> DataFrame:
    """A linear model for each ``key``, as a table of artifacts: key, rows, status, weights (intercept first), columns, error (mean square of its fit).

    Spark sums the products of each key's columns, which are as many as the columns' square whatever the rows, so a key with most rows is no task of its own; the
    normal equations of each key are then solved in a grouped map of these sums. Rows with nulls don't count; a key with fewer than ``least_rows`` others has no weights.
    """
    import numpy as np
    import pandas as pd

    names = [*(f"_x{k}" for k in range(len(columns) + 1)), "_y"]
    held = frame.select(F.col(key), F.lit(1.0).alias("_x0"), *(F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(columns, 1)), F.col(target).cast("double").alias("_y"))
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(n).isNotNull()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    products = F.array(*(F.coalesce(F.sum(F.when(whole, F.col(names[i]) * F.col(names[j]))), F.lit(0.0)) for i, j in pairs))
    sums = held.groupBy(key).agg(F.count_if(whole).alias("rows"), products.alias("sums"))

    def solve(groups: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in groups.itertuples(index=False):
            n, gram = int(r.rows), np.zeros((len(names), len(names)))
            for (i, j), v in zip(pairs, r.sums, strict=True):
                gram[i, j] = gram[j, i] = v
            if n < least_rows:
                out.append((getattr(r, key), n, "too few rows", None, columns, None))
                continue
            a, b = gram[:-1, :-1] + ridge * np.eye(len(names) - 1), gram[:-1, -1]
            w = np.linalg.solve(a, b)
            error = max(0.0, float(gram[-1, -1] - 2 * w @ b + w @ gram[:-1, :-1] @ w)) / n
            out.append((getattr(r, key), n, "trained", w.tolist(), columns, error))
        return pd.DataFrame(out, columns=[key, "rows", "status", "weights", "columns", "error"])

    kind = dict(frame.dtypes)[key]
    return sums.groupBy(key).applyInPandas(solve, f"{key} {kind}, rows long, status string, weights array<double>, columns array<string>, error double")


def predict_each(frame: DataFrame, fitted: DataFrame, key: str, columns: list[str], name: str = "predicted") -> DataFrame:
    """``frame`` with what the model of its key says; null where there is none or a column is null. ``fitted`` has a row for each key."""
    terms = [F.get("_weights", F.lit(0)), *(F.get("_weights", F.lit(k)) * F.col(c).cast("double") for k, c in enumerate(columns, 1))]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return frame.join(fitted.select(key, F.col("weights").alias("_weights")), key, "left").select(*(F.col(c) for c in frame.columns), total.alias(name))
