"""Decision-tree training and scoring on tabular data."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.functions.cells import as_text, column, is_number, to_double
from tidemark.operators.exact_trees import LOCAL_CELLS, ExactTree, train_exact
from tidemark.session import scratch_path

SEED = 42
TEST_SHARE = 0.33
SPLIT_BITS = 16


# --- cells ---------------------------------------------------------------------------------


def drop_unlabelled(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is not blank."""
    return df.where(as_text(target, df.schema[target].dataType) != "")


def feature_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as normalised text, other columns dropped."""
    return df.select([as_text(n, df.schema[n].dataType).alias(n) for n in columns])


def coerce_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Two columns per feature: ``<name>#value``, 0 unless numeric, and ``<name>#text``, null if numeric.

    Text starts with ``=``, so blank text is a value like any other.
    """
    out = [column(n) for n in df.columns if n not in columns]
    for name in columns:
        text = as_text(name, df.schema[name].dataType)
        out += [
            F.coalesce(to_double(text), F.lit(0.0)).alias(f"{name}#value"),
            F.when(~is_number(text), F.concat(F.lit("="), text)).alias(f"{name}#text"),
        ]
    return df.select(out)


# --- split ---------------------------------------------------------------------------------


def held_out_rows(total: int, share: float = TEST_SHARE) -> int:
    """Size of the test part, rounded up."""
    return math.ceil(share * total)


def split_order(key: Column, seed: int = SEED) -> Column:
    """Pseudo-random 64-bit position of a row, the same on every run."""
    return F.xxhash64(key, F.lit(seed))


def split_train_test(df: DataFrame, key: str, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add is_test, as ``split_with_total`` does."""
    return split_with_total(df, key, share, seed)[0]


def split_with_total(df: DataFrame, key: str, share: float = TEST_SHARE, seed: int = SEED) -> tuple[DataFrame, int]:
    """Add is_test and count the rows: exactly ``ceil(share * rows)`` rows with the lowest hashed positions.

    The boundary is found by counting rows per 16-bit prefix and narrowing down, at most four
    times. Each round returns one count per prefix (65,536 at most), so no row is sorted,
    gathered or sent to the driver. ``key`` must be unique.
    """
    position = F.col("_position")
    placed = df.withColumn("_position", split_order(column(key), seed))
    digit = {b: F.shiftrightunsigned(position, b).bitwiseAND(F.lit(0xFFFF)) for b in (48, 32, 16, 0)}
    wanted, chosen, total = None, [], 0
    for bits, value in digit.items():
        scope = placed
        for earlier_bits, found in chosen:
            scope = scope.where(digit[earlier_bits] == found)
        counts = sorted((r["d"], r["n"]) for r in scope.groupBy(value.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
        if wanted is None:
            total = sum(n for _, n in counts)
            wanted = held_out_rows(total, share)
        if not counts or wanted == 0:
            break
        for found, n in counts:
            if wanted < n:
                break
            wanted -= n
        else:
            found = 1 << SPLIT_BITS
        chosen.append((bits, found))
        if wanted == 0 or found == 1 << SPLIT_BITS:
            break
    is_test: Column = F.lit(False)
    for bits, found in reversed(chosen):
        is_test = (digit[bits] < found) | ((digit[bits] == found) & is_test)
    return placed.withColumn("is_test", is_test).drop("_position"), total


# --- training ------------------------------------------------------------------------------


@dataclass
class TrainedTree:
    """A fitted model with its scores; the tree itself stays in tables."""

    model: ExactTree
    model_type: str
    metric_name: str
    train_score: float
    test_score: float
    overfit_detected: bool
    weights: DataFrame

    @cached_property
    def importances(self) -> list[tuple[str, float]]:
        """Features with weight, the heaviest first."""
        return [(r["name"], r["importance"]) for r in self.weights.orderBy(F.desc("importance"), "name").collect()]


def _labelled(df: DataFrame, target: str, task: str) -> DataFrame:
    text = as_text(target, df.schema[target].dataType)
    label = to_double(text) if task == "regression" else text
    return df.withColumn("_label", label)


def scores(predictions: DataFrame, task: str) -> DataFrame:
    """is_test, score: accuracy, or R² from sums of the label and its error."""
    if task != "regression":
        return predictions.groupBy("is_test").agg(
            F.avg((F.col("prediction") == F.col("label_index")).cast("double")).alias("score")
        )
    y, error = F.col("_label"), F.col("_label") - F.col("prediction")
    spread = F.var_pop(y) * F.count(F.lit(1))
    residual = F.sum(error * error)
    return predictions.groupBy("is_test").agg(
        F.when(spread > 0, F.lit(1.0) - residual / spread)
        .otherwise(F.when(residual == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .alias("score")
    )


def overfit(train: Column, test: Column) -> Column:
    """Training beats testing by more than the allowed gap."""
    return (train - test) > fixed.OVERFIT_GAP


def check_labels(rows: DataFrame) -> None:
    """Refuse a regression target that is not numeric."""
    bad = rows.agg(F.count_if(F.col("_label").isNull()).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} target values are not numbers")


def train_model(
    df: DataFrame, target: str, task: str, key: str, artifact_path: str | None = None, local_cells: int = LOCAL_CELLS
) -> TrainedTree:
    """Train a tree on every column but ``target`` and ``key``; any task but regression classifies.

    Splits are exact and depth is not bounded, see ``train_exact``. Raises ValueError for an empty dataset, a missing
    target or fewer than two labelled rows.
    """
    if target not in df.columns:
        raise ValueError("Dataset is empty" if df.isEmpty() else f"Target column '{target}' was not found")
    features = sorted(n for n in df.columns if n not in (target, key))
    labelled = _labelled(drop_unlabelled(df, target), target, task).select(key, "_label", *features)
    # Read many times: a table in the shared folder outlives executors.
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "training")
    coerce_features(labelled, features).write.parquet(path)
    rows, total = split_with_total(spark.read.parquet(path), key)
    if total == 0 and df.isEmpty():
        raise ValueError("Dataset is empty")
    if total < 2:
        raise ValueError("Need at least two labeled rows to train a model")
    if task == "regression":
        check_labels(rows)
    model, predictions = train_exact(rows, features, task, local_cells)
    if task == "regression":
        compared = predictions.select("is_test", F.col("truth_value").alias("_label"), F.col("value").alias("prediction"))
    else:
        compared = predictions.select("is_test", F.col("truth").alias("label_index"), F.col("label").alias("prediction"))
    by_part = {r["is_test"]: r["score"] for r in scores(compared, task).collect()}
    train, test = float(by_part.get(False, math.nan)), float(by_part.get(True, math.nan))
    if artifact_path:
        model.save(artifact_path)
    return TrainedTree(
        model=model,
        model_type="DecisionTreeRegressor" if task == "regression" else "DecisionTreeClassifier",
        metric_name="r2" if task == "regression" else "accuracy",
        train_score=train,
        test_score=test,
        overfit_detected=train - test > fixed.OVERFIT_GAP,
        weights=model.importances(),
    )


def artifact_name(workspace_id: int, dataset_id: int, target: str) -> str:
    return f"ws{workspace_id}_dataset{dataset_id}_{target}"


def record_run(spark: SparkSession, trained: TrainedTree, artifact: str, path: str) -> None:
    """Append a training run's row to the registry table at ``path``."""
    row = (trained.model_type, trained.metric_name, trained.train_score, trained.test_score, trained.overfit_detected, artifact)
    schema = (
        "model_type string, metric_name string, train_score double, test_score double, overfit_detected boolean, artifact string"
    )
    runs = spark.createDataFrame([row], schema).withColumns({"metric_value": F.col("test_score"), "created_at": F.current_timestamp()})
    runs.coalesce(1).write.mode("append").parquet(path)


def score_model(df: DataFrame, features: list[str], path: str) -> DataFrame:
    """Predictions of a stored model for new rows; text values never seen fit no split.

    Columns that are no features stay; a classifier's label is ``predicted``, a regressor's value ``prediction``.
    """
    model = ExactTree.load(df.sparkSession, path)
    missing = sorted(set(model.features) - set(features))
    if missing:
        raise ValueError(f"Features are missing: {', '.join(missing)}")
    scored = model.predicted(coerce_features(df, model.features))
    return scored.select("record.*", F.col("label").alias("predicted"), F.col("value").alias("prediction"))
