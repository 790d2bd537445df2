"""Feature, split and tree queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.cells import normalise
from tidemark.operators import slots, trees
from tidemark.operators.sql import run_sql
from tidemark.plans.catalog import query
from tidemark.plans.stand_ins import dirty_parts, dirty_sql, table
from tidemark.session import scratch_path


@query("drop_unlabelled", f"WITH {dirty_sql('p_partkey')} SELECT p_partkey, brand FROM cells WHERE brand <> ''")
def drop_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = trees.drop_unlabelled(dirty_parts(spark, sf_dir, "p_partkey"), "brand")
    return kept.select("p_partkey", normalise(F.col("brand")).alias("brand"))


@query(
    "feature_coerce",
    f"WITH {dirty_sql('p_partkey')} SELECT p_partkey, coalesce(TRY_CAST(nullif(price_text, '') AS DOUBLE), 0) AS price_value, "
    "CASE WHEN price_text = '' THEN '' ELSE '(number)' END AS price_cell, "
    "CASE WHEN mixed_text <> '' AND NOT contains(mixed_text, 'd') THEN CAST(mixed_text AS DOUBLE) ELSE 0 END AS mixed_value, "
    "CASE WHEN mixed_text = '' OR contains(mixed_text, 'd') THEN mixed_text ELSE '(number)' END AS mixed_cell FROM cells",
)
def feature_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = dirty_parts(spark, sf_dir, "p_partkey").select("p_partkey", "price_text", "mixed_text")
    cells = trees.coerce_features(parts, ["price_text", "mixed_text"])
    return cells.select(
        "p_partkey",
        F.col("`price_text#value`").alias("price_value"),
        F.coalesce(F.expr("substring(`price_text#text`, 2)"), F.lit("(number)")).alias("price_cell"),
        F.col("`mixed_text#value`").alias("mixed_value"),
        F.coalesce(F.expr("substring(`mixed_text#text`, 2)"), F.lit("(number)")).alias("mixed_cell"),
    )


@query(
    "split_train_test",
    "SELECT is_test, CASE WHEN is_test THEN CAST(ceil(0.33 * n) AS BIGINT) ELSE n - CAST(ceil(0.33 * n) AS BIGINT) END AS n_rows "
    "FROM (SELECT COUNT(*) AS n FROM orders) c, (SELECT unnest([TRUE, FALSE]) AS is_test) t",
)
def split_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = trees.split_train_test(table(spark, sf_dir, "orders"), "o_orderkey")
    return split.groupBy("is_test").agg(F.count(F.lit(1)).alias("n_rows"))


# --- trees over whole tables, with a target that one feature decides -----------------------------
# What a tree must then give is known: the rule's own score in both parts, weight for no other feature.

_URGENT = "CASE WHEN {p} IN ('1-URGENT', '2-HIGH') THEN 'urgent' ELSE 'normal' END"
_WORTH = "CASE o_orderstatus WHEN 'F' THEN 10 WHEN 'O' THEN 25 ELSE 70 END"


def _urgent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("urgency", F.expr(_URGENT.format(p="o_orderpriority")))


def _rule_score(model_type: str, metric: str, right: str, extra: str = "") -> str:
    """The score of the rule itself, by part; the split does not matter to it."""
    return (
        f"SELECT '{model_type}' AS model_type, '{metric}' AS metric_name, s AS train_score, s AS test_score, s - s > 0.15 AS overfit_detected{extra} "
        f"FROM (SELECT {right} AS s FROM orders)"
    )


_ACCURACY = f"AVG(CASE WHEN ({_URGENT.format(p='o_orderpriority')} = 'urgent') = (o_orderpriority < '3') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


_PART_SLOTS = (
    "cells AS (SELECT p_partkey, unnest([struct_pack(name := 'p_name=' || p_name, v := 1.0::DOUBLE), struct_pack(name := 'p_brand=' || p_brand, v := 1.0), "
    "struct_pack(name := 'p_type=' || p_type, v := 1.0), struct_pack(name := 'p_size', v := p_size::DOUBLE), struct_pack(name := 'p_retailprice', v := p_retailprice)]) AS c FROM part), "
    "slots AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS slot FROM (SELECT DISTINCT c.name AS name FROM cells))"
)


@query(
    "encode_features",
    f"WITH {_PART_SLOTS} SELECT p_partkey, (SELECT COUNT(*) FROM slots)::BIGINT AS width, COUNT(*)::INTEGER AS filled, string_agg(slot::VARCHAR, ',' ORDER BY slot) AS slots, "
    "SUM(slot * c.v)::DOUBLE AS weighted FROM cells JOIN slots ON slots.name = c.name WHERE c.v <> 0 GROUP BY p_partkey",
)
def encode_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a sparse vector: width, filled slots in order, and a sum over slots and values."""
    parts = table(spark, sf_dir, "part")
    features = [c for c in parts.columns if c != "p_partkey"]
    cells = trees.coerce_features(parts, features)
    vectors = slots.encoded(cells, features, slots.slot_table(cells, features), "p_partkey")
    weighted = F.aggregate(F.arrays_zip("slots", "values"), F.lit(0.0), lambda total, c: total + c["slots"] * c["values"])
    return vectors.select("p_partkey", "width", F.size("slots").alias("filled"), F.array_join("slots", ",").alias("slots"), weighted.alias("weighted"))


def _scores(spark: SparkSession, trained: trees.TrainedTree) -> DataFrame:
    return spark.createDataFrame(
        [(trained.model_type, trained.metric_name, trained.train_score, trained.test_score, trained.overfit_detected)],
        "model_type string, metric_name string, train_score double, test_score double, overfit_detected boolean",
    )


@query("train_tree_classifier", _rule_score("DecisionTreeClassifier", "accuracy", _ACCURACY))
def train_tree_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, trees.train_model(_urgent_orders(spark, sf_dir), "urgency", "classification", "o_orderkey"))


@query(
    "train_tree_regressor",
    _rule_score(
        "DecisionTreeRegressor", "r2",
        f"1 - SUM(power({_WORTH} - (10 * (o_orderstatus = 'F')::INT + 25 * (o_orderstatus = 'O')::INT + 70 * (o_orderstatus NOT IN ('F', 'O'))::INT), 2)) "
        f"/ (VAR_POP({_WORTH}) * COUNT(*))",
    ),
)
def train_tree_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("worth", F.expr(_WORTH))
    return _scores(spark, trees.train_model(orders, "worth", "regression", "o_orderkey"))


def _order_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines folded to one row per order, with a shape that takes several splits to tell."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("top_price"),
        F.min("l_returnflag").alias("flag"), F.max("l_shipdate").cast("date").cast("string").alias("shipped"),
    )
    shape = F.when((F.col("lines") > 4) & (F.col("flag") != "R"), "many").when(F.col("top_price") > 60000, "costly").otherwise("plain")
    return lines.withColumn("shape", shape)


@query(
    "train_tree_shapes",
    "SELECT 'DecisionTreeClassifier' AS model_type, 1.0::DOUBLE AS train_score, TRUE AS tells_new_orders",
)
def train_tree_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of several levels over all order lines: right on every training order and nearly all others."""
    trained = trees.train_model(_order_shapes(spark, sf_dir), "shape", "classification", "l_orderkey")
    row = (trained.model_type, trained.train_score, trained.test_score > 0.97)
    return spark.createDataFrame([row], "model_type string, train_score double, tells_new_orders boolean")


@query("train_tree_prices", "SELECT 'DecisionTreeRegressor' AS model_type, 1.0::DOUBLE AS train_score, TRUE AS tells_new_parts")
def train_tree_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retail prices of parts from the last digits of their key: a tree as deep as there are prices."""
    parts = table(spark, sf_dir, "part").withColumn("cell", F.col("p_partkey") % 1000)
    trained = trees.train_model(parts, "p_retailprice", "regression", "p_partkey")
    row = (trained.model_type, round(trained.train_score, 9), trained.test_score > 0.97)
    return spark.createDataFrame([row], "model_type string, train_score double, tells_new_parts boolean")


@query("train_model", _rule_score("DecisionTreeClassifier", "accuracy", _ACCURACY, ", 'ws1_dataset3_urgency' AS artifact, s AS metric_value"))
def train_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, score and store a model; the run's row as it is read back from the registry."""
    name = trees.artifact_name(1, 3, "urgency")
    root = scratch_path(spark, "models")
    trained = trees.train_model(_urgent_orders(spark, sf_dir), "urgency", "classification", "o_orderkey", f"{root}/{name}")
    trees.record_run(spark, trained, name, f"{root}/runs")
    return spark.read.parquet(f"{root}/runs").drop("created_at")


def _scored_orders(spark: SparkSession, sf_dir: str, dataset_id: int) -> DataFrame:
    """Every order with the label that a stored and reloaded model gives it."""
    orders = _urgent_orders(spark, sf_dir)
    path = f"{scratch_path(spark, 'models')}/{trees.artifact_name(1, dataset_id, 'urgency')}"
    trees.train_model(orders, "urgency", "classification", "o_orderkey", path)
    features = [c for c in orders.columns if c not in ("o_orderkey", "urgency")]
    return trees.score_model(orders.drop("urgency"), features, path).select("o_orderkey", "predicted")


@query("save_model", f"SELECT {_URGENT.format(p='o_orderpriority')} AS predicted, COUNT(*) AS orders FROM orders GROUP BY ALL")
def save_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model answers after it was stored and read back: encoders, tree and labels are one artifact."""
    return _scored_orders(spark, sf_dir, 4).groupBy("predicted").agg(F.count(F.lit(1)).alias("orders"))


@query("score_model", f"SELECT o_orderkey, {_URGENT.format(p='o_orderpriority')} AS predicted FROM orders")
def score_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of every order by a stored model."""
    return _scored_orders(spark, sf_dir, 2)


_DECIDING = "SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"


@query("positive_importance_filter", f"SELECT concat('o_orderpriority=', o_orderpriority) AS feature FROM ({_DECIDING})")
def positive_importance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of an order that say something about its urgency; features without weight are left out."""
    trained = trees.train_model(_urgent_orders(spark, sf_dir), "urgency", "classification", "o_orderkey")
    return spark.createDataFrame(trained.importances, "feature string, importance double").where("importance > 0").select("feature")


@query(
    "rank_importances",
    f"SELECT CAST(row_number() OVER (ORDER BY o_orderpriority) AS INTEGER) AS place, TRUE AS falls, 1.0::DOUBLE AS total FROM ({_DECIDING})",
)
def rank_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that matter, most important first; their weights fall and add up to 1."""
    trained = trees.train_model(_urgent_orders(spark, sf_dir), "urgency", "classification", "o_orderkey")
    weights = [w for _, w in trained.importances]
    rows = [(i + 1, i == 0 or w <= weights[i - 1], round(sum(weights), 9)) for i, w in enumerate(weights)]
    return spark.createDataFrame(rows, "place int, falls boolean, total double")


# A stated guess for every order line: price from quantity, flag from tax.
_GUESSES = (
    "SELECT l_linenumber > 4 AS is_test, l_extendedprice AS y, l_quantity * 2000 AS p, l_returnflag = 'A' AS truth, l_tax < 0.03 AS guess FROM {source}"
)
_SCORED = (
    "scored AS (SELECT is_test, 'accuracy' AS metric, AVG(CASE WHEN truth = guess THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM g GROUP BY is_test "
    "UNION ALL SELECT is_test, 'r2', 1 - SUM((y - p) * (y - p)) / SUM((y - m) * (y - m)) FROM (SELECT *, AVG(y) OVER (PARTITION BY is_test) AS m FROM g) t GROUP BY is_test)"
)


@query(
    "ml_scores",
    f"WITH g AS ({_GUESSES.format(source='lineitem')}), {_SCORED} SELECT a.metric, ROUND(a.score, 6) AS train_score, ROUND(b.score, 6) AS test_score, "
    "a.score - b.score > 0.15 AS overfit_detected FROM scored a JOIN scored b ON a.metric = b.metric AND NOT a.is_test AND b.is_test",
)
def ml_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    guesses = run_sql(_GUESSES.format(source="dataset"), table(spark, sf_dir, "lineitem"))
    classes = guesses.select("is_test", F.col("truth").cast("double").alias("label_index"), F.col("guess").cast("double").alias("prediction"))
    numbers = guesses.select("is_test", F.col("y").alias("_label"), F.col("p").alias("prediction"))
    both = trees.scores(classes, "classification").withColumn("metric", F.lit("accuracy")).unionByName(
        trees.scores(numbers, "regression").withColumn("metric", F.lit("r2"))
    )
    train, test = (F.max(F.when(F.col("is_test") == part, F.col("score"))) for part in (False, True))
    return (
        both.groupBy("metric")
        .agg(train.alias("train"), test.alias("test"))
        .select(
            "metric",
            F.round("train", 6).alias("train_score"),
            F.round("test", 6).alias("test_score"),
            trees.overfit(F.col("train"), F.col("test")).alias("overfit_detected"),
        )
    )
