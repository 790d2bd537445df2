"""Tree training: encoding, scores, refusals."""

from collections import Counter

import numpy as np
import pytest

from tidemark.operators import exact_trees, slots, trees
from tidemark.sources.files import scan_csv_raw

TEXT = "id,feature_1,feature_2,label\n" + "".join(f"{i},{i},{i - 1},{'A' if i < 10 else 'B'}\n" for i in (1, 2, 3, 10, 11, 12))


def test_classifier(spark, write, tmp_path):
    raw = scan_csv_raw(spark, write(TEXT))
    path = str(tmp_path / trees.artifact_name(1, 2, "label"))
    got = trees.train_model(raw, "label", "classification", "id", path)
    assert (got.model_type, got.metric_name) == ("DecisionTreeClassifier", "accuracy")
    assert 0 <= got.test_score <= 1 and got.train_score == 1.0 and len(got.importances) >= 1
    assert got.overfit_detected == (got.train_score - got.test_score > 0.15)
    again = trees.score_model(raw, ["feature_1", "feature_2"], path)
    assert {r["predicted"] for r in again.collect()} <= {"A", "B"} and again.count() == 6
    trees.record_run(spark, got, "one", f"{path}-runs")
    trees.record_run(spark, got, "two", f"{path}-runs")
    assert {r["artifact"] for r in spark.read.parquet(f"{path}-runs").collect()} == {"one", "two"}


def test_regressor(spark):
    df = spark.range(300).selectExpr("id", "id % 10 AS a", "concat('g', id % 3) AS g", "CAST(id % 10 * 2 + id % 3 * 100 AS STRING) AS y")
    got = trees.train_model(df, "y", "regression", "id")
    assert got.metric_name == "r2" and got.test_score > 0.95 and not got.overfit_detected
    names = [n for n, _ in got.importances]
    assert set(names) <= {"a", "g=g0", "g=g1", "g=g2"} and [w for _, w in got.importances] == sorted((w for _, w in got.importances), reverse=True)


def test_mixed_cells_give_a_value_and_text_slots(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, ""), (4, " 1_0 ")], "id int, c string")
    cells = trees.coerce_features(df, ["c"])
    table = slots.slot_table(cells, ["c"])
    assert [(r["slot"], r["name"]) for r in table.orderBy("slot").collect()] == [(0, "c"), (1, "c="), (2, "c=x")]
    got = {r["id"]: (r["width"], list(r["slots"]), list(r["values"])) for r in slots.encoded(cells, ["c"], table, "id").collect()}
    assert got == {1: (3, [0], [5.0]), 2: (3, [2], [1.0]), 3: (3, [1], [1.0]), 4: (3, [0], [10.0])}
    new = trees.coerce_features(spark.createDataFrame([(5, "never seen"), (None, "0")], "id int, c string"), ["c"])
    assert {r["id"]: list(r["slots"]) for r in slots.encoded(new, ["c"], table, "id").collect()} == {5: [], None: []}
    assert slots.encoded(cells.limit(0), ["c"], table, "id").count() == 0
    assert slots.slot_table(cells.limit(0), ["c"]).count() == 0


def test_many_distinct_texts_and_a_hot_one(spark):
    n = 400_000
    df = spark.range(n).selectExpr("id", "IF(id % 3 = 0, 'hot', concat('v', id)) AS word", "id % 5 AS d")
    cells = trees.coerce_features(df, ["word", "d"])
    table = slots.slot_table(cells, ["word", "d"])
    names = [r["name"] for r in table.orderBy("slot").select("name").collect()]
    assert names == sorted({"d", "word=hot", *(f"word=v{i}" for i in range(n) if i % 3)})
    place = {name: i for i, name in enumerate(names)}
    got = slots.encoded(cells, ["word", "d"], table, "id")
    for r in got.where("id % 1009 = 0").collect():
        word = place["word=hot" if r["id"] % 3 == 0 else f"word=v{r['id']}"]
        assert list(r["slots"]) == ([place["d"]] if r["id"] % 5 else []) + [word] and r["width"] == len(names)
    assert got.count() == n


# --- exact splits against a plain tree ------------------------------------------------------------


def plain_tree(rows, targets, regression):
    """A recursive tree over rows of (number or text) cells; returns a function from row to prediction."""

    def worth(ys):
        if regression:
            return sum(ys) ** 2 / len(ys)
        return sum(c * c for c in Counter(ys).values()) / len(ys)

    def answer(ys):
        if regression:
            return sum(ys) / len(ys)
        return min(Counter(ys).items(), key=lambda item: (-item[1], item[0]))[0]

    def number(cell):
        return 0.0 if isinstance(cell, str) else cell

    if len(set(targets)) > 1:
        best = None
        for f in range(len(rows[0])):
            cuts = []
            values = sorted({number(r[f]) for r in rows})
            cuts += [(False, low, lambda r, f=f, t=low / 2 + high / 2: number(r[f]) > t) for low, high in zip(values, values[1:])]
            cuts += [(True, word, lambda r, f=f, w=word: r[f] == w) for word in sorted({r[f] for r in rows if isinstance(r[f], str)})]
            for _, _, test in cuts:
                up = [y for r, y in zip(rows, targets) if test(r)]
                down = [y for r, y in zip(rows, targets) if not test(r)]
                if up and down:
                    score = worth(up) + worth(down)
                    if best is None or score > best[0] + 1e-9 * abs(score):
                        best = (score, test)
        if best:
            test = best[1]
            sides = [([r for r in rows if test(r) == side], [y for r, y in zip(rows, targets) if test(r) == side]) for side in (False, True)]
            below, above = (plain_tree(*side, regression) for side in sides)
            return lambda r: above(r) if test(r) else below(r)
    said = answer(targets)
    return lambda r: said


def random_rows(seed, n):
    rng = np.random.default_rng(seed)
    words = ["red", "blue", "green", ""]
    rows = [
        (float(rng.integers(0, 9)), str(rng.choice(words)), float(rng.integers(0, 4)) if rng.random() < 0.7 else str(rng.choice(words)), 1.0) for _ in range(n)
    ]
    classes = [("a" if (r[0] > 4) != (r[1] == "red") else "b") if rng.random() < 0.9 else "c" for r in rows]
    numbers = [float(r[0] * 3 + (10 if r[1] == "blue" else 0) + rng.integers(0, 2)) for r in rows]
    return rows, classes, numbers


@pytest.mark.parametrize("local_cells", [1, 120, 1 << 19])
@pytest.mark.parametrize("task", ["classification", "regression"])
def test_exact_tree_equals_a_plain_one(spark, task, local_cells, tmp_path):
    """All by aggregates, some of each, and all in one task; then stored, read back and asked about new rows."""
    rows, classes, numbers = random_rows(3, 70)
    targets = numbers if task == "regression" else classes
    kind = "double" if task == "regression" else "string"
    schema = f"id int, a string, b string, c string, d string, _label {kind}, is_test boolean"
    data = [(i, *map(str, r), y, i % 4 == 0) for i, (r, y) in enumerate(zip(rows, targets))]
    cells = trees.coerce_features(spark.createDataFrame(data, schema), ["a", "b", "c", "d"])
    model, scored = exact_trees.train_exact(cells, ["a", "b", "c", "d"], task, local_cells)
    own = [i for i in range(len(rows)) if i % 4]
    plain = plain_tree([rows[i] for i in own], [targets[i] for i in own], task == "regression")
    column = "value" if task == "regression" else "label"
    want = Counter((i % 4 == 0, targets[i], plain(rows[i])) for i in range(len(rows)))
    truth = "truth_value" if task == "regression" else "truth"
    got = Counter((r["is_test"], r[truth], r[column]) for r in scored.collect())
    if task == "regression":
        want, got = (Counter((a, b, round(c, 9)) for a, b, c in x.elements()) for x in (want, got))
    assert got == want
    model.save(str(tmp_path / "tree"))
    again = exact_trees.ExactTree.load(spark, str(tmp_path / "tree"))
    fresh = random_rows(4, 40)[0] + [(99.0, "new word", "blue", -1.0)]
    asked = spark.createDataFrame([(i, *map(str, r)) for i, r in enumerate(fresh)], "id int, a string, b string, c string, d string")
    answers = again.predicted(trees.coerce_features(asked, ["a", "b", "c", "d"]), local_cells=max(local_cells, 40))
    found = {r["record"]["id"]: r[column] for r in answers.collect()}
    for i, r in enumerate(fresh):
        assert found[i] == (pytest.approx(plain(r)) if task == "regression" else plain(r))
    weights = {r["name"]: r["importance"] for r in model.importances().collect()}
    assert sum(weights.values()) == pytest.approx(1) and "d" not in weights and "b=red" in weights


def test_depth_and_bins_are_not_bounded(spark):
    """Alternating labels along one number: a tree of one leaf per row, far deeper than 30 if need be."""
    df = spark.range(600).selectExpr("id", "id * id AS x", "IF(id % 2 = 0, 'even', 'odd') AS parity")
    got = trees.train_model(df, "parity", "classification", "id")
    assert got.train_score == 1.0 and [n for n, _ in got.importances] == ["x"]


def test_refusals(spark, write):
    raw = scan_csv_raw(spark, write(TEXT))
    with pytest.raises(ValueError, match="was not found"):
        trees.train_model(raw, "nope", "classification", "id")
    with pytest.raises(ValueError, match="Dataset is empty"):
        trees.train_model(raw.limit(0), "label", "classification", "id")
    with pytest.raises(ValueError, match="at least two labeled rows"):
        trees.train_model(raw.where("id = 1"), "label", "classification", "id")
    with pytest.raises(ValueError, match="not numbers"):
        trees.train_model(raw, "label", "regression", "id")


def test_many_text_values_train(spark):
    df = spark.range(12_000).selectExpr("id", "concat('v', id) AS word", "IF(id % 2 = 0, 'even', 'odd') AS parity", "id % 2 AS bit")
    got = trees.train_model(df, "parity", "classification", "id")
    assert got.test_score == 1.0 and [n for n, _ in got.importances] == ["bit"]
