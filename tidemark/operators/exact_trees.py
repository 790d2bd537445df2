"""Decision trees with exact splits and no bound on depth, grown level by level.

A cell is a number or a text. A number splits rows at a threshold, a text by whether the cell is that
text. While a node has too many rows for one task, its best split comes from aggregates over all its rows;
smaller nodes are each finished in one task, all at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.cells import column
from tidemark.operators.ordered import running_sums
from tidemark.session import let_workers_import, scratch_path

#: Cells of a node that one task may finish.
LOCAL_CELLS = 1 << 21
ROOT = "r"

_NODE = (
    "root string, node int, below int, above int, feature int, is_text boolean, threshold double, text string, "
    "size long, gain double, label string, value double"
)
_GROWN = f"{_NODE}, is_test boolean, truth string, truth_value double"
_TOP = "node string, feature int, is_text boolean, threshold double, text string, size long, gain double, label string, value double"


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- one node in memory ----------------------------------------------------------------------


def _running_counts(y: np.ndarray) -> np.ndarray:
    """For every entry, how many earlier ones equal it."""
    order = np.argsort(y, kind="stable")
    ordered = y[order]
    out = np.empty(len(y), np.int64)
    out[order] = np.arange(len(y)) - np.searchsorted(ordered, ordered)
    return out


def _score(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n: int) -> np.ndarray:
    return left / n_left + right / (n - n_left)


def best_split(nums: np.ndarray, texts: np.ndarray, y: np.ndarray, regression: bool) -> tuple | None:
    """(score, feature, is_text, value): the split with the largest sum of squares per side, first among equals.

    ``texts`` are codes, -1 for a number; ``y`` class codes or values. The value is the last number of the lower side, or the text's code.
    """
    n = len(y)
    best = None
    if not regression:
        _, y, totals = np.unique(y, return_inverse=True, return_counts=True)
        totals = totals.astype(float)
        all_squares = (totals**2).sum()
    for f in range(nums.shape[1]):
        x = nums[:, f]
        order = np.argsort(x, kind="stable")
        xs = x[order]
        cuts = np.flatnonzero((xs[:-1] < xs[1:]) | (np.isnan(xs[1:]) & ~np.isnan(xs[:-1])))
        if len(cuts):
            ys = y[order]
            n_left = cuts + 1
            if regression:
                sums = np.cumsum(ys)
                score = _score(sums[cuts] ** 2, (sums[-1] - sums[cuts]) ** 2, n_left, n)
            else:
                left = np.cumsum(2.0 * _running_counts(ys) + 1)[cuts]
                right = all_squares - 2 * np.cumsum(totals[ys])[cuts] + left
                score = _score(left, right, n_left, n)
            at = int(np.argmax(score))
            if best is None or score[at] > best[0]:
                best = (float(score[at]), f, False, float(xs[cuts[at]]))
        code = texts[:, f]
        known = code >= 0
        if known.any():
            found, of, n_left = np.unique(code[known], return_inverse=True, return_counts=True)
            if regression:
                sums = np.bincount(of, y[known])
                left, right = sums**2, (y.sum() - sums) ** 2
            else:
                pairs, counts = np.unique(of * len(totals) + y[known], return_counts=True)
                kind, label = pairs // len(totals), pairs % len(totals)
                left = np.bincount(kind, counts.astype(float) ** 2)
                right = all_squares - 2 * np.bincount(kind, counts * totals[label]) + left
            some = np.flatnonzero(n_left < n)
            if len(some):
                score = _score(left[some], right[some], n_left[some], n)
                at = int(np.argmax(score))
                if best is None or score[at] > best[0]:
                    best = (float(score[at]), f, True, int(found[some[at]]))
    return best


def between(low: float, high: float) -> float:
    """A threshold with ``low`` at or below and ``high`` above it."""
    middle = low / 2 + high / 2
    return middle if low <= middle < high else low


def grow(nums: np.ndarray, texts: np.ndarray, y: np.ndarray, train: np.ndarray, regression: bool) -> tuple[list[list], np.ndarray]:
    """Nodes as [below, above, feature, is_text, threshold or code, size, gain, prediction], and every row's leaf.

    Only ``train`` rows decide; the others fall along. A node is split while its targets differ and
    any cell does.
    """
    nodes: list[list] = []
    leaf = np.zeros(len(y), np.int64)
    waiting = [(np.arange(len(y)), None, 0)]
    while waiting:
        rows, parent, side = waiting.pop()
        me = len(nodes)
        if parent is not None:
            nodes[parent][side] = me
        own = rows[train[rows]]
        mine = y[own]
        if regression:
            prediction, pure, base = float(mine.mean()), mine.min() == mine.max(), mine.sum() ** 2 / len(own)
        else:
            found, counts = np.unique(mine, return_counts=True)
            prediction, pure = int(found[np.argmax(counts)]), len(found) == 1
            base = (counts.astype(float) ** 2).sum() / len(own)
        nodes.append([None, None, None, None, None, len(own), 0.0, prediction])
        split = None if pure else best_split(nums[own], texts[own], mine, regression)
        if split is None:
            leaf[rows] = me
            continue
        score, f, is_text, value = split
        if is_text:
            up = texts[rows, f] == value
        else:
            x = nums[own, f]
            higher = x[(x > value)]
            value = between(value, float(higher.min())) if len(higher) else value
            up = ~(nums[rows, f] <= value)
        nodes[me][2:7] = [f, is_text, value, len(own), score - base]
        waiting += [(rows[up], me, 1), (rows[~up], me, 0)]
    return nodes, leaf


def _matrix(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and texts (objects) of a table's ``nums`` and ``texts``."""
    n = table.num_rows
    if not width or not n:
        return np.zeros((n, width)), np.full((n, width), None, object)
    nums, texts = (pa.concat_arrays([c.flatten() for c in table.column(name).chunks]) for name in ("nums", "texts"))
    return nums.to_numpy(zero_copy_only=False).reshape(n, width), np.array([*texts.to_pylist(), None], object)[:-1].reshape(n, width)


def _finisher(width: int, regression: bool):
    """Grows the subtree of one node's rows; returns its nodes and its rows' predictions."""

    def finish(table: pa.Table) -> pa.Table:
        root = table.column("node")[0].as_py()
        nums, texts = _matrix(table, width)
        codes, names = np.full(texts.shape, -1), []
        for f in range(width):
            kinds = pa.array(texts[:, f], pa.string()).dictionary_encode()
            words = np.array([*kinds.dictionary.to_pylist(), None], object)[:-1]
            order = np.argsort(words)
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            known = np.asarray(kinds.indices.is_valid())
            codes[known, f] = place[np.asarray(kinds.indices.drop_null())]
            names.append(words[order])
        train = ~table.column("is_test").to_numpy(zero_copy_only=False).astype(bool)
        if regression:
            y = table.column("y").to_numpy(zero_copy_only=False)
        else:
            labels, y = np.unique(np.array(table.column("label").to_pylist(), str), return_inverse=True)
        nodes, leaf = grow(nums, codes, y, train, regression)
        said = [n[7] for n in nodes]
        labels_of, means = ([None] * len(nodes), said) if regression else ([str(labels[x]) for x in said], [None] * len(nodes))
        cut = [n[2] is not None for n in nodes]
        by_text = [c and bool(n[3]) for c, n in zip(cut, nodes)]
        own = {
            "root": [root] * len(nodes), "node": range(len(nodes)), "below": [n[0] for n in nodes], "above": [n[1] for n in nodes],
            "feature": [n[2] for n in nodes], "is_text": [n[3] for n in nodes],
            "threshold": [n[4] if c and not t else None for c, t, n in zip(cut, by_text, nodes)],
            "text": [str(names[n[2]][n[4]]) if t else None for t, n in zip(by_text, nodes)],
            "size": [n[5] for n in nodes], "gain": [float(n[6]) for n in nodes], "label": labels_of, "value": means,
        }
        at = pa.array(leaf)
        fallen = {
            "root": pa.array([root] * len(leaf)), "label": pa.array(labels_of, pa.string()).take(at), "value": pa.array(means, pa.float64()).take(at),
            "is_test": pa.array(~train), "truth_value" if regression else "truth": table.column("y" if regression else "label").combine_chunks(),
        }

        def filled(columns: dict, n: int) -> pa.Table:
            arrays = [
                (columns[name] if isinstance(columns[name], pa.Array) else pa.array(columns[name], kind)) if name in columns else pa.nulls(n, kind)
                for name, kind in zip(_GROWN_NAMES, _GROWN_TYPES)
            ]
            return pa.Table.from_arrays([a.cast(kind) for a, kind in zip(arrays, _GROWN_TYPES)], names=_GROWN_NAMES)

        return pa.concat_tables([filled(own, len(nodes)), filled(fallen, len(leaf))])

    return finish


_GROWN_NAMES = [c.split()[0] for c in _GROWN.split(", ")]
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
_GROWN_TYPES = [_KINDS[c.split()[1]] for c in _GROWN.split(", ")]


# --- nodes of any size -------------------------------------------------------------------------


def _candidates(train: DataFrame, totals: DataFrame, regression: bool, numeric: list[int], textual: list[int]) -> DataFrame:
    """node and ``best`` (less, feature, is_text, low, text): the best split of every node from its rows' aggregates.

    ``totals``: node, n, and the targets' sum or sum of squared class counts.
    """
    each = train.select("node", "label", "y", F.posexplode(F.arrays_zip("nums", "texts")).alias("feature", "cell"))
    number = each.where(F.col("feature").isin(numeric)).select("node", "feature", F.col("cell.nums").alias("x"), "label", "y")
    word = each.where(F.col("feature").isin(textual) & F.col("cell.texts").isNotNull()).select("node", "feature", F.col("cell.texts").alias("t"), "label", "y")
    if regression:
        sums = [F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s")]
        words = word.groupBy("node", "feature", "t").agg(*sums)
        values = running_sums(_kept(number.groupBy("node", "feature", "x").agg(*sums), "values"), ["node", "feature"], ["x"], ["n", "s"])
        values = values.withColumns({c: F.col(f"before_{c}") + F.col(c) for c in ("n", "s")})
        left, right = F.col("s") * F.col("s"), (F.col("all") - F.col("s")) * (F.col("all") - F.col("s"))
    else:
        classes = train.groupBy("node", "label").agg(F.count(F.lit(1)).cast("double").alias("c"))
        classes = classes.select(F.col("node").alias("_node"), F.col("label").alias("_label"), "c")
        same = (F.col("node") == F.col("_node")) & (F.col("label") == F.col("_label"))
        count = F.count(F.lit(1)).cast("double").alias("n")

        def squares(df: DataFrame, by: list[str], growth: Column) -> DataFrame:
            """n, s (growth of the sum of squares), m (sum of counts by the class's total) for each value."""
            return df.join(classes, same).groupBy(*by).agg(F.sum("n").alias("n"), F.sum(growth).alias("s"), F.sum(F.col("n") * F.col("c")).alias("m"))

        words = squares(word.groupBy("node", "feature", "t", "label").agg(count), ["node", "feature", "t"], F.col("n") * F.col("n"))
        by_class = _kept(number.groupBy("node", "feature", "x", "label").agg(count), "class-values")
        before = running_sums(by_class, ["node", "feature", "label"], ["x"], ["n"])
        growth = (F.col("before_n") + F.col("n")) * (F.col("before_n") + F.col("n")) - F.col("before_n") * F.col("before_n")
        values = running_sums(_kept(squares(before, ["node", "feature", "x"], growth), "values"), ["node", "feature"], ["x"], ["n", "s", "m"])
        values = values.withColumns({c: F.col(f"before_{c}") + F.col(c) for c in ("n", "s", "m")})
        left, right = F.col("s"), F.col("all") - 2 * F.col("m") + F.col("s")
    both = values.withColumns({"is_text": F.lit(False), "low": F.col("x"), "text": F.lit(None).cast("string")}).unionByName(
        words.withColumns({"is_text": F.lit(True), "low": F.lit(None).cast("double"), "text": F.col("t")}), allowMissingColumns=True
    )
    whole = totals.select(F.col("node").alias("_of"), F.col("n").alias("rows"), F.col("sums").alias("all"))
    score = left / F.col("n") + right / (F.col("rows") - F.col("n"))
    scored = both.join(whole, F.col("node") == F.col("_of")).where(F.col("n") < F.col("rows")).withColumn("less", -score)
    return scored.groupBy("node").agg(F.min(F.struct("less", "feature", "is_text", "low", "text")).alias("best"))


def _upper(nums: Column, texts: Column) -> Column:
    """Whether a row goes to the upper side of the split beside it."""
    place = F.col("feature") + 1
    return F.when(F.col("is_text"), F.coalesce(F.element_at(texts, place) == F.col("text"), F.lit(False))).otherwise(
        F.element_at(nums, place) > F.col("threshold")
    )


@dataclass
class ExactTree:
    """A tree as two tables: ``top`` nodes by path, and the nodes of ``subtrees`` by their root's path."""

    features: list[str]
    regression: bool
    top: DataFrame
    subtrees: DataFrame

    def importances(self) -> DataFrame:
        """name, importance: every slot's share of the whole gain; those without gain are left out."""
        cuts = self.top.select("feature", "text", "gain").unionByName(self.subtrees.select("feature", "text", "gain"))
        names = F.element_at(F.array(*[F.lit(n) for n in self.features]), F.col("feature") + 1)
        found = cuts.where("feature IS NOT NULL").groupBy(F.concat(names, F.coalesce("text", F.lit(""))).alias("name")).agg(F.sum("gain").alias("gain"))
        whole = found.agg(F.sum("gain")).first()[0]
        return found.where("gain > 0").select("name", (F.col("gain") / F.lit(whole)).alias("importance"))

    def save(self, path: str) -> None:
        """Both tables and what else is needed to score, under one path."""
        self.top.write.mode("overwrite").parquet(f"{path}/top")
        self.subtrees.write.mode("overwrite").parquet(f"{path}/subtrees")
        about = json.dumps({"features": self.features, "regression": self.regression})
        self.top.sparkSession.createDataFrame([(about,)], "about string").write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ExactTree:
        about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
        top, subtrees = (spark.read.schema(s).parquet(f"{path}/{n}") for n, s in (("top", _TOP), ("subtrees", _NODE)))
        return cls(about["features"], about["regression"], top, subtrees)

    def predicted(self, cells: DataFrame, local_cells: int = LOCAL_CELLS) -> DataFrame:
        """Coerced rows' other columns as ``record``, with ``label`` or ``value``.

        Rows walk down the top nodes by joins, then meet the nodes of their subtree; the rows of one
        subtree are dealt over as many tasks as their number asks for.
        """
        let_workers_import(cells.sparkSession)
        width = len(self.features)
        rows = as_rows(cells, self.features).withColumn("node", F.lit(ROOT))
        inner = self.top.where("feature IS NOT NULL").select(F.col("node").alias("_node"), "feature", "is_text", "threshold", "text")
        for _ in range(self.top.where("feature IS NOT NULL").agg(F.max(F.length("node"))).first()[0] or 0):
            step = F.when(F.col("_node").isNull(), "").when(_upper(F.col("nums"), F.col("texts")), "1").otherwise("0")
            rows = rows.join(inner, F.col("node") == F.col("_node"), "left").select("record", "nums", "texts", F.concat("node", step).alias("node"))
        rows = _kept(rows, "placed")
        leaves = self.top.where("feature IS NULL").select(F.col("node").alias("_node"), "label", "value")
        done = rows.join(leaves, F.col("node") == F.col("_node")).select("record", "label", "value")
        copies = rows.groupBy(F.col("node").alias("root")).agg(F.ceil(F.count(F.lit(1)) * max(width, 1) / local_cells).cast("int").alias("copies"))
        nodes = self.subtrees.join(copies, "root").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        dealt = rows.join(copies.withColumnRenamed("root", "_root"), F.col("node") == F.col("_root"))
        dealt = dealt.select("node", F.pmod(F.xxhash64(F.to_json("record"), "nums", "texts"), "copies").cast("int").alias("copy"), "record", "nums", "texts")
        schema = rows.select("record").schema.add("label", "string").add("value", "double")

        def walk(left: pa.Table, right: pa.Table) -> pa.Table:
            n = left.num_rows if right.num_rows else 0
            left = left.slice(0, n)
            nums, texts = _matrix(left, width)
            order = np.argsort(right.column("node").to_numpy()) if n else []
            tree = right.take(pa.array(order, pa.int64())) if n else right
            column_of = {c: np.array([*tree.column(c).to_pylist(), None], object)[:-1] for c in ("below", "above", "feature", "is_text", "threshold", "text", "label", "value")}
            at, active = np.zeros(n, np.int64), np.arange(n)
            while len(active):
                active = active[np.array([f is not None for f in column_of["feature"][at[active]]], bool)]
                if not len(active):
                    break
                here = at[active]
                f = column_of["feature"][here].astype(int)
                by_text = column_of["is_text"][here].astype(bool)
                with np.errstate(invalid="ignore"):
                    up = ~(nums[active, f] <= column_of["threshold"][here].astype(float))
                up[by_text] = texts[active, f][by_text] == column_of["text"][here][by_text]
                at[active] = np.where(up, column_of["above"][here], column_of["below"][here]).astype(int)
            found = [pa.array(column_of[c][at].tolist() if n else [], kind) for c, kind in (("label", pa.string()), ("value", pa.float64()))]
            return pa.Table.from_arrays([left.column("record"), *found], names=["record", "label", "value"])

        walked = dealt.groupBy("node", "copy").cogroup(nodes.withColumnRenamed("node", "at").withColumnRenamed("root", "node").groupBy("node", "copy"))
        return done.unionByName(walked.applyInArrow(_renamed(walk), schema))


def _renamed(walk):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return walk(left, right.drop_columns(["node"]).rename_columns(["node" if c == "at" else c for c in right.column_names if c != "node"]))

    return run


def as_rows(cells: DataFrame, features: list[str], *others: str) -> DataFrame:
    """nums, texts of coerced ``features``; all other columns in ``record``, unless named in ``others``."""
    used = {f"{n}#{part}" for n in features for part in ("value", "text")}
    kept = [column(c) for c in cells.columns if c not in used and c not in others]
    nums = F.array(*[column(f"{n}#value") for n in features]).cast("array<double>")
    texts = F.array(*[column(f"{n}#text") for n in features]).cast("array<string>")
    return cells.select((F.struct(*kept) if kept else F.struct(F.lit(0).alias("none"))).alias("record"), nums.alias("nums"), texts.alias("texts"), *others)


def train_exact(cells: DataFrame, features: list[str], task: str, local_cells: int = LOCAL_CELLS) -> tuple[ExactTree, DataFrame]:
    """The tree of the rows that are not ``is_test``, and (is_test, truth or truth_value, label or value) of all rows.

    ``cells``: coerced features, ``_label``, ``is_test``. Classes are compared by their count of squares (Gini),
    numbers by variance; among equal splits the first feature, number before text, and lowest value wins. A node ends as a leaf when its
    targets agree or no cell differs, at whatever depth.
    """
    let_workers_import(cells.sparkSession)
    regression = task == "regression"
    width = len(features)
    target = [F.col("_label").cast("string").alias("label"), F.lit(None).cast("double").alias("y")]
    if regression:
        target = [F.lit(None).cast("string").alias("label"), F.col("_label").alias("y")]
    rows = as_rows(cells, features, "_label", "is_test").select("nums", "texts", "is_test", *target, F.lit(ROOT).alias("node"))
    seen = rows.agg(*[F.count_if(F.element_at("texts", i + 1).isNull()).alias(f"n{i}") for i in range(width)], *[F.count(F.element_at("texts", i + 1)).alias(f"t{i}") for i in range(width)]).first() if width else {}
    numeric, textual = ([i for i in range(width) if seen[f"{c}{i}"]] for c in "nt")
    most = max(1, local_cells // max(1, width))
    small, tops, leaves_of = [], [], []
    active = rows
    while True:
        active = _kept(active, "level")
        if regression:
            pure = F.min(F.when(~F.col("is_test"), F.col("y"))) == F.max(F.when(~F.col("is_test"), F.col("y")))
            sums = F.sum(F.when(~F.col("is_test"), F.col("y")))
            sizes = active.groupBy("node").agg(
                F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("is_test")).cast("double").alias("n"), sums.alias("sums"), pure.alias("pure"),
                F.lit(None).cast("string").alias("label"),
            )
            sizes = sizes.withColumn("value", F.col("sums") / F.col("n"))
        else:
            kinds = active.groupBy("node", "label").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("is_test")).cast("double").alias("n"))
            sizes = kinds.groupBy("node").agg(
                F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("sums"),
                F.max(F.col("n")).alias("top"),
                F.min(F.struct((-F.col("n")).alias("less"), "label"))["label"].alias("label"),
            ).withColumns({"pure": F.col("top") == F.col("n"), "value": F.lit(None).cast("double")}).drop("top")
        sizes = _kept(sizes, "sizes")
        by = sizes.withColumnRenamed("node", "_node")
        little = active.join(by.where((F.col("rows") <= most) & ~F.col("pure")).select("_node"), F.col("node") == F.col("_node"), "left_semi")
        small.append(little)
        if sizes.where((F.col("rows") > most) | F.col("pure")).isEmpty():
            break
        big = sizes.where((F.col("rows") > most) & ~F.col("pure"))
        chosen = None
        if not big.isEmpty():
            inside = active.join(big.select(F.col("node").alias("_node")), F.col("node") == F.col("_node"), "left_semi")
            train = inside.where(~F.col("is_test"))
            found = _kept(_candidates(train, big, regression, numeric, textual).select("node", "best.*"), "splits")
            cut = found.select(F.col("node").alias("_node"), "feature", "is_text", "low", "text")
            x = F.element_at("nums", F.col("feature") + 1)
            above = train.join(cut.where(~F.col("is_text")), F.col("node") == F.col("_node")).where(x > F.col("low"))
            nearest = above.groupBy(F.col("node").alias("_of")).agg(F.min(x).alias("high"))
            middle = F.col("low") / 2 + F.col("high") / 2
            threshold = F.when((F.col("low") <= middle) & (middle < F.col("high")), middle).otherwise(F.col("low"))
            base = F.col("sums") * F.col("sums") / F.col("n") if regression else F.col("sums") / F.col("n")
            chosen = _kept(
                found.join(nearest, F.col("node") == F.col("_of"), "left").join(big.select(F.col("node").alias("_node"), "n", "sums", "label", "value"), F.col("node") == F.col("_node"))
                .select("node", "feature", "is_text", threshold.alias("threshold"), "text", F.col("n").cast("long").alias("size"), (-F.col("less") - base).alias("gain"), "label", "value"),
                "chosen",
            )
            tops.append(chosen)
        ends = sizes.where((F.col("rows") > most) | F.col("pure"))
        if chosen is not None:
            ends = ends.join(chosen.select("node"), "node", "left_anti")
        none = F.lit(None)
        ends = _kept(ends.select("node", none.cast("int").alias("feature"), none.cast("boolean").alias("is_text"), none.cast("double").alias("threshold"), none.cast("string").alias("text"), F.col("n").cast("long").alias("size"), F.lit(0.0).alias("gain"), "label", "value"), "ends")
        tops.append(ends)
        answer = ends.select(F.col("node").alias("_node"), F.col("label").alias("_said"), F.col("value").alias("_mean"))
        leaves_of.append(active.join(answer, F.col("node") == F.col("_node")).select("is_test", F.col("label").alias("truth"), F.col("y").alias("truth_value"), F.col("_said").alias("label"), F.col("_mean").alias("value")))
        if chosen is None:
            break
        cut = chosen.select(F.col("node").alias("_node"), "feature", "is_text", "threshold", "text")
        moved = active.join(cut, F.col("node") == F.col("_node"))
        step = F.when(_upper(F.col("nums"), F.col("texts")), "1").otherwise("0")
        active = moved.select("nums", "texts", "is_test", "label", "y", F.concat("node", step).alias("node"))
    waiting = reduce(DataFrame.unionByName, small)
    grown = _kept(waiting.groupBy("node").applyInArrow(_finisher(width, regression), _GROWN), "grown")
    spark = cells.sparkSession
    top = reduce(DataFrame.unionByName, tops) if tops else spark.createDataFrame([], _TOP)
    subtrees = grown.where("node IS NOT NULL").select([c.split()[0] for c in _NODE.split(", ")])
    scored = [grown.where("node IS NULL").select("is_test", "truth", "truth_value", "label", "value"), *leaves_of]
    return ExactTree(features, regression, top, subtrees), reduce(DataFrame.unionByName, scored)
