"""Golden profiles of small CSV files."""

import csv
import io
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import profile, stats
from tidemark.session import scratch_path
from tidemark.sources.csv_records import ends_inside, marked_lines, records_of, running_state
from tidemark.sources.files import cells_of, duplicate_headers, scan_csv_raw, scan_csv_typed

GOLDEN = {
    "sales": (
        "id,amount\n1,10\n2,20\n", (2, 0, 100),
        [("id", 0, 2, "integer"), ("amount", 0, 2, "integer")], [],
        "a6d7cb1ac666dbb346c4aba60203641e84515dc50f0e04b08a7b534eae2f20b9",
    ),
    "sales-by-region": (
        "region,revenue\nNorth,100\nSouth,150\nWest,130\n", (3, 0, 100),
        [("region", 0, 3, "string"), ("revenue", 0, 3, "integer")], [],
        "9161ec5d7cd6a8f4761ba8da19788580c3e3e9ad2a8c08282faea3b80c6a1785",
    ),
    "training-data": (
        "feature_1,feature_2,label\n1,0,A\n2,1,A\n3,2,A\n10,9,B\n11,10,B\n12,11,B\n", (6, 0, 100),
        [("feature_1", 0, 6, "integer"), ("feature_2", 0, 6, "integer"), ("label", 0, 6, "string")], [],
        "2046cc8a3e5c0ffc82200e24a73cdceb3ad423668a2c59867716ee35da904b3b",
    ),
    "feature-target": (
        "feature,target\n1,yes\n2,no\n3,yes\n4,no\n", (4, 0, 100),
        [("feature", 0, 4, "integer"), ("target", 0, 4, "string")], [],
        "82587d58952444d7a95fe12b4112ae8828e61fd275ec8c1901318c2d93c5cc95",
    ),
    "smoke": (
        "region,sales\nNorth,10\nSouth,20\n", (2, 0, 100),
        [("region", 0, 2, "string"), ("sales", 0, 2, "integer")], [],
        "e26837d51e560b37f3910aa85e3d3d7432a27e1316aa11e2b4344d5b9c9b6c54",
    ),
    "dirty": (
        "id,b\n1,2\n , \n   \n,\n2,4\n", (5, 3, 45),
        [("id", 3, 2, "integer"), ("b", 3, 2, "integer")],
        ["6 missing values detected", "2 duplicate rows detected", "3 fully blank rows detected"],
        "f7262105f0f8e3ff92d45b68330b319375af21bf02050f111169e2e6499e4884",
    ),
    "types": (
        "i,f,s,m\n1,1.5,x,1\n 2 ,1e3,y,a\n1_0,nan,,2\n,inf,1d,\n", (4, 0, 91),
        [("i", 1, 3, "integer"), ("f", 0, 4, "number"), ("s", 1, 3, "string"), ("m", 1, 3, "string")],
        ["3 missing values detected"],
        "9f3118cfab7e660d56faa5adc85bc8d6f0ba9401f82448c9b3010a80b9dbfbc5",
    ),
}


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_golden(spark, write, name):
    text, (rows, rejected, score), columns, issues, fingerprint = GOLDEN[name]
    raw = scan_csv_raw(spark, write(text, bom=name == "types"))
    row = profile.profile_fingerprint(profile.profile_table(raw)).first()
    assert (row["row_count"], row["rejected_rows"], row["quality_score"]) == (rows, rejected, score)
    assert [tuple(c) for c in row["columns"]] == columns
    assert row["issues"] == issues
    assert row["profile_fingerprint"] == fingerprint


def test_header_only(spark, write):
    raw = scan_csv_raw(spark, write("a,b\n"))
    row = profile.profile_table(raw).first()
    assert (row["row_count"], row["rejected_rows"], row["quality_score"]) == (0, 0, 100)
    assert row["columns"] == [] and row["issues"] == ["Empty dataset"]
    assert stats.column_statistics(raw).count() == 0
    assert stats.column_kinds(raw).count() == 0


def test_quoted_cells(spark, write):
    raw = scan_csv_raw(spark, write('a,b\n"x ""q"" y","l1\nl2"\n1,2,3\n4\n'))
    assert Counter(map(tuple, raw.collect())) == Counter([('x "q" y', "l1\nl2"), ("1", "2"), ("4", None)])


def test_typed_scan(spark, write):
    typed = scan_csv_typed(spark, write("n,x,d,t\n1,1.5,2024-01-02,a\n2,2.5,2024-01-03,b\n"))
    assert [f.dataType.simpleString() for f in typed.schema.fields] == ["int", "double", "date", "string"]


@pytest.mark.parametrize("text", ["a,b\n1,2\n\n3,4\n", "a,b\n1,2\n  \n3,4\n", 'a,b\n1,"x\ny"\n3,4\n', 'a,b\n1,5" pipe\n'])
def test_scan_by_lines_reads_the_same_rows(spark, write, text):
    path = write(text)
    whole = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    assert Counter(scan_csv_raw(spark, path).collect()) == Counter(whole.collect())


def cut_scan(spark, path, size):
    """The scan with files cut every ``size`` bytes; what is kept in between is read as usual."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    kept = scratch_path(spark, "lines")
    for n in names:
        spark.conf.set(n, size)
    try:
        lines = marked_lines(spark, path)
        lines.coalesce(4).write.parquet(kept)
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)
    records = records_of(spark.read.schema(lines.schema).parquet(kept))
    return cells_of(records, whole_files(spark, path).schema)


def whole_files(spark, path):
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


@pytest.mark.parametrize("size", ["1k", "61"])
def test_cut_files_hold_the_records_of_whole_ones(spark, tmp_path, size):
    """Random cells with quotes, line ends and junk after quotes, cut anywhere, also inside cells longer than a range."""
    rng = np.random.default_rng(len(size) + int(size.rstrip("k")))
    path = tmp_path / "cut"
    path.mkdir()
    for f in range(3):
        cells = ["", "a", "b c", " ", '""', '"x,y"', '"l1\nl2"', '"\n\n"', '"q""q"', '"""\n"""', 'in"ner', '"junk"after', '"é\n日"', '"' + "long\n" * 30 + '"']
        lines = ["a,b,c"] + [",".join(rng.choice(cells, rng.integers(1, 5))) for _ in range(150)]
        end = rng.choice(["", "\n", "\n\n"])
        (path / f"{f}.csv").write_text("\n".join(lines) + end, encoding="utf-8", newline="")
    want = Counter(whole_files(spark, str(path)).collect())
    assert Counter(cut_scan(spark, str(path), size).collect()) == want


@pytest.mark.parametrize("text", ['a,b\n1,"never closed\n2,3\n\n4,"5\n', '"a\nz",b\n1,2\n', "\n\na,b\n1,2\n", '\ufeff"a",b\n"1\n",2\n', "", "a,b", "\n"])
@pytest.mark.parametrize("size", ["4", "1m"])
def test_odd_files(spark, write, text, size):
    path = write(text)
    want = whole_files(spark, path)
    got = cut_scan(spark, path, size)
    assert (got.columns, Counter(got.collect())) == (want.columns, Counter(want.collect()))


def test_line_ends_in_cells_stay_as_they_are(spark, write):
    text = 'a,b\r\n1,"x\r\ny\nz"\r\n\r\n3,4\r\n'
    want = Counter((r["a"], r["b"]) for r in csv.DictReader(io.StringIO(text, newline="")))
    assert Counter(map(tuple, cut_scan(spark, write(text), "4").collect())) == want


def test_states_of_lines():
    rng = np.random.default_rng(1)
    block = np.sort(rng.integers(0, 20, 300))
    to = np.array([(0, 1), (1, 0), (0, 0), (1, 1)], np.int8)[rng.choice(4, 300, p=[0.6, 0.3, 0.05, 0.05])]
    for first in (0, 1):
        want, state = [], first
        for i in range(300):
            state = first if i == 0 or block[i] != block[i - 1] else state
            want.append(state)
            state = to[i][state]
        assert running_state(block, to, first).tolist() == want
    assert ends_inside('a,"b', False) and not ends_inside('a"b,c', False) and ends_inside('x"y,"z', True)
    assert not ends_inside('x"', True) and ends_inside('x""', True) and not ends_inside('"a"b"c,d', False)


def test_folders_of_parts(spark, tmp_path):
    for day in (1, 2):
        part = tmp_path / "t" / f"day={day}"
        part.mkdir(parents=True)
        (part / "x.csv").write_text(f'a,b\n{day},"u\nv"\n5,6\n')
    got = scan_csv_raw(spark, str(tmp_path / "t"))
    assert got.columns == ["a", "b", "day"]
    assert Counter(map(tuple, got.collect())) == Counter([("1", "u\nv", 1), ("5", "6", 1), ("2", "u\nv", 2), ("5", "6", 2)])


def test_one_large_file_with_a_cell_over_lines_is_read_by_many_tasks(spark, write):
    path = write("a,b\n" + "1,2\n" * 250_000 + '3,"x\ny"\n' + "1,2\n" * 250_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        assert marked_lines(spark, path).rdd.getNumPartitions() > 4
        raw = scan_csv_raw(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert raw.count() == 500_001
    assert raw.where("a = 3").collect()[0]["b"] == "x\ny"


def test_types_of_texts(spark, write):
    text = "i,l,w,d,n,t,b,s,e\n1,3000000000,12345678901234567890123,1.5,NaN,2024-01-02T03:04:05,TRUE,1d,\n-2,,0,1e3,-Inf,2024-01-02,false,2024-13-01,\n"
    kinds = [f.dataType.simpleString() for f in scan_csv_typed(spark, write(text)).schema.fields]
    assert kinds == ["int", "bigint", "decimal(38,0)", "double", "double", "timestamp", "boolean", "string", "string"]


def test_duplicate_headers(spark, write):
    assert duplicate_headers(spark, write('A,a,"b"\n1,2,3\n')) == ["a"]
    assert duplicate_headers(spark, write("")) == []


@pytest.mark.parametrize("width", [1, 17])
def test_zero_has_no_sign_in_any_column(spark, width):
    df = spark.createDataFrame([(0.0,), (-0.0,)], "z double").select(*[F.lit(1).alias(f"c{i}") for i in range(width - 1)], "z")
    assert profile.profile_table(df).first()["duplicate_rows"] == 1


def test_statistics_keep_decimals_longs_and_signed_nan(spark):
    rows = [("9007199254740992", 9007199254740992, "+nan"), ("9007199254740993", 9007199254740993, "1")]
    df = spark.createDataFrame(rows, "d string, n long, t string").select(F.col("d").cast("decimal(20,0)").alias("d"), "n", "t")
    got = {r["name"]: r for r in stats.column_statistics(df).collect()}
    assert got["d"]["distinct_count"] == 2 and got["d"]["max_exact"] == got["n"]["max_exact"] == "9007199254740993"
    assert math.isnan(got["t"]["mean_num"]) and got["t"]["data_type"] == "number"


def test_doubled_table_adds_its_rows_as_duplicates(spark):
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    once, twice = (profile.profile_table(d).first() for d in (parts, parts.unionByName(parts)))
    assert twice["row_count"] == 2 * once["row_count"]
    assert twice["duplicate_rows"] == once["duplicate_rows"] + once["row_count"]


def test_fingerprint_does_not_depend_on_partitions(spark):
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    prints = {profile.profile_fingerprint(profile.profile_table(parts.repartition(n))).first()["profile_fingerprint"] for n in (1, 7)}
    assert len(prints) == 1


def test_wide_table_is_profiled_in_slices(spark):
    wide = spark.range(50).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(230)], F.lit("x").alias("last"))
    row = profile.profile_table(wide).first()
    assert len(row["columns"]) == 231 and row["columns"][230]["inferred_type"] == "string"
    assert [c["name"] for c in row["columns"][:3]] == ["c0", "c1", "c2"]
    assert row["duplicate_rows"] == 0


def test_any_column_name_works(spark):
    df = spark.createDataFrame([("1", "x", " "), ("2", "x", "y")], "`a.b` string, `we``ird` string, `x y#` string")
    assert [c["name"] for c in profile.profile_table(df).first()["columns"]] == ["a.b", "we`ird", "x y#"]
    assert {r["name"]: r["distinct_count"] for r in stats.column_statistics(df).collect()} == {"a.b": 2, "we`ird": 1, "x y#": 1}
    assert {r["name"]: r["data_type"] for r in stats.column_kinds(df).collect()}["a.b"] == "number"
    assert profile.cast_inferred(df, profile.castable_types(df)).columns == df.columns


def test_long_text_is_compared_whole(spark):
    long = "x" * 500
    df = spark.createDataFrame([(long + "a",), (long + "b",), (long + "a",), (" " + long + "b ",)], "t string")
    assert profile.profile_table(df).first()["duplicate_rows"] == 2


def test_cells_do_not_run_together(spark):
    rows = [tuple(["ab", "c"] + [""] * 20), tuple(["a", "bc"] + [""] * 20)]
    schema = ", ".join(f"c{i} string" for i in range(22))
    assert profile.row_totals(spark.createDataFrame(rows, schema)).first()["distinct_rows"] == 2
    shifted = [tuple([""] * 20 + ["ab", "c"]), tuple([""] * 20 + ["a", "bc"])]
    assert profile.row_totals(spark.createDataFrame(shifted, schema)).first()["distinct_rows"] == 2


def test_unicode_blanks_are_stripped(spark):
    df = spark.createDataFrame([(" x　",), (" ",), ("\x1c7\t",)], "t string")
    row = profile.profile_table(df).first()
    assert row["columns"][0]["missing"] == 1 and row["rejected_rows"] == 1


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("1_000", "integer"), ("+7", "integer"), ("-0", "integer"), ("1__0", "string"), ("_1", "string"), ("1.", "number"),
        (".5", "number"), ("1e5", "number"), ("1_0.5_0", "number"), ("Infinity", "number"), ("-nan", "number"),
        ("0x10", "string"), ("1d", "string"), ("1e", "string"), ("123456789012345678901234567890", "integer"), ("", "string"),
    ],
)
def test_inferred_type(spark, text, kind):
    df = spark.createDataFrame([(text,)], "t string")
    assert profile.profile_table(df).first()["columns"][0]["inferred_type"] == kind


def test_cast_inferred(spark, write):
    raw = scan_csv_raw(spark, write(GOLDEN["types"][0]))
    kinds = {c["name"]: c["inferred_type"] for c in profile.profile_columns(raw).collect()}
    typed = profile.cast_inferred(raw, kinds)
    assert dict(typed.dtypes) == {"i": "bigint", "f": "double", "s": "string", "m": "string"}
    assert sorted(r["i"] for r in typed.collect() if r["i"] is not None) == [1, 2, 10]


def test_long_whole_numbers_keep_their_digits(spark):
    df = spark.createDataFrame([("1" * 25, "2" * 50, "3"), ("4", "5", "6")], "wide string, huge string, small string")
    kinds = profile.castable_types(df)
    assert kinds == {"wide": "big_integer", "huge": "string", "small": "integer"}
    rows = profile.cast_inferred(df, kinds).collect()
    assert {str(r["wide"]) for r in rows} == {"1" * 25, "4"} and {r["huge"] for r in rows} == {"2" * 50, "5"}


def test_statistics_of_numbers_as_text(spark, write):
    raw = scan_csv_raw(spark, write("v,w\n 1 ,b\n2.5,a\n,a\n2.5,\n"))
    rows = {r["name"]: r for r in stats.column_statistics(raw).collect()}
    v, w = rows["v"], rows["w"]
    assert (v["data_type"], v["non_null_count"], v["null_count"], v["distinct_count"]) == ("number", 3, 1, 2)
    assert (v["min_num"], v["max_num"], v["mean_num"], v["min_str"]) == (1.0, 2.5, 2.0, None)
    assert (w["data_type"], w["distinct_count"], w["min_str"], w["max_str"], w["mean_num"]) == ("string", 2, "a", "b", None)


def test_statistics_of_chosen_columns(spark):
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    rows = stats.column_statistics(parts, ["p_size", "p_name"]).collect()
    assert sorted(r["name"] for r in rows) == ["p_name", "p_size"]


def test_changed_fingerprints(spark):
    history = spark.createDataFrame(
        [(1, 1, "a"), (1, 2, "a"), (1, 30, "b"), (2, 1, "a"), (1, 31, "b")], "dataset_id int, created_at int, profile_fingerprint string"
    ).withColumn("report_id", F.col("created_at"))
    rows = profile.fingerprint_changes(history, F.floor(F.col("created_at") / 10)).collect()
    assert sorted((r["dataset_id"], r["report_id"], r["changed"]) for r in rows) == [
        (1, 1, True), (1, 2, False), (1, 30, True), (1, 31, False), (2, 1, True)
    ]


def test_metric_sentence(spark):
    row = stats.metric_insights(spark.createDataFrame([("revenue", 12.5)], "name string, value double")).first()
    assert tuple(row) == ("revenue", "revenue is currently 12.50.", 0.8)
