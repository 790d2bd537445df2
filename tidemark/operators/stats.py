"""Column statistics: counts, exact distinct values, range and mean, for all columns at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.cells import FLOATING, INTEGRAL, TEMPORAL, as_text, column, is_number, stripped, stripped_text, to_double

STATISTICS = [
    "position", "name", "data_type", "row_count", "non_null_count", "null_count", "distinct_count",
    "min_num", "max_num", "mean_num", "min_str", "max_str", "min_exact", "max_exact",
]

#: Columns whose keys one generated method makes; the JVM interprets a method of more than 8,000 bytes of code, never compiling it.
COLUMNS_AT_ONCE = 4


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, INTEGRAL):
        return "bigint"
    if isinstance(dtype, FLOATING + (T.DecimalType,)):
        return "double"
    if isinstance(dtype, TEMPORAL):
        return "timestamp_ntz"
    return "string"


def _cell(field: T.StructField, family: str) -> Column:
    if family == "string":
        # Blank text counts as missing.
        text = stripped_text(field.name, field.dataType)
        return F.when(text != "", text)
    return column(field.name).cast(family)


def _key_text(field: T.StructField) -> Column:
    """A cell of a ``stripped`` table as text that values share exactly when they are equal; null if missing. Zero has no sign."""
    cell = _cell(field, _family(field.dataType)) if _family(field.dataType) == "string" else column(field.name)
    if isinstance(field.dataType, FLOATING):
        cell = cell + F.lit(0.0)
    return cell.cast("string")


def value_key(text: Column) -> Column:
    """At most 32 bytes that texts share exactly when they are equal; longer text is replaced by its SHA-256, which no shorter text can equal."""
    return F.when(F.octet_length(text) < 32, F.encode(text, "UTF-8")).otherwise(F.unhex(F.sha2(text, 256)))


def cell_keys(df: DataFrame) -> list[DataFrame]:
    """position, value: a key for every cell of a ``stripped`` table that is not missing, in tables of ``COLUMNS_AT_ONCE`` columns each.

    Every table reads ``df`` once. A cell's text is projected first, as the key uses it more than once.
    """
    fields, tables = list(enumerate(df.schema.fields)), []
    for first in range(0, len(fields), COLUMNS_AT_ONCE):
        some = fields[first : first + COLUMNS_AT_ONCE]
        texts = df.select([_key_text(f).alias(str(i)) for i, f in some])
        keys = [F.struct(F.lit(i).alias("position"), value_key(column(str(i))).alias("value")) for i, _ in some]
        tables.append(texts.select(F.inline(F.array(*keys))).where("value IS NOT NULL"))
    return tables


def cell_figures(field: T.StructField) -> tuple[Column, Column, Column]:
    """(cell, aggregate of cells that are no number, number) of one column of a ``stripped`` table; missing cells are null."""
    family, cell = _family(field.dataType), column(field.name)
    if family == "string":
        cell = _cell(field, family)
        return cell, F.count_if(cell.isNotNull() & ~is_number(cell)), to_double(cell)
    if family == "timestamp_ntz":
        cell = cell if isinstance(field.dataType, T.DateType) else cell.cast("timestamp_ntz")
        return cell, F.count(cell), F.lit(None).cast("double")
    return cell, F.lit(0), cell


def figure_rows(fields: list[T.StructField]) -> Column:
    """The rows of STATISTICS but distinct_count, from one row of figures.

    For column i: n present, w no numbers, l and h range as double, m mean, a and z range as text, le and he
    range of numbers in their own type as text; and ``rows``.
    """
    rows = []
    for i, field in enumerate(fields):
        present, numeric = F.col(f"n{i}"), (F.col(f"w{i}") == 0) & (F.col(f"n{i}") > 0)
        kind = F.when(numeric, "number").otherwise("datetime" if _family(field.dataType) == "timestamp_ntz" else "string")
        rows.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(field.name).alias("name"),
                kind.alias("data_type"),
                F.col("rows").alias("row_count"),
                present.alias("non_null_count"),
                (F.col("rows") - present).alias("null_count"),
                *[F.when(numeric, F.col(f"{c}{i}")).alias(n) for c, n in (("l", "min_num"), ("h", "max_num"), ("m", "mean_num"))],
                *[F.when(~numeric, F.col(f"{c}{i}")).alias(n) for c, n in (("a", "min_str"), ("z", "max_str"))],
                *[F.when(numeric, F.col(f"{c}{i}")).alias(n) for c, n in (("le", "min_exact"), ("he", "max_exact"))],
            )
        )
    return F.array(*rows)


def column_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column (see STATISTICS); empty when the table has no rows.

    Counts, ranges and means come from one plain aggregate, which shuffles a row per task. Only the exact
    distinct counts shuffle values, as keys of 32 bytes at most that collapse before the shuffle.
    ``min_exact`` and ``max_exact`` hold a numeric column's range in its own type, as text.
    """
    df = stripped(df if columns is None else df.select([column(f) for f in df.columns if f in columns]))
    fields = df.schema.fields
    totals = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(fields):
        cell, words, number = cell_figures(field)
        low, high = F.min(number), F.max(number)
        totals += [
            F.count(cell).alias(f"n{i}"), words.alias(f"w{i}"),
            low.cast("double").alias(f"l{i}"), high.cast("double").alias(f"h{i}"), F.avg(number).cast("double").alias(f"m{i}"),
            F.min(cell).cast("string").alias(f"a{i}"), F.max(cell).cast("string").alias(f"z{i}"),
            low.cast("string").alias(f"le{i}"), high.cast("string").alias(f"he{i}"),
        ]
    figures = df.agg(*totals).where("rows > 0").select(F.inline(figure_rows(fields)))
    keys = reduce(DataFrame.unionByName, [cells.distinct() for cells in cell_keys(df)])
    distinct = keys.groupBy("position").agg(F.count(F.lit(1)).alias("distinct_count"))
    return figures.join(distinct, "position", "left").na.fill(0, ["distinct_count"]).select(*STATISTICS)


def approximate_statistics(df: DataFrame, relative_error: float = 0.02) -> DataFrame:
    """position, name, non_null_count, approx_distinct: one scan with no value shuffle.

    For tables too wide or too varied for exact distinct counts.
    """
    df, totals, rows = stripped(df), [], []
    for i, field in enumerate(df.schema.fields):
        cell = _cell(field, _family(field.dataType))
        totals += [F.count(cell).alias(f"n{i}"), F.approx_count_distinct(cell, relative_error).alias(f"d{i}")]
        rows.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(field.name).alias("name"),
                F.col(f"n{i}").alias("non_null_count"),
                F.col(f"d{i}").alias("approx_distinct"),
            )
        )
    return df.agg(*totals).select(F.inline(F.array(*rows)))


def column_kinds(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """name, data_type only: what chart advice needs, from one aggregate and no shuffle of values."""
    totals, rows = [], []
    for i, field in enumerate(f for f in df.schema.fields if columns is None or f.name in columns):
        if isinstance(field.dataType, TEMPORAL):
            kind = F.lit("datetime")
        elif _family(field.dataType) != "string":
            totals.append(F.count(column(field.name)).alias(f"n{i}"))
            kind = F.when(F.col(f"n{i}") > 0, "number").otherwise("string")
        else:
            text = as_text(field.name, field.dataType)
            totals += [F.count_if(text != "").alias(f"n{i}"), F.count_if((text != "") & ~is_number(text)).alias(f"w{i}")]
            kind = F.when((F.col(f"n{i}") > 0) & (F.col(f"w{i}") == 0), "number").otherwise("string")
        rows.append(F.struct(F.lit(field.name).alias("name"), kind.alias("data_type")))
    return df.agg(F.count(F.lit(1)).alias("rows"), *totals).where("rows > 0").select(F.inline(F.array(*rows)))


def metric_insights(metrics: DataFrame) -> DataFrame:
    """Sentence per metric row (name, value): title, summary, confidence."""
    return metrics.select(
        F.col("name").alias("title"),
        F.format_string("%s is currently %.2f.", "name", "value").alias("summary"),
        F.lit(0.8).alias("confidence"),
    )
