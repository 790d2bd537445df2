"""Data-quality profile of a table: missing cells, types, duplicates, blank rows, score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import fixed_values as fixed
from tidemark.functions.cells import (
    FLOATING,
    INTEGRAL,
    TEMPORAL,
    as_text,
    column,
    is_integer,
    is_number,
    normalise,
    stripped,
    stripped_text,
    to_double,
)
from tidemark.operators.ordered import asof_last

_COLUMN_STRUCT = "struct<name:string,missing:bigint,sample_size:bigint,inferred_type:string>"


def _checks(field: T.StructField) -> tuple[Column, Column, Column]:
    """(missing, not an integer, not a number) for one column of a ``stripped`` table, by declared type where it decides."""
    cell, dtype = column(field.name), field.dataType
    if isinstance(dtype, T.StringType):
        text = stripped_text(field.name, dtype)
        missing = text == ""
        return missing, ~missing & ~is_integer(text), ~missing & ~is_number(text)
    missing = cell.isNull()
    if isinstance(dtype, INTEGRAL):
        return missing, F.lit(False), F.lit(False)
    if isinstance(dtype, T.DecimalType):
        return missing, ~missing & F.lit(dtype.scale > 0), F.lit(False)
    return missing, ~missing, ~missing & F.lit(not isinstance(dtype, FLOATING))


def column_totals(schema: T.StructType) -> list[Column]:
    """For column i of a ``stripped`` table: m missing cells, i no integers, f no numbers."""
    totals = []
    for i, field in enumerate(schema.fields):
        missing, not_integer, not_number = _checks(field)
        totals += [
            F.count_if(missing).alias(f"m{i}"),
            F.count_if(not_integer).alias(f"i{i}"),
            F.count_if(not_number).alias(f"f{i}"),
        ]
    return totals


def column_rows(names: list[str]) -> Column:
    """The rows of ``profile_columns``, from one row of ``column_totals`` and the number ``n`` of rows."""
    rows = []
    for i, name in enumerate(names):
        rows.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("name"),
                F.col(f"m{i}").alias("missing"),
                (F.col("n") - F.col(f"m{i}")).alias("sample_size"),
                F.when(F.col("n") == F.col(f"m{i}"), "string")
                .when(F.col(f"i{i}") == 0, "integer")
                .when(F.col(f"f{i}") == 0, "number")
                .otherwise("string")
                .alias("inferred_type"),
            )
        )
    return F.array(*rows)


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: position, name, missing, sample_size, inferred_type.

    One plain aggregate over all columns: nothing but one row per task is shuffled.
    """
    totals = stripped(df).agg(F.count(F.lit(1)).alias("n"), *column_totals(df.schema))
    return totals.where("n > 0").select(F.inline(column_rows(df.columns)))


def row_digest(schema: T.StructType) -> Column:
    """32 bytes that rows of a ``stripped`` table share exactly when all their cells are equal.

    Each cell carries its length, so cells cannot run together. Zero has no sign.
    """
    parts = []
    for field in schema.fields:
        text = stripped_text(field.name, field.dataType)
        if isinstance(field.dataType, FLOATING):
            text = F.coalesce((column(field.name) + F.lit(0.0)).cast("string"), F.lit(""))
        parts += [F.length(text).cast("string"), F.lit(":"), text]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def blank_row(schema: T.StructType) -> Column:
    """Whether all cells of a row of a ``stripped`` table are missing."""
    return reduce(Column.__and__, [stripped_text(f.name, f.dataType) == "" for f in schema.fields])


def row_totals(df: DataFrame) -> DataFrame:
    """One row: row_count, distinct_rows, blank_rows over normalised rows.

    Copies collapse before the shuffle, so a row repeated in a third of the table costs one
    record per task, and a record is a 32-byte digest, whatever the width of the table.
    """
    rows = stripped(df).select(row_digest(df.schema).alias("row"), blank_row(df.schema).alias("blank"))
    return (
        rows.groupBy(*rows.columns)
        .agg(F.count(F.lit(1)).alias("copies"))
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
            F.count(F.lit(1)).alias("distinct_rows"),
            F.coalesce(F.sum(F.when(F.col("blank"), F.col("copies"))), F.lit(0)).alias("blank_rows"),
        )
    )


def distinct_rows(df: DataFrame) -> DataFrame:
    """The set of normalised rows."""
    return df.select([as_text(f.name, f.dataType).alias(f.name) for f in df.schema.fields]).distinct()


def quality_score(missing: Column, duplicates: Column, blanks: Column, rows: Column, columns: int) -> Column:
    """100 less a truncated penalty for missing cells, duplicate rows and blank rows."""
    cells = F.greatest(rows * F.lit(max(columns, 1)), F.lit(1))
    whole = F.greatest(rows, F.lit(1))
    penalty = (
        (missing / cells) * F.lit(50.0) + (duplicates / whole) * F.lit(25.0) + (blanks / whole) * F.lit(25.0)
    ).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - penalty))


def issue_list(missing: Column, duplicates: Column, blanks: Column, rows: Column) -> Column:
    """Messages in fixed order, each with its count."""
    found = F.array(
        F.when(missing > 0, F.format_string("%d missing values detected", missing)),
        F.when(duplicates > 0, F.format_string("%d duplicate rows detected", duplicates)),
        F.when(blanks > 0, F.format_string("%d fully blank rows detected", blanks)),
    )
    return F.when(rows == 0, F.array(F.lit(fixed.EMPTY_DATASET))).otherwise(
        F.filter(found, lambda message: message.isNotNull())
    )


def profile_table(df: DataFrame) -> DataFrame:
    """The whole profile as one row.

    Columns: row_count, rejected_rows, quality_score, columns, issues, missing_cells, duplicate_rows.
    """
    return assembled(profile_columns(df), row_totals(df), len(df.columns))


def assembled(columns: DataFrame, totals: DataFrame, width: int) -> DataFrame:
    """The profile of a table of ``width`` columns from what ``profile_columns`` and ``row_totals`` say."""
    per_column = columns.agg(
        F.sum("missing").alias("missing_cells"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("position", "name", "missing", "sample_size", "inferred_type"))),
            lambda c: F.struct(
                c["name"].alias("name"),
                c["missing"].alias("missing"),
                c["sample_size"].alias("sample_size"),
                c["inferred_type"].alias("inferred_type"),
            ),
        ).alias("columns"),
    )
    merged = (
        per_column.unionByName(totals, allowMissingColumns=True)
        .agg(*[F.first(c, ignorenulls=True).alias(c) for c in
               ("row_count", "distinct_rows", "blank_rows", "missing_cells", "columns")])
        .select(
            "row_count",
            "blank_rows",
            F.coalesce("missing_cells", F.lit(0)).alias("missing_cells"),
            (F.col("row_count") - F.col("distinct_rows")).alias("duplicate_rows"),
            F.coalesce("columns", F.array().cast(f"array<{_COLUMN_STRUCT}>")).alias("columns"),
        )
    )
    rows, missing = F.col("row_count"), F.col("missing_cells")
    duplicates, blanks = F.col("duplicate_rows"), F.col("blank_rows")
    return merged.select(
        "row_count",
        blanks.alias("rejected_rows"),
        quality_score(missing, duplicates, blanks, rows, width).alias("quality_score"),
        "columns",
        issue_list(missing, duplicates, blanks, rows).alias("issues"),
        "missing_cells",
        "duplicate_rows",
    )


def profile_json(profile: DataFrame) -> DataFrame:
    """Add summary_json: the profile, with its metadata where it has any; its own keys in alphabetical order."""
    columns = F.transform(
        "columns",
        lambda c: F.struct(
            c["inferred_type"].alias("inferred_type"),
            c["missing"].alias("missing"),
            c["name"].alias("name"),
            c["sample_size"].alias("sample_size"),
        ),
    )
    kept = ["issues"] + (["metadata"] if "metadata" in profile.columns else [])
    document = F.struct(columns.alias("columns"), *kept, "quality_score", "rejected_rows", "row_count")
    return profile.withColumn("summary_json", F.to_json(document))


def profile_fingerprint(profile: DataFrame) -> DataFrame:
    """Add profile_fingerprint: SHA-256 of counts, score, schema and issues as compact sorted JSON."""
    schema = F.transform(
        "columns", lambda c: F.struct(c["inferred_type"].alias("inferred_type"), c["name"].alias("name"))
    )
    source = F.struct(
        F.col("issues").cast("array<string>").alias("issues"),
        F.col("quality_score"),
        F.col("rejected_rows"),
        F.col("row_count"),
        schema.alias("schema"),
    )
    return profile.withColumn("profile_fingerprint", F.sha2(F.to_json(source), 256))


def profile_metadata(profile: DataFrame, source_name: str, storage_path: str) -> DataFrame:
    """Add the metadata document kept beside a stored profile."""
    schema = F.transform(
        "columns", lambda c: F.struct(c["name"].alias("name"), c["inferred_type"].alias("inferred_type"))
    )
    return profile_fingerprint(profile).withColumn(
        "metadata",
        F.struct(
            F.lit(fixed.PROFILE_VERSION).alias("profile_version"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ingested_at"),
            F.lit(source_name).alias("source_name"),
            F.lit(storage_path).alias("storage_path"),
            F.size("columns").alias("column_count"),
            F.size("issues").alias("issue_count"),
            schema.alias("schema"),
            F.col("profile_fingerprint"),
        ),
    )


def fingerprint_changes(history: DataFrame, piece: Column) -> DataFrame:
    """Mark profiles that differ from the dataset's previous one; the first one counts as changed.

    ``history``: dataset_id, created_at, report_id, profile_fingerprint. ``piece`` rises with
    created_at and bounds how much of one dataset's history a task sorts.
    """
    current = F.col("profile_fingerprint")
    seen = asof_last(
        history, "dataset_id", ["created_at", "report_id"], piece, F.lit(True), current, "_before", strict=True
    )
    return seen.withColumn("changed", F.coalesce(F.col("_before") != current, F.lit(True))).drop("_before")


def castable_types(df: DataFrame) -> dict[str, str]:
    """Target type per text column: the inferred one, widened so that no whole number loses digits.

    ``integer`` holds 18 digits, ``big_integer`` 38; columns with longer numbers stay text.
    """
    kinds = {r["name"]: r["inferred_type"] for r in profile_columns(df).collect()}
    whole = [n for n, kind in kinds.items() if kind == "integer"]
    if not whole:
        return kinds
    digits = df.agg(
        *[F.max(F.length(F.regexp_replace(normalise(column(n)), "[^0-9]", ""))).alias(n) for n in whole]
    ).first()
    for name in whole:
        if digits[name] > 18:
            kinds[name] = "big_integer" if digits[name] <= 38 else "string"
    return kinds


def cast_inferred(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Typed copy of raw text rows: cast by inferred type, blank rows and copies dropped."""
    whole = F.lit("_")
    out = []
    for name in df.columns:
        text = normalise(column(name))
        kind = types.get(name, "string")
        if kind == "integer":
            value = F.when(is_integer(text), F.replace(text, whole, F.lit("")).try_cast("bigint"))
        elif kind == "big_integer":
            value = F.when(is_integer(text), F.replace(text, whole, F.lit("")).try_cast("decimal(38,0)"))
        elif kind == "number":
            value = to_double(text)
        else:
            value = F.when(text != "", text)
        out.append(value.alias(name))
    filled = reduce(Column.__or__, [normalise(column(n)) != "" for n in df.columns])
    return df.where(filled).select(out).distinct()
