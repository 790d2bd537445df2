"""File sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.cells import column
from tidemark.sources.csv_records import csv_records


def _csv_reader(spark: SparkSession, multi_line: bool, header: bool = True):
    return (
        spark.read.option("header", header)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
    )


def scan_csv_raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with a header row, every column as text.

    Short rows are padded with null, surplus cells dropped, empty lines skipped. Files are cut and read
    by many tasks, also where cells span lines; see ``csv_records``. Columns are named by the first file's header.
    """
    return cells_of(csv_records(spark, path), _csv_reader(spark, multi_line=True).csv(path).schema)


def cells_of(records: DataFrame, schema: T.StructType) -> DataFrame:
    """The text cells of ``csv_records`` under the names of ``schema``, and the columns of partition folders."""
    kind = records.schema["folders"].dataType
    folders = kind.names if isinstance(kind, T.StructType) else []
    cells = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields if f.name not in folders])
    parsed = F.from_csv("record", F.lit(cells.toDDL()), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    chosen = [F.col(k)[n].alias(n) for k, names in (("cells", cells.names), ("folders", folders)) for n in names]
    return records.select(parsed.alias("cells"), "folders").select(chosen) if cells else records.select([F.col("folders")[n].alias(n) for n in folders])


#: Types a text column may take, narrowest first, with the texts of each.
_DAY = r"^\d{4}-\d{2}-\d{2}$"
_TIME = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^(NaN|-?Inf|-?Infinity)$"
_KINDS = {
    "int": r"^[+-]?\d+$", "bigint": r"^[+-]?\d+$", "decimal(38,0)": r"^[+-]?\d+$", "double": _NUMBER, "date": _DAY,
    "timestamp": _TIME, "boolean": r"(?i)^(true|false)$",
}


def inferred_types(df: DataFrame) -> dict[str, str]:
    """The narrowest type that holds every text of each column, from one pass over all rows; ``string`` if none does or all are null."""
    checks = []
    for i, name in enumerate(df.columns):
        cell = column(name)
        checks.append(F.count(cell).alias(f"{i}:any"))
        for kind, shape in _KINDS.items():
            fits = cell.rlike(shape) & (cell.rlike("^(NaN|-?Inf)") | cell.try_cast(kind).isNotNull())
            checks.append(F.bool_and(fits).alias(f"{i}:{kind}"))
    found = df.agg(*checks).first().asDict()
    return {
        name: next((k for k in _KINDS if found[f"{i}:{k}"]), "string") if found[f"{i}:any"] else "string"
        for i, name in enumerate(df.columns)
    }


def scan_csv_typed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As ``scan_csv_raw`` with column types inferred from all rows (one extra pass over the parsed cells)."""
    raw = scan_csv_raw(spark, path)
    texts = raw.select([column(f.name) for f in raw.schema.fields if isinstance(f.dataType, T.StringType)])
    kinds = inferred_types(texts) if texts.columns else {}
    return raw.select([column(n).cast(kinds[n]).alias(n) if n in kinds else column(n) for n in raw.columns])


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Columnar source; filters and chosen columns reach the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def duplicate_headers(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Names that occur more than once in a file's header line, compared without case.

    Spark numbers such columns when it reads a header, so the line itself is looked at.
    """
    header = _csv_reader(spark, multi_line=True, header=False).csv(path).first() or ()
    seen: dict[str, int] = {}
    for name in header:
        if name is not None:
            seen[name.lower()] = seen.get(name.lower(), 0) + 1
    return sorted(name for name, times in seen.items() if times > 1)
