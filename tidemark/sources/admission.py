"""Gate for incoming sources, for a whole batch of them at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.functions.cells import normalise


def base_name(path: Column) -> Column:
    """Last path segment, trailing slashes ignored."""
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def source_admission(sources: DataFrame, file_name: str = "file_name", dataset_name: str = "dataset_name") -> DataFrame:
    """Add source_name, rejection (null when accepted) and accepted."""
    chosen = F.coalesce(F.when(F.col(file_name) != "", F.col(file_name)), F.col(dataset_name))
    name = base_name(chosen)
    rejection = F.when(normalise(F.col(dataset_name)) == "", fixed.NAME_REQUIRED).when(
        ~F.coalesce(F.lower(name).endswith(".csv"), F.lit(False)), fixed.CSV_ONLY
    )
    return sources.withColumns({"source_name": name, "rejection": rejection, "accepted": rejection.isNull()})


def infer_source_type(name: Column) -> Column:
    """file, api or database, by the name's ending or start (case matters)."""
    return (
        F.when(name.endswith(".csv") | name.endswith(".tsv"), "file")
        .when(name.startswith("http"), "api")
        .otherwise("database")
    )


def resolve_datasets(requests: DataFrame, registry: DataFrame, files: DataFrame) -> DataFrame:
    """Outcome per requested dataset_id: unknown, no_path, missing_file or resolved.

    ``registry``: dataset_id, storage_path. ``files``: storage_path of files that exist.
    Requests for one dataset collapse before the joins, so a popular id is looked up once.
    """
    wanted = requests.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("requests"))
    known = registry.select("dataset_id", "storage_path", F.lit(True).alias("known"))
    present = files.select("storage_path", F.lit(0).cast("bigint").alias("_spread"), F.lit(True).alias("present")).distinct()
    # Ids without a path match nothing; the second key deals them over all tasks.
    spread = F.when(F.col("storage_path").isNull(), F.xxhash64("dataset_id")).otherwise(0)
    return (
        wanted.join(known, "dataset_id", "left")
        .withColumn("_spread", spread)
        .join(present, ["storage_path", "_spread"], "left")
        .select(
            "dataset_id",
            "requests",
            "storage_path",
            F.when(F.col("known").isNull(), "unknown")
            .when(F.coalesce("storage_path", F.lit("")) == "", "no_path")
            .when(F.col("present").isNull(), "missing_file")
            .otherwise("resolved")
            .alias("outcome"),
        )
    )
