"""Read the driver's tables.

Readers select only the needed columns and apply filters before anything
opaque (the Python parse), so Parquet gets ``ReadSchema`` pruning and
``PushedFilters``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession

from ..session import INPUT_PARTITIONS, is_folder

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def table_files(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, str]:
    """The folder of a table's files and the pattern of their names: a table is one file, or a folder of files."""
    path = table_path(sf_dir, name)
    return (path, "*") if is_folder(spark, path) else (sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None,
               where: Column | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    if where is not None:
        df = df.filter(where)
    if columns:
        df = df.select(*columns)
    return df


def read_pages(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """R1 ``page_source``: the page bodies as a table ``(page_id, url, html)``.

    The parse that follows is CPU-bound, and a file of one row group is one
    task. A caller who wants more sets ``pagemill.inputPartitions`` on the
    session; the html is then dealt out once. Unset, nothing is moved.
    """
    df = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"], where)
    wanted = spark.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted else df
