"""Helpers that several operators share: the shared folder, written tables, held-out folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import shared_dir  # noqa: F401
from ..plans.shared import written as materialize  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, mod `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(columns: list[str], name: str) -> str:
    """`name`, with as many underscores after it as it takes to be none of `columns` in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_row(df: DataFrame) -> Column:
    """All columns as one struct `row`, so that columns beside it can't clash with theirs; `row.*` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
