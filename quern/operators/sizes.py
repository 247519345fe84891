"""Checks before a broadcast, rows dealt out evenly, and safe unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BYTES = 64 << 20
#: Rows of a partition that ``spread`` makes, and its most partitions.
ROWS, PARTITIONS = 5_000, 4_096


def hinted(df: DataFrame, size: int = BYTES) -> DataFrame:
    """A broadcast hint behind a check of the table's bytes; beyond ``size`` Spark chooses."""
    wide = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(wide.cast("long")), F.lit(0))).first()[0] <= size else df


def spread(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """The rows in partitions of about ``rows`` each.  A table of small rows is one split
    of one file, and so one task, however much is made of each row; deal it out before."""
    return df.repartition(min(max(1, -(-df.count() // rows)), PARTITIONS))


def dealt(df: DataFrame, lying: int, n: int, rows: int) -> DataFrame:
    """``n`` rows that come from ``lying`` partitions, dealt out if these are too few to
    keep the session's cores busy with ``rows`` each; else as they lie, unshuffled."""
    wanted = min(-(-n // rows), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(wanted) if lying < wanted else df


def union(parts: list[DataFrame]) -> DataFrame:
    """Rows of several tables by name.  A union of equally partitioned inputs may
    be zipped by partition, which fails where adaptive execution has given these
    other numbers of partitions; that is switched off."""
    parts[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(DataFrame.unionByName, parts)
