"""Union of overlapping shards, and completeness against independent counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine(shards: list[DataFrame], key: str = "id", markets: list[str] | None = None) -> DataFrame:
    """All shards' rows once for each key; rows of other markets go."""
    rows = reduce(DataFrame.unionByName, shards)
    if markets is not None:
        rows = rows.where(F.col("market").isin(markets))
    return rows.dropDuplicates([key])


def combine_lines(lines: DataFrame, markets: list[str] | None = None, key: str = "id") -> DataFrame:
    """The same over raw JSON lines (column value), which stay verbatim."""
    keyed = lines.select("value", F.get_json_object("value", f"$.{key}").alias("_key"), F.get_json_object("value", "$.market").alias("_market"))
    if markets is not None:
        keyed = keyed.where(F.col("_market").isin(markets))
    return keyed.dropDuplicates(["_key"]).select("value")


def combine_counts(shards: DataFrame, markets: list[str], key: str = "id") -> DataFrame:
    """One row: rows read, rows of other markets, duplicates."""
    mine = F.col("market").isin(markets)
    return shards.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~mine).alias("foreign_rows"), (F.count_if(mine) - F.count_distinct(F.when(mine, F.col(key)))).alias("duplicates"))


def reconcile(rows: DataFrame, expected: DataFrame, key: str = "market") -> DataFrame:
    """key, got, expected, complete: counts of rows against expected (key, expected)."""
    got = rows.groupBy(key).agg(F.count(F.lit(1)).alias("got"))
    both = got.join(expected, key, "full_outer").na.fill(0, ["got"])
    return both.select(key, "got", "expected", (F.col("got") == F.col("expected")).alias("complete"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows of a are not in b, and the reverse, with multiplicity."""
    missing, extra = a.exceptAll(b).agg(F.count(F.lit(1)).alias("missing")), b.exceptAll(a).agg(F.count(F.lit(1)).alias("extra"))
    return missing.join(F.broadcast(extra))


class Incomplete(ValueError):
    """A market has other than its expected number of rows."""


def gate(counts: DataFrame, allow_partial: bool = False) -> list[str]:
    """A line for each market of `reconcile` that is not complete; an error if there is one, unless allowed. Markets are few."""
    bad = [f"{r['market']}: {r['got']} of {r['expected']}" for r in counts.where("NOT coalesce(complete, false)").orderBy(counts.columns[0]).collect()]
    if bad and not allow_partial:
        raise Incomplete("; ".join(bad))
    return bad
