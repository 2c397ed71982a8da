"""Completeness, uniqueness, reference and rule audits for any table.

Each one reduces its input inside the map tasks before anything is shuffled, so
a key that holds a large share of the rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from airzone.operators.keys import rows_per_key


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row total and number of NULLs of every column, one row."""
    names = columns or df.columns
    return df.agg(F.count(F.lit(1)).alias("total_records"),
                  *[F.count_if(F.col(n).isNull()).alias(f"{n}_nulls") for n in names])


def category_frequencies(df: DataFrame, columns: Sequence[str], count_name: str = "site_count") -> DataFrame:
    """Rows per value of several text columns in one scan; NULL is a value."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("column_name"), F.col(n).cast("string").alias("category_value"))
        for n in columns])).alias("_c")).select("_c.*")
    return stacked.groupBy("column_name", "category_value").agg(F.count(F.lit(1)).alias(count_name))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row."""
    return rows_per_key(df, keys).filter(F.col("occurrences") > 1)


def key_uniqueness(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Per table: key values that repeat, surplus rows and NULL keys."""
    def audit(name: str, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        n = F.col("occurrences")
        has_null = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
        return rows_per_key(df, keys).agg(
            F.lit(name).alias("table_name"),
            F.count_if(n > 1).alias("duplicate_keys"),
            F.coalesce(F.sum(n - 1), F.lit(0)).alias("surplus_rows"),
            F.coalesce(F.sum(F.when(has_null, n)), F.lit(0)).alias("null_key_rows"))

    return reduce(DataFrame.unionByName, [audit(n, df, k) for n, (df, k) in tables.items()])


def orphans(fact: DataFrame, fact_key: str, dim: DataFrame, dim_key: str, name: str) -> DataFrame:
    """Foreign-key values without a dimension row, with the rows that hold them.

    The fact is reduced to one row per key value first; only those meet the
    dimension. NULL keys satisfy the constraint, as in SQL.
    """
    used = (fact.filter(F.col(fact_key).isNotNull())
            .groupBy(F.col(fact_key).alias("_k")).agg(F.count(F.lit(1)).alias("orphan_rows")))
    known = dim.select(F.col(dim_key).alias("_k"))
    return used.join(known, "_k", "left_anti").select(
        F.lit(name).alias("constraint_name"), F.col("_k").cast("string").alias("key_value"), "orphan_rows")


def rule_violations(df: DataFrame, table: str, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break each rule, in one scan. A NULL outcome passes, as CHECK does."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"),
                    *[F.count_if(~ok).alias(f"_r{i}") for i, ok in enumerate(rules.values())])
    rows = F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                              F.col("_n").alias("checked_rows"), F.col(f"_r{i}").alias("violations"))
                     for i, rule in enumerate(rules)])
    return counts.select(F.inline(rows))


def not_null_rules(columns: Sequence[str]) -> dict[str, Column]:
    return {f"{n} not null": F.col(n).isNotNull() for n in columns}
