"""Tables that change as a whole, by partitions or by keys."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from airzone.sources import snapshots


def files_of(root):
    return {str(p): p.stat().st_mtime_ns for p in Path(root, "data").rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    root = str(tmp_path / "t")
    frame = spark.range(300).select((F.col("id") % 3 + 2020).cast("int").alias("year"), F.col("id").alias("k"), F.lit(1.5).alias("v"))
    snapshots.replace_table(frame, root, partition_by="year", sort_by=["k"])
    return root


def test_a_refresh_replaces_and_keeps_the_order_of_columns(spark, table, rows):
    stored = snapshots.read(spark, table)
    assert stored.columns == ["year", "k", "v"] and stored.count() == 300
    small = spark.createDataFrame([(None, 1, 2.0), (2020, 2, 3.0)], "year int, k long, v double")
    assert rows(snapshots.replace_table(small, table, partition_by="year")) == sorted([(None, 1, 2.0), (2020, 2, 3.0)], key=repr)
    assert stored.count() == 300                                  # an open reader still has the table it began with
    assert rows(snapshots.replace_partitions(small.filter("false"), table, [None])) == [(2020, 2, 3.0)]
    assert snapshots.replace_table(small.filter("false"), table, partition_by="year").count() == 0
    assert snapshots.read(spark, table).columns == ["year", "k", "v"]


def test_a_write_that_fails_half_way_changes_nothing(spark, table):
    before = snapshots.current(spark, table)
    broken = spark.range(400).select(F.lit(2021).alias("year"), "id", F.when(F.col("id") < 399, 1.0).otherwise(
        F.raise_error(F.lit("lost")).cast("double")).alias("v")).withColumnRenamed("id", "k")
    for write in (lambda: snapshots.replace_table(broken, table, partition_by="year"), lambda: snapshots.replace_partitions(broken, table, [2021]),
                  lambda: snapshots.append(broken, table)):
        with pytest.raises(Exception, match="lost"):
            write()
    assert snapshots.current(spark, table) == before and snapshots.read(spark, table).count() == 300


def test_rows_without_an_entry_are_not_seen(spark, table):
    """What a killed job leaves: a whole folder that no entry names."""
    spark.range(5).select("id").write.parquet(f"{table}/data/{snapshots.TOKEN}=vdead/year=2020")
    assert snapshots.read(spark, table).count() == 300


def test_partitions_are_replaced_alone_and_pruned(spark, table):
    files = files_of(table)
    new = spark.createDataFrame([(2021, 7, 9.0)], "year int, k long, v double")
    stored = snapshots.replace_partitions(new, table, [2021, 2022])
    assert stored.groupBy("year").count().orderBy("year").collect() == [(2020, 100), (2021, 1)]
    after = files_of(table)
    assert {f: after[f] for f in files} == files                  # nothing that was written before has changed
    plan = stored.filter("year = 2020 and k = 3").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "EqualTo(k,3)" in plan
    with pytest.raises(ValueError, match="not replaced"):
        snapshots.replace_partitions(new, table, [2020])
    assert snapshots.read(spark, table).count() == 101
    gone = {r["folder"].rsplit("/", 1)[1] for r in snapshots.unused(spark, table).collect()}
    assert gone == {"year=2021", "year=2022"}


def test_append_adds_folders_only(spark, table):
    files = files_of(table)
    more = spark.createDataFrame([(2022, 1000, 1.0), (2023, 1001, 1.0)], "year int, k long, v double")
    assert snapshots.append(more, table).count() == 302
    after = files_of(table)
    assert {f: after[f] for f in files} == files and {f.split("year=")[1][:4] for f in set(after) - set(files)} == {"2022", "2023"}
    with pytest.raises(ValueError, match="another type"):
        snapshots.append(more.withColumn("v", F.lit("x")), table)


def test_keyed_update_rewrites_only_partitions_with_a_key(spark, table):
    old = set(snapshots.read(spark, table).inputFiles())
    computed = spark.createDataFrame([(4, 7.0, "a"), (7, None, "b"), (-5, 1.0, "nowhere")], "k long, v double, note string")
    stored = snapshots.update_rows(computed, table, ["k"])         # 4 and 7 are of 2021
    assert stored.columns == ["year", "k", "v", "note"] and stored.count() == 300
    assert {tuple(r) for r in stored.filter("note IS NOT NULL OR v IS NULL OR v <> 1.5").collect()} == {(2021, 4, 7.0, "a"), (2021, 7, None, "b")}
    kept = set(stored.inputFiles()) & old
    assert kept == {f for f in old if "year=2021" not in f}
    with pytest.raises(ValueError, match="partition column"):
        snapshots.update_rows(computed.withColumn("year", F.lit(1)), table, ["k"])


def test_two_writers_do_not_mix(spark, table, monkeypatch):
    behind = snapshots.current(spark, table)
    one = spark.createDataFrame([(2020, 1, 1.0)], "year int, k long, v double")
    for _ in range(2):
        snapshots.append(one, table)
    real, calls = snapshots.current, []
    monkeypatch.setattr(snapshots, "current", lambda s, r: (calls.append(1), behind if len(calls) == 1 else real(s, r))[1])
    with pytest.raises(RuntimeError, match="another writer"):
        snapshots.append(one, table)
    monkeypatch.undo()
    assert snapshots.read(spark, table).count() == 302
