import os

import pytest

from lonja import session


def test_shuffle_sizing(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert session.size_shuffles(spark, 1) == spark.sparkContext.defaultParallelism
        assert session.size_shuffles(spark, 10 << 40) == 40960            # 10 TB in 256 MB pieces
        assert session.size_shuffles(spark, 100 << 40) == 409600          # no clamp at 100 TB
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_scratch_uses_the_named_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = session.scratch_dir(spark, "x"), session.scratch_dir(spark, "x")
    assert first.startswith(root + "/x-") and first != second


class FakeCluster:
    class conf:
        @staticmethod
        def get(_key, default):
            return default

    class sparkContext:
        master = "yarn"


def test_a_cluster_must_name_its_folder():
    with pytest.raises(RuntimeError):
        session.scratch_dir(FakeCluster, "x")


def test_written_frames(spark, rows):
    df = session.written(spark.range(3), "t")
    assert rows(df) == [(0,), (1,), (2,)]


def test_scratch_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_MADE", [])
    df = session.written(spark.range(3), "gone")
    folder = session._MADE[0]
    assert df.count() == 3 and session.clear_scratch(spark) == 1 and session.clear_scratch(spark) == 0
    assert not os.path.exists(folder.removeprefix("file:"))


def test_tuning_is_applied(spark):
    session.tune(spark)
    assert all(spark.conf.get(k) == v for k, v in session.TUNING.items())


def test_tasks_of_a_report_read_the_same_at_any_size(spark, tmp_path):
    from lonja.catalog.registry import Catalog
    from lonja.sources import tpch

    folder, wide = str(tmp_path / "sf"), "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.createDataFrame([], tpch.SCHEMAS["orders"]).write.parquet(f"{folder}/orders.parquet")
    assert 0 < session.stored_bytes(spark, f"{folder}/orders.parquet") < 1 << 20 and session.stored_bytes(spark, f"{folder}/events.parquet") == 0
    try:
        assert session.bound_tasks(spark, 1) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert session.bound_tasks(spark, 16 << 30) == 3072            # 48 GB moved, 16 MB a task
        c = Catalog()
        c.add("keys", "k l", lambda s: s.raw("orders").select("o_orderkey").distinct().withColumnRenamed("o_orderkey", "k"))
        c.queries["keys"](spark, folder)
        assert spark.conf.get(wide) == spark.conf.get("spark.sql.shuffle.partitions")
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == str(16 << 20)
        assert session.tune(spark).conf.get(wide, None) is None        # other queries begin as their session says
    finally:
        spark.conf.unset(wide)
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
