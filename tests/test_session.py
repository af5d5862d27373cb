"""Where stage tables go."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from salesloom import session


def fake(master, setting=None, current=None):
    context = SimpleNamespace(
        master=master,
        applicationId="app-1",
        getConf=lambda: {},
        getCheckpointDir=lambda: current,
        setCheckpointDir=lambda path: None,
    )
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: setting or default))


def test_setting_of_the_session_wins():
    assert session.shared_root(fake("yarn", "hdfs:///stages", "hdfs:///other")) == "hdfs:///stages"
    assert session.scratch_path(fake("yarn", "hdfs:///stages/"), "t").startswith("hdfs:///stages/salesloom/app-1/t-")


def test_checkpoint_folder_of_the_context_is_next():
    assert session.shared_root(fake("yarn", None, "hdfs:///other")) == "hdfs:///other"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        session.shared_root(fake("spark://host:7077"))
    with pytest.raises(RuntimeError):
        session.shared_root(fake("local[2]"))


def test_release_removes_the_stages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_root", lambda _: str(tmp_path))
    assert session.cut_lineage(spark.range(3)).count() == 3
    assert list(tmp_path.rglob("*.parquet"))
    session.release(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_partitions_grow_with_the_input():
    assert session.shuffle_partitions(1) == 8
    assert session.shuffle_partitions(100 << 40) == 204800


def test_stage_tables_keep_rows_and_types(spark):
    df = spark.sql("SELECT 1L id, DATE '2024-01-01' d, 1.50 x, array(1, 2) a UNION ALL SELECT NULL, NULL, NULL, NULL")
    back = session.cut_lineage(df)
    assert back.dtypes == df.dtypes and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert session.cut_lineage(df.filter("id = 9")).count() == 0
