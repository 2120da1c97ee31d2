from types import SimpleNamespace

import pytest

from ebbline import session


def stub(configured=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: configured), sparkContext=SimpleNamespace(applicationId="app-1"))


def test_the_configured_folder_is_used():
    spark = stub("hdfs://shared/scratch/")
    assert session.scratch_root(spark) == "hdfs://shared/scratch"
    assert session.scratch_path(spark, "x").startswith("hdfs://shared/scratch/ebbline/app-1/x-")


def test_without_the_setting_staging_and_paths_raise_the_same_error():
    for use in (lambda s: session.scratch_path(s, "x"), lambda s: session.staged(SimpleNamespace(sparkSession=s), "x"), session.drop_scratch):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            use(stub())


def test_staged_tables_can_be_removed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "_own_folder", lambda _: str(tmp_path / "own"))
    assert session.staged(spark.range(3), "x").count() == 3 and list((tmp_path / "own").iterdir())
    assert session.drop_scratch(spark) and not (tmp_path / "own").exists()


def test_an_unset_setting_reads_as_none(spark):
    assert spark.conf.get("spark.ebbline.not.set", None) is None


def test_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == cores
    wide = spark.range(10, numPartitions=cores + 1)
    assert session.spread(wide) is wide
