from types import SimpleNamespace

import pytest

from kerbwise.session import new_path, shared_folder


def session(**conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)))


def test_the_named_folder_wins():
    spark = session(**{"spark.checkpoint.dir": "hdfs:///shared/", "spark.master": "yarn"})
    assert shared_folder(spark) == "hdfs:///shared"
    assert new_path(spark, "x").startswith("hdfs:///shared/x-") and new_path(spark, "x") != new_path(spark, "x")


def test_a_cluster_without_the_setting_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session(**{"spark.master": "yarn"}))


def test_local_mode_gets_one_folder_of_its_own():
    spark = session(**{"spark.master": "local[2]"})
    assert shared_folder(spark) == shared_folder(spark)
