"""What operators share: sizes in settings, the shared folder, names of columns, joins with hot groups."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from docloom.llm import shared
from docloom.llm.arrow import byte_size


def test_sizes_of_settings():
    assert [byte_size(x) for x in ("8388608", "64m", "1g", " 2 KB ", "3mb", "5b")] == [8388608, 64 << 20, 1 << 30, 2048, 3 << 20, 5]
    assert byte_size("-1") > 1 << 60 and byte_size("0") > 1 << 60


def test_a_cluster_needs_a_shared_folder():
    session = lambda master, named: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=SimpleNamespace(master=master))
    assert shared.folder(session("spark://host:7077", "s3a://bucket/x")) == "s3a://bucket/x"
    assert shared.folder(session("local[8]", None)) == shared.folder(session("local", None))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.folder(session(master, None))


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "Leaks int, leaks_ int")
    assert shared.free_name(df, "leaks") == "leaks__" and shared.free_name(df, "other") == "other"


def test_hot_groups_join_as_others_do(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id")).alias("g"), "id")
    groups = shared.saved(rows.groupBy("g").agg(F.min("id").alias("least"), F.count("*").alias("members")))
    got = shared.joined_by_group(rows, groups, "g", 1000)
    assert sorted((r.id, r.least) for r in got.collect()) == [(k, 0 if k < 600 else k) for k in range(1000)]
