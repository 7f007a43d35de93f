"""Tables in the folder that driver and executors share, and connected components over them."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and Spark is one process, as in tests, one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^]]*\])?", master := spark.sparkContext.master):
        raise ValueError(f"spark.checkpoint.dir is unset: on {master} executors need a folder that they share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-"))
        atexit.register(shutil.rmtree, _own_folder[0], True)
    return _own_folder[0]


def saved(df: DataFrame, rows: int | None = None, each: int = 100_000) -> DataFrame:
    """`df` as a written table: later steps start from it, also after executors are lost.

    Where the number of rows is known to be about `rows`, the last step gets a task for `each` of them.
    """
    if rows is not None:
        df = df.coalesce(max(6, -(-rows // each)))
    path = f"{folder(df.sparkSession)}/docloom/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of so many cells, 8 MB of numbers, are broadcast; larger ones are shuffled.
BROADCAST_CELLS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """`df`, a written table of numbers, to be broadcast if it has no more than so many cells, else left to a shuffled join."""
    return F.broadcast(df) if df.count() * len(df.columns) <= BROADCAST_CELLS else df


#: A group with more than one in so many rows is hot; there are fewer hot groups than that, however large the table.
HOT_PART = 200


def joined_by_group(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` joined to `groups`, a written table with a row for each `key` and the number of its rows as `members`.

    The few hot groups are broadcast, so that their rows stay where they are; the others are shuffled.
    """
    hot = F.broadcast(groups.where(F.col("members") * HOT_PART > total))
    others = groups.where(F.col("members") * HOT_PART <= total)
    rest = rows.join(hot.select(key), key, "left_anti").join(others, key)
    return rows.join(hot, key).unionByName(rest)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores after it while `df` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of `edges` (a, b): the smallest node that each can reach.

    Each round hooks every node to its smallest neighbour, shortens the pointers and contracts the
    edges, until none is left; the tables shrink from round to round.
    """
    left = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels: DataFrame | None = None
    while n := left.count():
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = saved(ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("x"), F.least("a", "b").alias("p")), 2 * n)
        up = small(hook)
        for _ in range(2):
            hook = hook.join(up.select(F.col("x").alias("p"), F.col("p").alias("q")), "p", "left").select("x", F.coalesce("q", "p").alias("p"))
        hook = saved(hook, 2 * n)
        near = small(hook)
        if labels is None:
            labels = hook.select(F.col("x").alias("node"), F.col("p").alias("component"))
        else:
            labels = saved(labels.join(near, labels["component"] == near["x"], "left").select("node", F.coalesce("p", "component").alias("component")))
        a, b = near.select(F.col("x").alias("a"), F.col("p").alias("pa")), near.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        moved = left.join(a, "a").join(b, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        left = saved(moved.where("a <> b").distinct(), n)
    return left.select(F.col("a").alias("node"), F.col("b").alias("component")) if labels is None else labels
