"""Files of documents: the sink, and compact files read in parts and as streams."""

import os

import pyarrow as pa
import pytest

from docloom.sources import compact, sinks

NAMES = ["plain", "a/b c", "", "../up", "_under", ".dot", "100% é漢", "x" * 300, "x" * 301, "+", None]


def lines_of(spark, names, k=3):
    return spark.createDataFrame([(d, n, f"{d} {n}") for d in names for n in range(k)], "doc string, n int, line string")


def files_in(path):
    return {f: open(os.path.join(path, f), encoding="utf-8").read() for f in os.listdir(path) if not f.startswith((".", "_"))}


def test_each_document_is_a_file_of_its_name(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_files(lines_of(spark, NAMES).repartition(4), path, suffix=".txt")
    want = {sinks.file_name(d, ".txt"): "".join(f"{d} {n}\n" for n in range(3)) for d in NAMES}
    assert len(want) == len(NAMES) and files_in(path) == want
    assert open(f"{path}/_SUCCESS").read() == '{"documents": 11, "lines": 33}' and not [f for f in os.listdir(path) if f.startswith(".") and not f.endswith(".crc")]
    sinks.write_files(lines_of(spark, ["plain", "new"], 1), path, suffix=".txt")  # again: replaced, not doubled
    assert files_in(path) == want | {"plain.txt": "plain 0\n", "new.txt": "new 0\n"}
    read = spark.read.text(path).selectExpr("_metadata.file_path as p").distinct()
    names = {r.d for r in read.select(sinks.document_of(read.p, ".txt").alias("d")).collect()}
    assert {d for d in NAMES if d is None or 0 < len(d) < 180} | {"new"} <= names
    with pytest.raises(Exception, match="only appends"):
        lines_of(spark, ["a"]).selectExpr("doc as name", "line").write.format(sinks.FORMAT).mode("overwrite").save(path)
    with pytest.raises(Exception, match="takes"):
        lines_of(spark, ["a"]).write.format(sinks.FORMAT).mode("append").save(path)
    sinks.write_files(lines_of(spark, NAMES, 0), str(tmp_path / "none"))
    assert files_in(tmp_path / "none") == {}


def test_a_repeated_or_failing_task_leaves_whole_documents(tmp_path):
    batch = lambda *rows: pa.RecordBatch.from_pylist([{"name": a, "line": b} for a, b in rows], pa.schema([("name", pa.string()), ("line", pa.string())]))
    writer = sinks.FilesWriter({"path": str(tmp_path)})
    batches = [batch(("a", "1"), ("a", None)), batch(), batch(("a", "2"), ("b", "3"))]
    for _ in range(2):
        assert writer.write(iter(batches)) == sinks.Written(2, 4)
        assert files_in(tmp_path) == {"a": "1\n2\n", "b": "3\n"}

    def lost():
        yield batch(("a", "new"), ("b", "half"))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(lost())
    assert files_in(tmp_path) == {"a": "new\n", "b": "3\n"} and len(os.listdir(tmp_path)) == 2
    for first, second in (("b", "a"), (None, "a")):
        with pytest.raises(ValueError, match="sorted"):
            writer.write(iter([batch((first, "1"), (second, "2"), ("z", "3"))]))


def test_compact_files_are_read_in_parts(spark, tmp_path):
    rows = [(d, "block", "paragraph", f"{d} {k} " + "é" * (k % 50), 1, "text", {}, k) for d in (1, 2) for k in range(3000)]
    from docloom.schema import BLOCK_COLUMNS

    blocks = spark.createDataFrame(rows, "doc long, kind string, element_type string, content string, level int, encoding string, attributes map<string,string>, element_order int")
    path = str(tmp_path / "out")
    sinks.write_files(compact.write_compact(blocks), path, suffix=".dblocks")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 8
        back = compact.read_compact_files(spark, path).withColumn("doc", sinks.document_of("doc", ".dblocks").cast("long"))
        assert back.columns == ["doc", *BLOCK_COLUMNS]
        assert sorted(map(tuple, back.select("doc", "element_order", "content").collect())) == sorted((r[0], r[7], r[3]) for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    compact.write_compact_stream(compact.stream_compact_lines(spark, path), str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination(120)
    table = spark.read.parquet(str(tmp_path / "table"))
    assert sorted(map(tuple, table.select(sinks.document_of("doc", ".dblocks").cast("long"), "element_order", "content").collect())) == sorted((r[0], r[7], r[3]) for r in rows)


def test_the_sink_takes_streams(spark, tmp_path):
    spark.dataSource.register(sinks.DocumentFiles)
    lines_of(spark, ["a", "b"], 1).select("line").coalesce(1).write.text(str(tmp_path / "in"))
    stream = spark.readStream.text(str(tmp_path / "in")).selectExpr("substring(value, 1, 1) as name", "value as line")
    run = stream.writeStream.format(sinks.FORMAT).option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert files_in(tmp_path / "out") == {"a": "a 0\n", "b": "b 0\n"}
    assert [f for f in os.listdir(tmp_path / "out") if f.startswith("_SUCCESS")]
