"""Archives read by slices, and archives written with a commit."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.sinks import archive_writer
from textloom.sources import archives

RESULTS = "name string, markdown string, success boolean, error string"


@pytest.fixture(scope="module")
def registered(spark):
    spark.dataSource.register(archives.ArchiveSource)
    spark.dataSource.register(archive_writer.BundleSink)
    return spark


def pack(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members:
            z.writestr(name, content)


def test_a_thousand_members_by_four_tasks(registered, tmp_path):
    members = [(f"d/{i:04d}.txt", f"text {i} " * (i % 50)) for i in range(1000)]
    pack(tmp_path / "a.zip", [("d/", ""), *members])
    df = registered.read.format("textloom_archive").option("tasks", 4).load(str(tmp_path / "a.zip"))
    assert df.rdd.getNumPartitions() == 4
    rows = df.orderBy("place").collect()
    assert [(r.name, bytes(r.content).decode(), r.size, r.error) for r in rows] == [(n, c, len(c), None) for n, c in members]
    assert [r.place for r in rows] == list(range(1, 1001))
    per_task = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) == 4 and max(per_task) < 400


def test_lost_members_and_archives(registered, tmp_path):
    pack(tmp_path / "a.zip", [("x.txt", "x" * 500), ("y.txt", "y" * 500)])
    data = bytearray((tmp_path / "a.zip").read_bytes())
    data[data.index(b"x.txt") + 6] ^= 0xFF
    (tmp_path / "a.zip").write_bytes(data)
    (tmp_path / "b.zip").write_bytes(b"no archive")
    pack(tmp_path / "c.ZIP", [])
    (tmp_path / "d.txt").write_text("other")
    rows = registered.read.format("textloom_archive").load(str(tmp_path)).orderBy("archive", "place").collect()
    assert [(r.name, r.error is None) for r in rows] == [("x.txt", False), ("y.txt", True), (None, False)]
    assert bytes(rows[1].content) == b"y" * 500 and "BadZipFile" in rows[2].error
    assert registered.read.format("textloom_archive").load(str(tmp_path / "none.zip")).first().error.startswith("FileNotFoundError")


def bundles(folder):
    out = {}
    for p in sorted(folder.glob("*.zip")):
        with zipfile.ZipFile(p) as z:
            for n in z.namelist():
                out.setdefault(n, []).append(z.read(n).decode())
    return out


def test_batch_commit(registered, tmp_path):
    rows = [(f"in/{i}.csv", f"# {i}", True, None) for i in range(25)] + [("bad.bin", None, False, "unsupported"), ("empty.md", "", True, None)]
    registered.createDataFrame(rows, RESULTS).repartition(3).write.format("textloom_bundle").mode("append").option("per_bundle", 4).save(str(tmp_path / "out"))
    assert {n: v for n, v in bundles(tmp_path / "out").items()} == {f"{i}.md": [f"# {i}"] for i in range(25)}
    assert len(list((tmp_path / "out").glob("bundle-*.zip"))) >= 7 and not list((tmp_path / "out").glob("*.part"))
    errors = [json.loads(x) for p in (tmp_path / "out" / "_errors").iterdir() for x in p.read_text().splitlines()]
    assert sorted((e["name"], e["error"]) for e in errors) == [("bad.bin", "unsupported"), ("empty.md", "Conversion failed")]


def test_names_repeat_within_a_bundle(registered, tmp_path):
    rows = [("a/x.csv", "1", True, None), ("b/x.md", "2", True, None), ("x", "3", True, None)]
    registered.createDataFrame(rows, RESULTS).coalesce(1).write.format("textloom_bundle").mode("append").save(str(tmp_path))
    assert bundles(tmp_path) == {"x.md": ["1"], "x_2.md": ["2"], "x_3.md": ["3"]}


def test_a_failed_task_leaves_nothing(registered, tmp_path):
    rows = registered.range(40).coalesce(1).select(
        F.col("id").cast("string").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise("text").alias("markdown"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error")
    )
    with pytest.raises(Exception, match="lost"):
        rows.write.format("textloom_bundle").mode("append").save(str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    w = archive_writer.BundleWriter({"path": str(tmp_path / "out")})
    w.write(iter([{"name": "a", "markdown": "x", "success": True, "error": None}]))  # its message is lost, as of a killed task
    w.abort([])
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]


def test_a_repeated_batch_is_written_once(registered, tmp_path):
    row = {"name": "a.md", "markdown": "x", "success": True, "error": None}
    bad = row | {"success": False, "error": "e"}
    for batch in (0, 1, 1, 0):
        w = archive_writer.BundleStreamWriter({"path": str(tmp_path)})
        w.commit([w.write(iter([row, bad])), w.write(iter([])), None], batch)
    w.abort([w.write(iter([row]))], 2)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["_batches", "_errors", "bundle-batch0-00000.zip", "bundle-batch1-00000.zip"]


def test_stream(registered, tmp_path):
    (tmp_path / "in").mkdir()
    registered.createDataFrame([("a.md", "A", True, None), ("b.md", None, False, "no")], RESULTS).write.json(str(tmp_path / "in" / "1"))
    stream = registered.readStream.schema(RESULTS).json(str(tmp_path / "in" / "*"))
    for _ in range(2):
        q = stream.writeStream.format("textloom_bundle").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
    assert bundles(tmp_path / "out") == {"a.md": ["A"]}
