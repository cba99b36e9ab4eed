import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointtide.sources import ply


@pytest.fixture(scope="module")
def with_ply(spark):
    spark.dataSource.register(ply.PlyDataSource)
    return spark


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_round_trip(with_ply, tmp_path, form, monkeypatch):
    spark = with_ply
    df = spark.createDataFrame([(float(i), i * 0.5, -1.0, 0.25 * i) for i in range(50)], "x double, y double, z double, opacity double")
    df.repartition(3).write.format("ply").mode("append").option("form", form).save(str(tmp_path))
    back = spark.read.format("ply").load(str(tmp_path))
    assert back.columns == ["path", "row", "x", "y", "z", "opacity"]
    assert df.exceptAll(back.select(*[F.col(c).cast("double") for c in df.columns])).count() == 0 and back.count() == 50


def test_schema_of_all_files(with_ply, tmp_path):
    """Properties that later files add are kept, and types are widened to what every file holds."""
    head = "ply\nformat ascii 1.0\nelement vertex 1\n{}end_header\n{}\n"
    for name, props, row in (("a", ["int x", "uchar red"], "2 7"), ("b", ["float red", "float x", "double late"], "0.5 1.25 3.5"), ("c", ["uint big", "short x"], "4000000000 -3")):
        (tmp_path / f"{name}.ply").write_text(head.format("".join(f"property {p}\n" for p in props), row))
    df = with_ply.read.format("ply").load(str(tmp_path))
    assert dict(df.dtypes) == {"path": "string", "row": "bigint", "x": "double", "red": "float", "late": "double", "big": "bigint"}
    assert [tuple(r)[2:] for r in df.orderBy("path").collect()] == [(2.0, 7.0, None, None), (1.25, 0.5, 3.5, None), (-3.0, None, None, 4000000000)]


def test_activation_and_sequence(with_ply, tmp_path):
    spark = with_ply
    data = [(f, float(r), 0.0, 0.0, 2.0, 0.1, 0.2, 0.3, -3.0, -4.0, -12.0, 2.0, 0.0, 0.0, 0.0) for f in (3, 4, 6) for r in range(4)]
    cols = ["frame", "x", "y", "z", "opacity", "f_dc_0", "f_dc_1", "f_dc_2", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]
    df = spark.createDataFrame(data, cols)
    out = ply.write_sequence(df, str(tmp_path)).collect()
    assert sorted(r["rows"] for r in out) == [4, 4, 4]
    seq = ply.sequence_of(spark.createDataFrame([(r["file"],) for r in out], "path string")).collect()
    assert sorted(r["frame"] for r in seq) == [3, 4]
    a = ply.activate(spark.read.format("ply").load(str(tmp_path))).first()
    assert a["active"] and np.isclose(a["o"], 1 / (1 + np.exp(-2))) and np.isclose(a["sx"], np.exp(-3), rtol=1e-6) and (a["qw"], a["qx"]) == (1.0, 0.0)
    with pytest.raises(ValueError):
        ply.write_sequence(df, str(tmp_path), source=str(tmp_path))
    bare = ply.activate(spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double")).first()
    assert bare["active"] and bare["o"] == 1.0 and bare["r"] == 0.5


def test_bad_files(tmp_path):
    p = tmp_path / "a.ply"
    for text in ("plx\n", "ply\nformat ascii 1.0\nelement face 1\nend_header\n", "ply\nformat ascii 1.0\nelement vertex 1\nproperty list uchar int a\nend_header\n", "ply\nformat ascii 1.0\n"):
        p.write_text(text)
        with pytest.raises(ValueError):
            ply.read_header(str(p))


def test_sidecars(spark, tmp_path):
    m = json.dumps({"frames": [{"frame": i, "chunk": "ab"[i // 2]} for i in range(4)]})
    got = ply.chunk_labels(spark.createDataFrame([(m,)], "json string")).orderBy("frame").collect()
    assert [r["fresh"] for r in got] == [True, False, True, False]
    (tmp_path / "b.tsv").write_text("0\t1\t1\n4\t1\t2\n")
    assert ply.births(spark, str(tmp_path / "b.tsv")).count() == 2
    (tmp_path / "c.tsv").write_text("0\tx\t1\n")
    with pytest.raises(Exception):
        ply.births(spark, str(tmp_path / "c.tsv")).collect()


def test_late_events_are_reported_and_the_stream_goes_on(spark, tmp_path):
    from pointtide.streaming.identity import run_to_table, track_identities

    kinds = "key bigint, at bigint, mark string"
    batches = [[(1, 10, "a"), (1, 12, "a"), (2, 5, "x")], [(1, 11, "a"), (1, 13, "a"), (1, 40, "a")], [(1, 41, "b"), (2, 6, "x")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{tmp_path}/{i}")
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    last = lambda t: t.groupBy("key", "generation", "first").agg(F.max_by(F.struct("last", "mark", "n"), "batch").alias("s"))
    out = run_to_table(spark, track_identities(stream, 20), "update", last).select("key", "generation", "first", "s.*").collect()
    assert {tuple(r) for r in out} == {(1, 0, 11, 11, "a", 1), (1, 1, 10, 13, "a", 3), (1, 2, 40, 40, "a", 1), (1, 3, 41, 41, "b", 1), (2, 1, 5, 6, "x", 2)}
