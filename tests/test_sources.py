import json
import time

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sondeflow.sources import files, wells
from sondeflow.streaming import causal


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "w1__horizontal_well.csv").write_text("MD,X,Y,Z,TVT,GR,TVT_input\n1,0,0,0,5,10,5\n2,1,0,0,6,,6\n3,2,0,0,7,nan,\n4,3,0,0,8,12,\n")
    (tmp_path / "train" / "w2__x__horizontal_well.csv").write_text("GR,MD,X,Y,Z,TVT_input\n1,1,0,0,0,3\n2,2,0,0,0,4\n")
    (tmp_path / "train" / "w1__typewell.csv").write_text("TVT,GR,Geology\n1,2,ANCC\n2,3,\n")
    (tmp_path / "train" / "notes.csv").write_text("a,b\n1,2\n")
    return str(tmp_path)


def test_base_table(spark, folder):
    rows = {(r.well_id, r.row_idx): r for r in wells.base_table(spark, folder, "train").collect()}
    assert len(rows) == 6 and len(wells.base_table(spark, folder, "train").columns) == 30
    a = rows[("w1", 2)]
    assert (a.ps_idx, a.n_rows_in_well, a.hidden_length, a.is_target, a.GR, a.is_gr_missing, a.last_known_TVT, a.delta_MD_from_PS, a.post_ps_step, a.id) == (2, 4, 2, True, None, True, 6.0, 1.0, 0, None)
    b = [r for (w, _), r in rows.items() if w != "w1"]
    assert {r.TVT for r in b} == {None} and {r.hidden_length for r in b} == {0} and {r.GR for r in b} == {1.0, 2.0}
    t = wells.typewell_table(spark, folder, "train").orderBy("row_idx").collect()
    assert [(r.TVT, r.GR, r.Geology, r.row_frac) for r in t] == [(1, 2, "ANCC", 0), (2, 3, None, 1)]


def test_inventory(spark, folder):
    got = {(r.well_id, r.table_type): (r.n_rows, r.n_cols) for r in wells.inventory(spark, folder, ["train"]).collect()}
    assert got == {("w1", "horizontal_well"): (4, 7), ("w2__x", "horizontal_well"): (2, 6), ("w1", "typewell"): (2, 3)}


def test_quoted_fields(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "w1__typewell.csv").write_text('TVT,"Geology",GR\n1,"sand, fine",2\n"2","a ""b""",3\n')
    rows = wells.raw(spark, str(tmp_path), "train", "typewell").orderBy("line").collect()
    assert [(r.TVT, r.GR, r.Geology) for r in rows] == [(1, 2, "sand, fine"), (2, 3, 'a "b"')]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string")
    facts = files.write_with_facts(df, str(tmp_path / "t.parquet"), ["s"])
    assert facts["rows"] == 2 and json.loads(spark.read.text(str(tmp_path / "t.parquet.meta.json")).first()[0])["rows"] == 2
    assert files.read_table(spark, str(tmp_path / "t.parquet"), ["s"]).columns == ["s"]
    assert files.content_hash(df, ["k", "s"]) == files.content_hash(df.orderBy(F.desc("k")), ["k", "s"]) != files.content_hash(df.limit(1), ["k", "s"])
    with pytest.raises(ValueError):
        files.read_table(spark, "x.docx")
    np.save(tmp_path / "a.npy", np.array([1.5, 2.5]))
    np.savez(tmp_path / "b.npz", p=np.array([[1, 2]]), q=np.array([3]))
    got = {(r.name, r.place, r.value) for r in files.read_arrays(spark, str(tmp_path / "*.np*")).collect()}
    assert got == {("", 0, 1.5), ("", 1, 2.5), ("p", 0, 1.0), ("p", 1, 2.0), ("q", 0, 3.0)}
    (tmp_path / "s.json").write_text('{"a": [1]}')
    assert files.read_settings(spark, str(tmp_path / "s.json")) == {"a": [1]}
    assert files.as_markdown(df).splitlines()[0] == "| k | s |"


def test_submission(spark):
    sample = spark.createDataFrame([("a",), ("b",)], "id string")
    p = spark.createDataFrame([("a", 1.0)], "id string, g double")
    assert {r.id: r.tvt for r in files.submission(sample, p, "id", "g", 0.5).collect()} == {"a": 1.0, "b": 0.5}
    with pytest.raises(ValueError, match="1 ids"):
        files.submission(sample, p, "id", "g")


def until(q, name, n):
    """Wait for n rows of a memory table; with timeouts by the clock a stream itself never comes to rest."""
    began = time.time()
    while time.time() - began < 60 and SparkSession.getActiveSession().table(name).count() < n:
        time.sleep(0.3)
    q.stop()


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(k, i, float(i * (k + 1))) for k in range(2) for i in range(6)]
    for part in (0, 3):
        spark.createDataFrame([r for r in rows if part <= r[1] < part + 3], "k long, i long, v double").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("k long, i long, v double").option("maxFilesPerTrigger", 1).parquet(src)
    q = causal.trailing_means(stream, "k", "i", "v", 3).writeStream.format("memory").queryName("means").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    until(q, "means", 12)
    got = {(r.k, r.i): r.mean for r in spark.table("means").collect()}
    assert len(got) == 12 and got[(0, 5)] == 4.0 and got[(1, 2)] == 2.0


def test_time_windows(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:05", 1.0), (1, "2024-01-01 00:00:50", 3.0), (1, "2024-01-01 00:05:00", 5.0)], "k long, t string, v double").withColumn("t", F.to_timestamp("t"))
    assert sorted((r.n, r.mean) for r in causal.tumbling(e, "t", "1 minute", "1 minute", ["k"], "v").collect()) == [(1, 5.0), (2, 2.0)]
    assert sorted(r.n for r in causal.sessions(e, "t", "2 minutes", "1 minute", ["k"]).collect()) == [1, 2]


def test_more_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,a,c\n1,2,x\nbad,3,y\n")
    rows = files.read_table(spark, str(tmp_path / "t.csv"), schema="a int, b double").orderBy("a").collect()
    assert [(r.a, r.b, r.c) for r in rows] == [(2, 1.0, "x"), (3, None, "y")]
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, s string")
    files.write_csv(df, str(tmp_path / "o.csv"), one_file=True)
    assert files.read_table(spark, str(tmp_path / "o.csv"), schema="k long").orderBy("k").collect()[0].k == 1
    files.write_json(df, str(tmp_path / "o.json"))
    assert sorted(r.k for r in files.read_table(spark, str(tmp_path / "o.json")).collect()) == [1, 2]
    files.write_settings(spark, {"a": [1, 2]}, str(tmp_path / "s.json"))
    assert files.read_settings(spark, str(tmp_path / "s.json")) == {"a": [1, 2]}
    (tmp_path / "s.yaml").write_text("a: [1, 2]\nb: x\n")
    pytest.importorskip("yaml")
    assert files.read_settings(spark, str(tmp_path / "s.yaml")) == {"a": [1, 2], "b": "x"}


def test_roots_and_resuming(spark, tmp_path):
    (tmp_path / "two" / "raw").mkdir(parents=True)
    assert files.first_root(spark, [str(tmp_path / "one"), str(tmp_path / "two")], ["raw"]) == str(tmp_path / "two")
    with pytest.raises(FileNotFoundError):
        files.first_root(spark, [str(tmp_path / "one")], ["raw"])
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert [files.resumed(spark, str(tmp_path / "r"), make).count() for _ in range(2)] == [3, 3] and made == [1]


def test_filled_submission(spark):
    sample = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    base = spark.createDataFrame([("a", 10.0), ("b", 20.0)], "id string, anchor double")
    delta = spark.createDataFrame([("a", 1.5)], "id string, d double")
    assert {r.id: r.tvt for r in files.filled_submission(sample, base, delta, "id", "anchor", "d", -1.0).collect()} == {"a": 11.5, "b": 20.0, "c": -1.0}


def test_contours(spark, tmp_path):
    image = np.zeros((6, 4, 3), np.uint8)
    image[2, 1], image[4, 1], image[5, 3] = (250, 10, 0), (255, 0, 0), (255, 0, 0)
    (tmp_path / "i.ppm").write_bytes(b"P6\n# a line\n4 6\n255\n" + image.tobytes())
    assert sorted((r.column, r.row) for r in files.read_contours(spark, str(tmp_path / "*.ppm"), (255, 0, 0)).collect()) == [(1, 3.0), (3, 5.0)]


def test_stream_with_nulls_and_places(spark, tmp_path):
    from sondeflow.operators import tracking
    from sondeflow.operators import windows as W
    from pyspark.sql.window import Window
    import pandas as pd

    src = str(tmp_path / "in")
    rows = [(k, i, None if i % 3 == 1 else float(10 * i + k)) for k in range(2) for i in range(9)]
    for part in (0, 4):
        spark.createDataFrame([r for r in rows if part <= r[1] < part + 4 + (part > 0)], "k long, i long, v double").coalesce(1).write.mode("append").parquet(src)

    def ran(make, name):
        stream = spark.readStream.schema("k long, i long, v double").option("maxFilesPerTrigger", 1).parquet(src)
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        until(q, name, len(rows))
        return {(r.k, r.i): r[3] for r in spark.table(name).collect()}

    got = ran(lambda s: causal.trailing_means(s, "k", "i", "v", 3), "with_nulls")
    batch = spark.read.parquet(src).select("k", "i", W.rolling_mean(F.col("v"), Window.partitionBy("k").orderBy("i"), 3).alias("m"))
    assert got == {(r.k, r.i): r.m for r in batch.collect()}
    x, y = list(map(float, range(20))), [float(7 * i % 45) for i in range(20)]
    got = ran(lambda s: causal.places(s, (x, y), "k", "i", "v", 5.0), "places")
    for k in range(2):
        pdf = pd.DataFrame({"gr": [v for a, _, v in rows if a == k], "start": 5.0}).dropna()
        want = tracking.greedy_match()(pdf, np.array(x), np.array(y), None)[0]
        assert [got[(k, i)] for i in range(9) if i % 3 != 1] == list(want)


def _as_png(pixels, colour, way, palette=None):
    """A PNG of the pixels (rows, columns, samples), each line stored by one of the five ways, by their definition."""
    import struct
    import zlib

    height, width, samples = pixels.shape
    p, lines = pixels.astype(int), []
    for y in range(height):
        out = []
        for x in range(width):
            for s in range(samples):
                a, b, c = (p[y, x - 1, s] if x else 0), (p[y - 1, x, s] if y else 0), (p[y - 1, x - 1, s] if x and y else 0)
                paeth = min(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))[2]
                out.append((p[y, x, s] - (0, a, b, (a + b) // 2, paeth)[way]) % 256)
        lines.append(bytes([way, *out]))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    data = zlib.compress(b"".join(lines))
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0))] + ([chunk(b"PLTE", palette)] if palette else []) + [chunk(b"IDAT", data[:20]), chunk(b"IDAT", data[20:]), chunk(b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(parts)


@pytest.mark.parametrize("colour, samples", [(0, 1), (2, 3), (4, 2), (6, 4)])
@pytest.mark.parametrize("way", range(5))
def test_png_lines(colour, samples, way):
    pixels = np.random.default_rng(way).integers(0, 256, (7, 9, samples)).astype(np.uint8)
    want = pixels[:, :, :3] if samples > 2 else np.repeat(pixels[:, :, :1], 3, axis=2)
    assert (files._png(_as_png(pixels, colour, way)) == want).all()


def test_contours_of_png(spark, tmp_path):
    """A drawn line in a palette image and in colours comes back as it was drawn."""
    line = [3, 4, 6, 6, 5, 2, 1, 0]
    index = np.zeros((8, 8, 1), np.uint8)
    for x, y in enumerate(line):
        index[y, x] = 1
    (tmp_path / "a.png").write_bytes(_as_png(index, 3, 4, bytes([255, 255, 255, 250, 10, 5])))
    colours = np.full((8, 8, 3), 255, np.uint8)
    colours[index[:, :, 0] == 1] = (250, 10, 5)
    (tmp_path / "b.png").write_bytes(_as_png(colours, 2, 3))
    got = files.read_contours(spark, str(tmp_path / "*.png"), (255, 0, 0)).collect()
    for name in ("a.png", "b.png"):
        assert sorted((r.column, r.row) for r in got if r.path.endswith(name)) == [(x, float(y)) for x, y in enumerate(line)]
    with pytest.raises(ValueError, match="damaged"):
        files._png(_as_png(index, 3, 0, bytes(6)).replace(b"IDAT", b"IDAX", 1))
