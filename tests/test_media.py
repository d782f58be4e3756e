"""Sources, models and sinks of videos and images, with decoders and models made here; image kernels."""

import gzip
import io
import json
import pickle
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lumenline.functions import images
from lumenline.functions import text as T
from lumenline.sources import files

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def model(content):
    if content == b"bad":
        raise ValueError("no image")
    return [] if content == b"none" else [(float(content[i]), [content[i], 1.0]) for i in range(len(content))]


def crops(content):
    return [(float(c), bytes([c])) for c in content]


def test_sampled_names(spark, tmp_path):
    df = spark.createDataFrame([("t", 65.9, 0.12345), ("t", 3.0, None)], "title string, s double, sim double")
    names = df.select(files.sampled_frame_name(F.col("title"), F.col("s"), F.col("sim")).alias("name"))
    assert [r.name for r in names.collect()] == ["t_1m05s_sim_0.123.jpg", "t_0m03s_sim_0.000.jpg"]
    odd = spark.createDataFrame([("a_0m01s_sim_-0.500.jpg",), ("a_0m01s_sim_0.500.gif",), ("a_0m01s_sim_0.250.png",)], "name string")
    assert rows(files.parse_sampled_name(names.union(odd)).select("title", "timestamp", "similarity"), "similarity") == [
        ("t", "0m03s", 0.0), ("t", "1m05s", 0.123), ("a", "0m01s", 0.25),
    ]
    (tmp_path / "f").mkdir()
    for name, size in (("t_0m01s_sim_0.5.jpg", 1080), ("u_0m01s_sim_0.5.png", 720), ("note.txt", 1)):
        (tmp_path / "f" / name).write_bytes(pickle.dumps(size))
    found = files.scan_frame_images(spark, str(tmp_path / "f"), lambda c: (pickle.loads(c), 1920))
    assert rows(found.select("title", "similarity", "ok"), "title") == [("t", 0.5, True), ("u", 0.5, False)]


def test_faces(spark, tmp_path):
    (tmp_path / "faces").mkdir()
    for name, content in (("a.JPG", b"\x02\x09\x05"), ("b.jpeg", b"bad"), ("c.png", b"none"), ("d.txt", b"\x01")):
        (tmp_path / "faces" / name).write_bytes(content)
    found = files.scan_face_images(spark, str(tmp_path / "faces"), lambda: model)
    assert [(r.name, len(r.faces), r.error) for r in found.orderBy("name").collect()] == [("a.JPG", 3, None), ("b.jpeg", 0, "ValueError: no image"), ("c.png", 0, None)]
    gallery = files.build_gallery(found)
    assert rows(gallery) == [("a.JPG", [9.0, 1.0])]
    saved = {}
    assert files.write_gallery(gallery, "x.npz", saved.__setitem__) == 1
    (tmp_path / "x.npz").write_bytes(saved["x.npz"])
    assert [r.embedding for r in files.scan_embeddings(spark, str(tmp_path / "x.npz")).collect()] == [[9.0, 1.0]]
    with pytest.raises(ValueError, match="too many"):
        files.write_gallery(gallery, "x.npz", saved.__setitem__, most=0)
    frames = spark.createDataFrame([(1, bytearray(b"\x03\x07")), (2, bytearray(b""))], "fno int, frame binary")
    assert [(r.fno, r.place, bytes(r.crop)) for r in files.face_crops(frames, "frame", lambda: crops, 1).collect()] == [(1, 0, b"\x07")]


def test_readings(spark):
    df = spark.createDataFrame([(bytearray(b"ab"), bytearray(b"c")), (None, bytearray(b"d"))], "bin binary, raw binary")
    load = lambda: lambda c: (bytes(c).decode(), len(c) / 10)
    assert sorted(tuple(r.read) for r in files.two_path_recognised(df, "raw", "bin", load).collect() if r.read.bin) == [("ab", 0.2, "c", 0.1)]
    calls = []
    made = lambda: "engine"
    assert files.engine("k", made, calls.append) == files.engine("k", made, calls.append) == "engine" and calls == ["engine"]


def test_lookups_that_are_not_there(spark, tmp_path):
    gone = str(tmp_path / "gone")
    assert files.scan_literal(spark, gone).count() == 0 and files.scan_mapping(spark, gone).count() == 0
    assert files.scan_timeline(spark, gone) is None
    (tmp_path / "m.json").write_text('{"/a": "t"}')
    (tmp_path / "broken.json").write_text("not json")
    assert rows(files.scan_mapping(spark, str(tmp_path / "m.json"))) == [("/a", "t")]
    assert files.scan_mapping(spark, str(tmp_path / "broken.json")).count() == 0
    spark.createDataFrame([("/b", "u")], "key string, value string").createOrReplaceTempView("preloaded_mapping")
    assert rows(files.scan_mapping(spark, gone, "preloaded_mapping")) == [("/b", "u")]


def test_timeline(spark, tmp_path):
    seg = {"bin": " x ", "raw": "", "y0": 1}
    line = {"ep": "P01", "fps": 25.0, "step": 5, "paths": ["bin", "raw"], "points": [{"fno": 1, "t": 0.04, "ocr": True, "segs": [seg, {"bin": None, "raw": "y"}]}, {"fno": 2, "t": 0.08, "ocr": False, "segs": []}]}
    (tmp_path / "t.json").write_text(json.dumps(line, indent=1))
    got = files.scan_timeline(spark, str(tmp_path / "t.json")).select("ep", "pos", "fno", files.point_texts(F.col("segs")).alias("x"))
    assert rows(got, "pos") == [("P01", 0, 1, ["x", "y"]), ("P01", 1, 2, [])]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, None), ("a", 1, "x")], "k string, n int, t string")
    files.export_array(df, str(tmp_path / "array"), ["k"])
    part = next((tmp_path / "array").glob("*.gz"))
    assert json.loads(gzip.decompress(part.read_bytes())) == [{"k": "a", "n": 1, "t": "x"}, {"k": "b", "n": 2, "t": None}]
    assert len(list((tmp_path / "array").iterdir())) <= 2  # the file and its checksum
    files.export_array(df.limit(0), str(tmp_path / "none"), ["k"])
    assert json.loads(gzip.decompress((tmp_path / "none" / "array.json.gz").read_bytes())) == []
    files.write_report(df.agg(F.count("*").alias("n"), F.max("t").alias("t")), str(tmp_path / "report"))
    assert json.loads(spark.read.text(str(tmp_path / "report")).first()[0]) == {"n": 2, "t": "x"}
    with pytest.raises(ValueError, match="one row"):
        files.write_report(df, str(tmp_path / "two"))
    folder = str(tmp_path / "out")
    (tmp_path / "out").mkdir()

    def save(path, content):
        with open(path, "wb") as f:
            f.write(content)

    frames = spark.createDataFrame([("a.jpg", bytearray(b"1")), ("b.jpg", bytearray(b"2"))], "name string, image binary")
    assert files.write_images(frames, "name", "image", folder, lambda c: bytes(c) * 2, save) == 2
    assert (tmp_path / "out" / "b.jpg").read_bytes() == b"22"
    assert files.rotate(spark, folder, "old") == f"{folder}_old" and files.rotate(spark, folder, "old") is None
    (tmp_path / "out").mkdir()
    assert files.rotate(spark, folder, "old") == f"{folder}_old_1" and (tmp_path / "out_old" / "a.jpg").exists()


def test_image_kernels():
    rng = np.random.default_rng(0)
    mask = rng.random((30, 40)) < 0.35
    got = images.components(mask)
    seen, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):  # a plain flood
        if not seen[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 30 and 0 <= b < 40 and mask[a, b] and not seen[a, b]:
                    seen[a, b] = n
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert (got == seen).all()
    image = np.zeros((60, 300, 3), np.uint8)
    image[10:30, 20:40] = 255  # a glyph
    image[40:44, 100:104] = 255  # too small
    image[5:20, 60:290] = 255  # too wide
    x0, x1, out = images.glyphs(image, (0, 60))
    assert (x0, x1) == (8, 51) and (out == 255).sum() == 400
    assert images.glyphs(image, (40, 60)) is None and images.glyphs(image, (5, 5)) is None
    boxed = images.letterboxed(np.full((100, 100, 3), 9, np.uint8), 54, 96)
    assert boxed.shape == (54, 96, 3) and (boxed[:, 21:75] == 9).all() and not boxed[:, :21].any() and not boxed[:, 75:].any()
    assert images.at_most(np.zeros((10, 20)), 2000).shape == (10, 20) and images.at_most(np.zeros((100, 4000)), 2000).shape == (50, 2000)
    assert images.resized(np.arange(4, dtype=np.uint8).reshape(2, 2), 4, 4).tolist()[0] == [0, 0, 1, 1]
    lines = np.zeros((540, 960), np.uint8)
    lines[200:210, 300:500] = 255
    lines[400:440] = 255
    assert images.line_bands(lines, 0, 1080, most=0.5) == [(400, 420, 2000)]
    assert images.row_runs(np.array([4, 4, 0]), 0.1, 2, least_peak=5) == []
    npz = io.BytesIO()
    np.savez(npz, encodings=np.ones((2, 3)))
    assert T.edit_kind_of("abc", "abXc") == ("add", "+1 insert:->X", 1, 0, 0) and T.edit_kind_of("a", "a") == ("same", "", 0, 0, 0)
    assert T.edit_kind_of("abcdef", "xbcdefyz") == ("mixed", "replace:a->x;insert:->yz", 2, 0, 1)


def test_exports_of_many_parts(spark, tmp_path):
    n = 300_000
    df = spark.range(n).selectExpr("(id * 7919) % 300000 as k", "concat('v\"]:[', id) as v", "if(id % 3 = 0, null, id) as w").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.export_array(df, str(tmp_path / "a"), ["k"])
        files.export_literal(df, "k", "v", "X", str(tmp_path / "l"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    with gzip.open(tmp_path / "a" / "array.json.gz") as f:
        assert f.peek(1) and (got := json.load(f))
    assert [r["k"] for r in got] == list(range(n)) and got[0] == {"k": 0, "v": 'v"]:[0', "w": None}
    assert (tmp_path / "a" / "array.json.gz").read_bytes().count(b"\x1f\x8b\x08") >= 6  # members of several tasks
    text = (tmp_path / "l" / "literal.txt").read_text()
    found = json.loads(text.removeprefix("window.X = ").rstrip("; \n"))
    assert len(found) == n and found["0"] == 'v"]:[0' and files.scan_literal(spark, str(tmp_path / "l" / "*.txt")).count() == n
    assert files.scan_gzip_json(spark, str(tmp_path / "a" / "*.gz"), "k long, v string, w long").where("w is null").count() == n // 3
