"""Video sources by path, with a codec made here that tells how it was used."""

import json
import os
import sys
from collections import Counter
from urllib.parse import unquote

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lumenline.sources import video

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Plain:
    """A file whose first line says frames and rate; each use is a line in a file beside it."""

    def __init__(self, path):
        self.path = unquote(path.removeprefix("file://").removeprefix("file:"))
        with open(self.path, "rb") as f:
            self.frames, self.fps = json.loads(f.readline())
        self.next, self.said = 0, []

    def seek(self, fno):
        self.said.append("seek")
        self.next = fno

    def grab(self):
        self.said.append("grab")
        self.next += 1
        return self.next <= self.frames

    def retrieve(self):
        self.said.append("retrieve")
        return (self.next - 1) / (self.fps or 1), b"f%d" % (self.next - 1)

    def at(self, seconds):
        fno = int(seconds * self.fps)
        return (fno, b"f%d" % fno) if fno < self.frames else None

    def close(self):
        if self.said:
            with open(os.path.join(os.path.dirname(self.path), "..", "log"), "a") as f:
                f.write(json.dumps([os.path.basename(self.path), os.getpid(), Counter(self.said)]) + "\n")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "v").mkdir()
    for name, about in (("[P01] a.mp4", [100, 10.0]), ("[P02] b.mp4", [7, 2.0]), ("[P03] c.mp4", [5, 0.0])):
        (tmp_path / "v" / name).write_text(json.dumps(about) + "\n")
    with open(tmp_path / "v" / "[P04] large.mp4", "ab") as f:
        f.write(b"[60000, 25.0]\n")
        f.truncate(3 << 30)  # beyond what a binary value can hold; sparse
    return tmp_path


def used(folder):
    try:
        with open(folder / "log") as f:
            return [json.loads(x) for x in f]
    finally:
        os.truncate(folder / "log", 0)


@pytest.fixture
def videos(spark, folder):
    return video.video_metadata(spark, str(folder / "v"), Plain).cache()


def test_metadata_without_contents(videos):
    got = sorted((r["name"], r["frames"], r["fps"], r["duration"]) for r in videos.collect())
    assert got == [("[P01] a.mp4", 100, 10.0, 10.0), ("[P02] b.mp4", 7, 2.0, 3.5), ("[P03] c.mp4", 5, 0.0, 0.0), ("[P04] large.mp4", 60000, 25.0, 2400.0)]


def test_a_large_video_is_several_tasks(spark, folder, videos):
    large = videos.where("name like '%large%'")
    got = video.frames(large, Plain, step=1000)
    assert got.rdd.getNumPartitions() == 6 and "content" not in got.columns
    assert [(r["fno"], r["t"], bytes(r["frame"])) for r in sorted(got.collect(), key=lambda r: r["fno"])] == [(n, n / 25, b"f%d" % n) for n in range(0, 60000, 1000)]
    log = used(folder)
    assert len(log) == 6 and sum(x[2]["grab"] for x in log) == 60000 and sum(x[2]["retrieve"] for x in log) == 60
    assert video.frames(large, Plain, step=1000, span=None).count() == 60
    assert [x[2].get("seek") for x in used(folder)] == [None]


def test_filters_reach_the_reader(spark, folder, videos):
    path = videos.where("name like '%large%'").first()["path"]
    got = video.frames(videos, Plain).where((F.col("path") == path) & F.col("fno").isin(20_005, 20_001, 45_000)).select("fno")
    assert sorted(r["fno"] for r in got.collect()) == [20_001, 20_005, 45_000]
    log = used(folder)
    assert {x[0] for x in log} == {"[P04] large.mp4"} and sum(x[2].get("retrieve", 0) for x in log) == 3 and len(log) == 2
    got = video.frames(videos, Plain).where("fno > 95 and fno <= 98 and t >= 9.7").select("fno")
    assert sorted(r["fno"] for r in got.where(F.col("path").contains("P01")).collect()) == [97, 98]
    assert video.frames(videos, Plain, begin=3, step=2).where("fno < 7 and path like '%P02%'").count() == 2


def test_wanted_frames_and_times(spark, folder, videos):
    paths = {r["name"][1:4]: r["path"] for r in videos.collect()}
    asked = [(paths["P01"], 7), (paths["P01"], 3), (paths["P01"], 7), (paths["P02"], 99), (paths["P04"], 59_999), (paths["P04"], 12), (paths["P01"], -4)]
    got = video.wanted_frames(spark.createDataFrame(asked, "path string, fno long"), Plain)
    assert sorted((r["path"][-7:], r["fno"], bytes(r["frame"])) for r in got.collect()) == sorted(
        (p[-7:], n, b"f%d" % n) for p, n in {(paths["P01"], 3), (paths["P01"], 7), (paths["P04"], 12), (paths["P04"], 59_999)}
    )
    log = used(folder)
    assert sum(x[2].get("retrieve", 0) for x in log) == 4 and sum(x[0] == "[P04] large.mp4" for x in log) == 2 and not any("P03" in x[0] for x in log)
    times = spark.createDataFrame([(paths["P01"], 2.0), (paths["P01"], -1.0), (paths["P02"], 60.0), (paths["P04"], 2000.04)], "path string, t double")
    assert sorted((r["fno"], r["t"]) for r in video.frames_at_times(times, Plain).collect()) == [(20, 2.0), (50_001, 2000.04)]


def test_frames_at_rate(videos):
    numbers = lambda name, **how: [r["fno"] for r in video.frames_at_rate(videos.where(f"name like '%{name}%'"), Plain, **how).orderBy("fno").collect()]
    assert numbers("P01", fps=0.25) == [0, 40, 80]
    assert numbers("P01", fps=0.25, start=5.0) == [80]
    assert numbers("P02", fps=9) == list(range(7))
    assert numbers("P02", fps=1, start=100.0) == [] and numbers("P04", fps=0.001) == [0, 25000, 50000]


def test_no_videos(spark):
    none = spark.createDataFrame([], "path string, frames long, fps double")
    assert video.frames(none, Plain).count() == video.frames_at_rate(none, Plain).count() == 0
    assert video.wanted_frames(spark.createDataFrame([], "path string, fno long"), Plain).count() == 0
