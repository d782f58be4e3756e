"""Frames of videos, by path: a data source that plans splits of frame ranges, and reads of wanted frames and times.

A codec is the caller's: ``open_(path)`` gives a :class:`Capture`.  Contents never pass through Spark, so a video has no size
limit, and only frames that are asked for are decoded; the others are grabbed, which moves on without decoding.  A video
longer than ``span`` frames is several tasks' work: each begins with one seek, which must land on the frame exactly (a codec
whose seeks don't is given ``span`` = None, and a video is read in one pass without any).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lumenline.sources.files import listing

FRAME = "path string, fno long, t double, frame binary"
NAMES = ["path", "fno", "t", "frame"]
#: Frames of a split, and bytes of frames that leave a task at a time.
SPAN, BATCH_BYTES = 10_000, 16 << 20


class Capture(Protocol):
    """An open video: its next frame is grabbed, and decoded only if it is retrieved."""

    frames: int
    fps: float

    def seek(self, fno: int) -> None: ...  # the next frame to be grabbed
    def grab(self) -> bool: ...  # False after the last
    def retrieve(self) -> tuple[float, bytes]: ...  # seconds and image of the frame that was grabbed last
    def at(self, seconds: float) -> tuple[int, bytes] | None: ...  # number and image of the frame that a seek by time finds
    def close(self) -> None: ...


Open = Callable[[str], Capture]
Frame = tuple[str, int, float, bytes]


def _batches(frames: Iterable[Frame]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for f in frames:
        held.append(f)
        size += len(f[3])
        if size >= BATCH_BYTES:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(held: list[Frame]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.float64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=NAMES)


def _read(open_: Open, path: str, begin: int, end: int, wanted: Callable[[int], bool]) -> Iterator[Frame]:
    """The wanted frames from ``begin`` up to ``end``, in one pass that ends where the video does."""
    video = open_(path)
    try:
        if begin:
            video.seek(begin)
        for fno in range(begin, end):
            if not video.grab():
                return
            if wanted(fno):
                yield path, fno, *video.retrieve()
    finally:
        video.close()


@dataclass
class Split(InputPartition):
    path: str
    begin: int
    end: int


class _Reader(DataSourceReader):
    """Filters on path and frame number choose the splits, and the frames that are decoded in them."""

    def __init__(self, open_: Open, options: dict):
        self.open_ = open_
        self.videos = json.loads(options["videos"])
        self.step, self.begin = int(options.get("step", 1)), int(options.get("begin", 0))
        self.span = int(options["span"]) if options.get("span") else None
        self.end: int | None = None
        self.paths: set[str] | None = None
        self.numbers: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("path",) and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = own if self.paths is None else self.paths & own
            elif column == ("fno",) and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.numbers = own if self.numbers is None else self.numbers & own
            elif column == ("fno",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.begin = max(self.begin, f.value + isinstance(f, GreaterThan))
            elif column == ("fno",) and isinstance(f, (LessThan, LessThanOrEqual)):
                end = f.value + isinstance(f, LessThanOrEqual)
                self.end = end if self.end is None else min(self.end, end)
            else:
                yield f

    def partitions(self) -> list[Split]:
        splits = []
        for path, frames in self.videos:
            if self.paths is not None and path not in self.paths:
                continue
            end = frames if self.end is None else min(frames, self.end)
            begin = max(0, self.begin)
            if self.numbers is not None:
                near = [n for n in self.numbers if n is not None and begin <= n < end]
                begin, end = (min(near), max(near) + 1) if near else (0, 0)
            if self.span is None:
                splits += [Split(path, 0, end)] if end > begin else []
            else:
                cuts = [Split(path, b, min(end, b + self.span)) for b in range(begin, end, self.span)]
                splits += [s for s in cuts if self.numbers is None or any(s.begin <= n < s.end for n in self.numbers)]
        return splits

    def read(self, split: Split | None) -> Iterator[pa.RecordBatch]:
        if split is None:  # what Spark reads where there are no splits
            return
        wanted = lambda n: n >= self.begin and n % self.step == 0 and (self.numbers is None or n in self.numbers)
        yield from _batches(_read(self.open_, split.path, split.begin, split.end, wanted))


def register(spark: SparkSession, open_: Open, name: str = "video_frames") -> str:
    """Registers a data source of this codec; its options are videos (JSON of path and frames), step, begin and span."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return FRAME

        def reader(self, schema) -> DataSourceReader:
            return _Reader(open_, self.options)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)
    return name


def video_metadata(spark: SparkSession, folder: str, open_: Open, glob: str = "*") -> DataFrame:
    """(path, name, frames, fps, duration) of a folder's videos, opened but not read; a rate of 0 has duration 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path in b.column("path").to_pylist():
                video = open_(path)
                found.append((video.frames, float(video.fps)))
                video.close()
            frames, fps = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("name"), pa.array(frames, pa.int64()), pa.array(fps, pa.float64())], names=["path", "name", "frames", "fps"])

    paths = listing(spark, folder, glob)
    probed = paths.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "path string, name string, frames long, fps double")
    return probed.withColumn("duration", F.coalesce(F.try_divide("frames", "fps"), F.lit(0.0)))


def frames(videos: DataFrame, open_: Open, step: int = 1, begin: int = 0, span: int | None = SPAN) -> DataFrame:
    """(path, fno, t, frame): each ``step``-th frame from ``begin`` on of ``videos`` (path, frames), as splits of ``span`` frames.

    The list of videos goes through the driver, as any scan's list of files does.  Filters on path and fno reach the splits.
    """
    spark = videos.sparkSession
    listed = json.dumps([(r["path"], r["frames"]) for r in videos.select("path", "frames").toLocalIterator()])
    reader = spark.read.format(register(spark, open_)).option("videos", listed).option("step", str(step)).option("begin", str(begin))
    return (reader.option("span", str(span)) if span else reader).load()


def frames_at_rate(videos: DataFrame, open_: Open, fps: float = 1.0, start: float | None = None, span: int | None = SPAN) -> DataFrame:
    """(path, fno, t, frame) of about ``fps`` frames a second from second ``start`` on of ``videos`` (path, frames, fps)."""
    every = F.greatest(F.lit(1), F.floor(F.col("fps") / fps)).cast("long")
    first = F.floor(F.col("fps") * (start or 0.0)).cast("long")
    first = F.ceil(first / every).cast("long") * every
    numbers = F.when(first < F.col("frames"), F.sequence(first, F.col("frames") - 1, every)).otherwise(F.array().cast("array<bigint>"))
    return wanted_frames(videos.select("path", F.explode(numbers).alias("fno")), open_, span)


def _each(lists: DataFrame, of: Callable[[str, list], Iterator[Frame]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, wanted in zip(b.column("path").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                yield from _batches(of(path, wanted))

    return lists.select("path", "wanted").mapInArrow(run, FRAME)


def wanted_frames(wanted: DataFrame, open_: Open, span: int | None = SPAN) -> DataFrame:
    """(path, fno, t, frame) of the frames in ``wanted`` (path, fno): one pass for each video and ``span`` of frames that has any.

    A pass begins with a seek to the first frame of its span and ends with the last that is wanted.  Videos without any are
    not opened; numbers under 0 and past the end have no frame.
    """
    part = F.floor(F.col("fno") / span) if span else F.lit(0)
    lists = wanted.where("fno >= 0").groupBy("path", part.alias("part")).agg(F.array_sort(F.collect_set(F.col("fno").cast("long"))).alias("wanted"))

    def of(path: str, numbers: list[int]) -> Iterator[Frame]:
        left = set(numbers)
        begin = numbers[0] // span * span if span else 0
        return _read(open_, path, begin, numbers[-1] + 1, left.__contains__)

    return _each(lists, of)


def frames_at_times(wanted: DataFrame, open_: Open, seconds: float = 600.0) -> DataFrame:
    """(path, fno, t, frame) of the frame that a seek finds at each second in ``wanted`` (path, t); times before 0 have none.

    A video is opened once for each stretch of so many ``seconds`` that has any; ``t`` is the time asked for.
    """
    part = F.floor(F.col("t") / seconds)
    lists = wanted.where("t >= 0").groupBy("path", part.alias("part")).agg(F.array_sort(F.collect_set(F.col("t").cast("double"))).alias("wanted"))

    def of(path: str, times: list[float]) -> Iterator[Frame]:
        video = open_(path)
        try:
            for t in times:
                if (found := video.at(t)) is not None:
                    yield path, found[0], t, found[1]
        finally:
            video.close()

    return _each(lists, of)
