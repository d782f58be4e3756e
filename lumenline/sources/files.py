"""Sources and sinks: corpora of JSON arrays, script literals, compressed JSON, ledgers, file listings, media.

All paths are read by Spark, with explicit schemas; nothing is inferred.  Models and codecs are callables of the user's.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenline.functions import text as T

LINE = "timestamp string, similarity double, text string"
SEARCH = "f string, t string, s double, x string, d int"
POINT = "fno long, t double, white long, diff double, ocr boolean, segs array<struct<bin string, bin_score double, raw string, raw_score double, y0 int, y1 int, fill long, x0 int, x1 int>>"
TIMELINE = f"ep string, fps double, step int, paths array<string>, points array<struct<{POINT}>>"


def _or_none(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` gives, or None where its path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan_corpus(spark: SparkSession, folder: str, title_pattern: str | None = r"^\[P(0[1-9]|1[0-9]|2[0-5])\]") -> DataFrame:
    """(title, pos, timestamp, similarity, text): one JSON array a file; the title is its name, the position its place."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    raw = raw.select(F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))), r"\.json$", "").alias("title"), F.from_json("value", f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in LINE.split(', '))}>>").alias("a"))
    if title_pattern:
        raw = raw.where(F.col("title").rlike(title_pattern))
    return raw.select("title", F.posexplode("a").alias("pos", "line")).select("title", "pos", "line.*")


def scan_literal(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a script of the form ``window.X = {...};`` with string values; the braces are matched greedily.

    A file that is not there has no entries.
    """
    body = F.regexp_extract("value", r"(?s)=\s*(\{.*\})\s*;", 1)
    raw = _or_none(lambda: spark.read.text(path, wholetext=True))
    if raw is None:
        return spark.createDataFrame([], "key string, value string")
    return raw.select(F.explode(F.from_json(body, "map<string,string>")).alias("key", "value"))


def scan_mapping(spark: SparkSession, path: str, preloaded: str | None = None) -> DataFrame:
    """(key, value) of a JSON object of strings: the temporary view ``preloaded`` where there is one, else the file.

    A file that is missing or is no such object has no entries.
    """
    if preloaded and spark.catalog.tableExists(preloaded):
        return spark.table(preloaded).select("key", "value")
    raw = _or_none(lambda: spark.read.text(path, wholetext=True))
    if raw is None:
        return spark.createDataFrame([], "key string, value string")
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def scan_timeline(spark: SparkSession, path: str) -> DataFrame | None:
    """(ep, fps, pos, point fields) of timelines, one JSON object a file; None where there is no such file."""
    raw = _or_none(lambda: spark.read.schema(TIMELINE).option("multiLine", True).json(path))
    if raw is None:
        return None
    return raw.select("ep", "fps", "paths", F.posexplode("points").alias("pos", "point")).select("ep", "fps", "paths", "pos", "point.*")


def point_texts(segments: Column, paths: tuple[str, ...] = ("bin", "raw")) -> Column:
    """All non-blank readings of a point's segments in order, by segment and then by path."""
    texts = F.transform(segments, lambda s: F.array(*(F.trim(F.coalesce(s[p], F.lit(""))) for p in paths)))
    return F.filter(F.flatten(texts), lambda t: t != "")


def scan_embeddings(spark: SparkSession, path: str, name: str = "encodings") -> DataFrame:
    """(path, row, embedding) of the arrays ``name`` in npz files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as found:
                    rows = np.atleast_2d(found[name]).astype(np.float32)
                yield pd.DataFrame({"path": p, "row": np.arange(len(rows)), "embedding": list(rows)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, embedding array<float>")


def scan_gzip_json(spark: SparkSession, path: str, schema: str = SEARCH) -> DataFrame:
    """Rows of a gzip-compressed JSON array whose file name says nothing of it."""

    @F.pandas_udf("string")
    def unpacked(content: pd.Series) -> pd.Series:
        return content.map(lambda b: gzip.decompress(b).decode())

    fields = ", ".join(x.strip().replace(" ", ": ", 1) for x in schema.split(","))
    rows = F.from_json(unpacked("content"), f"array<struct<{fields}>>")
    return spark.read.format("binaryFile").load(path).select(F.inline(rows))


def scan_ledgers(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Rows of all matching ledgers with their file name; fields that a file lacks are null."""
    return spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("file", F.col("_metadata.file_name"))


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, name) of files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


def frame_names(names: DataFrame, name: str = "name") -> DataFrame:
    """(ep, ts, off, name) of valid frame names ``Pnn_XmYYs[+-Ns].jpg``."""
    pattern = r"^P(\d{1,2})_(\d+m\d+s)([+-]\d+s)?\.jpg$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    return names.where(F.col(name).rlike(pattern)).select(part(1).cast("int").alias("ep"), part(2).alias("ts"), part(3).alias("off"), F.col(name).alias("name"))


def sampled_frame_name(title: Column, seconds: Column, similarity: Column) -> Column:
    """``title_XmYYs_sim_0.123.jpg`` of a sampled frame; no similarity (no face) is 0."""
    return F.concat(title, F.lit("_"), T.format_ts(F.floor(seconds).cast("long")), F.lit("_sim_"), T.fixed(F.coalesce(similarity, F.lit(0.0)), 3), F.lit(".jpg"))


def parse_sampled_name(names: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with title, timestamp and similarity of ``title_XmYYs_sim_0.123`` names that end with .jpg or .png; others go.

    A title has no underscore.  A similarity with a sign is not recognised, so frames of negative ones are left out.
    """
    pattern = r"^([^_]+)_(\d+m\d+s)_sim_(\d+\.\d+)"
    part = lambda k: F.regexp_extract(name, pattern, k)
    real = F.col(name).rlike(pattern) & F.col(name).rlike(r"\.(jpg|png)$")
    return names.where(real).select("*", part(1).alias("title"), part(2).alias("timestamp"), part(3).cast("double").alias("similarity"))


def scan_frame_images(spark: SparkSession, folder: str, size: Callable[[bytes], tuple[int, int]], wanted: tuple[int, int] = (1080, 1920)) -> DataFrame:
    """(name, title, timestamp, similarity, content, ok) of a folder of sampled frames; ``ok`` where (height, width) is ``wanted``."""

    @F.pandas_udf("boolean")
    def fits(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: tuple(size(c)) == wanted)

    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return parse_sampled_name(files).withColumn("ok", fits("content"))


# --- models ------------------------------------------------------------------------------------------------------

_MODELS: dict[str, object] = {}
#: Models that a worker keeps: of earlier queries those used last, so that a worker that lives on doesn't fill up.
MOST_MODELS = 2


def engine(key: str, load: Callable[[], object], warm: Callable[[object], object] | None = None) -> object:
    """The worker's only model of this ``key``, made by ``load`` at its first use; ``warm`` is called on it once, before any row."""
    if key in _MODELS:
        _MODELS[key] = _MODELS.pop(key)  # used last
        return _MODELS[key]
    while len(_MODELS) >= MOST_MODELS:
        del _MODELS[next(iter(_MODELS))]
    model = load()
    if warm is not None:
        warm(model)
    _MODELS[key] = model
    return model


def two_path_recognised(crops: DataFrame, plain: str, binary: str, load: Callable[[], Callable[[bytes], tuple[str, float]]], warm: Callable[[object], object] | None = None) -> DataFrame:
    """``crops`` with ``read``: (bin, bin_score, raw, raw_score), what a model reads in the binarised and the plain crop.

    A null crop has no text and score 0.
    """
    key = uuid.uuid4().hex

    @F.pandas_udf("bin string, bin_score double, raw string, raw_score double")
    def read(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = engine(key, load, warm)
        one = lambda c: (None, 0.0) if c is None else model(c)
        for b, p in parts:
            yield pd.DataFrame([(*one(x), *one(y)) for x, y in zip(b, p, strict=True)], columns=["bin", "bin_score", "raw", "raw_score"])

    return crops.withColumn("read", read(F.col(binary), F.col(plain)))


def with_faces(
    images: DataFrame, column: str, load: Callable[[], Callable[[bytes], list[tuple[float, list[float]]]]], warm: Callable[[object], object] | None = None
) -> DataFrame:
    """``images`` with ``faces`` (area, embedding) and ``error``: an image that the model fails on has no faces and a message."""
    key = uuid.uuid4().hex

    @F.pandas_udf("faces array<struct<area: double, embedding: array<float>>>, error string")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = engine(key, load, warm)

        def one(content: bytes) -> tuple[list, str | None]:
            try:
                return [{"area": a, "embedding": [float(x) for x in e]} for a, e in model(content)], None
            except Exception as e:  # one bad image must not end the job
                return [], f"{type(e).__name__}: {e}"

        for s in parts:
            yield pd.DataFrame([one(c) for c in s], columns=["faces", "error"])

    return images.withColumn("_f", found(F.col(column))).select("*", "_f.*").drop("_f")


def scan_face_images(
    spark: SparkSession, folder: str, load: Callable[[], Callable[[bytes], list[tuple[float, list[float]]]]], warm: Callable[[object], object] | None = None
) -> DataFrame:
    """(name, faces, error) of the .jpg, .jpeg and .png files of a folder, in any case."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return with_faces(files.where(F.lower("name").rlike(r"\.(jpg|jpeg|png)$")), "content", load, warm).drop("content")


def build_gallery(images: DataFrame) -> DataFrame:
    """(name, embedding) of each image's largest face; images without one are left out."""
    largest = F.array_max(F.transform("faces", lambda f, i: F.struct(f["area"].alias("a"), (-i).alias("i"), f["embedding"].alias("e"))))
    return images.where(F.size("faces") > 0).select("name", largest["e"].alias("embedding"))


def face_crops(frames: DataFrame, column: str, load: Callable[[], Callable[[bytes], list[tuple[float, bytes]]]], most: int = 1, warm: Callable[[object], object] | None = None) -> DataFrame:
    """One row for each of a frame's ``most`` largest faces: the frame's columns, ``place`` and ``crop``; the model gives (area, crop)."""
    key = uuid.uuid4().hex
    kept = [c for c in frames.columns if c not in ("place", "crop")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = engine(key, load, warm)
        for pdf in batches:
            for i, content in enumerate(pdf[column]):
                for place, (_, crop) in enumerate(sorted(model(content), key=lambda f: -f[0])[:most]):
                    yield pdf.iloc[[i]][kept].assign(place=place, crop=crop)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(*kept).schema.fields)
    return frames.select(*kept).mapInPandas(run, f"{schema}, place int, crop binary")


def recognised(frames: DataFrame, column: str, load: Callable[[], Callable[[bytes], str | None]], warm: Callable[[object], object] | None = None) -> DataFrame:
    """``frames`` with ``text`` by a model that each worker loads, and warms, once."""
    key = uuid.uuid4().hex

    @F.pandas_udf("string")
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = engine(key, load, warm)
        for s in parts:
            yield s.map(model)

    return frames.withColumn("text", read(F.col(column)))


# --- sinks -------------------------------------------------------------------------------------------------------


def write_by_title(lines: DataFrame, folder: str) -> None:
    """A folder for each title, its rows in the order of time, as JSON lines."""
    sec = T.parse_ts(F.col("timestamp"))
    lines.withColumn("_sec", sec).repartition("title").sortWithinPartitions("title", "_sec").drop("_sec").write.mode("overwrite").partitionBy("title").json(folder)


def export_rows(df: DataFrame, path: str, order: list[str]) -> None:
    """One compressed JSON line a row in total order; the table itself stays Parquet."""
    df.orderBy(*order).select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def _one_file(lines: DataFrame, order: list[Column], path: str, name: str, head: str, tail: str, packed: bool) -> None:
    """``lines`` (value, and what orders it) as one file ``path``/``name``: a head, the values with commas between, a tail.

    The rows are sorted by range and each range is a part of its own, written by its task; so no task holds more than its
    part.  The parts are then joined on the file system in order, with a comma between those that have rows; compressed
    members join as they are.  The file takes its name when it is whole.
    """
    spark = lines.sparkSession
    jvm, parts = spark.sparkContext._jvm, f"{path.rstrip('/')}/_parts-{uuid.uuid4().hex}"
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = lines.orderBy(*order).select("value", place.alias("at")).select(F.concat(F.when(F.col("at") == 0, "").otherwise(","), "value").alias("value"))
    rows.write.option("compression", "gzip" if packed else "none").text(parts)
    folder, to = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    system = folder.getFileSystem(conf)
    made = sorted((f.getPath().getName(), f) for f in system.listStatus(folder) if f.getPath().getName().startswith("part-"))
    half = jvm.org.apache.hadoop.fs.Path(f"{parts}/whole")
    out = system.create(half, True)
    say = lambda text: out.write(bytearray(gzip.compress(text.encode(), mtime=0) if packed else text.encode()))
    say(head)
    # a part without rows is an empty file, or an empty member
    empty, first = 20 if packed else 0, True
    for _, f in made:
        if f.getLen() > empty:
            if not first:
                say(",")
            first = False
            held = system.open(f.getPath())
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, out, 1 << 20, False)
            held.close()
    say(tail)
    out.close()
    system.delete(to, False)
    system.rename(half, to)
    system.delete(folder, True)


def export_array(df: DataFrame, path: str, order: list[str]) -> None:
    """The rows as ONE compressed JSON array, the file ``path``/array.json.gz, in total order, nulls included."""
    rows = df.withColumn("value", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    _one_file(rows, [F.col(c) for c in order], path, "array.json.gz", "[", "]", True)


def write_report(figures: DataFrame, path: str) -> None:
    """A report of one row as one JSON object, nulls included."""
    row = figures.limit(2).collect()
    if len(row) != 1:
        raise ValueError("a report has one row")
    figures.select(F.to_json(F.struct(*figures.columns), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_images(frames: DataFrame, name: str, image: str, folder: str, encode: Callable[[bytes], bytes], save: Callable[[str, bytes], None]) -> int:
    """Encodes and saves each row's image as ``folder``/``name`` from the task that has it; returns how many were saved.

    A task that runs twice saves the same files again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, content in zip(pdf["name"], pdf["image"], strict=True):
                save(f"{folder.rstrip('/')}/{n}", encode(content))
            yield pd.DataFrame({"n": [len(pdf)]})

    made = frames.select(F.col(name).alias("name"), F.col(image).alias("image")).mapInPandas(run, "n long")
    return made.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_gallery(gallery: DataFrame, path: str, save: Callable[[str, bytes], None], name: str = "encodings", most: int = 1_000_000) -> int:
    """The embeddings, by name, as one npz file; returns how many.  The file is one value, so over ``most`` rows are refused."""
    rows = gallery.count()
    if rows > most:
        raise ValueError(f"{rows} embeddings are too many for one file")
    if rows:
        body = io.BytesIO()
        np.savez(body, **{name: np.array(gallery.orderBy("name").toArrow()["embedding"].to_pylist(), np.float32)})
        save(path, body.getvalue())
    return rows


def rotate(spark: SparkSession, folder: str, stamp: str) -> str | None:
    """Renames a folder that is there to ``folder_stamp`` (and a number while that is taken), so nothing is deleted; its new name."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    k, to = 0, f"{folder.rstrip('/')}_{stamp}"
    while system.exists(jvm.org.apache.hadoop.fs.Path(to)):
        k += 1
        to = f"{folder.rstrip('/')}_{stamp}_{k}"
    system.rename(path, jvm.org.apache.hadoop.fs.Path(to))
    return to


def export_literal(df: DataFrame, key: str, value: str, name: str, path: str) -> None:
    """``window.NAME = {...};`` of a lookup table, keys in order: the file ``path``/literal.txt."""
    bare = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    _one_file(df.select(F.concat(bare(F.col(key).cast("string")), F.lit(":"), bare(F.col(value))).alias("value"), F.col(key).alias("k")), [F.col("k")], path, "literal.txt", f"window.{name} = {{", "};", False)
