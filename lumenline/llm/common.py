"""Shared plumbing of the corpus operators: tables, the shared folder, exact text rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the ``documents`` table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the input folder; only Spark's reader opens it, so the folder can be in any store."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text"):
    """A null text counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, one machine (tests) makes a temporary folder and remembers it in the session; a cluster is refused,
    since its executors would write where no one else reads.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lumenline.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenline-")
        spark.conf.set("lumenline.shared.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: lineage ends there.

    A lost executor then costs a read of the file, not a new run of all that came before.  ``by`` names a column of few
    values by which the files are kept apart, so that a filter on it reads only its own.
    """
    spark = df.sparkSession
    name = f"{label}-{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    if (scratch := _SCRATCH.get()) is not None:
        scratch.append(name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession):
    """The shared folder as a path of the JVM, and its file system."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, names: set[str]) -> None:
    folder, system = _folder(spark)
    for name in names:
        system.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, name), True)


def forget(spark: SparkSession, *done: DataFrame) -> None:
    """Delete the files behind tables made by :func:`written`, once nothing reads them any more."""
    folder, system = _folder(spark)
    root = system.makeQualified(folder).toUri().getPath().rstrip("/") + "/"
    _delete(spark, {f.split(root, 1)[1].split("/", 1)[0] for df in done for f in df.inputFiles() if root in f})


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what :func:`written` made inside it, but for names taken out of the list it gives."""
    names: list[str] = []
    token = _SCRATCH.set(names)
    try:
        yield names
    finally:
        _SCRATCH.reset(token)
        _delete(spark, set(names))


def sql_crc32(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a string's UTF-8 bytes: bit by bit, as DuckDB has no such function."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    bits = f"flatten(list_transform(range(octet_length(encode({text}))), lambda i: list_transform(range(8), lambda k: ({byte} >> k) & 1)))"
    step = "lambda c, b: xor(c >> 1, CASE WHEN (c & 1) <> b THEN 3988292384::BIGINT ELSE 0::BIGINT END)"
    return f"xor(list_reduce({bits}, {step}, 4294967295::BIGINT), 4294967295::BIGINT)"
