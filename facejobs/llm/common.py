"""What the operators of this package share: staged tables, text columns, Arrow batches."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name under which operators add their struct of results; unlikely to clash with a column.
RESULT = "__facejobs_result"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset (tests, local mode) is one made here.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="facejobs-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, and survives
    the loss of the executors that made it."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.staged_path = path
    return held


def discard(*staged: DataFrame) -> None:
    """Delete tables of :func:`stage` that nothing reads any more."""
    for df in staged:
        spark = df.sparkSession
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


#: Rows of a few numbers each that :func:`sized` lets Spark broadcast: about 10 MB, its own default.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, marked for broadcast if it is small; else joined by shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by bytes too, so that very long texts do not fill a worker."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20)),
    ):
        spark.conf.set(key, value)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of an Arrow column; null becomes the empty text."""
    return [x or "" for x in column.to_pylist()]


def struct(**columns: Iterable) -> pa.StructArray:
    arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()]
    return pa.StructArray.from_arrays(arrays, names=list(columns))


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece holds about ``most_bytes`` of ``column`` and one row at least."""
    for batch in batches:
        sizes = [len(x) if x else 0 for x in batch.column(column).to_pylist()]
        start = held = 0
        for k, n in enumerate(sizes):
            if k > start and held + n > most_bytes:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def crc_mod(doc_id: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def type_of(df: DataFrame, column: str) -> str:
    """The column's type as a schema string has it."""
    return df.schema[column].dataType.simpleString()


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Place of a public tokenizer file. ``folder`` is a parameter; by default the installed package's."""
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers
    except ImportError:
        if os.path.isdir("/opt/tokenizers"):
            return os.path.join("/opt/tokenizers", name)
        raise
    return public_tokenizers.path(name)


def trim(cache: dict, most: int) -> dict:
    """Start a worker's cache anew when it has grown past ``most`` entries."""
    if len(cache) > most:
        cache.clear()
    return cache


def log(*what: object) -> None:
    print(*what, file=sys.stderr)
