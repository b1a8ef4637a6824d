"""The gallery and the guest frames as Parquet tables.

A gallery's version is a manifest, a small file that names the folders of its tables. It is
created only if no other writer has created it, so of two writers one takes the number and the
other tries the next. Tables are written before their manifest: what a crash leaves is no version.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facejobs import schemas
from facejobs.sources.shared import delete

TABLES = {"members": schemas.MEMBERS, "embeddings": schemas.MEMBER_EMBEDDINGS, "sums": schemas.MEMBER_SUMS}


@dataclass(frozen=True)
class Gallery:
    """Enrolled people, and all their vectors.

    ``sums`` holds each person's vectors added up, from which enrolment goes on without reading
    them; None has it computed. ``stored`` and ``added`` are of a gallery that enrolment has
    extended: folders that hold its earlier vectors, and the rows to be written beside them.
    """

    members: DataFrame
    embeddings: DataFrame
    sums: DataFrame | None = None
    stored: tuple[str, ...] = ()
    added: DataFrame | None = None


def _fs(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file whole, unless it is there; whether it was created.

    By a hard link on local files and by a rename elsewhere, which never replaces a file on HDFS.
    Storage whose rename replaces files needs another way.
    """
    jvm = spark.sparkContext._jvm
    fs, target = _fs(spark, path)
    fs.mkdirs(target.getParent())
    fresh = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    out = fs.create(fresh, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() != "file":
            return bool(not fs.exists(target) and fs.rename(fresh, target))
        place = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
        try:
            jvm.java.nio.file.Files.createLink(place(target), place(fresh))
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True
    finally:
        fs.delete(fresh, False)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions, rising."""
    fs, root = _fs(spark, f"{path}/versions")
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())


def _manifest(spark: SparkSession, path: str, version: int) -> dict[str, list[str]]:
    return json.loads("".join(r["value"] for r in spark.read.text(f"{path}/versions/v{version}.json", wholetext=True).collect()))


def _write_tables(gallery: Gallery, path: str) -> dict[str, list[str]]:
    """Write the tables into folders of their own; the manifest that names them. The earlier
    vectors of an extended gallery are named again, not written again."""
    folder = f"data/{uuid.uuid4().hex}"
    extended = gallery.added is not None and gallery.stored and all(f.startswith(f"{path}/data/") for f in gallery.stored)
    tables = {"embeddings": gallery.added if extended else gallery.embeddings, "members": gallery.members}
    if gallery.sums is not None:
        tables["sums"] = gallery.sums
    for name, table in tables.items():
        table.write.parquet(f"{path}/{folder}/{name}")
    manifest = {name: [f"{folder}/{name}"] for name in tables}
    if extended:
        manifest["embeddings"] = [*(f.removeprefix(f"{path}/") for f in gallery.stored), *manifest["embeddings"]]
    return manifest


def _committed(spark: SparkSession, path: str, version: int, manifest: dict) -> bool:
    return put_if_absent(spark, f"{path}/versions/v{version}.json", json.dumps(manifest))


def _newest(spark: SparkSession, path: str) -> int:
    return max(_versions(spark, path), default=-1)


def write_gallery(gallery: Gallery, path: str) -> int:
    """Write a new version and return its number: the first that no other writer has taken.

    The version stands for itself, whatever others have written meanwhile; a change that must
    keep theirs goes through :func:`update_gallery`.
    """
    spark = gallery.members.sparkSession
    manifest = _write_tables(gallery, path)
    version = _newest(spark, path) + 1
    while not _committed(spark, path, version, manifest):
        version += 1
    return version


def update_gallery(spark: SparkSession, path: str, change: Callable[[Gallery], Gallery], attempts: int = 20) -> int:
    """Apply ``change`` to the newest version and write the result as the next; its number.

    If another writer has taken that number meanwhile, what was written is deleted and the change
    applied anew to the version that is then the newest, so no writer's change is lost.
    """
    for attempt in range(attempts):
        base = _newest(spark, path)
        manifest = _write_tables(change(read_gallery(spark, path, base)), path)
        if _committed(spark, path, base + 1, manifest):
            return base + 1
        delete(spark, f"{path}/{manifest['members'][0].rpartition('/')[0]}")
        time.sleep(min(2.0, 0.05 * 2**attempt))
    raise RuntimeError(f"other writers were first {attempts} times")


def gallery_version(spark: SparkSession, path: str, wanted: int | None = None) -> int:
    """``wanted`` if there is such a version, else the newest."""
    found = _versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no gallery in {path}")
    return wanted if wanted in found else found[-1]


def read_gallery(spark: SparkSession, path: str, version: int | None = None) -> Gallery:
    """A version, by default the newest."""
    if version is None:
        version = _newest(spark, path)
    if version < 0:
        raise FileNotFoundError(f"no gallery in {path}")
    manifest = _manifest(spark, path, version)
    tables = {name: spark.read.schema(TABLES[name]).parquet(*(f"{path}/{f}" for f in folders)) for name, folders in manifest.items()}
    return Gallery(tables["members"], tables["embeddings"], tables.get("sums"), tuple(f"{path}/{f}" for f in manifest["embeddings"]))


def purge_versions(spark: SparkSession, path: str) -> list[int]:
    """Delete all versions but the newest, and the tables that it doesn't name, so that removed
    people's vectors are gone; the versions' numbers. No writer may be at work meanwhile, as
    tables without a manifest yet are deleted too."""
    *old, newest = _versions(spark, path) or [-1]
    if newest < 0:
        return []
    kept = {f.rpartition("/")[0].rpartition("/")[2] for folders in _manifest(spark, path, newest).values() for f in folders}
    for v in old:
        delete(spark, f"{path}/versions/v{v}.json")
    fs, root = _fs(spark, f"{path}/data")
    for status in fs.listStatus(root):
        if status.getPath().getName() not in kept:
            fs.delete(status.getPath(), True)
    return old


def guest_file_names(guests: DataFrame) -> DataFrame:
    """Adds ``file_name`` and ``date`` from saved_at (UTC session), frame_index and guest_count."""
    name = F.concat(
        F.date_format("saved_at", "HHmmss-SSSSSS"), F.lit("_f"), F.col("frame_index").cast("string"), F.lit("_"), F.col("guest_count").cast("string"), F.lit("guests.jpg")
    )
    return guests.withColumn("file_name", name).withColumn("date", F.to_date("saved_at"))


def write_guest_frames(guests: DataFrame, path: str, run: str) -> None:
    """Write guest frames, original bytes, by date and run.

    ``run`` names the job, or the batch, whose frames these are. Its partitions are replaced, so a
    job that is tried again leaves the same table, and other runs' frames stay.
    """
    rows = guest_file_names(guests).withColumn("run", F.lit(run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "run").parquet(path)
