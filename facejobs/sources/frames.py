"""Requests and frames: exploding batches, decoding payloads, validation, the detector's scaffold."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facejobs.schemas import UNKNOWN
from facejobs.sources.shared import BROADCAST_ROWS, new_path, sized, stage


def explode_frames(batches: DataFrame, images: str = "images") -> DataFrame:
    """One row per image of each batch, numbered from 0 as ``frame_index``; the text is ``payload``.

    Batches without images give no rows.
    """
    rest = [c for c in batches.columns if c != images]
    return batches.select(*rest, F.posexplode(images).alias("frame_index", "payload"))


def read_image_files(spark: SparkSession, path: str, chunk: int = BROADCAST_ROWS) -> DataFrame:
    """(person_id, image_index, image): files below ``path``, one folder per person, in path order.

    Files are numbered from their paths alone, which Spark lists on the driver anyhow; then each
    is read once, where it lies, and meets its number by a broadcast. Where there are more than
    ``chunk`` files, each chunk of people reads its own folders with its own numbers; only a
    person of more files than that is a larger chunk.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    person = F.url_decode(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    order = Window.partitionBy("person_id").orderBy("path")
    paths = files.select(person.alias("person_id"), "path").withColumn("image_index", F.row_number().over(order) - 1)
    paths = stage(paths, "image-paths")
    counts = paths.groupBy("person_id").agg(F.count("*").alias("n")).orderBy("person_id").collect()  # a row per folder that Spark has listed
    if sum(r["n"] for r in counts) <= chunk:
        return files.select("path", F.col("content").alias("image")).join(F.broadcast(paths), "path").select("person_id", "image_index", "image")
    chunks, held = [[]], 0
    for r in counts:
        if chunks[-1] and held + r["n"] > chunk:
            chunks.append([])
            held = 0
        chunks[-1].append(r["person_id"])
        held += r["n"]
    parts = []
    for people in chunks:
        mine = paths.where(F.col("person_id").between(people[0], people[-1]))
        folders = [r["f"] for r in mine.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("f")).distinct().collect()]
        part = spark.read.format("binaryFile").load([f.replace("{", "\\{").replace("[", "\\[").replace("*", "\\*").replace("?", "\\?") for f in folders])
        parts.append(part.select("path", F.col("content").alias("image")).join(F.broadcast(mine), "path").select("person_id", "image_index", "image"))
    return reduce(DataFrame.unionByName, parts)


def decode_payload(frames: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``image`` binary and ``decode_ok``: what follows the first comma, if any, from base64.

    Text that is not strict base64, and null, gives a null image and ``decode_ok`` false; the row stays.
    """
    image = F.expr(f"try_to_binary(regexp_replace(`{payload}`, '(?s)^[^,]*,', ''), 'base64')")
    return frames.withColumn("image", image).withColumn("decode_ok", F.col("image").isNotNull())


FACE = "struct<bbox: array<double>, det_score: double, embedding: array<float>>"
#: What a detector found in an image, by the SHA-256 of its bytes.
FOUND = f"digest string, height int, width int, decode_ok boolean, faces array<{FACE}>"
Detector = Callable[[bytes], tuple[int, int, list[tuple]] | None]


def _detected(images: DataFrame, detector_factory: Callable[[], Detector]) -> DataFrame:
    """:data:`FOUND` of images (digest, image), each digest of a task once."""

    def detect(batches: Iterable) -> Iterator:
        import pandas as pd

        detector, seen = detector_factory(), set()
        for pdf in batches:
            rows = []
            for digest, image in zip(pdf["digest"], pdf["image"]):
                if digest in seen:
                    continue
                seen.add(digest)
                found = detector(bytes(image))
                h, w, faces = found if found is not None else (0, 0, [])
                rows.append((digest, h, w, found is not None, [{"bbox": list(map(float, b)), "det_score": float(d), "embedding": list(map(float, e))} for b, e, d in faces]))
            yield pd.DataFrame(rows, columns=["digest", "height", "width", "decode_ok", "faces"])

    return images.mapInPandas(detect, FOUND)


def detect_once(frames: DataFrame, detector_factory: Callable[[], Detector], table: str, parts: int = 1) -> None:
    """Run the detector on every image whose result is not in ``table`` yet, and store it there.

    Images are told apart by the SHA-256 of their bytes, so copies are detected once, and a run
    that is repeated detects what it has not committed: with ``parts`` the work is cut by digest
    into so many commits. Digests alone are shuffled; the images to be read are found by a
    broadcast of their keys where a count finds few. One run at a time writes a table.
    """
    spark = frames.sparkSession
    keyed = frames.where("image IS NOT NULL").select("sequence_id", "frame_index", "image", F.sha2("image", 256).alias("digest"))
    asked = keyed.groupBy("digest").agg(F.min(F.struct("sequence_id", "frame_index")).alias("at"))
    for part in range(parts):
        mine = asked.where(F.pmod(F.xxhash64("digest"), F.lit(parts)) == part)
        known = _stored(spark, table)
        todo = stage(mine.join(known.select("digest"), "digest", "left_anti") if known is not None else mine, "to-detect")
        left = sized(todo.select("digest", "at.*"))
        same = [F.col(f"f.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("sequence_id", "frame_index")]
        images = keyed.alias("f").join(left.alias("t"), (F.col("f.digest") == F.col("t.digest")) & same[0] & same[1], "left_semi").select("digest", "image")
        _detected(images, detector_factory).dropDuplicates(["digest"]).write.mode("append").parquet(table)


def _stored(spark: SparkSession, table: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(FOUND).parquet(table)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def detect_faces(frames: DataFrame, detector_factory: Callable[[], Detector], table: str | None = None, parts: int = 1) -> tuple[DataFrame, DataFrame]:
    """(detections, frame_status) of decoded frames, by a detector that the caller supplies.

    ``detector_factory`` is called once per task; what it returns maps image bytes to (height,
    width, faces), a face being (bbox, embedding, det_score), or to None if it cannot read them.
    Such frames, and null images, have shape (0, 0) and no faces. The faces of a frame keep the
    detector's order. Frames that repeat a key are rows of their own.

    The detector runs once for an image, here and now, by :func:`detect_once`; both results are
    read from ``table``, by default one in the shared folder.
    """
    spark = frames.sparkSession
    table = table or new_path(spark, "detected")
    detect_once(frames, detector_factory, table, parts)
    keys = frames.select("sequence_id", "frame_index", F.sha2("image", 256).alias("digest"))
    found = keys.join(spark.read.schema(FOUND).parquet(table), "digest", "left")
    status = found.select("sequence_id", "frame_index", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("height", "width")), F.coalesce("decode_ok", F.lit(False)).alias("decode_ok"))
    detections = found.select("sequence_id", "frame_index", F.posexplode("faces").alias("face_index", "face")).select("sequence_id", "frame_index", "face_index", "face.bbox", "face.det_score", "face.embedding")
    return detections, status


def validate_requests(requests: DataFrame, kind: str) -> DataFrame:
    """Adds ``reason``, null where the request is valid: the first rule it breaks.

    ``enroll``: person_id of 1 to 64 characters and not reserved, name of 1 to 128, an image.
    ``identify``: an image. ``motion``: two images. ``detection``: confidence within [0, 1].
    Nulls break the rule on their column.
    """
    between = lambda c, a, b: F.coalesce(F.char_length(c).between(a, b), F.lit(False))
    images = lambda n: F.coalesce(F.size("images") >= n, F.lit(False))
    reserved = (F.col("person_id") == UNKNOWN) | F.col("person_id").startswith(f"{UNKNOWN}_") if kind == "enroll" else None
    rules = {
        "enroll": lambda: [(between("person_id", 1, 64), "person_id length"), (~reserved, "person_id reserved"), (between("name", 1, 128), "name length"), (images(1), "too few images")],
        "identify": lambda: [(images(1), "too few images")],
        "motion": lambda: [(images(2), "too few images")],
        "detection": lambda: [(F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence range")],
    }
    return requests.withColumn("reason", F.coalesce(*(F.when(~ok, F.lit(why)) for ok, why in rules[kind]())))
