"""Structured Streaming forms of identification and motion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from facejobs.operators.identify import identify
from facejobs.operators.motion import motion_direction, number_tracks
from facejobs.params import DEFAULTS, Params
from facejobs.sources.stores import gallery_version, put_if_absent, read_gallery
from facejobs.streaming import tracking

Sink = Callable[[DataFrame, int], None]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_sink(path: str) -> Sink:
    """A sink that writes each micro-batch to a partition ``batch`` of its own in a Parquet table.
    A batch that is replayed replaces its partition, so no row comes twice."""

    def write(rows: DataFrame, number: int) -> None:
        held = rows.withColumn("batch", F.lit(number))
        held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return write


def pinned_version(spark: SparkSession, gallery_path: str, pins: str, number: int) -> int:
    """The gallery version of micro-batch ``number``: the newest when it first ran, also if it runs
    again. Where that version has been purged, so that nobody removed comes back, the newest now."""
    put_if_absent(spark, f"{pins}/{number}", str(gallery_version(spark, gallery_path)))
    pinned = int(spark.read.text(f"{pins}/{number}").first()["value"])
    return gallery_version(spark, gallery_path, pinned)


def identify_stream(detections: DataFrame, gallery_path: str, sink: Sink, params: Params = DEFAULTS, keep_embedding: bool = False, pins: str | None = None) -> DataStreamWriter:
    """Identify each micro-batch against the gallery as it is then, so enrolments and removals
    take effect at the next one. Stateless; ``sink`` gets identities and the batch's number.

    ``pins`` is a folder of this stream in which the gallery version of each batch is noted, so
    that a batch that is replayed gives the same identities; with :func:`table_sink` each row is
    then in the table once.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = pinned_version(spark, gallery_path, pins, number) if pins else None
        sink(identify(batch, read_gallery(spark, gallery_path, version).members, params, keep_embedding=keep_embedding), number)

    return detections.writeStream.foreachBatch(each)


def motion_stream(frames: DataFrame, sink: Sink, gap: str = "10 seconds", delay: str = "30 seconds", params: Params = DEFAULTS) -> DataStreamWriter:
    """Motion of each sequence once, after ``gap`` without frames: the tracks of
    :func:`facejobs.operators.motion.detect_motion` without trajectories.

    ``frames``: sequence_id, frame_index, height, width, ts, faces (array of face_index, bbox,
    person_id, name, confidence, embedding; empty or null where none); frames are taken in order
    of ``ts``, then frame_index. A sequence whose frames pause for ``gap`` or longer gives a track
    set for each part, keyed ``<sequence_id>@<start>``. It closes when the watermark, ``delay``
    behind the latest ``ts``, passes its end; later rows of it are dropped, rows without ``ts``
    too, and the last sequences wait for a later row. State is held in RocksDB: tracks of open
    sequences, and rows that the watermark has not passed.
    """
    spark = frames.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    gap_us = int(spark.range(1).select(F.expr(f"cast(unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {gap}) as long)")).first()[0])
    face = F.transform("faces", lambda f: F.struct(f["face_index"].alias("face_index"), f["bbox"].alias("bbox"), f["person_id"].alias("person_id"), f["name"].alias("name"), f["confidence"].alias("confidence"), f["embedding"].cast("array<double>").alias("embedding")))
    rows = frames.where("ts IS NOT NULL").withWatermark("ts", delay).select("sequence_id", "ts", F.unix_micros("ts").alias("us"), "frame_index", "height", "width", face.alias("faces"))
    closed = rows.groupBy("sequence_id").transformWithState(tracking.OpenTracks(gap_us, params.cross_frame_similarity), tracking.OUT, "Append", "EventTime")

    def each(batch: DataFrame, number: int) -> None:
        key = F.concat_ws("@", "sequence_id", F.timestamp_micros("start").cast("string"))
        tracks = number_tracks(motion_direction(batch.withColumn("sequence_id", key), params))
        sink(tracks.select("sequence_id", "track_id", F.col("track_key").alias("person_id"), "name", "direction", "confidence"), number)

    return closed.writeStream.outputMode("append").foreachBatch(each)
