"""Motion: linking guests across frames, tracks, directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from facejobs.functions import classify_direction, geometry, is_guest
from facejobs.operators.linking import linked
from facejobs.params import DEFAULTS, Params


def link_unknowns(identities: DataFrame, params: Params = DEFAULTS, laid_out: bool = False) -> DataFrame:
    """Guests' rows with ``link_no`` and ``track_key`` ``unknown_<link_no>``, without their
    embeddings; known rows are left out.

    In a sequence, by frame and then detector order, a guest joins the first track, oldest first,
    whose last face is similar enough, or else opens one. Two faces of a frame may join one
    track. Numbers count all tracks, also those of one face. A guest without a usable vector
    opens a track of its own, only vectors of one length are compared, null keys order first and
    a null sequence is one like any other, and rows that repeat a key are rows of their own, in
    the order of a hash.

    Order matters, so a sequence lies in one partition, sorted; it is read batch by batch, and
    only its tracks' last vectors are held. ``laid_out`` says that rows are partitioned by
    sequence already.
    """
    least = params.cross_frame_similarity
    guests = identities.where(is_guest("person_id"))
    guests = guests if laid_out else guests.repartition("sequence_id")
    ordered = guests.sortWithinPartitions("sequence_id", "frame_index", "face_index", F.xxhash64("embedding", "bbox"))
    schema = StructType([*guests.drop("embedding").schema, StructField("link_no", IntegerType())])
    found = ordered.mapInArrow(lambda batches: linked(batches, least), schema)
    return found.withColumn("track_key", F.concat(F.lit("unknown_"), F.col("link_no").cast("string")))


def entries_of(identities: DataFrame, params: Params = DEFAULTS, link: bool = True, laid_out: bool = False) -> DataFrame:
    """Track entries: known faces under their person_id, guests under their link."""
    columns = ["sequence_id", "frame_index", "face_index", "track_key", "link_no", "name", "confidence", "bbox"]
    known = identities.where(~is_guest("person_id")).withColumn("track_key", F.col("person_id")).withColumn("link_no", F.lit(None).cast("int"))
    return known.select(*columns).unionByName(link_unknowns(identities, params, laid_out).select(*columns)) if link else known.select(*columns)


def track_summary(entries: DataFrame, frames: DataFrame, trajectory: bool = True) -> DataFrame:
    """One row per track of two entries or more: first and last point, mean confidence, first
    name, the first entry's frame shape, and the ordered trajectory if asked for."""
    at = F.struct("frame_index", "face_index")
    point = geometry("bbox")
    tracks = entries.groupBy("sequence_id", "track_key").agg(
        F.count("*").alias("n_entries"),
        F.min(at).alias("first_at"),
        F.min_by(point, at).alias("first_point"),
        F.max_by(point, at).alias("last_point"),
        F.min_by("name", at).alias("name"),
        F.avg("confidence").alias("mean_confidence"),
        F.min("link_no").alias("link_no"),
        *([F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "face_index", point.alias("point")))), lambda x: x["point"]).alias("trajectory")] if trajectory else []),
    ).where("n_entries >= 2")
    shape = frames.select("sequence_id", F.col("frame_index").alias("_frame"), "height", "width").dropDuplicates(["sequence_id", "_frame"])
    return tracks.withColumn("_frame", F.col("first_at.frame_index")).join(shape, ["sequence_id", "_frame"], "left").drop("_frame")


def motion_direction(tracks: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Adds ``direction`` and ``confidence``, the least of mean identity and direction confidence."""
    moved = tracks.withColumn("_move", classify_direction(F.col("first_point"), F.col("last_point"), F.coalesce(F.col("width"), F.lit(0)), params))
    return moved.select("*", F.col("_move.direction").alias("direction"), F.least("mean_confidence", "_move.confidence").alias("confidence")).drop("_move")


def number_tracks(tracks: DataFrame) -> DataFrame:
    """Adds ``track_id``: from 0 in each sequence, known people by first appearance, then guests by link."""
    order = Window.partitionBy("sequence_id").orderBy(F.col("link_no").isNotNull(), "link_no", "first_at")
    return tracks.withColumn("track_id", F.row_number().over(order) - 1)


def detect_motion(frames: DataFrame, identities: DataFrame, params: Params = DEFAULTS, link: bool = True, trajectory: bool = True, laid_out: bool = False) -> DataFrame:
    """Tracks: sequence_id, track_id, person_id, name, direction, confidence, trajectory.

    ``identities`` carry embeddings if guests are to be linked. Sequences of fewer than two
    frames have no motion; frames that could not be read count and hold no faces.
    """
    long_enough = frames.groupBy("sequence_id").agg(F.count("*").alias("n")).where("n >= 2").select("sequence_id")
    entries = entries_of(identities, params, link, laid_out).join(long_enough, "sequence_id", "left_semi")
    tracks = number_tracks(motion_direction(track_summary(entries, frames, trajectory), params))
    return tracks.select("sequence_id", "track_id", F.col("track_key").alias("person_id"), "name", "direction", "confidence", *(["trajectory"] if trajectory else []))

