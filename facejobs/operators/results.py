"""Tables made of identities: guests per frame, nested frame results, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facejobs.functions import is_guest, is_known, label
from facejobs.params import DEFAULTS, Params


def guest_counts(identities: DataFrame) -> DataFrame:
    """(sequence_id, frame_index, guest_count) of frames with a guest."""
    return identities.groupBy("sequence_id", "frame_index").agg(F.count_if(is_guest("person_id")).alias("guest_count")).where("guest_count > 0")


def frame_results(frames: DataFrame, identities: DataFrame) -> DataFrame:
    """(sequence_id, frame_index, faces): each frame's faces in detector order; empty where none."""
    face = F.struct("face_index", "person_id", "name", "confidence", "bbox")
    faces = identities.groupBy("sequence_id", "frame_index").agg(F.array_sort(F.collect_list(face)).alias("faces"))
    empty = F.array().cast(faces.schema["faces"].dataType)
    return frames.select("sequence_id", "frame_index").join(faces, ["sequence_id", "frame_index"], "left").withColumn("faces", F.coalesce("faces", empty))


def overlay(identities: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Boxes in whole pixels (toward zero), their colour, and the label to draw."""
    colour = lambda c: F.array(*map(F.lit, c))
    corner: list[Column] = [F.col("bbox")[k].cast("int").alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))]
    return identities.select(
        "sequence_id", "frame_index", "face_index", *corner,
        F.when(is_known("person_id"), colour(params.known_colour)).otherwise(colour(params.unknown_colour)).alias("colour"),
        label("name", "confidence").alias("label"),
    )


def frame_overlays(frames: DataFrame, identities: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """(sequence_id, frame_index, marks): what is drawn on each frame, in detector order. Empty
    where a frame has no faces, null where it could not be read (``decode_ok`` false)."""
    mark = F.struct("face_index", "x1", "y1", "x2", "y2", "colour", "label")
    marks = overlay(identities, params).groupBy("sequence_id", "frame_index").agg(F.array_sort(F.collect_list(mark)).alias("marks"))
    empty = F.array().cast(marks.schema["marks"].dataType)
    found = frames.select("sequence_id", "frame_index", "decode_ok").join(marks, ["sequence_id", "frame_index"], "left")
    return found.select("sequence_id", "frame_index", F.when(F.col("decode_ok"), F.coalesce("marks", empty)).alias("marks"))
