"""The batch jobs: identify a set of sequences, and enrol people."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facejobs.functions import is_guest
from facejobs.operators.gallery import enroll
from facejobs.operators.gallery_index import GalleryIndex
from facejobs.operators.identify import filter_detections, identify
from facejobs.operators.motion import detect_motion
from facejobs.operators.results import frame_overlays, frame_results, guest_counts, overlay
from facejobs.params import DEFAULTS, Params
from facejobs.sources.frames import decode_payload, detect_faces
from facejobs.sources.shared import sized
from facejobs.sources.stores import Gallery, guest_file_names


class BatchResults(dict):
    """Results by name, and the layout that they share. ``release`` it when they are written, or
    use them in a ``with`` block."""

    def __init__(self, identities: DataFrame):
        super().__init__()
        self.identities = identities

    def release(self) -> None:
        self.identities.unpersist()

    def __enter__(self) -> BatchResults:
        return self

    def __exit__(self, *failure) -> None:
        self.release()


def identify_batch(
    frames: DataFrame,
    detections: DataFrame,
    members: DataFrame | None,
    params: Params = DEFAULTS,
    include_motion: bool = True,
    save_guests: bool = False,
    include_overlay: bool = False,
    index: GalleryIndex | None = None,
) -> BatchResults:
    """Results by name: ``frames``, and as asked for ``motion``, ``guests``, ``overlay`` (the boxes
    and labels of each face) and ``marks`` (those of each frame). A single image is a sequence of
    one frame; it has no motion.

    ``frames``: sequence_id, frame_index, height, width, decode_ok, and for guests image and ts.
    Identities are laid out by sequence once and kept for all parts; frames join them by sequence
    (the session's ``requireAllClusterKeysForCoPartition`` is turned off for that), so faces are
    shuffled once. Only guests keep their embedding, as only linking reads it, and image bytes
    are read for frames with guests alone, by a broadcast of their keys where a count finds few.
    """
    frames.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    found = identify(filter_detections(detections, params), members, params, keep_embedding=True, index=index)
    slim = found.withColumn("embedding", F.when(is_guest("person_id"), F.col("embedding")))
    out = BatchResults(slim.repartition("sequence_id").persist(StorageLevel.MEMORY_AND_DISK))
    out["frames"] = frame_results(frames, out.identities)
    if include_motion:
        out["motion"] = detect_motion(frames, out.identities, params, laid_out=True)
    if save_guests:
        images = frames.select("sequence_id", "frame_index", "image", F.col("ts").alias("saved_at"))
        out["guests"] = guest_file_names(images.join(sized(guest_counts(out.identities)), ["sequence_id", "frame_index"]))
    if include_overlay:
        out["overlay"] = overlay(out.identities, params)
        out["marks"] = frame_overlays(frames, out.identities, params)
    return out


def enroll_batch(gallery: Gallery, requests: DataFrame, detector_factory: Callable, now: datetime, params: Params = DEFAULTS, table: str | None = None) -> tuple[Gallery, DataFrame]:
    """Decode, detect and enrol: ``requests`` has person_id, name, image_index, payload."""
    return enroll_images(gallery, decode_payload(requests), detector_factory, now, params, table)


def enroll_images(gallery: Gallery, images: DataFrame, detector_factory: Callable, now: datetime, params: Params = DEFAULTS, table: str | None = None) -> tuple[Gallery, DataFrame]:
    """Detect and enrol: ``images`` has person_id, name, image_index, image, as files of
    :func:`facejobs.sources.read_image_files` with a name. ``table`` as in ``detect_faces``."""
    images = images.select(F.to_json(F.struct("person_id", "name")).alias("sequence_id"), F.col("image_index").alias("frame_index"), "image")
    detections, status = detect_faces(images, detector_factory, table)
    faces = status.join(detections, ["sequence_id", "frame_index"], "left")
    who = F.from_json("sequence_id", "person_id string, name string")
    return enroll(gallery, faces.select(who["person_id"].alias("person_id"), who["name"].alias("name"), F.col("frame_index").alias("image_index"), "decode_ok", "face_index", "bbox", "det_score", "embedding"), now, params)
