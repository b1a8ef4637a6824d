"""Identification: each face's most similar member.

Three plans give the same rows. ``matrix`` takes one matrix product per Arrow batch, with the
gallery in every task; ``blocks`` leaves a gallery that is too large for that in the shared
storage, as blocks under a pruning index; ``columns`` compares by column functions and serves as
their cross-check. In all of them faces stay where they lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facejobs.functions import dot, usable_vector
from facejobs.operators.gallery_index import BEST, GalleryIndex, build_index, identify_by_index
from facejobs.params import DEFAULTS, Params
from facejobs.schemas import GUEST, UNKNOWN
from facejobs.sources.shared import new_path

_BEST = f"struct<{BEST}>"


def filter_detections(detections: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Detections that score ``det_threshold`` or more."""
    return detections.where(F.col("det_score") >= params.det_threshold)


def usable(members: DataFrame) -> DataFrame:
    """Members that can be matched: person_id, name, centroid, and ``at``, which with the id is
    the gallery's order (microseconds of created_at; null first). A centroid that is null, empty
    or holds anything but finite numbers matches nobody."""
    at = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(1 << 63)))
    return members.where(usable_vector("centroid")).select("person_id", "name", at.alias("at"), F.col("centroid").cast("array<double>").alias("centroid"))


def _identity(best: Column, params: Params) -> list[Column]:
    score = -best["minus"]
    known = F.coalesce(score >= params.threshold, F.lit(False))
    return [
        F.when(known, best["person_id"]).otherwise(UNKNOWN).alias("person_id"),
        F.when(known, best["name"]).otherwise(GUEST).alias("name"),
        F.least(F.lit(1.0), F.when(known, score).otherwise(F.greatest(F.lit(0.0), F.coalesce(score, F.lit(0.0))))).alias("confidence"),
    ]


def _columns(faces: DataFrame, gallery: DataFrame) -> DataFrame:
    """One row holds the gallery, so joining it multiplies nothing."""
    held = gallery.groupBy().agg(F.collect_list(F.struct("at", "person_id", "name", "centroid")).alias("_gallery"))
    scores = F.transform("_gallery", lambda m: F.struct((-dot(F.col("embedding"), m["centroid"])).alias("minus"), m["at"].alias("at"), m["person_id"].alias("person_id"), m["name"].alias("name")))
    best = F.array_min(F.filter(scores, lambda s: F.abs(s["minus"]) < float("inf")))
    return faces.join(F.broadcast(held), F.lit(True), "left").withColumn("_best", best.cast(_BEST)).drop("_gallery")


def _arg_max(faces: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column and score of each row's best product; only finite ones win, the first of equals does."""
    with np.errstate(invalid="ignore", over="ignore"):
        scores = faces @ centroids.T
    scores[~np.isfinite(scores)] = -np.inf
    k = scores.argmax(axis=1)
    return k, scores[np.arange(len(faces)), k]


def _matrix(faces: DataFrame, gallery: DataFrame) -> DataFrame:
    rows = gallery.orderBy("at", "person_id").collect()  # its size has been checked
    if not rows:
        return faces.withColumn("_best", F.lit(None).cast(_BEST))
    places: dict[int, list[int]] = {}
    for k, r in enumerate(rows):
        places.setdefault(len(r["centroid"]), []).append(k)
    matrices = {size: (np.array(k), np.array([rows[j]["centroid"] for j in k], np.float64)) for size, k in places.items()}
    ids, names, at = ([r[k] for r in rows] for k in ("person_id", "name", "at"))

    @F.arrow_udf("minus double, at long, person_id string, name string")
    def best(column: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        won, place = np.full(len(column), -np.inf), np.zeros(len(column), int)
        for size, (of, centroids) in matrices.items():  # vectors that are null or of another length match nobody
            if len(where := np.flatnonzero(lengths == size)):
                vectors = column.take(pa.array(where)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                k, won[where] = _arg_max(vectors, centroids)
                place[where] = of[k]
        lost = ~np.isfinite(won)
        pick = lambda values, kind: pa.array([None if gone else values[i] for i, gone in zip(place, lost)], kind)
        return pa.StructArray.from_arrays([pa.array(-won, mask=lost), pick(at, pa.int64()), pick(ids, pa.string()), pick(names, pa.string())], names=["minus", "at", "person_id", "name"])

    return faces.withColumn("_best", best(F.col("embedding").cast("array<double>")))


def identify(detections: DataFrame, members: DataFrame | None, params: Params = DEFAULTS, plan: str = "auto", keep_embedding: bool = False, index: GalleryIndex | None = None) -> DataFrame:
    """Detections with person_id, name, confidence of their most similar member.

    From ``threshold`` on, the member and the raw score, at most 1; below, ``unknown``, ``Guest``
    and the score, at least 0. The first in gallery order (created_at, then person_id) wins among
    equals. A face is compared with the members whose vectors are as long as its own; scores that
    are not finite never win. An empty gallery, and a vector that is null, holds nulls or has a
    length that no member's has, make a face unknown with 0. Faces are independent of each other,
    whatever their keys: null and repeated ones stay as they are.

    ``plan``: ``matrix``, ``columns`` or ``blocks``; ``auto`` is ``matrix``. A gallery of more
    than ``broadcast_bytes`` always goes by ``blocks``. ``index`` is a stored index of the
    gallery; it takes the place of ``members``, so that a large gallery is indexed once.
    """
    if index is None:
        gallery = usable(members)
        if plan != "blocks":
            held = gallery.agg(F.coalesce(F.sum(F.size("centroid")), F.lit(0)).alias("n")).first()["n"]
            plan = "blocks" if 8 * held > params.broadcast_bytes else plan
        if plan == "blocks":
            index = build_index(gallery, new_path(detections.sparkSession, "gallery-index"), params)
    if index is not None:
        found = identify_by_index(detections, index, params)
    else:
        found = _columns(detections, gallery) if plan == "columns" else _matrix(detections, gallery)
    kept = [c for c in detections.columns if keep_embedding or c != "embedding"]
    return found.select(*kept, *_identity(F.col("_best"), params))
