"""Column expressions over boxes, vectors, ids and scores. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facejobs.params import DEFAULTS, Params
from facejobs.schemas import UNKNOWN


def dot(a: Column | str, b: Column | str) -> Column:
    """Similarity of two vectors taken as unit length: their dot product, in doubles."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def usable_vector(c: Column | str) -> Column:
    """Whether a vector can be compared: not null or empty, and only finite numbers in it."""
    v = F.col(c) if isinstance(c, str) else c
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def geometry(bbox: Column | str) -> Column:
    """Struct cx, cy, width, height of a box [x1, y1, x2, y2]."""
    b = F.col(bbox) if isinstance(bbox, str) else bbox
    return F.struct(((b[0] + b[2]) / 2.0).alias("cx"), ((b[1] + b[3]) / 2.0).alias("cy"), (b[2] - b[0]).alias("width"), (b[3] - b[1]).alias("height"))


def area(bbox: Column | str) -> Column:
    b = F.col(bbox) if isinstance(bbox, str) else bbox
    return (b[2] - b[0]) * (b[3] - b[1])


def is_guest(person_id: Column | str) -> Column:
    """Whether identification found no member."""
    return (F.col(person_id) if isinstance(person_id, str) else person_id) == UNKNOWN


def is_known(person_id: Column | str) -> Column:
    """Whether a label names a member: neither ``unknown`` nor a linked guest ``unknown_i``."""
    c = F.col(person_id) if isinstance(person_id, str) else person_id
    return ~((c == UNKNOWN) | c.startswith(f"{UNKNOWN}_"))


def match_band(confidence: Column | str, params: Params = DEFAULTS) -> Column:
    """``known``, ``uncertain`` or ``unknown``; both limits belong to the higher band."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.when(c >= params.threshold, "known").when(c >= params.unknown_threshold, "uncertain").otherwise("unknown")


def label(name: Column | str, confidence: Column | str) -> Column:
    """``name 84%``, the per cent rounded half to even."""
    n, c = (F.col(x) if isinstance(x, str) else x for x in (name, confidence))
    return F.concat(n, F.lit(" "), F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def classify_direction(first: Column, last: Column, width: Column, params: Params = DEFAULTS) -> Column:
    """Struct direction, confidence of a move between two points (see :func:`geometry`).

    Sideways wins over depth only where its share of the width is strictly larger than the share
    of area; without either the track is stationary. Frames without width give no sideways move,
    and boxes without area no depth. Vertical moves do not count.
    """
    least, change = F.lit(params.min_displacement_fraction), F.lit(params.area_change_fraction)
    dx = last["cx"] - first["cx"]
    side = F.when(width > 0, F.abs(dx) / F.when(width > 0, width)).otherwise(0.0)
    a0, a1 = first["width"] * first["height"], last["width"] * last["height"]
    mean = F.when(a0 + a1 > 0, (a0 + a1) / 2.0).otherwise(1.0)
    depth = (a1 - a0) / mean
    moved, grown = side >= least, F.abs(depth) >= change
    sideways = F.when(dx > 0, "left-to-right").otherwise("right-to-left")
    inout = F.when(depth > 0, "towards-camera").otherwise("away-from-camera")
    is_side, is_depth = moved & (~grown | (side > F.abs(depth))), grown
    return F.struct(
        F.when(is_side, sideways).when(is_depth, inout).otherwise("stationary").alias("direction"),
        F.when(is_side, F.least(F.lit(1.0), side / least * 0.5))
        .when(is_depth, F.least(F.lit(1.0), F.abs(depth)))
        .otherwise(F.greatest(F.lit(0.0), 1.0 - F.greatest(side / least, F.abs(depth) / change)))
        .alias("confidence"),
    )
