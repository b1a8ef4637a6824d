import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from facejobs import schemas
from facejobs.operators.identify import filter_detections, identify
from facejobs.params import Params

PLANS = ["columns", "matrix", "blocks"]
NAN = float("nan")


def members(spark, rows):
    t0 = datetime(2026, 1, 1)
    return spark.createDataFrame([(p, f"Name {p}", t0 + timedelta(seconds=k), 1, c) for k, (p, c) in enumerate(rows)], schemas.MEMBERS)


def faces(spark, vectors):
    return spark.createDataFrame([("s", k // 2, k % 2, [0.0, 0.0, 1.0, 1.0], 0.9, v) for k, v in enumerate(vectors)], schemas.DETECTIONS)


def run(spark, vectors, people, plan, **params):
    found = identify(faces(spark, vectors), members(spark, people), Params(**params), plan=plan)
    assert "embedding" not in found.columns
    return [(r.person_id, r.name, round(r.confidence, 6)) for r in found.orderBy("frame_index", "face_index").collect()]


@pytest.mark.parametrize("plan", PLANS)
def test_rules(spark, plan):
    people = [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("lost", None)]
    got = run(spark, [[1.0, 0.0], [0.6, 0.8], [-1.0, -0.5], [0.25, 0.125], [NAN, 0.0], [1.5, 0.0]], people, plan, threshold=0.25)
    assert got == [("b", "Name b", 1.0), ("c", "Name c", 0.8), ("unknown", "Guest", 0.0), ("b", "Name b", 0.25), ("unknown", "Guest", 0.0), ("b", "Name b", 1.0)]


@pytest.mark.parametrize("plan", PLANS)
def test_odd_vectors_and_keys(spark, plan):
    rows = [(None, None, None, [1.0, 0.0]), ("s", 0, 0, [0.0, 1.0]), ("s", 0, 0, [1.0, 0.0]), ("s", 1, 0, None), ("s", 2, 0, [1.0]), ("s", 3, 0, [1.0, 0.0, 0.0]), ("s", 4, 0, []), ("s", 5, 0, [None, 1.0]), ("s", 6, 0, [1.0, 0.0])]
    faces = spark.createDataFrame([(s, f, k, [0.0, 0.0, 1.0, 1.0], 0.9, v) for s, f, k, v in rows], schemas.DETECTIONS)
    people = members(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0])])
    got = sorted(((r.sequence_id or "", -1 if r.frame_index is None else r.frame_index, r.person_id, r.confidence) for r in identify(faces, people, plan=plan).collect()))
    unknown = [("s", k, "unknown", 0.0) for k in (1, 2, 3, 4, 5)]
    assert got == [("", -1, "a", 1.0), ("s", 0, "a", 1.0), ("s", 0, "b", 1.0), *unknown, ("s", 6, "a", 1.0)]


@pytest.mark.parametrize("plan", PLANS)
def test_vectors_of_two_lengths_infinite_and_odd_centroids(spark, plan):
    inf = float("inf")
    people = [("a", [1.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [1.0]), ("x", [NAN, 1.0]), ("y", [inf, 0.0]), ("z", []), ("n", [None, 1.0])]
    got = run(spark, [[1.0, 0.0], [0.0, 1.0, 0.0], [1.0], [inf, 1.0], [-inf, 0.0], [0.0, 1.0], [], [None, 1.0, 0.0], [1e30, 1e30], [0.5, 0.5, 0.5, 0.5]], people, plan)
    unknown = ("unknown", "Guest", 0.0)
    assert got == [("a", "Name a", 1.0), ("b", "Name b", 1.0), ("c", "Name c", 1.0), unknown, unknown, unknown, unknown, unknown, ("a", "Name a", 1.0), unknown]


@pytest.mark.parametrize("plan", PLANS)
def test_first_enrolled_wins_and_nulls_come_first(spark, plan):
    people = members(spark, [("b", [1.0, 0.0]), ("a", [1.0, 0.0])])
    late = people.withColumn("created_at", F.when(F.col("person_id") == "b", F.col("created_at") + F.expr("interval 1 day")).otherwise(F.col("created_at")))
    none = people.withColumn("created_at", F.when(F.col("person_id") == "b", F.col("created_at")))
    one = faces(spark, [[1.0, 0.0]])
    assert [identify(one, p, plan=plan).first().person_id for p in (people, late, none)] == ["b", "a", "a"]


@pytest.mark.parametrize("plan", [*PLANS, "auto"])
def test_empty_gallery_keeps_faces(spark, plan):
    assert run(spark, [[1.0, 0.0]], [], plan) == [("unknown", "Guest", 0.0)]


def test_plans_agree_and_order_does_not_matter(spark):
    rng = random.Random(1)
    vec = lambda: [rng.gauss(0, 0.4) for _ in range(8)]
    people, probes = [(f"p{k}", vec()) for k in range(40)], [vec() for _ in range(60)]
    small = {"broadcast_bytes": 8 * 8 * 7}
    results = [run(spark, probes, people, plan, **more) for plan, more in (("columns", {}), ("matrix", {}), ("blocks", small), ("auto", {}), ("matrix", small))]
    assert results.count(results[0]) == 5
    shuffled = identify(faces(spark, probes).repartition(7).orderBy(F.rand(3)), members(spark, people).repartition(5))
    again = [(r.person_id, r.name, round(r.confidence, 6)) for r in shuffled.orderBy("frame_index", "face_index").collect()]
    assert again == results[0]


def test_detection_threshold_is_inclusive(spark):
    rows = faces(spark, [[1.0]] * 3).withColumn("det_score", F.element_at(F.array(F.lit(0.5), F.lit(0.49), F.lit(0.9)), F.col("frame_index") * 2 + F.col("face_index") + 1))
    assert sorted(r.det_score for r in filter_detections(rows).collect()) == [0.5, 0.9]


def test_params_are_checked():
    for bad in ({"min_displacement_fraction": 0}, {"threshold": 2}, {"broadcast_bytes": 0}):
        with pytest.raises(ValueError):
            Params(**bad)
