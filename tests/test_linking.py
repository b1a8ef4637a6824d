import random

import model
import numpy as np
import pyarrow as pa
import pytest

from facejobs.operators.linking import Tracks, linked
from facejobs.operators.motion import detect_motion, link_unknowns

ROW = "sequence_id string, frame_index int, face_index int, person_id string, name string, confidence double, bbox array<double>, embedding array<float>, link string"
NAN, INF = float("nan"), float("inf")


def guests(spark, rows):
    return spark.createDataFrame([(s, f, k, "unknown", "Guest", 0.1, [float(n), 0.0, 10.0, 10.0], v, "x") for n, (s, f, k, v) in enumerate(rows)], ROW)


def test_odd_vectors_open_tracks_of_their_own(spark):
    one = [1.0, 0.0]
    rows = [("s", 0, 0, None), ("s", 1, 0, one), ("s", 2, 0, [None, 1.0]), ("s", 3, 0, one), ("s", 4, 0, [1.0]), ("s", 5, 0, [1.0]), ("s", 6, 0, [NAN, 0.0]), ("s", 7, 0, [INF, 0.0]), ("s", 8, 0, []), ("s", 9, 0, one)]
    got = link_unknowns(guests(spark, rows)).orderBy("frame_index").collect()
    assert [r.link_no for r in got] == [0, 1, 2, 1, 3, 3, 4, 5, 6, 1]
    assert "embedding" not in got[0].asDict() and got[0].link == "x" and got[1].track_key == "unknown_1"


def test_repeated_and_null_keys_lose_and_multiply_nothing(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [("s", 0, 0, a), ("s", 0, 0, a), ("s", 0, 0, b), (None, 0, 0, a), (None, None, None, b), (None, 1, 0, b)]
    got = link_unknowns(guests(spark, rows).repartition(3)).collect()
    assert len(got) == 6 and sorted(r.bbox[0] for r in got) == [0, 1, 2, 3, 4, 5]
    by = {r.bbox[0]: r.link_no for r in got}
    assert by[0] == by[1] != by[2] and (by[4], by[3], by[5]) == (0, 1, 0)


def test_a_sequence_goes_on_over_batches(spark):
    rng = random.Random(2)
    unit = lambda v: [x / model.dot(v, v) ** 0.5 for x in v]
    bases = [unit([rng.gauss(0, 1) for _ in range(6)]) for _ in range(5)]
    rows = [(rng.choice("aaaab"), f, k, unit([x + rng.gauss(0, 0.3) for x in rng.choice(bases)])) for f in range(120) for k in range(3)]
    rows = [(s, f, k, [float(np.float32(x)) for x in v]) for s, f, k, v in rows]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r.sequence_id, r.frame_index, r.face_index): r.link_no for r in link_unknowns(guests(spark, rows).repartition(4)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for s in "ab":
        mine = [(f, k, v) for t, f, k, v in rows if t == s]
        assert [got[s, f, k] for f, k, _ in mine] == model.link(mine)


def test_what_is_held_grows_with_tracks():
    batch = pa.RecordBatch.from_pydict({"sequence_id": ["s"] * 1000, "embedding": [[1.0, 0.0], [0.0, 1.0]] * 500})
    seen = list(linked(iter([batch] * 50), 0.5))
    assert all(b.column("link_no").to_pylist() == [0, 1] * 500 for b in seen)
    tracks = Tracks(0.5)
    for k in range(1000):
        tracks.add(np.eye(3)[k % 3])
    assert tracks.n == 3 and len(tracks.state()["last"]) == 3


def test_state_goes_round():
    rng = np.random.default_rng(1)
    vectors = [None if k % 11 == 0 else rng.normal(size=3 + k % 2) for k in range(200)]
    one, out = Tracks(0.5), []
    for v in vectors:
        out.append(one.add(v))
    two, again = Tracks(0.5), []
    for v in vectors:
        two = Tracks.of(0.5, two.state())
        again.append(two.add(v))
    assert out == again and two.n == one.n > 20


@pytest.mark.parametrize("laid_out", [False, True])
def test_motion_with_odd_guests(spark, laid_out):
    rows = guests(spark, [("s", 0, 0, [1.0, 0.0]), ("s", 1, 0, None), ("s", 2, 0, [1.0, 0.0]), ("s", 3, 0, [1.0])])
    frames = spark.createDataFrame([("s", k, 480, 640) for k in range(4)], "sequence_id string, frame_index int, height int, width int")
    got = detect_motion(frames, rows.repartition("sequence_id") if laid_out else rows, laid_out=laid_out).collect()
    assert [(r.track_id, r.person_id, len(r.trajectory)) for r in got] == [(0, "unknown_0", 2)]


def test_empty(spark):
    assert link_unknowns(guests(spark, [])).count() == 0
