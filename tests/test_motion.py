import random

import model
import pytest
from pyspark.sql import functions as F

from facejobs.functions import classify_direction, geometry
from facejobs.operators.motion import detect_motion, link_unknowns

ROW = "sequence_id string, frame_index int, face_index int, person_id string, name string, confidence double, bbox array<double>, embedding array<float>"


def frames(spark, n, width=640, sequences=("s",)):
    return spark.createDataFrame([(s, k, 480, width) for s in sequences for k in range(n)], "sequence_id string, frame_index int, height int, width int")


def guests(spark, faces):
    return spark.createDataFrame([("s", f, i, "unknown", "Guest", 0.1, [0.0, 0.0, 10.0, 10.0], e) for f, i, e in faces], ROW)


def links(spark, faces):
    found = {(r.frame_index, r.face_index): r.link_no for r in link_unknowns(guests(spark, faces)).collect()}
    return [found[f[:2]] for f in faces]


@pytest.mark.parametrize(
    "faces",
    [
        [(0, 0, [1.0, 0.0]), (0, 1, [0.6, 0.8]), (1, 0, [0.6, 0.8])],  # the first that fits, not the best
        [(0, 0, [1.0, 0.0, 0.0]), (1, 0, [0.6, 0.8, 0.0]), (2, 0, [0.0, 1.0, 0.0])],  # a chain by last faces
        [(3, 0, [1.0, 0.0]), (3, 1, [1.0, 0.0])],  # two of one frame
        [(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0]), (1, 0, [0.0, 1.0]), (1, 1, [0.5, 0.8])],
    ],
)
def test_linking_cases(spark, faces):
    assert links(spark, faces) == model.link(faces)


def test_motion_equals_the_plain_rules(spark):
    rng = random.Random(5)
    rows, per, width = [], {}, 640
    for s in ("s1", "s2", "s3"):
        seq, bases = [], [[rng.gauss(0, 1) for _ in range(8)] for _ in range(3)]
        for f in range(6):
            for i in range(rng.randint(0, 3)):
                known, b = rng.random() < 0.5, rng.choice(bases)
                e = [x + rng.gauss(0, 0.1) for x in b]
                e = [x / model.dot(e, e) ** 0.5 for x in e]
                x, w = rng.uniform(0, 500), rng.uniform(40, 90)
                p = rng.choice("ab") if known else "unknown"
                seq.append((f, i, p, known, f"N{p}{f}", round(rng.random(), 3), [x, 0.0, x + w, w], e))
        rows += [(s, f, i, p, n, c, b, e) for f, i, p, _, n, c, b, e in seq]
        numbers = iter(model.link([(f, i, e) for f, i, _, k, *_, e in seq if not k]))
        flat = []
        for f, i, p, k, n, c, b, _ in seq:
            number = None if k else next(numbers)
            flat.append((f, i, p if k else f"unknown_{number}", k, number, n, c, b))
        per[s] = model.motion(flat, width)
    got = detect_motion(frames(spark, 6, sequences=("s1", "s2", "s3")), spark.createDataFrame(rows, ROW).repartition(5))
    found = {s: [] for s in per}
    for r in got.orderBy("sequence_id", "track_id").collect():
        assert len(r.trajectory) >= 2
        found[r.sequence_id].append((r.track_id, r.person_id, r.name, r.direction, round(r.confidence, 9)))
    assert found == per


def test_worked_example(spark):
    boxes = [[100.0, 50.0, 200.0, 250.0], [150.0, 55.0, 260.0, 260.0], [210.0, 60.0, 320.0, 270.0]]
    rows = [("s", k, 0, "p", "P", c, b, None) for k, (b, c) in enumerate(zip(boxes, (0.85, 0.87, 0.86)))]
    t = detect_motion(frames(spark, 3), spark.createDataFrame(rows, ROW)).collect()
    assert [(r.track_id, r.person_id, r.direction, round(r.confidence, 6)) for r in t] == [(0, "p", "left-to-right", 0.86)]
    assert [p.cx for p in t[0].trajectory] == [150.0, 205.0, 265.0]


def test_one_frame_gives_no_motion(spark):
    rows = [("s", 0, k, "p", "P", 0.9, [0.0, 0.0, 1.0, 1.0], None) for k in range(2)]
    assert detect_motion(frames(spark, 1), spark.createDataFrame(rows, ROW)).count() == 0
    assert detect_motion(frames(spark, 2), spark.createDataFrame(rows, ROW)).count() == 1


@pytest.mark.parametrize(
    ("a", "b", "width"),
    [
        ((0, 0, 100, 100), (32, 0, 132, 100), 640), ((0, 0, 100, 100), (31.9, 0, 131.9, 100), 640), ((0, 0, 100, 100), (0, 0, 100, 116), 640),
        ((0, 0, 100, 116), (0, 0, 100, 100), 640), ((0, 0, 0, 0), (0, 0, 0, 0), 640), ((0, 0, 10, 10), (0, 0, 10, 10), 0),
        ((0, 0, 100, 100), (500, 0, 600, 130), 640), ((0, 0, 100, 100), (40, 0, 140, 200), 640), ((40, 0, 140, 100), (0, 0, 100, 100), 640),
    ],
)
def test_direction_edges(spark, a, b, width):
    row = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b], width)], "a array<double>, b array<double>, w int")
    got = row.select(classify_direction(geometry("a"), geometry("b"), F.col("w")).alias("d")).first().d
    want = model.direction(a, b, width)
    assert (got.direction, round(got.confidence, 9)) == (want[0], round(want[1], 9))


def test_mirror_swaps_sides(spark):
    moves = [([x, 0.0, x + 50, 50.0], [y, 0.0, y + 55, 50.0]) for x, y in ((0.0, 100.0), (300.0, 20.0))]
    swap = {"left-to-right": "right-to-left", "right-to-left": "left-to-right"}
    for a, b in moves:
        mirror = lambda v: [640 - v[2], v[1], 640 - v[0], v[3]]
        assert model.direction(mirror(a), mirror(b), 640)[0] == swap[model.direction(a, b, 640)[0]]


def test_linked_query_equals_the_model(spark):
    """The query over the given tables against the rules restated in plain Python, beside its SQL form."""
    from facejobs import queries

    sf_dir = "/root/testdata/sf0.001"
    got = {(r.sequence_id, r.person_id): (r.direction, r.confidence) for r in queries.queries()["detect_motion_linked"](spark, sf_dir).collect()}
    sequences = {}
    for r in queries._identities(spark, sf_dir, keep_embedding=True).collect():
        sequences.setdefault(r.sequence_id, []).append(r)
    want = {}
    for name, rows in sequences.items():
        rows.sort(key=lambda r: (r.frame_index, r.face_index))
        guests = [r for r in rows if r.person_id == "unknown"]
        numbers = model.link([(r.frame_index, r.face_index, r.embedding) for r in guests], 0.2)
        tracks = {}
        for r in rows:
            key = r.person_id if r.person_id != "unknown" else f"unknown_{numbers[guests.index(r)]}"
            tracks.setdefault(key, []).append(r)
        for key, found in tracks.items():
            if len(found) >= 2:
                way, sure = model.direction(found[0].bbox, found[-1].bbox, 640)
                want[name, key] = (way, round(min(sum(r.confidence for r in found) / len(found), sure), 9))
    assert got.keys() == want.keys() and any(k.startswith("unknown_") for _, k in got)
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-8 for k in want)
