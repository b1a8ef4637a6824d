import base64
import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from facejobs.operators import results as R
from facejobs.plans import enroll_batch, identify_batch
from facejobs.sources import Gallery, decode_payload, detect_faces, explode_frames, guest_file_names, read_image_files, validate_requests, write_guest_frames
from facejobs import schemas


def b64(x: bytes) -> str:
    return base64.b64encode(x).decode()


def image(height, width, faces):
    """A small fixed layout: shape, then per face box, score and a vector of two."""
    return struct.pack("<2sii", b"IM", height, width) + b"".join(struct.pack("<7d", *box, score, *vector) for box, score, vector in faces)


def stub():
    def detector(data):
        if data[:2] != b"IM":
            return None
        h, w = struct.unpack_from("<ii", data, 2)
        faces = [struct.unpack_from("<7d", data, at) for at in range(10, len(data), 56)]
        return h, w, [(f[:4], f[5:], f[4]) for f in faces]

    return detector


def test_explode_and_decode(spark):
    batches = spark.createDataFrame([("s", [b64(b"a"), "data:x;base64," + b64(b"bc"), "x,y," + b64(b"d"), "###", "", None]), ("none", [])], "sequence_id string, images array<string>")
    rows = decode_payload(explode_frames(batches)).orderBy("frame_index").collect()
    assert [r.frame_index for r in rows] == list(range(6))
    assert [(None if r.image is None else bytes(r.image), r.decode_ok) for r in rows] == [(b"a", True), (b"bc", True), (None, False), (None, False), (b"", True), (None, False)]


def test_validation(spark):
    rows = [("p", "n", ["i"]), ("", "n", ["i"]), ("a" * 65, "n", ["i"]), (None, "n", ["i"]), ("unknown", "n", ["i"]), ("unknown_0", "n", ["i"]), ("p", "n" * 129, ["i"]), ("p", "n", []), ("p", "n", None)]
    df = spark.createDataFrame(rows, "person_id string, name string, images array<string>").withColumn("k", F.monotonically_increasing_id())
    got = [r.reason for r in validate_requests(df, "enroll").orderBy("k").collect()]
    assert got == [None, *["person_id length"] * 3, *["person_id reserved"] * 2, "name length", *["too few images"] * 2]
    assert validate_requests(df, "motion").where("reason IS NULL").count() == 0
    c = spark.createDataFrame([(0.0,), (1.0,), (1.1,), (None,)], "confidence double")
    assert validate_requests(c, "detection").where("reason IS NULL").count() == 2


def test_image_files(spark, tmp_path):
    for person, name, data in (("ann", "2.jpg", b"2"), ("ann", "1.jpg", b"1"), ("bob", "x.jpg", b"x")):
        (tmp_path / person).mkdir(exist_ok=True)
        (tmp_path / person / name).write_bytes(data)
    got = {(r.person_id, r.image_index): bytes(r.image) for r in read_image_files(spark, str(tmp_path)).collect()}
    assert got == {("ann", 0): b"1", ("ann", 1): b"2", ("bob", 0): b"x"}


def test_detector_scaffold(spark):
    face = ((0.0, 0.0, 9.0, 9.0), 0.8, (1.0, 0.0))
    frames = spark.createDataFrame([("s", 0, image(4, 6, [face, face])), ("s", 1, b"bad"), ("s", 2, None), ("s", 3, image(4, 6, []))], "sequence_id string, frame_index int, image binary")
    detections, status = detect_faces(frames, stub)
    assert [(r.frame_index, r.height, r.width, r.decode_ok) for r in status.orderBy("frame_index").collect()] == [(0, 4, 6, True), (1, 0, 0, False), (2, 0, 0, False), (3, 4, 6, True)]
    assert [(r.frame_index, r.face_index, r.det_score) for r in detections.orderBy("frame_index", "face_index").collect()] == [(0, 0, 0.8), (0, 1, 0.8)]


def test_guest_names_and_sink(spark, tmp_path):
    rows = spark.createDataFrame([("s", 3, 2, b"x", datetime(2026, 3, 23, 1, 2, 3, 45))], "sequence_id string, frame_index int, guest_count int, image binary, saved_at timestamp")
    r = guest_file_names(rows).first()
    assert (r.file_name, str(r.date)) == ("010203-000045_f3_2guests.jpg", "2026-03-23")
    path = str(tmp_path / "g")
    for run in ("one", "two", "one"):  # a run that is tried again leaves the same table
        write_guest_frames(rows, path, run)
    later = rows.withColumn("saved_at", F.expr("saved_at + interval 1 day")).withColumn("image", F.lit(b"y"))
    write_guest_frames(later, path, "two")
    got = sorted((str(r.date), r.run, bytes(r.image)) for r in spark.read.parquet(path).collect())
    assert got == [("2026-03-23", "one", b"x"), ("2026-03-23", "two", b"x"), ("2026-03-24", "two", b"y")]


def test_overlay_labels_round_half_to_even(spark):
    rows = [("s", 0, k, p, "N", c, [1.9, -1.9, 3.2, 4.0]) for k, (p, c) in enumerate((("p", 0.845), ("unknown", 0.125), ("unknown_1", 0.5)))]
    df = spark.createDataFrame(rows, "sequence_id string, frame_index int, face_index int, person_id string, name string, confidence double, bbox array<double>")
    got = R.overlay(df).orderBy("face_index").collect()
    assert [r.label for r in got] == ["N 84%", "N 12%", "N 50%"] and (got[0].x1, got[0].y1) == (1, -1)
    assert [r.colour for r in got] == [[0, 200, 0], [0, 165, 255], [0, 165, 255]]


def test_jobs_end_to_end(spark):
    a, b = (1.0, 0.0), (0.0, 1.0)
    box = lambda x: (x, 0.0, x + 50.0, 50.0)
    requests = spark.createDataFrame([("ann", "Ann", 0, b64(image(480, 640, [(box(0.0), 0.9, a)]))), ("ann", "Ann", 1, "###"), ("bob", "Bob", 0, b64(b"bad"))], "person_id string, name string, image_index int, payload string")
    nothing = Gallery(spark.createDataFrame([], schemas.MEMBERS), spark.createDataFrame([], schemas.MEMBER_EMBEDDINGS))
    gallery, report = enroll_batch(nothing, requests, stub, datetime(2026, 1, 1))
    assert {r.person_id: (r.status, r.failed_images) for r in report.collect()} == {"ann": ("enrolled", [1]), "bob": ("failed", [0])}
    shots = [image(480, 640, [(box(10.0 + 100 * k), 0.9, a), (box(400.0), 0.9, b), (box(0.0), 0.3, a)]) for k in range(3)] + [b"bad"]
    frames = spark.createDataFrame([("s", k, x, datetime(2026, 1, 1, 0, 0, k)) for k, x in enumerate(shots)], "sequence_id string, frame_index int, image binary, ts timestamp")
    detections, status = detect_faces(frames, stub)
    frames = frames.join(status, ["sequence_id", "frame_index"])
    out = identify_batch(frames, detections, gallery.members, save_guests=True, include_overlay=True)
    assert [len(r.faces) for r in out["frames"].orderBy("frame_index").collect()] == [2, 2, 2, 0]
    assert [(r.track_id, r.person_id, r.direction) for r in out["motion"].orderBy("track_id").collect()] == [(0, "ann", "left-to-right"), (1, "unknown_0", "stationary")]
    assert [(r.frame_index, r.guest_count) for r in out["guests"].orderBy("frame_index").collect()] == [(0, 1), (1, 1), (2, 1)]
    assert out["overlay"].count() == 6


def test_unknown_kind_of_request(spark):
    with pytest.raises(KeyError):
        validate_requests(spark.createDataFrame([(["x"],)], "images array<string>"), "other")
