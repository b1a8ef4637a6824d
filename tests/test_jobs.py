"""Jobs from frames and files to results: the detector's calls, exchanges, single images, enrolment from a folder."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_sources import image, stub

from facejobs import schemas
from facejobs.plans import enroll_images, identify_batch
from facejobs.sources import Gallery, detect_faces, detect_once, read_image_files
from facejobs.sources.shared import stage

A, B = (1.0, 0.0), (0.0, 1.0)
NOW = datetime(2026, 1, 1)
SHOT = "sequence_id string, frame_index int, image binary"


def box(x):
    return (x, 0.0, x + 50.0, 50.0)


def counting(path):
    """The stub, noting each call in a file."""

    def factory():
        detector = stub()

        def counted(data):
            fd = os.open(path, os.O_WRONLY | os.O_APPEND | os.O_CREAT)
            os.write(fd, b"x")
            os.close(fd)
            return detector(data)

        return counted

    return factory


def calls(path):
    return os.path.getsize(path) if os.path.exists(path) else 0


@pytest.mark.parametrize("parts", [1, 3])
def test_one_call_an_image(spark, tmp_path, parts):
    noted, table = str(tmp_path / "calls"), str(tmp_path / "found")
    shots = [image(4, 6, [(box(float(k)), 0.8, A)] * (k % 3)) for k in range(6)]
    rows = [("s", k, x) for k, x in enumerate(shots)] + [("t", 0, shots[1]), ("t", 1, b"bad"), ("t", 2, None), ("s", 0, shots[0]), (None, None, shots[2])]
    frames = spark.createDataFrame(rows, SHOT).repartition(5)
    detections, status = detect_faces(frames, counting(noted), table, parts)
    assert status.count() == len(rows) and detections.count() == sum(0 if x in (None, b"bad") else shots.index(x) % 3 for *_, x in rows)
    assert calls(noted) == 7  # six images, and one that cannot be read
    detect_faces(frames, counting(noted), table, parts)[0].collect()
    assert calls(noted) == 7  # a run that is repeated
    more = frames.unionByName(spark.createDataFrame([("u", 0, image(9, 9, []))], SHOT))
    got = detect_faces(more, counting(noted), table, parts)[1].where("sequence_id = 'u'").first()
    assert calls(noted) == 8 and (got.height, got.width, got.decode_ok) == (9, 9, True)
    lost = detect_faces(frames, stub, table)[1].where("NOT decode_ok").select("sequence_id", "frame_index", "height").collect()
    assert sorted(map(tuple, lost)) == [("t", 1, 0), ("t", 2, 0)]


def test_a_run_that_fails_keeps_what_it_has_committed(spark, tmp_path):
    noted, table = str(tmp_path / "calls"), str(tmp_path / "found")
    frames = spark.createDataFrame([("s", k, image(k + 1, 6, [])) for k in range(12)], SHOT)
    worse = frames.unionByName(spark.createDataFrame([("s", 99, b"broken image")], SHOT))

    def failing():
        detector = counting(noted)()

        def detect(data):
            if data == b"broken image":
                raise RuntimeError("detector broke")
            return detector(data)

        return detect

    with pytest.raises(Exception, match="detector broke"):
        detect_once(worse, failing, table, parts=8)
    held = spark.read.parquet(table).count() if os.path.exists(table) else 0
    before = calls(noted)
    detect_once(worse, counting(noted), table, parts=8)
    assert calls(noted) - before == 13 - held and spark.read.parquet(table).count() == 13
    assert before < 12 + 4 * 12  # a failed part may be tried again, one that is committed is not


def test_empty_frames(spark, tmp_path):
    detections, status = detect_faces(spark.createDataFrame([], SHOT), stub, str(tmp_path / "found"))
    assert detections.count() == status.count() == 0


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def batch(spark):
    shots = [image(480, 640, [(box(10.0 + 100 * k), 0.9, A), (box(400.0), 0.9, B), (box(0.0), 0.3, A)]) for k in range(3)] + [b"bad", image(480, 640, [])]
    rows = [(s, k, x, datetime(2026, 1, 1, 0, 0, k)) for s in ("s", "t") for k, x in enumerate(shots)] + [("one", 0, shots[0], NOW)]
    frames = spark.createDataFrame(rows, f"{SHOT}, ts timestamp")
    detections, status = detect_faces(frames, stub)
    members = spark.createDataFrame([("ann", "Ann", NOW, 1, list(A))], schemas.MEMBERS)
    return stage(frames.join(status, ["sequence_id", "frame_index"]), "frames"), stage(detections, "detections"), members


def test_faces_are_shuffled_once(spark, batch):
    with identify_batch(*batch, save_guests=True, include_overlay=True) as out:
        layout = exchanges(out.identities).split("Initial Plan")[-1]  # the kept table may have run already
        assert layout.count("REPARTITION_BY_COL") == 1
        for name in ("frames", "marks"):
            plan = out[name]._jdf.queryExecution().sparkPlan().toString()
            assert "InMemoryTableScan" in plan
            executed = exchanges(out[name]).split("InMemoryRelation")[0]
            shuffled = [x.split("hashpartitioning(")[1].split(")")[0] for x in executed.splitlines() if "Exchange hashpartitioning" in x]
            assert len(shuffled) <= 1 and not any("frame_index" in x for x in shuffled), executed  # frames alone, by sequence
        linked = exchanges(out["motion"])
        assert "embedding" not in "".join(x for x in linked.split("InMemoryRelation")[0].splitlines() if "Exchange" in x)
        assert out.identities.storageLevel.useMemory
    assert not out.identities.storageLevel.useMemory


def test_frames_without_faces_and_single_images(spark, batch):
    with identify_batch(*batch, save_guests=True, include_overlay=True) as out:
        faces = {(r.sequence_id, r.frame_index): r.faces for r in out["frames"].collect()}
        assert len(faces) == 11 and [len(faces["s", k]) for k in range(5)] == [2, 2, 2, 0, 0] and [f.person_id for f in faces["one", 0]] == ["ann", "unknown"]
        marks = {(r.sequence_id, r.frame_index): r.marks for r in out["marks"].collect()}
        assert marks["s", 3] is None and marks["s", 4] == [] and [(m.label, m.colour) for m in marks["one", 0]] == [("Ann 100%", [0, 200, 0]), ("Guest 0%", [0, 165, 255])]
        assert sorted((r.sequence_id, r.person_id) for r in out["motion"].collect()) == [(s, p) for s in "st" for p in ("ann", "unknown_0")]
        guests = {(r.sequence_id, r.frame_index): r for r in out["guests"].collect()}
        assert len(guests) == 7 and guests["one", 0].file_name == "000000-000000_f0_1guests.jpg" and bytes(guests["one", 0].image)[:2] == b"IM"
        assert out["overlay"].count() == 14


def test_enrolment_from_a_folder_of_files(spark, tmp_path):
    for person, shots in {"ann": [image(4, 6, [(box(0.0), 0.9, A)]), b"bad", image(4, 6, [(box(0.0), 0.9, B), ((0, 0, 90, 90), 0.9, A)])], "b b": [image(4, 6, [])]}.items():
        (tmp_path / "in" / person).mkdir(parents=True)
        for k, x in enumerate(shots):
            (tmp_path / "in" / person / f"{k}.jpg").write_bytes(x)
    files = read_image_files(spark, str(tmp_path / "in"))
    nothing = Gallery(spark.createDataFrame([], schemas.MEMBERS), spark.createDataFrame([], schemas.MEMBER_EMBEDDINGS))
    gallery, report = enroll_images(nothing, files.withColumn("name", F.initcap("person_id")), stub, NOW)
    assert {r.person_id: (r.status, r.embedding_count, r.failed_images) for r in report.collect()} == {"ann": ("enrolled", 2, [1]), "b b": ("failed", 0, [0])}
    assert [(r.person_id, r.name, r.centroid) for r in gallery.members.collect()] == [("ann", "Ann", [1.0, 0.0])]


@pytest.mark.parametrize("chunk", [500_000, 3])
def test_files_are_read_once_and_their_bytes_stay(spark, tmp_path, chunk):
    want = {}
    for p in ("a", "b", "c d", "e[1]", "f"):
        (tmp_path / "in" / p).mkdir(parents=True)
        for k in range(2):
            (tmp_path / "in" / p / f"{k}.bin").write_bytes(f"{p}{k}".encode())
            want[p, k] = f"{p}{k}".encode()
    rows = read_image_files(spark, str(tmp_path / "in"), chunk)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("binaryFile") >= 1 and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert {(r.person_id, r.image_index): bytes(r.image) for r in rows.collect()} == want
