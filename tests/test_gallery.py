import threading
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest

from facejobs import schemas
from facejobs.operators import gallery as G
from facejobs.sources import Gallery, purge_versions, put_if_absent, read_gallery, update_gallery, write_gallery

NOW, OLD = datetime(2026, 2, 1), datetime(2026, 1, 1)
FACES = "person_id string, name string, image_index int, decode_ok boolean, face_index int, bbox array<double>, det_score double, embedding array<float>"


def box(side):
    return [0.0, 0.0, float(side), float(side)]


def empty(spark):
    return Gallery(spark.createDataFrame([], schemas.MEMBERS), spark.createDataFrame([], schemas.MEMBER_EMBEDDINGS))


def enroll(spark, gallery, rows):
    g, report = G.enroll(gallery, spark.createDataFrame(rows, FACES), NOW)
    return g, {r.person_id: r for r in report.collect()}


def test_largest_usable_face_and_failed_images(spark):
    rows = [
        ("p", "P", 0, True, 0, box(1), 0.9, [1.0, 0.0]),
        ("p", "P", 0, True, 1, box(3), 0.6, [0.0, 1.0]),
        ("p", "P", 0, True, 2, box(3), 0.9, [1.0, 0.0]),
        ("p", "P", 1, True, 0, box(9), 0.4, [1.0, 0.0]),
        ("p", "P", 2, False, None, None, None, None),
        ("q", "Q", 0, True, None, None, None, None),
    ]
    g, report = enroll(spark, empty(spark), rows)
    assert [(r.person_id, r.centroid, r.embedding_count, r.created_at) for r in g.members.collect()] == [("p", [0.0, 1.0], 1, NOW)]
    assert (report["p"].status, report["p"].failed_images, report["p"].n_added) == ("enrolled", [1, 2], 1)
    assert (report["q"].status, report["q"].embedding_count, report["q"].failed_images) == ("failed", 0, [0])


def test_two_steps_equal_one(spark):
    first = [("p", "P", k, True, 0, box(1), 0.9, v) for k, v in enumerate(([1.0, 0.0], [0.0, 1.0]))]
    second = [("p", "New", 2, True, 0, box(1), 0.9, [0.0, 1.0])]
    g, _ = enroll(spark, empty(spark), first)
    g, report = enroll(spark, g, second)
    whole, _ = enroll(spark, empty(spark), first + second)
    a, b = g.members.collect()[0], whole.members.collect()[0]
    assert report["p"].status == "updated" and a.name == b.name == "New" and a.embedding_count == b.embedding_count == 3
    assert a.centroid == pytest.approx(b.centroid) and a.centroid == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
    assert sorted(r.embedding_index for r in g.embeddings.collect()) == [0, 1, 2]


def test_failed_update_leaves_the_row(spark):
    g, _ = enroll(spark, empty(spark), [("p", "P", 0, True, 0, box(1), 0.9, [1.0, 0.0])])
    g, report = enroll(spark, g, [("p", "Other", 0, True, None, None, None, None)])
    r = g.members.collect()[0]
    assert (r.name, r.embedding_count, r.centroid, report["p"].status, report["p"].embedding_count) == ("P", 1, [1.0, 0.0], "failed", 1)


def test_mean_without_length_is_listed_but_not_usable(spark):
    g, _ = enroll(spark, empty(spark), [("p", "P", k, True, 0, box(1), 0.9, v) for k, v in enumerate(([1.0, 0.0], [-1.0, 0.0]))])
    assert g.members.collect()[0].centroid is None
    assert tuple(G.gallery_stats(g.members).collect()[0]) == (1, 0)


def test_centroid_forms_agree(spark):
    rows = [(f"p{k % 3}", k, [float(k), 1.0, -float(k % 4)]) for k in range(30)]
    e = spark.createDataFrame(rows, schemas.MEMBER_EMBEDDINGS).repartition(3)
    a, b = ({r.person_id: r.centroid for r in f(e).collect()} for f in (G.centroids, G.centroids_at_scale))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_remove_then_lookup_and_purge(spark, tmp_path):
    g, _ = enroll(spark, empty(spark), [(p, p, 0, True, 0, box(1), 0.9, [1.0, 0.0]) for p in ("a", "b")])
    path = str(tmp_path / "gallery")
    assert write_gallery(g, path) == 0
    left, report = G.remove_members(read_gallery(spark, path), spark.createDataFrame([("a",), ("x",)], "person_id string"))
    assert {r.person_id: r.removed for r in report.collect()} == {"a": True, "x": False}
    assert write_gallery(left, path) == 1 and purge_versions(spark, path) == [0]
    now = read_gallery(spark, path)
    assert [r.person_id for r in now.embeddings.collect()] == ["b"]
    found = G.lookup_members(spark.createDataFrame([("a",), ("b",)], "person_id string"), now.members)
    assert {r.person_id: r.found for r in found.collect()} == {"a": False, "b": True}


def test_list_order(spark):
    rows = [("2", "b", OLD, 1, None), ("1", "b", OLD, 1, None), ("3", "B", OLD, 1, None)]
    assert [r.person_id for r in G.list_members(spark.createDataFrame(rows, schemas.MEMBERS)).collect()] == ["3", "1", "2"]


NAN, INF = float("nan"), float("inf")
ODD = [None, [], [None, 1.0], [NAN, 1.0], [INF, 1.0]]


@pytest.mark.parametrize("form", [G.centroids, G.centroids_at_scale])
def test_centroids_of_odd_vectors(spark, form):
    rows = [("a", k, v) for k, v in enumerate([[1.0, 0.0], [1.0, 1.0], *ODD])] + [("only", k, v) for k, v in enumerate(ODD)]
    rows += [("two", 0, [1.0]), ("two", 1, [0.0, 2.0]), ("two", 2, [1.0]), (None, 0, [1.0, 0.0]), ("zero", 0, [0.0, 0.0]), ("repeated", 0, [3.0, 4.0]), ("repeated", 0, [3.0, 4.0])]
    got = {r.person_id: r.centroid for r in form(spark.createDataFrame(rows, schemas.MEMBER_EMBEDDINGS).repartition(3)).collect()}
    assert got.keys() == {"a", "two", "zero", "repeated"}
    assert got["a"] == pytest.approx([2 / 5**0.5, 1 / 5**0.5]) and got["two"] == [0.0, 1.0] and got["zero"] is None and got["repeated"] == pytest.approx([0.6, 0.8])
    assert form(spark.createDataFrame([], schemas.MEMBER_EMBEDDINGS)).count() == 0


def test_enrolment_passes_over_odd_vectors(spark):
    rows = [("p", "P", k, True, 0, box(9), 0.9, v) for k, v in enumerate(ODD)] + [("p", "P", 0, True, 1, box(1), 0.9, [1.0, 0.0]), (None, "N", 0, True, 0, box(1), 0.9, [1.0, 0.0])]
    g, report = enroll(spark, empty(spark), rows)
    assert [(r.person_id, r.centroid, r.embedding_count) for r in g.members.collect()] == [("p", [1.0, 0.0], 1)]
    assert report.keys() == {"p"} and report["p"].failed_images == [1, 2, 3, 4]


def test_enrolment_reads_and_writes_no_earlier_vector(spark, tmp_path):
    path = str(tmp_path / "gallery")
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(40, 8)).tolist()
    rows = [(f"p{k % 4}", "P", k, True, 0, box(1), 0.9, v) for k, v in enumerate(vectors)]
    first, _ = enroll(spark, empty(spark), rows[:25])
    write_gallery(first, path)
    update_gallery(spark, path, lambda g: enroll(spark, g, rows[25:])[0])
    old = {str(f) for f in Path(path, "data").rglob("embeddings/*.parquet")}
    g, _ = enroll(spark, read_gallery(spark, path, 0), rows[25:])
    read = {f.removeprefix("file:") for f in (*g.members.inputFiles(), *g.sums.inputFiles())}
    assert read and not read & old
    now = read_gallery(spark, path)
    assert now.embeddings.count() == 40 and len(now.stored) == 2
    a, b = ({r.person_id: r.centroid for r in t.collect()} for t in (now.members, G.centroids(now.embeddings)))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
    # elsewhere, such a gallery is written whole
    write_gallery(g, str(tmp_path / "copy"))
    assert read_gallery(spark, str(tmp_path / "copy")).embeddings.count() == 40


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "gallery")
    write_gallery(empty(spark), path)
    both, found, faults = threading.Barrier(2), [], []

    def enrolled(person):
        waited = []

        def change(g):
            if not waited:  # both have read the same version
                waited.append(both.wait(60))
            return enroll(spark, g, [(person, person, 0, True, 0, box(1), 0.9, [1.0, 0.0])])[0]

        try:
            found.append(update_gallery(spark, path, change))
        except Exception as e:
            faults.append(e)

    threads = [threading.Thread(target=enrolled, args=(p,)) for p in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not faults and sorted(found) == [1, 2]
    now = read_gallery(spark, path)
    assert sorted(r.person_id for r in now.members.collect()) == ["a", "b"] == sorted(r.person_id for r in now.embeddings.collect())
    assert len(list(Path(path, "data").iterdir())) == 3  # what the second wrote in vain is gone


def test_writers_that_replace_take_two_numbers(spark, tmp_path):
    path = str(tmp_path / "gallery")
    found = []
    threads = [threading.Thread(target=lambda: found.append(write_gallery(empty(spark), path))) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(found) == [0, 1, 2]


def test_a_crash_between_two_tables_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "gallery")
    g, _ = enroll(spark, empty(spark), [("a", "A", 0, True, 0, box(1), 0.9, [1.0, 0.0])])
    write_gallery(g, path)
    broken = Gallery(g.members.withColumn("embedding_count", G.F.raise_error(G.F.lit("crash")).cast("int")), g.embeddings)
    with pytest.raises(Exception, match="crash"):
        write_gallery(broken, path)
    assert len(list(Path(path, "data").iterdir())) == 2
    assert [r.person_id for r in read_gallery(spark, path).members.collect()] == ["a"]
    assert write_gallery(g, path) == 1 and purge_versions(spark, path) == [0]
    assert len(list(Path(path, "data").iterdir())) == 1 and read_gallery(spark, path).embeddings.count() == 1


def test_put_if_absent(spark, tmp_path):
    path = str(tmp_path / "new" / "file")
    assert put_if_absent(spark, path, "one") and not put_if_absent(spark, path, "two")
    assert Path(path).read_text() == "one" and [f.name for f in Path(path).parent.iterdir() if not f.name.endswith(".crc")] == ["file"]


def test_no_gallery(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_gallery(spark, str(tmp_path / "none"))
    assert purge_versions(spark, str(tmp_path / "none")) == []
