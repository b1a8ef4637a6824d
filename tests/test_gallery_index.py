from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from facejobs import schemas
from facejobs.operators.gallery_index import build_index, identify_by_index, open_index
from facejobs.operators.identify import identify, usable
from facejobs.params import Params
from facejobs.sources.shared import new_path

T0 = datetime(2026, 1, 1)


def clustered(n, size=16, clusters=40, noise=0.08, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(clusters, size))[rng.integers(0, clusters, n)] / size**0.5 + rng.normal(size=(n, size)) * noise
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


@pytest.fixture(scope="module")
def many(spark):
    """100,000 members and faces near them, as stored tables."""
    x, probes = clustered(100_000), clustered(300, seed=4)
    folder = new_path(spark, "many")
    spark.createDataFrame([(f"p{k}", f"N{k}", T0 + timedelta(seconds=k % 1000), 1, v) for k, v in enumerate(x.tolist())], schemas.MEMBERS).write.parquet(f"{folder}/members")
    spark.createDataFrame([("s", k, 0, [0.0] * 4, 0.9, v) for k, v in enumerate(probes.tolist())], schemas.DETECTIONS).write.parquet(f"{folder}/faces")
    return spark.read.parquet(f"{folder}/members"), spark.read.parquet(f"{folder}/faces"), x


def test_equals_all_products_on_a_large_gallery_and_prunes(spark, many):
    members, faces, x = many
    index = build_index(usable(members), new_path(spark, "index"))
    found = identify_by_index(faces, index).collect()
    probes = np.array([r.embedding for r in found], np.float64)
    scores = probes @ x.T
    for r, s in zip(found, scores):
        assert abs(-r._best.minus - s.max()) < 1e-9 and s[int(r._best.person_id[1:])] >= s.max() - 1e-12
    share = 1 - sum(r._compared for r in found) / (len(found) * len(x))
    print(f"share of products pruned: {share:.3f}")
    assert len(found) == 300 and share > 0.8
    # a stored index serves later jobs, and what is shuffled or replicated is nothing
    again = identify(faces, None, index=open_index(spark, index.folder))
    assert "Exchange" not in again._jdf.queryExecution().toString()
    a = {r.frame_index: (r.person_id, round(r.confidence, 9)) for r in again.collect()}
    few = faces.where("frame_index < 12")
    b = {r.frame_index: (r.person_id, round(r.confidence, 9)) for r in identify(few, members, Params(broadcast_bytes=1 << 30), plan="columns").collect()}
    assert len(b) == 12 and all(a[k] == v for k, v in b.items())


def test_a_large_gallery_always_goes_by_blocks(spark, many):
    members, faces, _ = many
    part = members.where(F.col("embedding_count") == 1).where(F.pmod(F.hash("person_id"), F.lit(10)) == 0)
    small = Params(broadcast_bytes=1 << 16)
    got = {r.frame_index: (r.person_id, round(r.confidence, 9)) for r in identify(faces, part, small, plan="matrix").collect()}
    assert got == {r.frame_index: (r.person_id, round(r.confidence, 9)) for r in identify(faces, part, plan="matrix").collect()}


def test_ties_across_blocks_and_few_bytes(spark):
    """One vector many times, more than a block holds: the first in gallery order wins."""
    rows = [(f"p{k:04}", f"N{k}", T0 + timedelta(seconds=(k * 7) % 1500), 1, [0.6, 0.8]) for k in range(1500)] + [(f"q{k}", "Q", T0, 1, [k / 500, 0.0]) for k in range(400)]
    members = spark.createDataFrame(rows, schemas.MEMBERS)
    faces = spark.createDataFrame([("s", k, 0, [0.0] * 4, 0.9, v) for k, v in enumerate([[0.6, 0.8], [1.0, 0.0], [-1.0, 0.0]])], schemas.DETECTIONS)
    got = [(r.person_id, round(r.confidence, 6)) for r in identify(faces, members, Params(broadcast_bytes=2048), plan="blocks").orderBy("frame_index").collect()]
    assert got == [("p0000", 1.0), ("q399", 0.798), ("unknown", 0.0)]


def test_empty_gallery(spark):
    members = spark.createDataFrame([], schemas.MEMBERS)
    index = build_index(usable(members), new_path(spark, "index"))
    faces = spark.createDataFrame([("s", 0, 0, [0.0] * 4, 0.9, [1.0])], schemas.DETECTIONS)
    assert [(r._best, r._compared) for r in identify_by_index(faces, index).collect()] == [(None, 0)]
