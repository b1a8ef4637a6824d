"""Times headline queries, and identification in galleries of three sizes; prints one JSON line."""

from __future__ import annotations

import importlib
import json
import os
import tempfile
import time
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

QUERIES = (
    "identify_columns", "identify_matrix", "identify_blocks", "centroids", "centroids_at_scale", "detect_motion_known", "detect_motion_linked", "track_summary", "enroll_members", "link_unknowns",
    "identify_batch_frames", "motion_stream",
)
#: Members of the galleries, and the plans timed on each.
GALLERIES = {100: ("columns", "matrix"), 1_000: ("columns", "matrix"), 100_000: ("matrix", "index")}


def timed(make) -> float:
    """Seconds of the second of two runs."""
    for _ in range(2):
        began = time.time()
        make().write.format("noop").mode("overwrite").save()
    return round(time.time() - began, 3)


def gallery(spark: SparkSession, faces: DataFrame, n: int, folder: str) -> DataFrame:
    """A stored gallery of ``n`` people in clusters around some of the faces."""
    import numpy as np
    import pandas as pd

    from facejobs import schemas

    rng = np.random.default_rng(n)
    base = np.array([r["embedding"] for r in faces.orderBy("vec_id").limit(200).collect()])
    x = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, base.shape[1])) * 0.05
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    t0 = datetime(2026, 1, 1)
    rows = pd.DataFrame({"person_id": [f"p{k}" for k in range(n)], "name": [f"Person {k}" for k in range(n)], "created_at": [t0 + timedelta(seconds=k) for k in range(n)], "embedding_count": 1, "centroid": x.tolist()})
    spark.createDataFrame(rows, schemas.MEMBERS).write.parquet(f"{folder}/members")
    return spark.read.parquet(f"{folder}/members")


def galleries(spark: SparkSession, sf_dir: str, scratch: str) -> tuple[dict[str, float], float]:
    """Seconds by gallery and plan, galleries and index made beforehand; the share of products that
    the index spares."""
    from pyspark.sql import functions as F

    from facejobs import queries
    from facejobs.operators.gallery_index import build_index, identify_by_index
    from facejobs.operators.identify import identify, usable

    faces, seconds, pruned = queries.detections(spark, sf_dir), {}, 0.0
    for n, plans in GALLERIES.items():
        members = gallery(spark, faces, n, f"{scratch}/gallery-{n}")
        index = None
        if "index" in plans:
            began = time.time()
            index = build_index(usable(members), f"file://{scratch}/index-{n}")
            seconds[f"build_index_{n}"] = round(time.time() - began, 3)
            work = identify_by_index(faces, index).agg(F.sum("_compared"), F.count("*")).first()
            pruned = round(1 - work[0] / (work[1] * n), 4)
        for plan in plans:
            how = {"index": index} if plan == "index" else {"plan": plan}
            seconds[f"identify_{n}_{plan}"] = timed(lambda members=members, how=how: identify(faces, members, **how))
    return seconds, pruned


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{scratch}/shared")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = importlib.import_module("__spark_entry__").queries()
    seconds = {name: timed(lambda name=name: queries[name](spark, sf_dir)) for name in QUERIES if name in queries}
    more, pruned = galleries(spark, sf_dir, scratch)
    seconds |= more
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "index_spares": pruned}))
    spark.stop()


if __name__ == "__main__":
    main()
