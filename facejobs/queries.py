"""Queries over the given tables, one per operator, and their SQL forms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facejobs.functions import area, dot, geometry, is_guest, match_band
from facejobs.operators import gallery as G
from facejobs.operators import motion as M
from facejobs.operators import results as R
from facejobs.operators.identify import filter_detections, identify
from facejobs.params import Params
from facejobs.plans import identify_batch
from facejobs.sources import Gallery, decode_payload, detect_faces, explode_frames, guest_file_names, purge_versions, read_gallery, read_image_files, update_gallery, validate_requests, write_gallery
from facejobs.sources.shared import new_path
from facejobs.streaming import identify_stream, motion_stream, table_sink

NOW = datetime(2026, 1, 1)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- inputs made of the given tables ---------------------------------------------------------


def member_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, those of a label being a person's."""
    rank = F.expr("row_number() over (partition by label order by vec_id)")
    rows = _table(spark, sf_dir, "embeddings").withColumn("k", rank)
    return rows.select(F.concat(F.lit("p"), F.col("label").cast("string")).alias("person_id"), (F.col("k") - 1).cast("int").alias("embedding_index"), F.col("embedding").cast("array<float>").alias("embedding"), "vec_id", "label")


def held_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in the gallery before enrolment: every other vector, none of p0; the rest is enrolled."""
    return member_embeddings(spark, sf_dir).where("embedding_index % 2 = 0 AND label > 0").withColumn("embedding_index", F.expr("cast(embedding_index div 2 as int)"))


def members(spark: SparkSession, sf_dir: str, embeddings=member_embeddings) -> DataFrame:
    vectors = embeddings(spark, sf_dir)
    who = vectors.groupBy("person_id", "label").agg(F.count("*").cast("int").alias("embedding_count"))
    return who.join(G.centroids(vectors), "person_id").select(
        "person_id", F.concat(F.lit("Person "), F.col("label").cast("string")).alias("name"), F.timestamp_seconds(F.col("label")).alias("created_at"), "embedding_count", "centroid"
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    x, y = ((v * k) % n for k, n in ((37, 400), (53, 300)))
    w, h = 60 + (v * 17) % 80, 80 + (v * 29) % 90
    return _table(spark, sf_dir, "embeddings").select(
        F.expr("cast(vec_id div 50 as string)").alias("sequence_id"), F.expr("cast((vec_id % 50) div 2 as int)").alias("frame_index"), (v % 2).cast("int").alias("face_index"),
        F.array(*(c.cast("double") for c in (x, y, x + w, y + h))).alias("bbox"), ((30 + (v * 13) % 70).cast("double") / 100).alias("det_score"),
        F.col("embedding").cast("array<float>").alias("embedding"), "vec_id", "label",
    )


def enroll_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select(
        F.concat(F.lit("p"), F.col("label").cast("string")).alias("person_id"), F.concat(F.lit("New "), F.col("label").cast("string")).alias("name"),
        F.expr("cast(vec_id div 10 as int)").alias("image_index"), F.lit(True).alias("decode_ok"), F.col("vec_id").cast("int").alias("face_index"), "bbox", "det_score", "embedding", "vec_id",
    )


def _enroll(spark: SparkSession, sf_dir: str) -> tuple[Gallery, DataFrame]:
    held = held_embeddings(spark, sf_dir).select("person_id", "embedding_index", "embedding")
    old = Gallery(members(spark, sf_dir, held_embeddings), held, G.vector_sums(held))
    return G.enroll(old, _new_faces(spark, sf_dir).drop("vec_id"), NOW)


def _new_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enroll_faces(spark, sf_dir).join(held_embeddings(spark, sf_dir).select("vec_id"), "vec_id", "left_anti")


def _identities(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return identify(filter_detections(detections(spark, sf_dir)).drop("vec_id", "label"), members(spark, sf_dir), **how)


def _tracks_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(frames, identities) of the events table: a day is a sequence, an event a frame with one face."""
    side = (80 + (F.col("event_id") * 7) % 13).cast("double")
    value = F.col("value").cast("double")
    rows = _table(spark, sf_dir, "events").select(
        F.expr("cast(cast(ts as date) as string)").alias("sequence_id"), F.expr("cast(row_number() over (partition by cast(ts as date) order by ts, event_id) - 1 as int)").alias("frame_index"),
        F.lit(0).alias("face_index"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("person_id"), F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("name"),
        F.array(value, F.lit(0.0), value + side, side).alias("bbox"), ((40 + F.col("event_id") % 60).cast("double") / 100).alias("confidence"),
    )
    return rows.select("sequence_id", "frame_index", F.lit(480).alias("height"), F.lit(640).alias("width")), rows


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids asked for: some people's, and for each other vector one that nobody has."""
    known, nobody = F.concat(F.lit("p"), F.col("label").cast("string")), F.concat(F.lit("nobody"), F.col("vec_id").cast("string"))
    return _table(spark, sf_dir, "embeddings").select(F.when(F.col("label") % 3 == 0, known).otherwise(nobody).alias("person_id")).distinct()


# --- queries --------------------------------------------------------------------------------

r6 = lambda c, name: F.round(c, 6).alias(name)


def q_identify(spark, sf_dir, **how):
    found = identify(detections(spark, sf_dir).drop("label"), members(spark, sf_dir), **how)
    return found.select("vec_id", "sequence_id", "frame_index", "face_index", "person_id", "name", r6("confidence", "confidence"))


def q_explode_frames(spark, sf_dir):
    batches = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("images"))
    return explode_frames(batches).select(F.col("conv_id").alias("sequence_id"), "frame_index", "payload")


def q_decode_payload(spark, sf_dir):
    plain = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", "")
    kind = (F.col("conv_id") + F.col("turn")) % 3
    payload = F.when(kind == 0, plain).when(kind == 1, F.concat(F.lit("data:image/png;base64,"), plain)).otherwise("###")
    decoded = decode_payload(_table(spark, sf_dir, "conversations").select("conv_id", "turn", payload.alias("payload")))
    return decoded.select("conv_id", "turn", "decode_ok", F.col("image").cast("string").alias("text"))


def q_guest_file_names(spark, sf_dir):
    guests = _table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("saved_at"), (F.col("event_id") % 5).alias("frame_index"), (1 + F.col("event_id") % 3).alias("guest_count"))
    return guest_file_names(guests).select("event_id", "file_name", F.col("date").cast("string").alias("date"))


def q_validate_requests(spark, sf_dir):
    n = lambda k, m: ((F.col("doc_id") * k) % m).cast("int")
    requests = _table(spark, sf_dir, "documents").select("doc_id", F.repeat(F.lit("a"), n(7, 80)).alias("person_id"), F.repeat(F.lit("b"), n(11, 150)).alias("name"), F.array_repeat(F.lit("x"), n(1, 3)).alias("images"))
    return validate_requests(requests, "enroll").select("doc_id", "reason")


def q_box_geometry(spark, sf_dir):
    rows = detections(spark, sf_dir).withColumn("g", geometry("bbox"))
    return rows.select("vec_id", "g.cx", "g.cy", "g.width", "g.height", area("bbox").alias("area"))


def q_match_band(spark, sf_dir):
    return _identities(spark, sf_dir).groupBy(match_band("confidence").alias("band")).agg(F.count("*").alias("n"))


def q_pair_similarity(spark, sf_dir):
    a = _table(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", r6(dot("embedding", "other"), "similarity"))


def q_centroids(spark, sf_dir, how=G.centroids):
    return how(member_embeddings(spark, sf_dir)).select("person_id", F.posexplode("centroid").alias("pos", "x")).select("person_id", "pos", r6("x", "x"))


def q_largest_face(spark, sf_dir):
    return G.largest_face(filter_detections(enroll_faces(spark, sf_dir))).select("person_id", "image_index", "vec_id")


def q_embedding_index(spark, sf_dir):
    best = G.largest_face(filter_detections(_new_faces(spark, sf_dir)))
    return G.assign_embedding_index(best, members(spark, sf_dir, held_embeddings)).select("person_id", "image_index", "embedding_index")


def q_enroll_members(spark, sf_dir):
    rows = _enroll(spark, sf_dir)[0].members
    return rows.select("person_id", "name", F.col("created_at").cast("string").alias("created_at"), "embedding_count", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


def q_enroll_report(spark, sf_dir):
    return _enroll(spark, sf_dir)[1].select("person_id", "status", "embedding_count", F.size("failed_images").alias("n_failed"))


def q_enroll_failed_images(spark, sf_dir):
    return G.enroll_failed_images(enroll_faces(spark, sf_dir)).select("person_id", F.explode("failed_images").alias("image_index"))


def q_lookup_members(spark, sf_dir):
    return G.lookup_members(_ids(spark, sf_dir), members(spark, sf_dir)).select("person_id", "name", "embedding_count", "found")


def q_remove_members(spark, sf_dir):
    left, _ = G.remove_members(Gallery(members(spark, sf_dir), member_embeddings(spark, sf_dir)), _ids(spark, sf_dir))
    return left.members.select("person_id").join(left.embeddings.groupBy("person_id").agg(F.count("*").alias("n_vectors")), "person_id", "full_outer")


def q_remove_report(spark, sf_dir):
    return G.remove_members(Gallery(members(spark, sf_dir), member_embeddings(spark, sf_dir)), _ids(spark, sf_dir))[1]


def q_frame_results(spark, sf_dir):
    frames = detections(spark, sf_dir).select("sequence_id", "frame_index").distinct()
    rows = R.frame_results(frames, _identities(spark, sf_dir))
    return rows.select("sequence_id", "frame_index", F.size("faces").alias("n_faces"), F.array_join(F.transform("faces", lambda f: F.concat_ws(":", f["face_index"].cast("string"), f["person_id"])), ",").alias("faces"))


def q_overlay(spark, sf_dir):
    return R.overlay(_identities(spark, sf_dir)).select("sequence_id", "frame_index", "face_index", "x1", "y1", "x2", "y2", F.array_join("colour", ",").alias("colour"), "label")


def q_track_summary(spark, sf_dir):
    frames, identities = _tracks_input(spark, sf_dir)
    t = M.track_summary(M.entries_of(identities, link=False), frames)
    return t.select(
        "sequence_id", F.col("track_key").alias("person_id"), "n_entries", "name", r6("mean_confidence", "mean_confidence"), F.col("first_point.cx").alias("first_cx"), F.col("last_point.cx").alias("last_cx"),
        F.size("trajectory").alias("n_points"), F.aggregate("trajectory", F.lit(0.0), lambda s, p: s + p["cx"]).alias("sum_cx"), "height", "width",
    )


def q_motion_direction(spark, sf_dir):
    frames, identities = _tracks_input(spark, sf_dir)
    t = M.motion_direction(M.track_summary(M.entries_of(identities, link=False), frames, trajectory=False))
    return t.select("sequence_id", F.col("track_key").alias("person_id"), "direction", F.round("confidence", 9).alias("confidence"))


def q_track_numbers(spark, sf_dir):
    frames, identities = _tracks_input(spark, sf_dir)
    t = M.number_tracks(M.track_summary(M.entries_of(identities, link=False), frames, trajectory=False))
    return t.select("sequence_id", F.col("track_key").alias("person_id"), F.col("track_id").cast("int").alias("track_id"))


def q_detect_motion(spark, sf_dir):
    frames, identities = _tracks_input(spark, sf_dir)
    t = M.detect_motion(frames, identities, link=False, trajectory=False)
    return t.select("sequence_id", F.col("track_id").cast("int").alias("track_id"), "person_id", "name", "direction", F.round("confidence", 9).alias("confidence"))


def q_detect_motion_linked(spark, sf_dir):
    """Known people and linked guests of the detections, in frames of the same size. These vectors
    are mostly unlike each other, so guests are linked from a similarity of 0.2 on."""
    found = _identities(spark, sf_dir, keep_embedding=True)
    frames = detections(spark, sf_dir).select("sequence_id", "frame_index", F.lit(480).alias("height"), F.lit(640).alias("width")).distinct()
    tracks = M.detect_motion(frames, found, Params(cross_frame_similarity=0.2), trajectory=False)
    return tracks.withColumns({"track_id": F.col("track_id").cast("int"), "confidence": F.round("confidence", 9)})


def q_link_unknowns(spark, sf_dir):
    found = M.link_unknowns(_identities(spark, sf_dir, keep_embedding=True))
    return found.select("sequence_id", "frame_index", "face_index", "link_no", "track_key")


def _shots(spark, sf_dir):
    """(frames, detections) of the identify-batch job: every sixth frame could not be
    read and holds no faces."""
    found = detections(spark, sf_dir)
    frames = found.select("sequence_id", "frame_index", F.lit(480).alias("height"), F.lit(640).alias("width")).distinct()
    frames = frames.withColumns({"decode_ok": F.col("frame_index") % 6 != 5, "image": F.concat_ws(":", "sequence_id", "frame_index").cast("binary"), "ts": F.timestamp_seconds(F.col("sequence_id").cast("long") * 1000 + F.col("frame_index"))})
    return frames, found.where("frame_index % 6 <> 5").drop("vec_id", "label")


def q_identify_batch(spark, sf_dir, part):
    frames, found = _shots(spark, sf_dir)
    out = identify_batch(frames, found, members(spark, sf_dir), Params(cross_frame_similarity=0.2), include_motion=part == "motion", save_guests=part == "guests", include_overlay=part == "marks")
    rows = out[part]
    nested = lambda c, f: F.array_join(F.transform(c, f), ",")
    if part == "frames":
        return rows.select("sequence_id", "frame_index", nested("faces", lambda f: F.concat_ws(":", f["face_index"], f["person_id"], f["name"], F.format_number(f["confidence"], 4), f["bbox"][0].cast("int"))).alias("faces"))
    if part == "guests":
        return rows.select("sequence_id", "frame_index", "guest_count", F.col("image").cast("string").alias("image"), "file_name", F.col("date").cast("string").alias("date"))
    if part == "marks":
        return rows.select("sequence_id", "frame_index", nested("marks", lambda m: F.concat_ws(":", m["face_index"], m["x1"], m["y1"], m["x2"], m["y2"], m["colour"][2], m["label"])).alias("marks"))
    return rows.select("sequence_id", F.col("track_id").cast("int").alias("track_id"), "person_id", "name", "direction", F.round("confidence", 9).alias("confidence"), F.size("trajectory").alias("n_points"))


def _letters():
    """A stand-in for a detector: what it finds follows from the number of bytes."""

    def detector(data):
        n = len(data)
        return None if n % 10 == 9 else (n, 640, [((k, 0.0, k + n % 50, 10.0), (float(n % 97), float(k)), (n % 100) / 100) for k in range(n % 3)])

    return detector


def _detected(spark, sf_dir):
    images = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sequence_id"), F.lit(0).alias("frame_index"), F.col("text").cast("binary").alias("image"))
    return detect_faces(images, _letters)


def q_detect_faces(spark, sf_dir):
    rows = _detected(spark, sf_dir)[0]
    return rows.select("sequence_id", "face_index", F.col("bbox")[0].alias("x1"), F.col("bbox")[2].alias("x2"), "det_score", F.col("embedding")[0].cast("double").alias("e0"))


def q_image_files(spark, sf_dir):
    """Texts by language as files, read back as images."""
    folder = new_path(spark, "images")
    _table(spark, sf_dir, "documents").select("lang", F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("lang").text(folder)
    rows = read_image_files(spark, folder).groupBy("person_id").agg(F.sum(F.octet_length("image")).alias("n_bytes"), F.min("image_index").alias("first_index"), (F.max("image_index") - F.count("*") + 1).alias("gaps"), (F.count("*") - F.countDistinct("image_index")).alias("repeats"))
    return rows.select("person_id", "n_bytes", *(F.col(c).cast("long").alias(c) for c in ("first_index", "gaps", "repeats")))


def q_gallery_versions(spark, sf_dir):
    """A gallery written, extended by enrolment, reduced by removal, purged and read back."""
    path = new_path(spark, "gallery")
    held = held_embeddings(spark, sf_dir).select("person_id", "embedding_index", "embedding")
    write_gallery(Gallery(members(spark, sf_dir, held_embeddings), held), path)
    update_gallery(spark, path, lambda g: G.enroll(g, _new_faces(spark, sf_dir).drop("vec_id"), NOW)[0])
    update_gallery(spark, path, lambda g: G.remove_members(g, _ids(spark, sf_dir))[0])
    purged = len(purge_versions(spark, path))
    left = read_gallery(spark, path)
    n, total = (t.groupBy("person_id").agg(f) for t, f in ((left.embeddings, F.count("*").alias("n_vectors")), (left.sums, F.sum("n").alias("n_summed"))))
    return left.members.join(n, "person_id", "full_outer").join(total, "person_id", "full_outer").select("person_id", "name", "embedding_count", "n_vectors", "n_summed", F.lit(purged).alias("n_purged"))


def q_identify_stream(spark, sf_dir):
    """Identification as a stream over the embeddings, into a table."""
    folder, schema = new_path(spark, "identify-stream"), _table(spark, sf_dir, "embeddings").schema
    write_gallery(Gallery(members(spark, sf_dir), member_embeddings(spark, sf_dir).select("person_id", "embedding_index", "embedding")), f"{folder}/gallery")
    rows = detections(_Stream(spark, schema), sf_dir).drop("label")
    writer = identify_stream(rows, f"{folder}/gallery", table_sink(f"{folder}/out"), pins=f"{folder}/pins")
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("vec_id", "sequence_id", "frame_index", "face_index", "person_id", "name", r6("confidence", "confidence"))


def q_motion_stream(spark, sf_dir):
    """Motion as a stream over the events: a user is a sequence, which a pause of two hours ends;
    those that later events have not closed yet are left out."""
    folder = new_path(spark, "motion-stream")
    side, value = (80 + (F.col("event_id") * 7) % 13).cast("double"), F.col("value").cast("double")
    face = F.struct(
        F.lit(0).alias("face_index"), F.array(value, F.lit(0.0), value + side, side).alias("bbox"), F.concat(F.lit("k"), (F.col("event_id") % 2).cast("string")).alias("person_id"), F.lit("N").alias("name"),
        ((40 + F.col("event_id") % 60).cast("double") / 100).alias("confidence"), F.lit(None).cast("array<float>").alias("embedding"),
    )
    rows = _Stream(spark, _table(spark, sf_dir, "events").schema).read.parquet(f"{sf_dir}/events.parquet")
    frames = rows.select(F.col("user_id").cast("string").alias("sequence_id"), F.col("event_id").cast("int").alias("frame_index"), F.lit(480).alias("height"), F.lit(640).alias("width"), F.col("ts").cast("timestamp").alias("ts"), F.array(face).alias("faces"))
    writer = motion_stream(frames, table_sink(f"{folder}/out"), "2 hours", "1 hour")
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    at = F.unix_micros(F.substring_index("sequence_id", "@", -1).cast("timestamp"))
    return spark.read.parquet(f"{folder}/out").select(F.substring_index("sequence_id", "@", 1).alias("sequence_id"), at.alias("start_us"), F.col("track_id").cast("int").alias("track_id"), "person_id", "direction", F.round("confidence", 9).alias("confidence"))


class _Stream:
    """Reads a table as a stream where a session reads it as a table. A stream of files takes a
    folder or a pattern, so the name of a table that may be either is made a pattern."""

    def __init__(self, spark: SparkSession, schema):
        self.read, self.stream = self, spark.readStream.schema(schema)

    def parquet(self, path: str) -> DataFrame:
        return self.stream.parquet(f"{path[:-1]}[{path[-1]}]")


def queries() -> dict:
    return {
        "identify": q_identify,
        "identify_columns": lambda s, d: q_identify(s, d, plan="columns"),
        "identify_matrix": lambda s, d: q_identify(s, d, plan="matrix"),
        "identify_blocks": lambda s, d: q_identify(s, d, plan="blocks"),
        "match_band": q_match_band,
        "pair_similarity": q_pair_similarity,
        "centroids": q_centroids,
        "centroids_at_scale": lambda s, d: q_centroids(s, d, G.centroids_at_scale),
        "filter_detections": lambda s, d: filter_detections(detections(s, d)).select("vec_id", "det_score"),
        "box_geometry": q_box_geometry,
        "largest_face": q_largest_face,
        "embedding_index": q_embedding_index,
        "enroll_members": q_enroll_members,
        "enroll_report": q_enroll_report,
        "enroll_failed_images": q_enroll_failed_images,
        "lookup_members": q_lookup_members,
        "remove_members": q_remove_members,
        "remove_report": q_remove_report,
        "list_members": lambda s, d: G.list_members(members(s, d)).select("person_id", "name", "embedding_count"),
        "gallery_stats": lambda s, d: G.gallery_stats(members(s, d)),
        "explode_frames": q_explode_frames,
        "decode_payload": q_decode_payload,
        "validate_requests": q_validate_requests,
        "guest_file_names": q_guest_file_names,
        "guest_counts": lambda s, d: R.guest_counts(_identities(s, d)),
        "frame_results": q_frame_results,
        "overlay": q_overlay,
        "track_summary": q_track_summary,
        "motion_direction": q_motion_direction,
        "track_numbers": q_track_numbers,
        "detect_motion_known": q_detect_motion,
        "detect_motion_linked": q_detect_motion_linked,
        "link_unknowns": q_link_unknowns,
        **{f"identify_batch_{part}": lambda s, d, part=part: q_identify_batch(s, d, part) for part in ("frames", "motion", "guests", "marks")},
        "detect_faces": q_detect_faces,
        "detect_status": lambda s, d: _detected(s, d)[1],
        "image_files": q_image_files,
        "gallery_versions": q_gallery_versions,
        "identify_stream": q_identify_stream,
        "motion_stream": q_motion_stream,
    }


# --- SQL ------------------------------------------------------------------------------------

_MEMBERS = "me AS (SELECT 'p' || label AS person_id, label, vec_id, embedding FROM embeddings),"
_HELD = "me AS (SELECT 'p' || label AS person_id, label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings QUALIFY k % 2 = 1 AND label > 0),"
_MEANS = """
mean AS (SELECT person_id, label, pos, avg(x::DOUBLE) AS m, count(*) AS n FROM (SELECT person_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM me) GROUP BY ALL),
norm AS (SELECT person_id, sqrt(sum(m * m)) AS l FROM mean GROUP BY 1),
cent AS (SELECT person_id, label, pos, m / l AS x, n FROM mean JOIN norm USING (person_id)),
mem AS (SELECT person_id, 'Person ' || label AS name, label, max(n) AS embedding_count, list(x ORDER BY pos) AS centroid FROM cent GROUP BY ALL)
"""
_GALLERY = _MEMBERS + _MEANS
_DET = """
det AS (SELECT vec_id, label, embedding, (vec_id // 50)::VARCHAR AS sequence_id, (vec_id % 50) // 2 AS frame_index, vec_id % 2 AS face_index,
  ((vec_id * 37) % 400)::DOUBLE AS x1, ((vec_id * 53) % 300)::DOUBLE AS y1, (60 + (vec_id * 17) % 80)::DOUBLE AS w, (80 + (vec_id * 29) % 90)::DOUBLE AS h,
  (30 + (vec_id * 13) % 70)::DOUBLE / 100 AS det_score FROM embeddings)
"""
_BEST = """
score AS (SELECT d.vec_id, m.person_id, m.name, m.label, list_dot_product(d.embedding::DOUBLE[], m.centroid) AS s FROM det d, mem m),
best AS (SELECT vec_id, person_id, name, s FROM score QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1),
ident AS (SELECT det.*, CASE WHEN s >= 0.4::DOUBLE THEN person_id ELSE 'unknown' END AS person_id, CASE WHEN s >= 0.4::DOUBLE THEN name ELSE 'Guest' END AS name,
  least(1.0::DOUBLE, greatest(0.0::DOUBLE, s)) AS confidence FROM det JOIN best USING (vec_id))
"""
_BATCH = f"WITH RECURSIVE {_GALLERY}, {_DET}, {_BEST}, kept AS (SELECT * FROM ident WHERE det_score >= 0.5::DOUBLE AND frame_index % 6 <> 5)"
_KEPT = f"WITH RECURSIVE {_GALLERY}, {_DET}, {_BEST}, kept AS (SELECT * FROM ident WHERE det_score >= 0.5::DOUBLE)"
_FACES = f"WITH {_DET}, f AS (SELECT 'p' || label AS person_id, label, vec_id // 10 AS image_index, vec_id, w * h AS a, det_score, embedding FROM det)"
_IDS = "ids AS (SELECT DISTINCT CASE WHEN label % 3 = 0 THEN 'p' || label ELSE 'nobody' || vec_id END AS person_id FROM embeddings)"
_NEW = f"""
WITH {_HELD}{_MEANS}, {_DET},
f AS (SELECT 'p' || label AS person_id, label, (vec_id // 10)::INT AS image_index, vec_id, w * h AS a, det_score, embedding FROM det WHERE vec_id NOT IN (SELECT vec_id FROM me)),
fresh AS (SELECT * FROM f WHERE det_score >= 0.5::DOUBLE QUALIFY row_number() OVER (PARTITION BY person_id, image_index ORDER BY a DESC, vec_id) = 1),
added AS (SELECT person_id, label, count(*) AS n_added FROM fresh GROUP BY ALL),
old AS (SELECT * FROM mem),
failed AS (SELECT person_id, count(*) AS n_failed FROM (SELECT DISTINCT person_id, image_index FROM f EXCEPT SELECT person_id, image_index FROM fresh) GROUP BY 1)
"""
_DIRECTION = """mv AS (SELECT *, abs(last_cx - first_cx) / 640 AS side, (a1 - a0) / ((a0 + a1) / 2) AS depth FROM tr),
dir AS (SELECT *, side >= 0.05::DOUBLE AND (abs(depth) < 0.15::DOUBLE OR side > abs(depth)) AS is_side, abs(depth) >= 0.15::DOUBLE AS is_depth FROM mv),
out AS (SELECT *, CASE WHEN is_side THEN CASE WHEN last_cx > first_cx THEN 'left-to-right' ELSE 'right-to-left' END WHEN is_depth THEN CASE WHEN depth > 0 THEN 'towards-camera' ELSE 'away-from-camera' END ELSE 'stationary' END AS direction,
  least(mean_confidence, CASE WHEN is_side THEN least(1.0::DOUBLE, side / 0.05::DOUBLE * 0.5::DOUBLE) WHEN is_depth THEN least(1.0::DOUBLE, abs(depth)) ELSE greatest(0.0::DOUBLE, 1 - greatest(side / 0.05::DOUBLE, abs(depth) / 0.15::DOUBLE)) END) AS confidence,"""
_TRACKS = f"""
WITH e AS (SELECT CAST(ts AS DATE)::VARCHAR AS sequence_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS frame_index, 'u' || user_id AS person_id, 'User ' || user_id AS name,
  value::DOUBLE AS x1, (80 + (event_id * 7) % 13)::DOUBLE AS w, (40 + event_id % 60)::DOUBLE / 100 AS confidence FROM events),
tr AS (SELECT sequence_id, person_id, count(*) AS n_entries, min_by(name, frame_index) AS name, avg(confidence) AS mean_confidence, min(frame_index) AS first_frame,
  min_by((x1 + (x1 + w)) / 2, frame_index) AS first_cx, max_by((x1 + (x1 + w)) / 2, frame_index) AS last_cx, min_by(((x1 + w) - x1) * w, frame_index) AS a0, max_by(((x1 + w) - x1) * w, frame_index) AS a1,
  sum((x1 + (x1 + w)) / 2) AS sum_cx FROM e GROUP BY ALL HAVING count(*) >= 2),
{_DIRECTION}
  row_number() OVER (PARTITION BY sequence_id ORDER BY first_frame) - 1 AS track_id FROM dir)
"""
#: Tracks of guests by a recursive walk: one guest of every sequence a step, the tracks' last vectors in a list.
_LINK = """
guest AS (SELECT sequence_id, frame_index, face_index, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY sequence_id ORDER BY frame_index, face_index) AS k FROM kept WHERE person_id = 'unknown'),
walk AS (
  SELECT sequence_id, k, frame_index, face_index, 0 AS link_no, [e] AS last FROM guest WHERE k = 1
  UNION ALL
  SELECT sequence_id, k, frame_index, face_index, link_no, list_concat(last[:link_no], [e], last[link_no + 2:]) FROM (
    SELECT w.sequence_id, g.k, g.frame_index, g.face_index, g.e, w.last,
      (coalesce(nullif(list_position(list_transform(w.last, lambda v: list_dot_product(v, g.e) >= {least}::DOUBLE), true), 0), len(w.last) + 1) - 1)::INT AS link_no
    FROM walk w JOIN guest g ON g.sequence_id = w.sequence_id AND g.k = w.k + 1))
"""
_IDENTIFY = f"WITH {_GALLERY}, {_DET}, {_BEST} SELECT vec_id, sequence_id, frame_index::INT AS frame_index, face_index::INT AS face_index, person_id, name, round(confidence, 6) AS confidence FROM ident"
_CENTROIDS = f"WITH {_GALLERY} SELECT person_id, pos::INT AS pos, round(x, 6) AS x FROM cent"


_BYTES = "WITH b AS (SELECT doc_id::VARCHAR AS sequence_id, strlen(text) AS n FROM documents)"
_SESSIONS = f"""
WITH e AS (SELECT user_id::VARCHAR AS sequence_id, event_id, ts, value::DOUBLE AS x1, (80 + (event_id * 7) % 13)::DOUBLE AS w, 'k' || (event_id % 2) AS person_id, (40 + event_id % 60)::DOUBLE / 100 AS confidence FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER u >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM e WINDOW u AS (PARTITION BY sequence_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY sequence_id ORDER BY ts, event_id) AS part FROM g),
c AS (SELECT sequence_id, part, epoch_us(min(ts)) AS start_us FROM s GROUP BY ALL HAVING count(*) >= 2 AND max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR),
tr AS (SELECT sequence_id, start_us, person_id, avg(confidence) AS mean_confidence, min(event_id) AS first_frame, min_by((x1 + (x1 + w)) / 2, (ts, event_id)) AS first_cx, max_by((x1 + (x1 + w)) / 2, (ts, event_id)) AS last_cx,
  min_by(w * w, (ts, event_id)) AS a0, max_by(w * w, (ts, event_id)) AS a1 FROM s JOIN c USING (sequence_id, part) GROUP BY ALL HAVING count(*) >= 2),
{_DIRECTION} 0 AS nothing FROM dir)
SELECT sequence_id, start_us, (row_number() OVER (PARTITION BY sequence_id, start_us ORDER BY first_frame) - 1)::INT AS track_id, person_id, direction, round(confidence, 9) AS confidence FROM out"""


def _linked_sql(least: float, kept: str = _KEPT, more: str = "") -> str:
    return f"""{kept}, {_LINK.format(least=least)},
      entry AS (SELECT k.sequence_id, k.frame_index, k.face_index, k.confidence, k.name, k.x1, k.w, k.h, link_no, coalesce('unknown_' || link_no, k.person_id) AS key FROM kept k LEFT JOIN walk USING (sequence_id, frame_index, face_index)),
      tr AS (SELECT sequence_id, key AS person_id, min(link_no) AS link_no, min(frame_index * 2 + face_index) AS first_at, min_by(name, frame_index * 2 + face_index) AS name, avg(confidence) AS mean_confidence, count(*)::INT AS n_points,
        min_by(x1 + w / 2, frame_index * 2 + face_index) AS first_cx, max_by(x1 + w / 2, frame_index * 2 + face_index) AS last_cx, min_by(w * h, frame_index * 2 + face_index) AS a0, max_by(w * h, frame_index * 2 + face_index) AS a1
        FROM entry GROUP BY ALL HAVING count(*) >= 2),
      {_DIRECTION} 0 AS nothing FROM dir)
      SELECT sequence_id, (row_number() OVER (PARTITION BY sequence_id ORDER BY link_no IS NOT NULL, link_no, first_at) - 1)::INT AS track_id, person_id, name, direction, round(confidence, 9) AS confidence{more} FROM out"""


def oracle_sql() -> dict[str, str]:
    return {
        "identify": _IDENTIFY,
        "identify_columns": _IDENTIFY,
        "identify_matrix": _IDENTIFY,
        "identify_blocks": _IDENTIFY,
        "match_band": f"{_KEPT} SELECT CASE WHEN confidence >= 0.4::DOUBLE THEN 'known' WHEN confidence >= 0.25::DOUBLE THEN 'uncertain' ELSE 'unknown' END AS band, count(*) AS n FROM kept GROUP BY 1",
        "pair_similarity": "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
        "centroids": _CENTROIDS,
        "centroids_at_scale": _CENTROIDS,
        "filter_detections": f"WITH {_DET} SELECT vec_id, det_score FROM det WHERE det_score >= 0.5::DOUBLE",
        "box_geometry": f"WITH {_DET} SELECT vec_id, (x1 + x1 + w) / 2 AS cx, (y1 + y1 + h) / 2 AS cy, w AS width, h AS height, w * h AS area FROM det",
        "largest_face": f"{_FACES} SELECT person_id, image_index::INT AS image_index, vec_id FROM f WHERE det_score >= 0.5::DOUBLE QUALIFY row_number() OVER (PARTITION BY person_id, image_index ORDER BY a DESC, vec_id) = 1",
        "embedding_index": f"{_NEW} SELECT person_id, image_index, (coalesce(embedding_count, 0) + row_number() OVER (PARTITION BY person_id ORDER BY image_index) - 1)::INT AS embedding_index FROM fresh LEFT JOIN old USING (person_id)",
        "enroll_members": f"""{_NEW},
            allv AS (SELECT person_id, embedding FROM me UNION ALL SELECT person_id, embedding FROM fresh),
            m2 AS (SELECT person_id, pos, avg(x::DOUBLE) AS m FROM (SELECT person_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM allv) GROUP BY ALL),
            n2 AS (SELECT person_id, sqrt(sum(m * m)) AS l FROM m2 GROUP BY 1)
            SELECT x.person_id, CASE WHEN n_added IS NULL THEN old.name ELSE 'New ' || added.label END AS name,
              CASE WHEN old.label IS NULL THEN '2026-01-01 00:00:00' ELSE strftime(TIMESTAMP '1970-01-01' + to_seconds(old.label), '%Y-%m-%d %H:%M:%S') END AS created_at,
              (coalesce(embedding_count, 0) + coalesce(n_added, 0))::INT AS embedding_count, pos::INT AS pos, round(m / l, 6) AS x
            FROM (SELECT person_id, pos, m / l AS m, 1 AS l FROM m2 JOIN n2 USING (person_id)) x LEFT JOIN old USING (person_id) LEFT JOIN added USING (person_id)""",
        "enroll_report": f"""{_NEW} SELECT person_id, CASE WHEN n_added IS NULL THEN 'failed' WHEN embedding_count IS NULL THEN 'enrolled' ELSE 'updated' END AS status,
            (coalesce(embedding_count, 0) + coalesce(n_added, 0))::INT AS embedding_count, coalesce(n_failed, 0)::INT AS n_failed
            FROM (SELECT DISTINCT person_id FROM f) LEFT JOIN added USING (person_id) LEFT JOIN old USING (person_id) LEFT JOIN failed USING (person_id)""",
        "enroll_failed_images": f"{_FACES} SELECT person_id, image_index::INT AS image_index FROM f GROUP BY ALL HAVING max(det_score) < 0.5::DOUBLE",
        "lookup_members": f"WITH {_GALLERY}, {_IDS} SELECT person_id, name, embedding_count::INT AS embedding_count, name IS NOT NULL AS found FROM ids LEFT JOIN mem USING (person_id)",
        "remove_members": f"WITH {_GALLERY}, {_IDS} SELECT person_id, count(*) AS n_vectors FROM me WHERE person_id NOT IN (SELECT person_id FROM ids) GROUP BY 1",
        "remove_report": f"WITH {_GALLERY}, {_IDS} SELECT person_id, name IS NOT NULL AS removed FROM ids LEFT JOIN mem USING (person_id)",
        "list_members": f"WITH {_GALLERY} SELECT person_id, name, embedding_count::INT AS embedding_count FROM mem ORDER BY name, person_id",
        "gallery_stats": f"WITH {_GALLERY} SELECT count(*) AS n_members, count(centroid) AS n_usable FROM mem",
        "explode_frames": "SELECT conv_id AS sequence_id, turn::INT AS frame_index, text AS payload FROM conversations",
        "decode_payload": "SELECT conv_id, turn, (conv_id + turn) % 3 <> 2 AS decode_ok, CASE WHEN (conv_id + turn) % 3 <> 2 THEN text END AS text FROM conversations",
        "validate_requests": """SELECT doc_id, CASE WHEN (doc_id * 7) % 80 NOT BETWEEN 1 AND 64 THEN 'person_id length' WHEN (doc_id * 11) % 150 NOT BETWEEN 1 AND 128 THEN 'name length'
            WHEN doc_id % 3 < 1 THEN 'too few images' END AS reason FROM documents""",
        "guest_file_names": "SELECT event_id, strftime(ts, '%H%M%S-%f') || '_f' || (event_id % 5) || '_' || (1 + event_id % 3) || 'guests.jpg' AS file_name, CAST(ts AS DATE)::VARCHAR AS date FROM events",
        "guest_counts": f"{_KEPT} SELECT sequence_id, frame_index::INT AS frame_index, count(*) AS guest_count FROM kept WHERE person_id = 'unknown' GROUP BY ALL",
        "frame_results": f"""{_KEPT}, fr AS (SELECT DISTINCT sequence_id, frame_index FROM det)
            SELECT sequence_id, frame_index::INT AS frame_index, count(face_index)::INT AS n_faces, coalesce(string_agg(face_index || ':' || person_id, ',' ORDER BY face_index), '') AS faces
            FROM fr LEFT JOIN kept USING (sequence_id, frame_index) GROUP BY ALL""",
        "overlay": f"""{_KEPT} SELECT sequence_id, frame_index::INT AS frame_index, face_index::INT AS face_index, x1::INT AS x1, y1::INT AS y1, (x1 + w)::INT AS x2, (y1 + h)::INT AS y2,
            CASE WHEN person_id = 'unknown' THEN '0,165,255' ELSE '0,200,0' END AS colour, name || ' ' || round_even(confidence * 100, 0)::INT || '%' AS label FROM kept""",
        "track_summary": f"""{_TRACKS} SELECT sequence_id, person_id, n_entries, name, round(mean_confidence, 6) AS mean_confidence, first_cx, last_cx, n_entries::INT AS n_points, sum_cx, 480 AS height, 640 AS width FROM tr""",
        "motion_direction": f"{_TRACKS} SELECT sequence_id, person_id, direction, round(confidence, 9) AS confidence FROM out",
        "track_numbers": f"{_TRACKS} SELECT sequence_id, person_id, track_id::INT AS track_id FROM out",
        "link_unknowns": f"{_KEPT}, {_LINK.format(least=0.5)} SELECT sequence_id, frame_index::INT AS frame_index, face_index::INT AS face_index, link_no, 'unknown_' || link_no AS track_key FROM walk",
        "detect_motion_linked": _linked_sql(0.2),
        "identify_batch_motion": _linked_sql(0.2, _BATCH, ", n_points"),
        "identify_batch_frames": f"""{_BATCH}, fr AS (SELECT DISTINCT sequence_id, frame_index FROM det)
            SELECT sequence_id, frame_index::INT AS frame_index, coalesce(string_agg(face_index || ':' || person_id || ':' || name || ':' || format('{{:.4f}}', confidence) || ':' || x1::INT, ',' ORDER BY face_index), '') AS faces
            FROM fr LEFT JOIN kept USING (sequence_id, frame_index) GROUP BY ALL""",
        "identify_batch_guests": f"""{_BATCH}, g AS (SELECT sequence_id, frame_index, count(*) AS guest_count, TIMESTAMP '1970-01-01' + to_seconds(sequence_id::BIGINT * 1000 + frame_index) AS ts FROM kept WHERE person_id = 'unknown' GROUP BY ALL)
            SELECT sequence_id, frame_index::INT AS frame_index, guest_count, sequence_id || ':' || frame_index AS image, strftime(ts, '%H%M%S-%f') || '_f' || frame_index || '_' || guest_count || 'guests.jpg' AS file_name, CAST(ts AS DATE)::VARCHAR AS date FROM g""",
        "identify_batch_marks": f"""{_BATCH}, fr AS (SELECT DISTINCT sequence_id, frame_index FROM det)
            SELECT sequence_id, frame_index::INT AS frame_index, CASE WHEN frame_index % 6 <> 5 THEN coalesce(string_agg(face_index || ':' || x1::INT || ':' || y1::INT || ':' || (x1 + w)::INT || ':' || (y1 + h)::INT || ':' || CASE WHEN person_id = 'unknown' THEN '255' ELSE '0' END || ':' ||
              name || ' ' || round_even(confidence * 100, 0)::INT || '%', ',' ORDER BY face_index), '') END AS marks
            FROM fr LEFT JOIN kept USING (sequence_id, frame_index) GROUP BY sequence_id, frame_index""",
        "detect_faces": f"""{_BYTES} SELECT sequence_id, k::INT AS face_index, k::DOUBLE AS x1, (k + n % 50)::DOUBLE AS x2, (n % 100)::DOUBLE / 100 AS det_score, (n % 97)::DOUBLE AS e0 FROM (SELECT sequence_id, n, unnest(range(n % 3)) AS k FROM b WHERE n % 10 <> 9)""",
        "detect_status": f"{_BYTES} SELECT sequence_id, 0 AS frame_index, CASE WHEN n % 10 = 9 THEN 0 ELSE n END::INT AS height, CASE WHEN n % 10 = 9 THEN 0 ELSE 640 END AS width, n % 10 <> 9 AS decode_ok FROM b",
        "image_files": "SELECT 'lang=' || lang AS person_id, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS n_bytes, 0::BIGINT AS first_index, 0::BIGINT AS gaps, 0::BIGINT AS repeats FROM documents GROUP BY lang",
        "gallery_versions": f"""{_NEW}, {_IDS}, allv AS (SELECT person_id, label FROM me UNION ALL SELECT person_id, label FROM fresh)
            SELECT person_id, CASE WHEN any_value(n_added) IS NULL THEN 'Person ' ELSE 'New ' END || allv.label AS name, count(*)::INT AS embedding_count, count(*) AS n_vectors, count(*) AS n_summed, 2 AS n_purged
            FROM allv LEFT JOIN added USING (person_id) WHERE person_id NOT IN (SELECT person_id FROM ids) GROUP BY person_id, allv.label""",
        "identify_stream": _IDENTIFY,
        "motion_stream": _SESSIONS,
        "detect_motion_known": f"{_TRACKS} SELECT sequence_id, track_id::INT AS track_id, person_id, name, direction, round(confidence, 9) AS confidence FROM out",
    }


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the identify-batch job, each frame with its faces."""
    frames, found = _shots(spark, sf_dir)
    return identify_batch(frames, found, members(spark, sf_dir))["frames"]
