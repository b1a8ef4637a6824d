"""The gallery: centroids, enrolment, lookup, removal, listing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facejobs import schemas
from facejobs.functions import area, usable_vector
from facejobs.operators.identify import filter_detections
from facejobs.params import DEFAULTS, Params
from facejobs.sources.stores import Gallery


def _unit(values: Column) -> Column:
    """``values`` over their length; null where that is 0 or not a finite number."""
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(values, lambda x: x / norm))


def _counted(member_embeddings: DataFrame) -> DataFrame:
    return member_embeddings.where(F.col("person_id").isNotNull() & usable_vector("embedding")).select("person_id", "embedding")


def centroids(member_embeddings: DataFrame) -> DataFrame:
    """(person_id, centroid): the mean of a person's vectors, brought to unit length.

    Vectors that are null, empty or hold anything but finite numbers, and null people, take no
    part; of vectors of several lengths a person's longest ones count. People without a vector
    have no row; the centroid is null where the mean has no length. Explodes vectors; a
    cross-check of :func:`centroids_at_scale`.
    """
    held = _counted(member_embeddings).withColumn("size", F.size("embedding"))
    longest = held.groupBy("person_id").agg(F.max("size").alias("size"))
    elements = held.join(longest, ["person_id", "size"], "left_semi").select("person_id", F.posexplode("embedding").alias("pos", "x"))
    means = elements.groupBy("person_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    return means.groupBy("person_id").agg(_unit(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"])).alias("centroid"))


def vector_sums(member_embeddings: DataFrame) -> DataFrame:
    """(person_id, size, total, n): vectors of each person and length added up, as in
    :func:`centroids`, where they lie, one partial sum per person and Arrow batch."""

    def partial(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            pdf["size"] = pdf["embedding"].map(len)
            rows = [(p, size, np.sum(np.stack(g.to_numpy()).astype(np.float64), axis=0), len(g)) for (p, size), g in pdf.groupby(["person_id", "size"])["embedding"]]
            yield pd.DataFrame(rows, columns=["person_id", "size", "total", "n"])

    return merge_sums(_counted(member_embeddings).mapInPandas(partial, schemas.MEMBER_SUMS))


def merge_sums(sums: DataFrame) -> DataFrame:
    """One row per person and length of any number of rows of such sums."""
    elements = sums.select("person_id", "size", "n", F.posexplode("total").alias("pos", "x"))
    added = elements.groupBy("person_id", "size", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"])
    return added.groupBy("person_id", "size").agg(whole.alias("total"), F.max("n").alias("n"))


def centroids_of(sums: DataFrame) -> DataFrame:
    """(person_id, centroid) of sums: of a person's lengths the longest counts."""
    longest = sums.groupBy("person_id").agg(F.max_by(F.struct("total", "n"), "size").alias("s"))
    return longest.select("person_id", _unit(F.transform("s.total", lambda x: x / F.col("s.n"))).alias("centroid"))


def centroids_at_scale(member_embeddings: DataFrame) -> DataFrame:
    """:func:`centroids` by way of sums: what is shuffled grows with people per partition, not with
    vectors, and a person with very many vectors is summed where they lie."""
    return centroids_of(vector_sums(member_embeddings))


def _is_face() -> Column:
    return F.col("face_index").isNotNull() & usable_vector("embedding")


def largest_face(enroll_faces: DataFrame) -> DataFrame:
    """Per person and image the face with the largest box; the detector's first among equals.
    Faces without a usable vector are none."""
    order = Window.partitionBy("person_id", "image_index").orderBy(area("bbox").desc(), "face_index")
    return enroll_faces.where(_is_face()).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def assign_embedding_index(new: DataFrame, members: DataFrame) -> DataFrame:
    """Adds ``embedding_index``, going on from each person's count in image order."""
    order = Window.partitionBy("person_id").orderBy("image_index")
    had = members.select("person_id", F.col("embedding_count").alias("_had"))
    return new.join(had, "person_id", "left").withColumn("embedding_index", (F.coalesce("_had", F.lit(0)) + F.row_number().over(order) - 1).cast("int")).drop("_had")


def enroll_failed_images(enroll_faces: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """(person_id, failed_images): indices of images without a usable face, undecodable ones included."""
    images = enroll_faces.select("person_id", "image_index").distinct()
    good = filter_detections(enroll_faces, params).where(_is_face()).select("person_id", "image_index").distinct()
    return images.join(good, ["person_id", "image_index"], "left_anti").groupBy("person_id").agg(F.array_sort(F.collect_list("image_index")).alias("failed_images"))


def enroll(gallery: Gallery, enroll_faces: DataFrame, now: datetime, params: Params = DEFAULTS) -> tuple[Gallery, DataFrame]:
    """Add people and vectors; the new gallery, and a report per person asked for.

    The largest usable face of each image is added. The name is replaced (the last image's name
    wins), ``created_at`` kept; only people with new vectors get a new centroid. Without any
    usable face a person is ``failed`` and their row stays as it was; null people are left out.
    Report: person_id, status (``enrolled``, ``updated``, ``failed``), reason, embedding_count,
    n_added, failed_images.

    New vectors are added to the stored sums of their people; earlier vectors are neither read nor
    written again.
    """
    enroll_faces = enroll_faces.where("person_id IS NOT NULL")
    best = largest_face(filter_detections(enroll_faces, params))
    new = assign_embedding_index(best, gallery.members).select("person_id", "embedding_index", "embedding")
    held = vector_sums(gallery.embeddings) if gallery.sums is None else gallery.sums
    embeddings = gallery.embeddings.select("person_id", "embedding_index", "embedding").unionByName(new)
    touched = new.groupBy("person_id").agg(F.count("*").cast("int").alias("n_added"))
    names = enroll_faces.groupBy("person_id").agg(F.max_by("name", F.struct("image_index", F.coalesce("face_index", F.lit(-1)))).alias("new_name"))
    changed = merge_sums(held.join(touched, "person_id", "left_semi").unionByName(vector_sums(new)))
    sums = held.join(touched, "person_id", "left_anti").unionByName(changed)
    fresh = centroids_of(changed)
    change = touched.join(names, "person_id").join(fresh.withColumnRenamed("centroid", "new_centroid"), "person_id", "left")
    old = gallery.members.select("person_id", "name", "created_at", "embedding_count", "centroid")
    is_new = F.col("n_added").isNotNull()
    members = old.join(change, "person_id", "full_outer").select(
        "person_id",
        F.when(is_new, F.col("new_name")).otherwise(F.col("name")).alias("name"),
        F.coalesce("created_at", F.lit(now)).alias("created_at"),
        (F.coalesce("embedding_count", F.lit(0)) + F.coalesce("n_added", F.lit(0))).cast("int").alias("embedding_count"),
        F.when(is_new, F.col("new_centroid")).otherwise(F.col("centroid")).alias("centroid"),
    )
    asked = names.join(touched, "person_id", "left").join(old.select("person_id", "embedding_count"), "person_id", "left").join(enroll_failed_images(enroll_faces, params), "person_id", "left")
    report = asked.select(
        "person_id",
        F.when(~is_new, "failed").when(F.col("embedding_count").isNull(), "enrolled").otherwise("updated").alias("status"),
        F.when(~is_new, "no usable face in any image").alias("reason"),
        (F.coalesce("embedding_count", F.lit(0)) + F.coalesce("n_added", F.lit(0))).cast("int").alias("embedding_count"),
        F.coalesce("n_added", F.lit(0)).alias("n_added"),
        F.coalesce("failed_images", F.array().cast("array<int>")).alias("failed_images"),
    )
    return Gallery(members, embeddings, sums, gallery.stored, new), report


def lookup_members(ids: DataFrame, members: DataFrame) -> DataFrame:
    """Each id with its member row, and whether it was ``found``."""
    return ids.select("person_id").join(members.withColumn("_there", F.lit(True)), "person_id", "left").withColumn("found", F.col("_there").isNotNull()).drop("_there")


def remove_members(gallery: Gallery, ids: DataFrame) -> tuple[Gallery, DataFrame]:
    """The gallery without these people and their vectors, and (person_id, removed) per distinct id."""
    asked = ids.select("person_id").distinct()
    left = Gallery(*(None if t is None else t.join(asked, "person_id", "left_anti") for t in (gallery.members, gallery.embeddings, gallery.sums)))
    return left, lookup_members(asked, gallery.members).select("person_id", F.col("found").alias("removed"))


def gallery_stats(members: DataFrame) -> DataFrame:
    """(n_members, n_usable): all listed, and those that can be matched."""
    return members.agg(F.count("*").alias("n_members"), F.count("centroid").alias("n_usable"))


def list_members(members: DataFrame) -> DataFrame:
    """Members by name, then id."""
    return members.select("person_id", "name", "created_at", "embedding_count").orderBy("name", "person_id")
