"""WARC archives of pages, with revisit records in place of repeated payloads.

Headers alone decide: digests are grouped into the originals of payloads that occur more than
once, and every page meets its original. The archives then written hold each such payload once;
the other records are revisits with headers of their own that name the original. Records are
put together by column expressions and written by Spark's text writer, whose line separator is
the end of a WARC record, so its commit protocol holds for the archives too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facejobs.llm import common

#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_BYTES = 1000
#: Records of one archive file at most.
RECORDS = 2000
DATE = "2026-01-01T00:00:00Z"
EOL, END = "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Extension field with the page's id in decimal; absent where it is null.
PAGE, REFERS_TO_PAGE = "Page-ID", "Refers-To-Page-ID"

RECORD = "page_id long, url string, record_type string, record_id string, refers_to long, refers_to_id string, payload_digest string, payload string"


class WarcError(ValueError):
    """The bytes are not a WARC record of the kind stored here, or a digest differs."""


def headers(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest) of each row: the text in UTF-8 and
    the lower-case hex SHA-1 of its bytes. A null text is an empty payload."""
    payload = F.coalesce(F.col(html), F.lit(""))
    return pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"),
    )


def originals(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(payload_digest, check, original) of payloads of ``least_bytes`` or more that several rows
    hold: the largest page_id of theirs. ``check`` is a second hash, as SHA-1 alone can be made
    to collide. Digests are counted where they lie before they are shuffled."""
    long = pages.where(F.col("payload_bytes") >= least_bytes)
    grouped = long.groupBy("payload_digest", F.xxhash64("payload").alias("check")).agg(F.count("*").alias("n"), F.max("page_id").alias("original"))
    return grouped.where("n > 1 AND original IS NOT NULL").drop("n")


def resolve(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Adds ``refers_to`` to :func:`headers`: the page_id of the original of a row that repeats a
    payload, null for a response.

    Rows that carry the original's page_id are all responses, so an archive never refers a record
    to itself; a null page_id refers to the original if there is one. Only digests of repeated
    payloads are stored and joined, broadcast if a count finds few; a digest that very many rows
    hold is one row on that side, and Spark splits the other side of a skewed join.
    """
    repeated = common.sized(common.stage(originals(pages, least_bytes), "originals"))
    found = pages.withColumn("check", F.xxhash64("payload")).join(repeated, ["payload_digest", "check"], "left").drop("check")
    return found.withColumn("refers_to", F.when(~F.col("original").eqNullSafe(F.col("page_id")), F.col("original"))).drop("original")


def _record_id(page: Column, digest: Column) -> Column:
    """Name-based URN, so that a task that runs again writes the same record."""
    h = F.sha2(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("")), digest), 256)
    parts = (F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12)))
    a, b, c, d, e = parts
    return F.concat(F.lit("<urn:uuid:"), a, F.lit("-"), b, F.lit("-8"), c, F.lit("-8"), d, F.lit("-"), e, F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line; none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit(""))


def records(resolved: DataFrame, date: str = DATE) -> DataFrame:
    """(value): the text of each row's WARC record without the blank lines at its end.

    A response's block is an HTTP response with the payload; a revisit's has its head alone, and
    the WARC header names the original. Line breaks and control characters of a URL are percent
    signs' escapes, so that none forges a header; a null or empty URL becomes ``urn:page:<id>``.
    """
    page, digest, refers = F.col("page_id"), F.col("payload_digest"), F.col("refers_to")
    revisit = refers.isNotNull()
    clean = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")
    uri = F.when(F.length(clean) > 0, clean).otherwise(F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit(""))))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(EOL),
        _field("WARC-Record-ID", _record_id(page, digest)), _field("WARC-Date", F.lit(date)), _field("WARC-Target-URI", uri),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), _field(PAGE, page.cast("string")),
        F.when(revisit, F.concat(_field("WARC-Profile", F.lit(PROFILE)), _field("WARC-Refers-To", _record_id(refers, digest)), _field(REFERS_TO_PAGE, refers.cast("string")))).otherwise(""),
        _field("Content-Type", F.lit("application/http;msgtype=response")), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    return resolved.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, folder: str, html: str = "html", page_id: str = "page_id", url: str = "url", least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    """Write gzip-compressed WARC files into ``folder``, a record for each row of ``pages``.

    Null and empty texts are empty payloads, rows that repeat are written as often as they occur,
    other columns are left out whatever their names, and an empty table gives files without
    records. ``url`` and ``page_id`` may be null.
    """
    resolved = resolve(headers(pages, html, page_id, url), least_bytes)
    records(resolved, date).write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", RECORDS).text(folder)


def _parsed(head: bytes) -> dict[str, str]:
    lines = head.decode().split(EOL)
    if not lines[0].startswith("WARC/1."):
        raise WarcError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse(stored: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a gzip file, inflated piece by piece: what is held at
    once is the file as stored and a record. Field names are in lower case."""
    unzip, held, at = zlib.decompressobj(31), bytearray(), 0

    def more() -> bool:
        nonlocal at, unzip
        piece = unzip.unconsumed_tail or stored[at : at + (1 << 18)]
        if not piece:
            return False
        at += 0 if unzip.unconsumed_tail else len(piece)
        held.extend(unzip.decompress(piece, 1 << 20))
        if unzip.eof:  # the next member begins in what is left over
            at -= len(unzip.unused_data)
            unzip = zlib.decompressobj(31)
        return True

    while True:
        while (n := held.find(END.encode())) < 0:
            if not more():
                if held:
                    raise WarcError("cut short")
                return
        fields = _parsed(bytes(held[:n]))
        start, length = n + 4, int(fields["content-length"])
        while len(held) < start + length + 4:
            if not more():
                raise WarcError("cut short")
        block = bytes(held[start : start + length])
        if held[start + length : start + length + 4] != END.encode():
            raise WarcError("record of another length")
        del held[: start + length + 4]
        yield fields, block


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives in ``folder`` as :data:`RECORD` says; a revisit has no payload.

    The payload digest of every response is computed anew; where it differs, or a file is
    damaged, :class:`WarcError` ends the job.
    """
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in RECORD.split(", ")]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        whole = lambda x: None if x is None else int(x)
        for batch in batches:
            for stored in batch.column("content"):
                held, size = [], 0
                for fields, block in parse(stored.as_py()):
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    payload = block.partition(END.encode())[2] if fields["warc-type"] == "response" else None
                    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                        raise WarcError(f"payload digest of {fields['warc-record-id']}")
                    held.append((whole(fields.get(PAGE.lower())), fields["warc-target-uri"], fields["warc-type"], fields["warc-record-id"], whole(fields.get(REFERS_TO_PAGE.lower())), fields.get("warc-refers-to"), digest, payload))
                    size += len(block)
                    if size > 4 << 20:
                        yield _batch(held, kinds, names)
                        held, size = [], 0
                if held:
                    yield _batch(held, kinds, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(rows, RECORD)


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    # payloads are UTF-8 as Spark wrote them; bytes that are not pass as they are
    arrays = [pa.array(c, pa.binary()).view(pa.string()) if n == "payload" else pa.array(c, t) for c, t, n in zip(columns, kinds, names)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def restore(archived: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): each record with the
    length of its full payload, a revisit's being that of the response it refers to.

    A revisit whose response is missing has null ``payload_bytes``.
    """
    size = F.octet_length("payload").cast("long")
    targets = archived.where("record_type = 'revisit'").select(F.col("refers_to_id").alias("record_id")).distinct()
    full = archived.where("record_type = 'response'").select("record_id", size.alias("full_bytes")).join(targets, "record_id", "left_semi").dropDuplicates(["record_id"])
    full = common.sized(common.stage(full.withColumnRenamed("record_id", "refers_to_id"), "targets"))
    kept = archived.withColumn("payload_bytes", size).drop("payload")
    found = kept.join(full, "refers_to_id", "left")
    return found.select("page_id", F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: archives of all pages, written and read back."""
    common.small_batches(spark)
    folder = common.new_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return restore(read(spark, folder))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND last IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND last IS DISTINCT FROM page_id THEN last END AS refers_to FROM g"""
