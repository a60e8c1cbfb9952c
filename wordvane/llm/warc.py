"""WARC archives with revisit resolution.

Records are (page_id, url, payload). Headers alone are shuffled by payload digest to find, for each payload of at least
MIN_BYTES bytes that several records hold, the one with the smallest page_id; the others become revisits of it and carry no
payload. Archives are written by Spark's own text writer, whose line end is the record end of WARC (CRLF CRLF), to the shared
folder, so any file system of Spark and its commit protocol serve. Reading takes each archive by its Content-Length fields,
checks every payload against its digest (a wrong one is an error), and joins revisits to the originals by digest again.

Defined cases: a null payload is an empty one. Payloads under MIN_BYTES are always responses. Rows that share page_id and
payload are all responses if theirs is the smallest id. A null page_id sorts last, is written as an empty id and comes
back as null. Other columns are ignored. No rows give no records.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordvane.llm.common import shared_dir, small, staged

MIN_BYTES = 100
#: Bytes that one archive holds, about, by the mean payload; its reader keeps one archive in memory.
ARCHIVE_BYTES = 16_000_000
EOL = "\r\n"
RECORD_END = EOL + EOL
#: Records get this one date: reruns write the same bytes.
DATE = "2020-01-01T00:00:00Z"
READ_SCHEMA = "page_id long, url string, record_type string, payload_digest string, refers_to long, content_length long, intact boolean, payload binary"


def with_headers(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload (string), payload_bytes, payload_digest, refers_to (null: a response) of every row.

    Only (digest, page_id) rows are shuffled, combined on the map side to one per digest and task however many copies there are. What comes out
    of it, digests held by several records, goes to where the payloads are while it is small enough to be broadcast; payloads move beyond that only.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    records = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(F.encode(payload, "UTF-8"), 256).alias("payload_digest"))
    first = records.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("_digest")).agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = staged(first.where("_n > 1").select("_digest", "_first"))
    joined = records.join(small(first), F.col("payload_digest") == F.col("_digest"), "left")
    refers = F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def record_text(records: DataFrame) -> DataFrame:
    """One column `value`: a whole record but for the line end that closes it."""
    revisit = F.col("refers_to").isNotNull()
    length = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    clean = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "")
    header = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}{EOL}"),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id(F.col("refers_to"))), F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{EOL}"))).otherwise(F.lit("")),
        F.lit(f"Content-Type: text/html; charset=utf-8{EOL}"),
        line("Content-Length", length.cast("string")),
        F.lit(EOL),
    )
    return records.select(F.concat(header, F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("value"))


def write_archives(records: DataFrame, path: str, records_each: int) -> None:
    """Deduplicated archives with fresh headers, of records_each records at most. A revisit's payload is left out."""
    record_text(records).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", records_each).option("compression", "gzip").text(path)


def parse_archive(content: bytes) -> Iterator[tuple]:
    """Records of one archive; the payload's place follows from Content-Length alone, whatever the payload holds."""
    at, end = 0, len(content)
    while at < end:
        stop = content.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in content[at:stop].decode("utf-8").split("\r\n")[1:])
        length = int(fields["Content-Length"])
        payload = content[stop + 4 : stop + 4 + length]
        at = stop + 4 + length + 4
        ident = lambda s: int(v) if s and (v := s[len("<urn:page:") : -1]) else None
        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
        intact = kind == "revisit" or hashlib.sha256(payload).hexdigest() == digest
        yield ident(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, digest, ident(fields.get("WARC-Refers-To")), length, intact, payload


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives under a path, as READ_SCHEMA. An archive is one input row, of so many records as its writer puts into one: about ARCHIVE_BYTES
    where payloads are near their mean, and as many of the largest payloads at most."""

    def parse(batches):
        import zlib

        import pandas as pd

        names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                data = bytes(content)
                data = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
                rows = []
                held = 0
                for row in parse_archive(data):
                    rows.append(row if payloads else (*row[:-1], None))
                    held += row[5] * payloads
                    if held > 8_000_000:
                        yield frame(pd, rows, names)
                        rows, held = [], 0
                yield frame(pd, rows, names)

    def frame(pd, rows, names):
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"page_id": "Int64", "refers_to": "Int64", "content_length": "Int64", "intact": "boolean"})

    found = spark.read.format("binaryFile").load(path).select("content")
    return found.mapInPandas(parse, READ_SCHEMA)


def resolve_revisits(headers: DataFrame) -> DataFrame:
    """Headers with payload_bytes: a revisit's is that of the response it refers to, found by digest."""
    originals = headers.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("_digest")).agg(F.max("content_length").alias("_bytes"))
    revisits = headers.where("record_type = 'revisit'").join(originals, F.col("payload_digest") == F.col("_digest"), "left").withColumn("payload_bytes", F.col("_bytes")).drop("_digest", "_bytes")
    return headers.where("record_type = 'response'").withColumn("payload_bytes", F.col("content_length")).unionByName(revisits)


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every row into archives in the shared folder, reads them back and resolves their revisits."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0.0
    write_archives(with_headers(pages, min_bytes), path, int(min(1_000_000, max(1, archive_bytes // (mean + 500)))))
    headers = read_archives(spark, path, payloads=False)
    whole = F.when(F.col("intact"), True).otherwise(F.raise_error(F.concat(F.lit("payload of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(" does not fit its digest"))))
    return resolve_revisits(headers).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", whole.cast("boolean").alias("intact"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, intact of every row of `pages`, as read back from its archives."""
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP8_SQL = """
with r as (select page_id, url, coalesce(html, '') as p from pages),
d as (select page_id, url, cast(octet_length(encode(p)) as bigint) as payload_bytes, sha256(p) as payload_digest from r),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1 having count(*) > 1)
select d.page_id, payload_bytes, d.payload_digest, case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
 case when page_id is distinct from first then first end as refers_to, coalesce(url, '') as url, true as intact
from d left join f on d.payload_digest = f.payload_digest
"""
