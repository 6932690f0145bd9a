"""WARC archives with each payload stored once: headers by payload digest, revisits resolved to the first response.

Of the records with equal payloads the one of the smallest key is written as a response and the others as revisits that
refer to it. Only headers (key, url, digest, size) are grouped and joined by digest, so a payload that a third of all pages
share brings no payloads together; payloads move once, dealt to archives by record, where the revisits join them. Archives are gzip files written by Spark's text writer (each record one value, the two line breaks after it
the separator), so they go wherever Spark can write. Reading follows Content-Length, so a payload may hold anything.

Null payload counts as empty. Rows that repeat the smallest key of a payload are responses too; a null key is a revisit
where its payload has a row with a key, else a response. An empty table writes an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import new_folder, settle

ARCHIVE_BYTES = 32 << 20
# The alphabet of base 32, and the names that the WARC format gives.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "\r\n"
RECORDS = "record_id string, record_type string, page_id bigint, url string, payload_bytes bigint, payload_digest string, refers_to_record string"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: eight groups of twenty bits, four letters each."""
    digest = F.sha1(payload)
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def headers(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url without line breaks, html, payload_bytes, payload_digest."""
    html = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    return pages.select(
        F.col(key).cast("bigint").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("url"), html.alias("html"),
        F.octet_length(html).cast("bigint").alias("payload_bytes"), base32_sha1(F.encode(html, "UTF-8")).alias("payload_digest"))


def _record_id(page_id: Column, url: Column, digest: Column) -> Column:
    # A missing key is an empty place, so that no url can stand in for it.
    name = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), url, digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def find_revisits(slim: DataFrame, min_bytes: int) -> DataFrame:
    """(record_id, refers_to_record, refers_to_url) of every record that is a revisit, each once.

    `slim` holds record_id, page_id, url, payload_bytes and payload_digest, and is read several times.
    """
    large = slim.where(F.col("payload_bytes") >= min_bytes)
    digests = large.groupBy("payload_digest").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "record_id"))).alias("first"))
    # Written, so that the join below knows its size and can split a digest that many records share.
    repeated = settle(digests.where("rows > 1 and first is not null").select("payload_digest", "first"))
    same = F.coalesce(F.col("page_id") == F.col("first.page_id"), F.lit(False))
    found = large.join(repeated, "payload_digest").where(~same)
    return found.select("record_id", F.col("first.record_id").alias("refers_to_record"), F.col("first.url").alias("refers_to_url")).distinct()


def record_text(date: Column) -> Column:
    """The whole record but for the two line breaks after it."""
    def lines(*pairs: tuple[str, Column]) -> list[Column]:
        return [F.concat(F.lit(f"{name}: "), value, F.lit(LINE)) for name, value in pairs]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(LINE + LINE))
    block = F.concat(http, F.when(F.col("record_type") == "response", F.col("html")).otherwise(""))
    always = lines(
        ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", date), ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), ("Content-Type", F.lit("application/http;msgtype=response")))
    page = F.coalesce(F.concat(F.lit("WARC-Page-ID: "), F.col("page_id").cast("string"), F.lit(LINE)), F.lit(""))
    refers = F.when(F.col("record_type") == "revisit", F.concat(*lines(
        ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", F.col("refers_to_record")), ("WARC-Refers-To-Target-URI", F.col("refers_to_url"))))).otherwise("")
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(LINE + LINE))
    return F.concat(F.lit(f"WARC/1.1{LINE}"), *always, page, refers, length, block)


def typed_records(pages: DataFrame, min_bytes: int = 0, key: str = "page_id", url: str = "url", payload: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Headers and payload of every row with its record_type and what it refers to, dealt to partitions of about `archive_bytes`."""
    rows = headers(pages, key, url, payload).withColumn("record_id", _record_id(F.col("page_id"), F.col("url"), F.col("payload_digest")))
    slim = settle(rows.drop("html"))
    total = slim.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("n")).first()["n"]
    revisits = settle(find_revisits(slim, min_bytes))
    # The join takes over the archives' partitions, so payloads are shuffled once.
    dealt = rows.repartition(max(1, -(-total // archive_bytes)), "record_id").join(revisits, "record_id", "left")
    return dealt.withColumn("record_type", F.when(F.col("refers_to_record").isNotNull(), "revisit").otherwise("response"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, key: str = "page_id", url: str = "url", payload: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per row below `folder`, in archives of about `archive_bytes` before compression."""
    date = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    records = typed_records(pages, min_bytes, key, url, payload, archive_bytes).select(record_text(date).alias("value"))
    records.write.option("lineSep", LINE + LINE).option("compression", "gzip").text(folder)


def parse_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload of each record of one gzip archive."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(archive)))
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"no record begins at {line[:40]!r}")
            continue
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8").partition(": ")
            fields[name] = value
        block = stream.read(int(fields["Content-Length"]))
        yield fields, block.partition(b"\r\n\r\n")[2]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record. Responses are measured anew and must match the digest in their header."""
    def parse(batches):
        for batch in batches:
            for archive in batch.column(0):
                rows = []
                for fields, payload in parse_records(archive.as_py()):
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = fields["WARC-Type"] == "response"
                    if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{fields['WARC-Record-ID']} does not hold the payload of its digest")
                    page = fields.get("WARC-Page-ID")
                    rows.append({
                        "record_id": fields["WARC-Record-ID"], "record_type": fields["WARC-Type"], "page_id": int(page) if page is not None else None, "url": fields.get("WARC-Target-URI", ""),
                        "payload_bytes": len(payload) if response else None, "payload_digest": digest, "refers_to_record": fields.get("WARC-Refers-To")})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
    schema = pa.schema([
        ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("refers_to_record", pa.string())])
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content").mapInArrow(parse, RECORDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with payload_bytes filled from the response that a revisit refers to, and `refers_to`, that response's page_id.

    `records` is read twice and must stay the same.
    """
    responses, revisits = records.where("record_type = 'response'"), records.where("record_type = 'revisit'").drop("payload_bytes")
    wanted = revisits.select(F.col("refers_to_record").alias("record_id")).distinct()
    # One row for each response that is referred to; written, so that the join below deals both sides by plain exchanges.
    targets = settle(responses.join(wanted, "record_id", "left_semi").groupBy(F.col("record_id").alias("refers_to_record")).agg(
        F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("found_bytes")))
    joined = revisits.join(targets, "refers_to_record", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return responses.withColumn("refers_to", F.lit(None).cast("bigint")).select(*columns).unionByName(joined.withColumnRenamed("found_bytes", "payload_bytes").select(*columns))


def archive_round(pages: DataFrame, min_bytes: int = 0, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write the archives below the shared folder, read them back and resolve the revisits."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archives(pages, folder, min_bytes, key, url, payload)
    return resolve_revisits(settle(read_archives(spark, folder)))
