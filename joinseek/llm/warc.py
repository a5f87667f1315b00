"""A content-addressed archive of WARC records.

Payload bytes are stored once, under their SHA-256; the exact header bytes of
every record are stored beside them. A record is read back by joining its header
with its payload, whose digest is computed anew. Everything is Parquet in a
folder that all executors share, written and read by Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joinseek.session import quoted

#: The base32 alphabet of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BREAK = "\r\n"
HTTP_HEAD = f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}"


@dataclass(frozen=True)
class WarcParams:
    """Payloads of fewer than ``min_bytes`` are written each time and never referred to."""

    min_bytes: int = 0
    date: str = "2024-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of binary data in base32: four characters for every five hexadecimal digits."""
    digits = F.sha1(data)
    return F.transform(
        F.array(digits),
        lambda d: F.concat(
            *(
                F.substring(F.lit(BASE32), F.shiftright(_number(d, part), shift).bitwiseAND(31) + 1, F.lit(1))
                for part in range(8)
                for shift in (15, 10, 5, 0)
            )
        ),
    )[0]


def _number(digits: Column, part: int) -> Column:
    return F.conv(F.substring(digits, 5 * part + 1, 5), 16, 10).cast("int")


def _record_id(key: Column, address: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.substring(address, 1, 16), F.lit(">"))


def _plain(value: Column) -> Column:
    """A header value without line breaks."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]+", " ")


def write_archive(
    pages: DataFrame, folder: str, params: WarcParams | None = None, key: str = "page_id", url: str = "url", html: str = "html"
) -> None:
    """Write a record per row of ``pages`` to ``folder``.

    ``headers`` has (page, address, record_id, record_type, header), ``payloads``
    (address, payload) with each payload once. Of records with equal payloads
    that with the smallest key is a response and the others revisit it; rows that
    agree in key and payload are both that response. A null page is an empty
    payload, a null key sorts first, a null URL is empty.
    """
    params = params or WarcParams()
    spark = pages.sparkSession
    body = F.coalesce(F.col(quoted(html)), F.lit("")).cast("binary")
    facts = pages.select(
        F.col(quoted(key)).alias("page"),
        _plain(F.col(quoted(url))).alias("target"),
        F.octet_length(body).cast("long").alias("bytes"),
        F.sha2(body, 256).alias("address"),
        base32_sha1(body).alias("digest"),
    )
    facts.write.parquet(f"{folder}/facts")
    facts = spark.read.schema(facts.schema).parquet(f"{folder}/facts")

    firsts = facts.groupBy("address").agg(F.min(F.struct("page")).alias("first"))
    typed = facts.join(firsts, "address")
    refers = F.expr(f"bytes >= {params.min_bytes} AND NOT (page <=> first.page)")
    own, other = _record_id(F.col("page"), F.col("address")), _record_id(F.col("first.page"), F.col("address"))
    http = F.concat(F.lit(f"{HTTP_HEAD}Content-Length: "), F.col("bytes"), F.lit(BREAK * 2))
    block = F.octet_length(http) + F.when(refers, 0).otherwise(F.col("bytes"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(refers, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), own),
        F.lit(f"WARC-Date: {params.date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("target")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(refers, F.concat(F.lit("WARC-Refers-To: "), other)),
        F.when(refers, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("Content-Type: application/http; msgtype=response")),
        F.concat(F.lit("Content-Length: "), block),
    ]
    header = F.concat(F.concat_ws(BREAK, *lines), F.lit(BREAK * 2), http)
    records = typed.select(
        "page", "address", own.alias("record_id"), F.when(refers, "revisit").otherwise("response").alias("record_type"), header.cast("binary").alias("header")
    )
    records.write.parquet(f"{folder}/headers")
    records = spark.read.schema(records.schema).parquet(f"{folder}/headers")

    # Only keys of records without a payload of their own; few of them, as a rule,
    # and then the pages are not shuffled.
    bare = records.where("record_type = 'revisit'").select("page", "address").distinct()
    bare.write.parquet(f"{folder}/revisits")
    bare = spark.read.schema(bare.schema).parquet(f"{folder}/revisits")
    stored = pages.select(F.col(quoted(key)).alias("page"), F.sha2(body, 256).alias("address"), body.alias("payload"))
    same = stored["page"].eqNullSafe(bare["page"]) & (stored["address"] == bare["address"])
    stored = stored.join(bare, same, "left_anti").select("address", "payload")
    if params.min_bytes > 0 or facts.count() != facts.select("page", "address").distinct().count():
        # Rows that repeat a record, or small payloads that nothing refers to.
        stored = stored.dropDuplicates(["address"])
    stored.write.option("compression", "zstd").parquet(f"{folder}/payloads")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(page, record_type, refers_to, target, header, payload, payload_bytes, payload_digest, verified) per record.

    ``header`` and ``payload`` together are the exact bytes of the record; the
    payload of a revisit is null, as it lies in the record it refers to. Bytes and
    digest are computed from the stored payload; ``verified`` tells that it still
    has the digest it is filed under and the one that the header states.
    """
    headers = spark.read.parquet(f"{folder}/headers")
    payloads = spark.read.parquet(f"{folder}/payloads").select(
        "address",
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        (F.sha2(F.col("payload"), 256) == F.col("address")).alias("intact"),
    )
    text = F.col("header").cast("string")

    def value(name: str) -> Column:
        return F.regexp_extract(text, rf"\n{name}: ([^\r]*)\r\n", 1)

    parsed = headers.select(
        "page",
        "address",
        "header",
        value("WARC-Type").alias("record_type"),
        value("WARC-Target-URI").alias("target"),
        value("WARC-Payload-Digest").alias("stated"),
        F.nullif(value("WARC-Refers-To"), F.lit("")).alias("refers_to_record"),
    )
    # A response meets its payload alone; revisits only need the facts about it,
    # so that a payload with any number of copies is moved once.
    responses = parsed.where("record_type = 'response'").join(payloads, "address")
    facts = payloads.select("address", "payload_bytes", "payload_digest", "intact")
    revisits = parsed.where("record_type = 'revisit'").join(facts, "address").withColumn("payload", F.lit(None).cast("binary"))
    columns = [
        "page",
        "record_type",
        F.regexp_extract("refers_to_record", r"^<urn:record:(.*):[0-9a-f]+>$", 1).alias("refers_to"),
        "target",
        "header",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.expr("intact AND stated = concat('sha1:', payload_digest)").alias("verified"),
    ]
    return responses.select(*columns).unionAll(revisits.select(*columns))


def write_warc_files(records: DataFrame, folder: str, compression: str | None = None) -> None:
    """The records of ``read_archive`` as .warc text, each ended by two line breaks.

    For payloads in UTF-8, which those written from text columns are.
    """
    whole = F.concat(F.col("header").cast("string"), F.coalesce(F.col("payload").cast("string"), F.lit("")))
    writer = records.select(whole.alias("value")).write.option("lineSep", BREAK * 2)
    (writer.option("compression", compression) if compression else writer).text(folder)
