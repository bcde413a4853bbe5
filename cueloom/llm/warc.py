"""A content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; record headers are kept exactly, in a table of
their own. Of the records with equal payloads the one with the smallest key is a response and the
others revisit it. Reading joins headers and payloads again and refuses a payload whose digest is
not its address. Everything is a DataFrame operation; payloads are moved once when the archive is
written (copies are merged before the shuffle) and once when records are put together.

An archive is a folder with the Parquet tables ``payloads`` (address, payload) and ``headers``
(record_no, key, uri, record_type, refers_to, address, payload_bytes, payload_digest, warc_header,
http_header).

Cases: a null html is an empty payload; a null uri leaves its header line out, and line breaks in a
uri are percent-encoded in the header; of equal payloads whose keys tie or are null, the first read
is the response, null keys last (refers_to is then null, and the header names the record); other
columns are left out; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm.common import cut

#: The digits of base 32 as conv() writes them, and as RFC 4648 does.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of a digest of 20 bytes in hex: each 5 hex digits are 4 of base 32."""
    groups = (F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8))
    return F.translate(F.concat(*groups), CONV_DIGITS, BASE32_DIGITS)


def _uuid(*of: Column) -> Column:
    return F.regexp_replace(F.md5(F.concat_ws("|", *of)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def write_archive(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", html: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes the archive of ``pages`` to a new folder.

    min_bytes: payloads of fewer bytes are all responses. date: the WARC-Date of every record.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    x = pages.select(F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"), payload.alias("payload"))
    x = x.withColumn("address", F.sha2("payload", 256))
    x.groupBy("address").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")

    names = x.select("key", "uri", "address", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.upper(F.sha1("payload"))).alias("payload_digest"))
    names = cut(names.withColumn("record_no", F.monotonically_increasing_id()))
    place = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("record_no").alias("record_no"))
    first = names.where(F.col("payload_bytes") >= min_bytes).groupBy("address").agg(F.min(place).alias("first"))
    typed = names.join(first, "address", "left").withColumn("revisits", F.coalesce(F.col("first.record_no") != F.col("record_no"), F.lit(False)))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit("\r\n\r\n"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    safe_uri = F.replace(F.replace("uri", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    urn = lambda k, n: F.concat(F.lit("<urn:uuid:"), _uuid(k.cast("string"), n.cast("string")), F.lit(">"))
    length = F.octet_length("http_header") + F.when(F.col("revisits"), 0).otherwise(F.col("payload_bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("key"), F.col("record_no"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", safe_uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(F.col("revisits"), F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", urn(F.col("first.key"), F.col("first.record_no"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    typed = typed.withColumn("record_type", F.when(F.col("revisits"), "revisit").otherwise("response")).withColumn("http_header", http)
    typed.select("record_no", "key", "uri", "record_type", F.when(F.col("revisits"), F.col("first.key")).alias("refers_to"), "address", "payload_bytes", "payload_digest", header.alias("warc_header"), "http_header").write.parquet(f"{path}/headers")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(address, payload); a payload that is not what its address says ends the query."""
    stored = spark.read.parquet(f"{path}/payloads")
    checked = F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload: "), F.col("address"))).cast("binary"))
    return stored.select("address", checked.alias("payload"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_no, key, record_type, refers_to, record binary): every record's exact bytes."""
    headers = read_headers(spark, path).withColumn("head", F.encode(F.concat("warc_header", "http_header"), "UTF-8"))
    tail = F.lit("\r\n\r\n").cast("binary")
    plain = ["record_no", "key", "record_type", "refers_to", "address"]
    responses = headers.where("record_type = 'response'").join(read_payloads(spark, path), "address").select(*plain, F.concat("head", "payload", tail).alias("record"))
    revisits = headers.where("record_type = 'revisit'").select(*plain, F.concat("head", tail).alias("record"))
    return responses.unionByName(revisits)


def parse_records(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with warc_type, record_id, refers_to_id, target_uri and payload (null for a revisit)
    out of each record's bytes."""
    latin = F.decode(record, "ISO-8859-1")  # a character for each byte
    parts = F.split(latin, "\r\n\r\n", 3)
    start = F.length(parts[0]) + 5  # of the block, counted from 1
    body = start + F.length(parts[1]) + 4  # of the payload
    head = F.decode(F.substring(F.col(record), F.lit(1), start - 1), "UTF-8")
    field = lambda name: F.nullif(F.regexp_extract(head, rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))
    payload = F.substring(F.col(record), body, field("Content-Length").cast("int") - (body - start))
    found = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to_id": "WARC-Refers-To", "target_uri": "WARC-Target-URI"}
    return records.withColumns({**{column: field(name) for column, name in found.items()}, "payload": F.when(field("WARC-Type") == "response", payload)})


def report(spark: SparkSession, path: str, key: str = "page_id") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of an archive read back: all of it is
    out of the records' bytes. A revisit meets the response that its header names, whose payload it has."""
    size, digest = F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.upper(F.sha1("payload"))).alias("payload_digest")
    # Records are put together and parsed once; what is left of them is small.
    read = cut(parse_records(read_records(spark, path)).select("key", "warc_type", "record_id", "refers_to_id", size, digest))
    responses = read.where("warc_type = 'response'").select("key", "record_id", "payload_bytes", "payload_digest")
    revisits = read.where("warc_type = 'revisit'").select("key", F.col("refers_to_id").alias("record_id"))
    met = revisits.join(responses.withColumnRenamed("key", "refers_to"), "record_id")
    columns = [F.col("key").alias(key), "payload_bytes", "payload_digest"]
    own = responses.select(*columns, F.lit("response").alias("record_type"), F.lit(None).cast(responses.schema["key"].dataType).alias("refers_to"))
    return own.unionByName(met.select(*columns, F.lit("revisit").alias("record_type"), "refers_to"))
