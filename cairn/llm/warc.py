"""A content-addressed web archive.

Payload bytes are kept once, under their SHA-256, which is verified when they are read. Record headers are kept exactly,
in a table of their own, each with its payload's address. The original records come back by joining the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import stored

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"


def base32_sha1(data: Column) -> Column:
    """SHA-1 as 32 characters of base32: each 10 hex digits are 40 bits, which are 8 characters."""
    digest = F.sha1(data)

    def eight(k: Column) -> Column:
        bits = F.lpad(F.conv(F.substr(digest, k * 10 + 1, F.lit(10)), 16, 2), 40, "0")
        letter = lambda i: F.substr(F.lit(BASE32), F.conv(F.substr(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letter), "")

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), eight), "")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Writes a record for each row: path/headers (page_id, header, address) and path/payloads (address, payload).

    The payload is the html in UTF-8, null as empty. Of equal payloads of at least `least` bytes the record with the
    largest page_id is the response and the others revisit it; all smaller ones are responses. Null identifiers are
    smaller than any other; records of a group that has no other are all responses, and so are rows that repeat the
    largest one. A null url gives an empty WARC-Target-URI; line ends in a url are percent-encoded. Other columns
    are ignored; an empty table writes an empty archive.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("address", F.sha2("payload", 256))
    store = rows.groupBy("address", "payload").agg(F.count("*").alias("n")).select("address", "payload")
    store.write.option("compression", "zstd").parquet(f"{path}/payloads")
    facts = rows.select("page_id", "url", "address", F.octet_length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("digest"))
    last = stored(facts.groupBy("address").agg(F.max("page_id").alias("response_id")), "responses")
    known = facts.join(last, "address")
    revisit = (F.col("size") >= least) & F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Refers-To", _urn(F.col("response_id"))),
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("size").cast("string"))),
        F.lit(END),
    )
    known.select("page_id", header.alias("header"), "address").write.option("compression", "zstd").parquet(f"{path}/headers")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page_id long, header string, address string").parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(address, payload). A payload that doesn't have its address's SHA-256 is an error, so that no address stands for two payloads."""
    store = spark.read.schema("address string, payload binary").parquet(f"{path}/payloads")
    good = F.assert_true(F.sha2("payload", 256) == F.col("address"), "a payload doesn't have its address's digest")
    return store.filter(good.isNull())


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: page_id, header, payload (whole, also for revisits) and record, the WARC bytes."""
    records = read_headers(spark, path).join(read_payloads(spark, path), "address")
    body = F.when(F.col("header").contains(f"{END}WARC-Type: revisit{END}"), F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return records.select(
        "page_id", "header", "payload", F.concat(F.encode("header", "UTF-8"), body, F.encode(F.lit(END * 2), "UTF-8")).alias("record")
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """What the archive says of each record: page_id, payload_bytes, payload_digest, record_type, refers_to. Sizes and digests are
    taken anew from the stored payloads, once for each payload."""
    sizes = read_payloads(spark, path).select(
        "address", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")
    )
    field = lambda name: F.regexp_extract("header", f"\r\n{name}: ([^\r]*)\r\n", 1)
    number = lambda urn: F.regexp_extract(urn, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    return read_headers(spark, path).join(sizes, "address").select(
        number(field("WARC-Record-ID")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        field("WARC-Type").alias("record_type"),
        number(field("WARC-Refers-To")).alias("refers_to"),
    )


def export_warc(spark: SparkSession, path: str, out: str) -> None:
    """Plain .warc text files, written by Spark: each line of the text sink is a record and its line end the two empty lines
    that close one."""
    records = read_records(spark, path)
    body = F.when(F.col("header").contains(f"{END}WARC-Type: revisit{END}"), "").otherwise(F.decode("payload", "UTF-8"))
    records.select(F.concat("header", body).alias("value")).write.option("lineSep", END * 2).text(out)
