"""A content-addressed WARC archive.

Every payload is stored once, under its SHA-256.  The exact header of every
record (WARC header and HTTP header, byte for byte) is stored apart, with the
digest of its payload.  Original records are the join of the two.  Of records
with equal payloads of at least `min_revisit_bytes`, that with the largest id is
a response and the others are revisits of it; smaller ones are all responses.

Reading rebuilds every record, header and full payload, parses it from its bytes
and verifies: the SHA-256 of every stored payload is taken again and must be the
key that it stands under, and the SHA-1 and length of the payload in each record
must agree with its header; otherwise the query fails.

A group of equal payloads meets in sums combined before the shuffle and in
equality joins that adaptive execution can split.

Cases: a null payload is an empty one; a null url gives an empty target, and line
breaks in one are percent-encoded; a null id is smaller than any other and keeps
its null; every record has an id of its own; of repeated rows one is the
response and the others revisit it; an empty table gives an empty archive; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, hex_digest_base32, met, written

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    #: digest string, payload binary
    payloads: DataFrame
    #: digest string, header binary
    headers: DataFrame


def _line(name: str, value) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def archive(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0, date: str = DATE) -> Archive:
    """Writes the pages' records as two tables in the shared folder."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    facts = written(rows.select("id", "url", "digest", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1")), "facts")

    keepers = facts.groupBy("digest").agg(F.max("id").alias("keeper"))
    turn = F.row_number().over(Window.partitionBy("id", "digest").orderBy("url"))
    known = met(facts.withColumn("turn", turn), keepers, "digest")
    small = F.col("n") < min_revisit_bytes
    response = small | (F.col("id").eqNullSafe(F.col("keeper")) & (F.col("turn") == 1))

    def name(ident: str, nth: Column) -> Column:
        """Of one record alone: the page, its payload, and which of the rows that repeat both."""
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(ident).cast("string"), F.lit("none")), F.lit(":"), F.substring("digest", 1, 16), F.lit(":"), nth.cast("string"), F.lit(">"))

    target = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        F.when(response, _line("WARC-Type", F.lit("response"))).otherwise(F.concat(_line("WARC-Type", F.lit("revisit")), _line("WARC-Refers-To", name("keeper", F.lit(1))), _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))),
        _line("WARC-Record-ID", name("id", F.col("turn"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", target),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), hex_digest_base32(F.col("sha1")))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.octet_length(http) + F.when(response, F.col("n")).otherwise(0)).cast("string")),
        F.lit(CRLF),
        http,
    )
    headers = written(known.select("digest", header.cast("binary").alias("header")), "headers")

    # one row for each digest: the keeper's, or any one of its repeated rows
    # (the window's keys are the join's, so that payloads are shuffled once)
    slot = F.coalesce("id", F.lit(-(1 << 63))).alias("slot")
    chosen = rows.select("digest", slot, "payload").join(keepers.select("digest", F.coalesce("keeper", F.lit(-(1 << 63))).alias("slot")), ["digest", "slot"])
    once = chosen.withColumn("turn", F.row_number().over(Window.partitionBy("digest", "slot").orderBy(F.lit(0)))).where("turn = 1")
    payloads = written(once.select("digest", "payload"), "payloads")
    dropped(facts)
    return Archive(payloads, headers)


def _checked(payloads: DataFrame) -> DataFrame:
    same = F.sha2("payload", 256) == F.col("digest")
    return payloads.withColumn("payload", F.when(same, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("a stored payload does not match its digest "), F.col("digest")))))


def records(stored: Archive, full: bool = False) -> DataFrame:
    """(record binary) of every record as a WARC file has it; with `full`, revisits carry their payload too."""
    joined = stored.headers.join(_checked(stored.payloads), "digest")
    revisit = F.col("header").cast("string").contains(f"WARC-Type: revisit{CRLF}")
    body = F.col("payload") if full else F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    return joined.select(F.concat("header", body, F.lit(CRLF.encode() * 2)).alias("record"))


def read_back(stored: Archive) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record, from whole records rebuilt from the archive.

    A record is parsed from its bytes: the WARC header ends at the first empty line
    and the HTTP header at the second, and what follows, but for the closing line
    breaks, is the payload, of which length and SHA-1 are taken.
    """
    blank = F.lit(CRLF.encode() * 2)
    whole = records(stored, full=True)
    head_end = F.expr("position(X'0D0A0D0A', record)")
    http_end = F.expr("position(X'0D0A0D0A', record, head_end + 4)")
    cut = whole.withColumn("head_end", head_end).withColumn("http_end", http_end)
    begin = F.col("http_end") + 4
    size = F.octet_length("record") - F.octet_length(blank)
    parts = cut.select(
        F.substring("record", F.lit(1), F.col("head_end") + 3).cast("string").alias("head"),
        F.substring("record", F.col("head_end") + 4, F.col("http_end") - F.col("head_end")).cast("string").alias("http"),
        F.substring("record", begin, size - begin + 1).alias("payload"),
    )

    def field(text: str, pattern: str) -> Column:
        return F.regexp_extract(text, pattern, 1)

    facts = parts.select(
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        hex_digest_base32(F.sha1("payload")).alias("payload_digest"),
        F.expr("try_cast(regexp_extract(head, '\\r\\nWARC-Record-ID: <urn:page:([^:>]*):', 1) as bigint)").alias("page_id"),
        field("head", "\r\nWARC-Type: ([a-z]+)\r\n").alias("record_type"),
        F.expr("try_cast(regexp_extract(head, '\\r\\nWARC-Refers-To: <urn:page:([^:>]*):', 1) as bigint)").alias("refers_to"),
        field("head", "\r\nWARC-Payload-Digest: sha1:([A-Z2-7]+)\r\n").alias("said_digest"),
        field("http", "\r\nContent-Length: ([0-9]+)\r\n").cast("long").alias("said_bytes"),
    )
    agrees = (F.col("said_digest") == F.col("payload_digest")) & (F.col("said_bytes") == F.col("payload_bytes"))
    bytes_ = F.when(agrees, F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a record's header does not agree with its payload")))
    return facts.select("page_id", bytes_.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def _oracle() -> str:
    """The result of read_back(archive(pages)) in DuckDB's SQL."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    group = "CAST('0x' || substr(h, {at}, 5) AS INTEGER)"
    coded = " || ".join(f"substr('{digits}', (({group.format(at=5 * i + 1)} >> {shift}) & 31) + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
k AS (SELECT body, max(page_id) AS keeper FROM p GROUP BY body),
j AS (SELECT p.page_id, k.keeper, strlen(p.body) AS payload_bytes, sha1(p.body) AS h FROM p JOIN k ON p.body = k.body)
SELECT page_id, payload_bytes, {coded} AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM j
"""


ORACLE_SQL = _oracle()
