import base64
import collections
import glob
import hashlib
import time

import pytest
from pyspark.sql import functions as F

from hearth.llm import queries, warc


def test_warc(spark, sf):
    rows = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, "http://a/3", "same"), (7, "u\r\nx", ""), (8, None, None), (9, "http://a/9", "é own"), (9, "http://a/9", "é own"), (None, "n", "no id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    stored = warc.archive(pages)
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_back(stored).collect())

    def digest(t):
        return base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()

    assert got == collections.Counter([(1, 4, digest("same"), "revisit", 5), (5, 4, digest("same"), "response", None), (3, 4, digest("same"), "revisit", 5), (7, 0, digest(""), "revisit", 8), (8, 0, digest(""), "response", None), (9, 6, digest("é own"), "response", None), (9, 6, digest("é own"), "revisit", 9), (None, 5, digest("no id"), "response", None)])
    assert stored.payloads.count() == 4 and stored.payloads.agg(F.sum(F.length("payload"))).first()[0] == 15
    for r in warc.records(stored).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and rest[size:] == b"\r\n\r\n"
    heads = [bytes(r.header).decode() for r in stored.headers.collect()]
    assert len({h.split("WARC-Record-ID: ")[1].split("\r\n")[0] for h in heads}) == len(rows)
    assert any("WARC-Target-URI: u%0D%0Ax\r\n" in h for h in heads)
    named = {h.split("WARC-Record-ID: ")[1].split("\r\n")[0] for h in heads if "WARC-Type: response" in h}
    assert all(h.split("WARC-Refers-To: ")[1].split("\r\n")[0] in named for h in heads if "WARC-Type: revisit" in h)
    whole = warc.records(stored, full=True)
    assert whole.where(F.col("record").cast("string").endswith("\r\n\r\nsame\r\n\r\n")).count() == 3
    small = warc.read_back(warc.archive(pages, min_revisit_bytes=5))
    assert {r.record_type for r in small.where("page_id IN (1, 3, 5, 7, 8)").collect()} == {"response"}
    assert warc.read_back(warc.archive(pages.limit(0))).count() == 0
    broken = warc.Archive(stored.payloads.withColumn("payload", F.lit(b"other")), stored.headers)
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_back(broken).collect()


def test_query_leaves_no_shuffles_of_its_tables(spark, sf):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def shuffles():
        return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}

    before = shuffles()
    rows = queries.op10_warc(spark, sf)
    for _ in range(50):  # files are deleted in the background
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before
    assert rows.count() == spark.read.parquet(f"{sf}/pages.parquet").count()
