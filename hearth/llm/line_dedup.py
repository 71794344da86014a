"""Line de-duplication by site-relative frequency, with DataFrame functions only.

Rows are grouped by host.  A line stands on a page if the page's text has it
once or more.  A line that stands on more than `ratio` of a host's pages, and on
`min_pages` of them at least, is boilerplate of that host and is dropped
wherever the host's pages have it.  Order and all other lines stay.

Lines are counted by two independent 64-bit hashes, so only 16 bytes a line are
shuffled, and the counts are combined before the shuffle: a host that owns a
third of the pages adds no large group.  A host's boilerplate lines number at
most (distinct lines per page) / ratio, which bounds the arrays that are joined
back.  They are broadcast below `broadcast_rows` lines (counted first, about 24
bytes each) and joined by (host, salt) beyond.

Cases: a null text stays null and has no lines, but its row counts as a page; a
null host is a host of its own; blank lines are never dropped; repeated rows
count as pages of their own; an empty table gives an empty result; other columns
pass through, and `n_lines`, `n_dropped` of the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import met, unused, written

SALTS = 64


def line_dedup(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, min_pages: int = 3, broadcast_rows: int = 200_000) -> DataFrame:
    """The input's columns with the cleaned text, then n_lines (before) and n_dropped, both int."""
    h, drop, salt, kept = (unused(name, docs) for name in ("host", "drop", "salt", "kept"))
    key = F.concat(F.when(F.col(host).isNull(), "-").otherwise("+"), F.coalesce(F.col(host).cast("string"), F.lit("")))
    lines = F.split(F.col(text), "\n", -1)

    def digest(line):
        return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))

    shown = docs.select(key.alias("host"), lines.alias("lines"))
    pages = shown.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    inked = F.filter(F.array_distinct("lines"), lambda x: F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")) != "")
    counts = shown.select("host", F.explode(F.transform(inked, digest)).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    frequent = written(met(counts, pages, "host").where(F.col("n") > F.lit(float(ratio)) * F.col("pages")).select("host", "line"), "boilerplate")
    per_host = frequent.groupBy(F.col("host").alias(h)).agg(F.collect_list("line").alias(drop))

    marked = docs.drop("n_lines", "n_dropped").withColumn(h, key)
    if frequent.count() <= broadcast_rows:
        joined = marked.join(F.broadcast(per_host), h, "left")
    else:
        salted = per_host.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        plain = [c for c, kind in marked.dtypes if "map" not in kind and "variant" not in kind]  # a row is dealt by what it holds, so that a task run again deals alike
        joined = marked.withColumn(salt, F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int")).join(salted, [h, salt], "left")
    left = F.when(F.col(drop).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(drop, digest(x))))
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    out = joined.withColumn(kept, left)
    own = [F.array_join(kept, "\n").alias(text) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*own, F.when(F.col(text).isNull(), 0).otherwise(n_lines).alias("n_lines"), F.when(F.col(text).isNull(), 0).otherwise(n_lines - F.size(kept)).alias("n_dropped"))


#: The same in DuckDB's SQL, over documents.
ORACLE_SQL = """
WITH pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
lines AS (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents),
drops AS (
  SELECT l.source, l.line FROM (SELECT source, line, count(*) AS n FROM lines WHERE NOT regexp_full_match(line, '[ \\t\\r\\x0B\\x0C]*') GROUP BY source, line) l
  JOIN pages p ON p.source IS NOT DISTINCT FROM l.source WHERE l.n >= 3 AND l.n > 0.1 * p.pages),
dropped AS (SELECT source, list(line) AS lines FROM drops GROUP BY source)
SELECT d.doc_id,
       array_to_string(list_filter(string_split(d.text, chr(10)), lambda x : NOT coalesce(list_contains(b.lines, x), false)), chr(10)) AS text,
       CAST(len(string_split(d.text, chr(10))) AS INTEGER) AS n_lines,
       CAST(len(list_filter(string_split(d.text, chr(10)), lambda x : coalesce(list_contains(b.lines, x), false))) AS INTEGER) AS n_dropped
FROM documents d LEFT JOIN dropped b ON b.source IS NOT DISTINCT FROM d.source
"""
