"""Graph queries over vertex and edge tables, and clusters that cross member kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vertices(*parts: tuple[DataFrame, str, str, str]) -> DataFrame:
    """(id, type, label) of (table, type, id column, label column); the first row of an id wins."""
    made = [df.select(F.col(i).cast("string").alias("id"), F.lit(t).alias("type"), F.col(l).cast("string").alias("label"), F.lit(n).alias("ord")) for n, (df, t, i, l) in enumerate(parts)]
    every = reduce(DataFrame.unionByName, made)
    return every.groupBy("id").agg(F.min(F.struct("ord", "type", "label")).alias("v")).select("id", "v.type", "v.label")


def edges(*parts: tuple[DataFrame, str, str, str]) -> DataFrame:
    """(source, target, kind) of (table, kind, source column, target column); parallel edges stay."""
    made = [df.select(F.col(s).cast("string").alias("source"), F.col(t).cast("string").alias("target"), F.lit(k).alias("kind")) for df, k, s, t in parts]
    return reduce(DataFrame.unionByName, made)


def stats(vs: DataFrame, es: DataFrame) -> DataFrame:
    """Counts by vertex type (ends of edges without a vertex are Unknown) and by edge kind."""
    ends = es.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    unknown = ends.join(vs, "id", "left_anti").select(F.lit("Unknown").alias("name"))
    nodes = vs.select(F.col("type").alias("name")).unionByName(unknown).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("vertex").alias("what"), "name", "n")
    return nodes.unionByName(es.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "name", "n"))


def neighbours(es: DataFrame, kind: str, at: DataFrame, key: str) -> DataFrame:
    """`at` joined with the targets of its edges of a kind, as target."""
    return at.join(es.where(F.col("kind") == kind).select(F.col("source").alias(key), "target"), key)


def first_neighbour(es: DataFrame, kind: str) -> DataFrame:
    """(source, target): the least target of each source."""
    return es.where(F.col("kind") == kind).groupBy("source").agg(F.min("target").alias("target"))


def same_code_pairs(codes: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Edges between codes that a crosswalk (code, other) calls the same, where the codes differ."""
    return crosswalk.where("code <> other").join(codes.select("code"), "code", "left_semi").select(F.col("code").alias("source"), F.col("other").alias("target"), F.lit("SAME_AS").alias("kind"))


def export(vs: DataFrame, es: DataFrame) -> DataFrame:
    """Nodes and links as JSON rows."""
    return vs.select(F.lit("node").alias("what"), F.to_json(F.struct("id", "type", "label")).alias("row")).unionByName(es.select(F.lit("link").alias("what"), F.to_json(F.struct("source", "target", "kind")).alias("row")))


def cross_kind_clusters(conditions: DataFrame, members: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """Groups in which members of both kinds have a code.

    conditions: ref, code, onset, case_id; members: ref, kind, group_id.  The
    index case is the earliest (first kind before second, then ref, then case_id;
    a null onset comes first); interval_days is from it to the next case.  Cases
    are summed once by member and day; counts and the two earliest both come from
    these sums (one exchange, reused), and only two rows of a group are ranked, so
    that no group is gathered in one place.
    """
    cases = conditions.join(members, "ref").withColumn("kind_ord", F.when(F.col("kind") == kinds[0], 0).otherwise(1))
    daily = cases.groupBy("group_id", "code", "onset", "ref", "kind", "kind_ord").agg(F.count("*").alias("n"), F.min("case_id").alias("case_id"))
    place = F.struct("onset", "kind_ord", "ref", "case_id", "kind", "n")
    counts = daily.groupBy("group_id", "code").agg(
        F.sum(F.when(F.col("kind") == kinds[0], F.col("n")).otherwise(0)).alias("n_first"), F.sum(F.when(F.col("kind") == kinds[1], F.col("n")).otherwise(0)).alias("n_second"), F.count_distinct("ref").alias("n_members")
    ).where("n_first > 0 AND n_second > 0")
    turn = Window.partitionBy("group_id", "code").orderBy(F.asc_nulls_first("onset"), "kind_ord", "ref", "case_id")
    two = daily.withColumn("rn", F.row_number().over(turn)).where("rn <= 2").groupBy("group_id", "code").agg(F.min(place).alias("index"), F.max(F.when(F.col("rn") == 2, F.col("onset"))).alias("second"))
    next_onset = F.when(F.col("index.n") > 1, F.col("index.onset")).otherwise(F.col("second"))
    return counts.join(two, ["group_id", "code"]).select("group_id", "code", "n_first", "n_second", "n_members", F.col("index.ref").alias("index_ref"), F.col("index.kind").alias("index_kind"), F.col("index.onset").alias("index_onset"), F.datediff(next_onset, F.col("index.onset")).alias("interval_days"))


def secondaries(conditions: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    """The cases of each cluster after its index case, numbered in order."""
    cases = conditions.join(members, "ref").join(clusters.select("group_id", "code", "index_kind"), ["group_id", "code"])
    turn = Window.partitionBy("group_id", "code").orderBy(F.asc_nulls_first("onset"), F.when(F.col("kind") == F.col("index_kind"), 0).otherwise(1), "ref", "case_id")
    return cases.withColumn("ordinal", F.row_number().over(turn) - 1).where("ordinal > 0").drop("index_kind")


def at_risk(conditions: DataFrame, members: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(group_id, code, ref): members of a group in which somebody has the code, who have not; for the asked (group_id, code) alone if given."""
    seen = conditions.join(members, "ref").select("group_id", "code", "ref").distinct()
    if asked is not None:
        seen = seen.join(asked.select("group_id", "code").distinct(), ["group_id", "code"], "left_semi")
    return seen.select("group_id", "code").distinct().join(members.select("group_id", "ref"), "group_id").join(seen, ["group_id", "code", "ref"], "left_anti")


def at_risk_counts(conditions: DataFrame, members: DataFrame) -> DataFrame:
    """(group_id, code, n_diagnosed, n_at_risk) of every group and code, from sums; members are not listed."""
    seen = conditions.join(members, "ref").groupBy("group_id", "code").agg(F.count_distinct("ref").alias("n_diagnosed"))
    sizes = members.groupBy("group_id").agg(F.count_distinct("ref").alias("n"))
    return seen.join(sizes, "group_id").select("group_id", "code", "n_diagnosed", (F.col("n") - F.col("n_diagnosed")).alias("n_at_risk"))


def identity_search(people: DataFrame, name: str, birth: str, address: str, n: int = 5) -> DataFrame:
    """People by weighted matches of name, birth date (year-month for less) and address; capped at .99, the best n."""
    q_name, q_address = name.lower(), address.lower()
    score = F.when(F.lower("name").contains(q_name), 0.5).otherwise(0.0) + F.when(F.col("birth") == birth, 0.35).when(F.substring("birth", 1, 7) == birth[:7], 0.2).otherwise(0.0) + F.when(F.lower("address").contains(q_address), 0.2).otherwise(0.0)
    return people.withColumn("score", F.least(F.lit(0.99), score)).where("score > 0").orderBy(F.desc("score"), "ref").limit(n)
