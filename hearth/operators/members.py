"""Members of groups: flattening of nested groups, charts, searches, and the access functions of a read API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.functions.strings import by_locale, equal_ignoring_case


def flatten(groups: DataFrame, group_id: str, arrays: dict[str, tuple[str, str, Column, Column]]) -> DataFrame:
    """(group_id, ref, kind, name) from nested arrays: {array: (kind, ref prefix, id, name)} with id and name over the element `m`."""
    parts = []
    for array, (kind, prefix, ident, name) in arrays.items():
        rows = groups.select(F.col(group_id).alias("group_id"), F.explode(F.col(array)).alias("m"))
        parts.append(rows.select("group_id", F.concat(F.lit(prefix), ident).alias("ref"), F.lit(kind).alias("kind"), F.coalesce(name, F.lit(kind)).alias("name")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_kind(members: DataFrame) -> DataFrame:
    """The members of each group as one array for each kind."""
    return members.groupBy("group_id", "kind").agg(F.sort_array(F.collect_list("ref")).alias("refs"))


def counts_and_flags(members: DataFrame, flags: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Members of each group and kind in all, and {flag: (column, values)} as 0/1."""
    made = [F.max(F.col(c).isin(values).cast("int")).alias(flag) for flag, (c, values) in flags.items()]
    return members.groupBy("group_id").agg(F.count("*").alias("n_members"), F.count_distinct("kind").alias("n_kinds"), *[F.coalesce(m, F.lit(0)).alias(f) for m, f in zip(made, flags)])


def in_region(rows: DataFrame, column: str, region: str | None) -> DataFrame:
    return rows.where(equal_ignoring_case(F.col(column), region))


def named(rows: DataFrame, column: str, names: DataFrame, name: str) -> DataFrame:
    """Rows beside the names that are theirs by locale, without regard to case: an equality join on the collation's keys."""
    return rows.join(names, by_locale(rows[column]) == by_locale(names[name]))


def with_value(rows: DataFrame, column: str, value: str | None) -> DataFrame:
    return rows.where(F.col(column) == value) if value else rows


def point(rows: DataFrame, column: str, value) -> DataFrame:
    """The one row with a key; an error if there is none."""
    found = rows.where(F.col(column) == value).limit(1)
    if found.isEmpty():
        raise KeyError(f"no row with {column} = {value!r}")
    return found


def with_kind(rows: DataFrame, column: str, kind: str, known: set[str]) -> DataFrame:
    """Rows of a kind that must be one of those known."""
    if kind not in known:
        raise ValueError(f"unknown kind {kind!r}")
    return rows.where(F.col(column) == kind)


def search(rows: DataFrame, query: str, columns: list[str], arrays: list[str] = ()) -> DataFrame:
    """Rows where any of the columns, or any element of the arrays, holds the query, case ignored."""
    q = query.lower()
    hit = F.lit(not q)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False))
    for c in arrays:
        hit = hit | F.coalesce(F.exists(F.col(c), lambda x: F.lower(x).contains(q)), F.lit(False))
    return rows.where(hit)


def listing(rows: DataFrame, alerted: DataFrame, group: str, label: str, n: int = 80) -> DataFrame:
    """Rows of groups with an alert first, then by label in the locale's order; the first n."""
    marks = alerted.select(F.col(group).alias("_g")).distinct().withColumn("has_alert", F.lit(1))
    joined = rows.join(marks, rows[group] == marks["_g"], "left").drop("_g").withColumn("has_alert", F.coalesce("has_alert", F.lit(0)))
    return joined.orderBy(F.desc("has_alert"), by_locale(F.col(label)), label).limit(n)


def newest_per(rows: DataFrame, key: str, time: str, tie: str, n: int) -> DataFrame:
    """The newest n rows of each key; the limit is applied before the shuffle too."""
    turn = Window.partitionBy(key).orderBy(F.desc(time), F.desc(tie))
    return rows.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= n)


def chart(member: DataFrame, conditions: DataFrame, events: DataFrame, ref: str = "ref", n_events: int = 12) -> DataFrame:
    """Each member with its active conditions, distinct medications and newest events."""
    active = conditions.where("active").groupBy(ref).agg(F.sort_array(F.collect_set(F.struct("code", "onset"))).alias("conditions"))
    medications = events.select(ref, F.explode("medications").alias("m")).groupBy(ref).agg(F.sort_array(F.collect_set("m")).alias("medications"))
    recent = newest_per(events, ref, "date", "event_id", n_events).groupBy(ref).agg(F.sort_array(F.collect_list(F.struct("rank", "event_id", "date"))).alias("recent"))
    return member.join(active, ref, "left").join(medications, ref, "left").join(recent, ref, "left")


def codings(pairs: list[tuple[str, Column]]) -> Column:
    """An array of (system, code) with the codes that exist."""
    made = F.array(*[F.struct(F.lit(s).alias("system"), c.alias("code")) for s, c in pairs])
    return F.filter(made, lambda x: x["code"].isNotNull())


def first_match(rows: DataFrame, key: str, lookups: list[tuple[DataFrame, Column]], value: str) -> DataFrame:
    """`value` of the first look-up, in order, that has a row; within one look-up the first by its `ordinal`."""
    out = rows
    found = []
    for i, (table, on) in enumerate(lookups):
        hits = rows.join(table, on, "inner").groupBy(rows[key].alias(f"_k{i}")).agg(F.min_by(table[value], table["ordinal"]).alias(f"_v{i}"))
        out = out.join(hits, out[key] == hits[f"_k{i}"], "left")
        found.append(F.col(f"_v{i}"))
    return out.select(*[out[c] for c in rows.columns], F.coalesce(*found).alias(value))
