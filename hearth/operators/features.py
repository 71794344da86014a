"""Labels and leakage-free features of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.functions.dates import day_number, season_flags
from hearth.functions.strings import contains_any


def trailing(events: DataFrame, group: str, date: str, days: list[int], distinct: dict[str, Column] | None = None) -> DataFrame:
    """Counts, and distinct counts, of a group's events in the `days` days strictly before each event's day.

    The frame is a range of days that ends the day before, so neither the event
    itself, nor its day, nor the future can leak in.
    """
    out = events.withColumn("_day", day_number(F.to_date(date)))
    for n in days:
        w = Window.partitionBy(group).orderBy("_day").rangeBetween(-n, -1)
        out = out.withColumn(f"n_{n}d", F.count("*").over(w))
        for name, c in (distinct or {}).items():
            out = out.withColumn(f"{name}_{n}d", F.size(F.collect_set(c).over(w)))
    return out.drop("_day")


def daily_trailing(events: DataFrame, group: str, date: str, days: list[int]) -> DataFrame:
    """The same counts for groups with very many events: days are summed first, so a window holds a row for each day."""
    day = day_number(F.to_date(date))
    daily = events.groupBy(group, day.alias("_day")).agg(F.count("*").alias("_n"))
    for n in days:
        w = Window.partitionBy(group).orderBy("_day").rangeBetween(-n, -1)
        daily = daily.withColumn(f"n_{n}d", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return events.withColumn("_day", day).join(daily.drop("_n"), [group, "_day"]).drop("_day")


def _code_sums(asks: DataFrame, cases: DataFrame, keys: list[str], days: int) -> DataFrame:
    """(*keys, _d, code, _n): for each asked day and code of its keys, the cases of the `days` days up to it, where there are any."""
    daily = cases.groupBy(*keys, "code", "_d").agg(F.sum("_n").alias("_n"))
    asked = asks.select(*keys, "_d").distinct().join(daily.select(*keys, "code").distinct(), keys)
    both = daily.select(*keys, "code", "_d", "_n", F.lit(False).alias("_ask")).unionByName(asked.select(*keys, "code", "_d", F.lit(0).cast("long").alias("_n"), F.lit(True).alias("_ask")))
    w = Window.partitionBy(*keys, "code").orderBy("_day").rangeBetween(-days, 0)
    return both.withColumn("_day", day_number(F.col("_d"))).withColumn("_n", F.sum("_n").over(w)).where("_ask AND _n > 0").select(*keys, "_d", "code", "_n")


def others_recent(events: DataFrame, cases: DataFrame, days: int, group: str = "group_id", member: str = "ref", date: str = "date") -> DataFrame:
    """For each event: cases of other members of its group in the `days` days up to it, and their distinct codes.

    Sums by group, code and day less the member's own; events do not meet cases.
    """
    named = [F.col(group).alias("_g"), F.col(member).alias("_m"), F.to_date(date).alias("_d")]
    asks = events.select(*named).distinct()
    summed = cases.select(*named, "code").where("_g IS NOT NULL AND _m IS NOT NULL AND _d IS NOT NULL").groupBy("_g", "_m", "code", "_d").agg(F.count("*").alias("_n"))
    total = _code_sums(asks, summed, ["_g"], days)
    own = _code_sums(asks, summed, ["_g", "_m"], days).withColumnRenamed("_n", "_own")
    known = F.col("code").isNotNull()
    alls = total.groupBy("_g", "_d").agg(F.sum("_n").alias("_all"), F.count_if(known).alias("_codes"))
    t = total.select(F.col("_g").alias("_tg"), F.col("_d").alias("_td"), F.col("code").alias("_tc"), "_n")
    mine = own.join(t, (F.col("_g") == F.col("_tg")) & (F.col("_d") == F.col("_td")) & F.col("code").eqNullSafe(F.col("_tc")))
    mine = mine.groupBy("_g", "_m", "_d").agg(F.sum("_own").alias("_own"), F.count_if(known & (F.col("_own") == F.col("_n"))).alias("_gone"))
    less = lambda a, b: F.when(F.col("_m").isNull(), 0).otherwise(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))).cast("long")
    found = events.withColumns(dict(zip(("_g", "_m", "_d"), named))).join(alls, ["_g", "_d"], "left").join(mine, ["_g", "_m", "_d"], "left")
    return found.select(*events.columns, less(F.col("_all"), F.col("_own")).alias("n_other_cases"), less(F.col("_codes"), F.col("_gone")).alias("n_other_codes"))


def labelled(events: DataFrame, indices: DataFrame, days: int, keywords: list[str], region: Column, window: tuple[str, str], text: Column, date: str = "date", group: str = "group_id") -> DataFrame:
    """label and reason: 1 near a group's index date, or in a region and window with a keyword; the first rule wins.

    indices: group, index_date, one row for each group at most.
    """
    joined = events.join(indices.withColumnRenamed(group, "_g"), F.col(group) == F.col("_g"), "left")
    near = F.abs(F.datediff(F.col(date), F.col("index_date"))) <= days
    second = region & F.col(date).between(F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date")) & contains_any(text, keywords)
    reason = F.when(F.coalesce(near, F.lit(False)), "index_group").when(F.coalesce(second, F.lit(False)), "region_keyword").otherwise("none")
    return joined.withColumn("reason", reason).drop("_g", "index_date").withColumn("label", (F.col("reason") != "none").cast("int"))


def keyword_flags(rows: DataFrame, text: Column, bags: dict[str, list[str]]) -> DataFrame:
    return rows.withColumns({name: contains_any(text, words).cast("int") for name, words in bags.items()})


def temporal(rows: DataFrame, date: Column) -> DataFrame:
    return rows.withColumns(season_flags(date))


def measurement_flags(rows: DataFrame, rules: dict[str, tuple[str, float | None, float | None]]) -> DataFrame:
    """{flag: (column, above, below)} as 0/1; a missing measurement counts as normal."""
    made = {}
    for flag, (c, above, below) in rules.items():
        hit = F.lit(True)
        if above is not None:
            hit = hit & (F.col(c) > above)
        if below is not None:
            hit = hit & (F.col(c) < below)
        made[flag] = F.coalesce(hit, F.lit(False)).cast("int")
    return rows.withColumns(made)


def region_anomaly(series: DataFrame, region: str, value: str, since: Column | None = None) -> DataFrame:
    """(region, total, z): z of the largest value against all, population deviation (1 where they do not vary)."""
    rows = series.where(since) if since is not None else series
    sums = rows.groupBy(region).agg(F.sum(value).alias("total"), F.max(value).alias("top"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return sums.select(region, "total", ((F.col("top") - F.col("mean")) / F.coalesce(F.nullif("sd", F.lit(0.0)), F.lit(1.0))).alias("z"))


def assembled(events: DataFrame, parts: list[tuple[DataFrame, str]], defaults: float = 0.0) -> DataFrame:
    """Events with the columns of each part, joined by its key; numbers that a part lacks take the default."""
    out = events
    for part, key in parts:
        new = [c for c in part.columns if c != key]
        out = out.join(part, key, "left").fillna(defaults, subset=new)
    return out
