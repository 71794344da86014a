"""Contact tracing and lead time, as set-based queries over all index groups at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.functions.numbers import safe_ratio


def contacts(indices: DataFrame, members: DataFrame, groups: DataFrame, near_routes: list[str], include_index: bool = True) -> DataFrame:
    """Tier 1: members of the index group; tier 2: members of other groups of its region, if the route is a near one.

    indices: index_id, group_id, ref, index_date, route; groups: group_id, region_id.
    """
    own = indices.select("index_id", "group_id", F.col("ref").alias("index_ref"), "index_date").join(members, "group_id").withColumn("tier", F.lit(1))
    if not include_index:
        own = own.where("ref <> index_ref")
    at = indices.where(F.col("route").isin(near_routes)).join(groups, "group_id").select("index_id", F.col("group_id").alias("index_group"), F.col("ref").alias("index_ref"), "index_date", "region_id")
    near = at.join(groups, "region_id").where("group_id <> index_group").join(members, "group_id").withColumn("tier", F.lit(2))
    columns = ["index_id", "tier", "group_id", "ref", "index_date"]
    return own.select(*columns).unionByName(near.select(*columns))


def vector_contacts(indices: DataFrame, members: DataFrame, groups: DataFrame, traced: DataFrame, routes: list[str], region: str, window: tuple[str, str]) -> DataFrame:
    """Tier 3: members of groups of one region not yet traced, for vector routes inside a window of dates."""
    at = indices.where(F.col("route").isin(routes) & F.col("index_date").between(F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date"))).select("index_id", "index_date")
    inside = groups.where(F.col("region_id").cast("string") == region).join(members, "group_id")
    pairs = at.withColumn("region_id", F.lit(region)).join(inside.withColumn("region_id", F.lit(region)), "region_id")
    return pairs.join(traced.select("index_id", "group_id").distinct(), ["index_id", "group_id"], "left_anti").select("index_id", F.lit(3).alias("tier"), "group_id", "ref", "index_date")


def next_event(rows: DataFrame, events: DataFrame, member: str, date: str, event_date: str, event_id: str) -> DataFrame:
    """As-of forward: each row with its member's first event on or after its date (left join).

    The sorted union carries the next event back over each member's rows, so the
    cost is a sort and not a range join.
    """
    marks = events.select(F.col(member).alias("_m"), F.col(event_date).alias("_d"), F.struct(F.col(event_date).alias("next_date"), F.col(event_id).alias("next_id")).alias("_e"), F.lit(1).alias("_k"), F.lit(None).cast(rows.schema).alias("_row"))
    asks = rows.select(F.col(member).alias("_m"), F.col(date).alias("_d"), F.lit(None).cast("struct<next_date:date,next_id:bigint>").alias("_e"), F.lit(0).alias("_k"), F.struct(*rows.columns).alias("_row"))
    ahead = Window.partitionBy("_m").orderBy("_d", "_k", F.col("_e.next_id")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = asks.unionByName(marks.withColumn("_e", F.col("_e").cast("struct<next_date:date,next_id:bigint>")))
    found = both.withColumn("_n", F.first("_e", ignorenulls=True).over(ahead)).where("_k = 0")
    return found.select("_row.*", "_n.next_date", "_n.next_id").withColumn("days_until", F.datediff("next_date", date))


def scored(rows: DataFrame, model: DataFrame, priors: dict[int, float], default: float, bands: list[tuple[float, str]], otherwise: str) -> DataFrame:
    """risk: the model's probability of the next event, else the tier's prior; action: the first band reached."""
    table = F.create_map(*[F.lit(x) for pair in priors.items() for x in pair])
    risk = F.coalesce(F.col("probability"), table[F.col("tier")], F.lit(default))
    action = reduce(lambda acc, b: F.when(F.col("risk") >= b[0], b[1]).otherwise(acc), reversed(bands), F.lit(otherwise))
    return rows.join(model.select(F.col("event_id").alias("next_id"), "probability"), "next_id", "left").withColumn("risk", risk).withColumn("action", action)


def threshold_curve(rows: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """tp, fp, fn, sensitivity, precision and F1 at each threshold; rows are summed once for every threshold, not copied."""
    out = rows.agg(F.count_if(F.col(label) == 1).alias("positives"), *[F.count_if((F.col(score) >= t) & (F.col(label) == y)).alias(f"{k}{i}") for i, t in enumerate(thresholds) for k, y in (("tp", 1), ("fp", 0))])
    per = out.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), (F.col("positives") - F.col(f"tp{i}")).alias("fn")) for i, t in enumerate(thresholds)])).alias("r")).select("r.*")
    return per.withColumn("sensitivity", safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("precision", safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("f1", safe_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def earliest_in_window(events: DataFrame, confirmations: DataFrame, key: str, date: str, days: int, signal: str, where: Column | None = None) -> DataFrame:
    """(key, signal, earliest): the first qualifying event in the `days` days before the confirmation, that day excluded."""
    rows = events if where is None else events.where(where)
    inside = (F.col(date) < F.col("confirmed")) & (F.col(date) >= F.date_sub("confirmed", days))
    return rows.join(confirmations, key).where(inside).groupBy(key).agg(F.min(date).alias("earliest")).select(key, F.lit(signal).alias("signal"), "earliest")


def series_signal(series: DataFrame, confirmations: DataFrame, key: str, date: str, value: str, threshold: float, signal: str, least: int = 4, trailing_only: bool = False) -> DataFrame:
    """The first period before the confirmation whose z exceeds the threshold; z against the whole series, or only what came before."""
    w = Window.partitionBy(key)
    if trailing_only:
        w = w.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    z = (F.col(value) - F.avg(value).over(w)) / F.coalesce(F.nullif(F.stddev_pop(value).over(w), F.lit(0.0)), F.lit(1.0))
    zs = series.withColumn("_z", z).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    hits = zs.where((F.col("_z") > threshold) & (F.col("_n") >= least)).join(confirmations, key).where(F.col(date) < F.col("confirmed"))
    return hits.groupBy(key).agg(F.min(date).alias("earliest")).select(key, F.lit(signal).alias("signal"), "earliest")


def best_signal(confirmations: DataFrame, signals: list[DataFrame], key: str) -> DataFrame:
    """Each confirmation with its signal of most lead days (the first listed among equals), null without one."""
    every = reduce(DataFrame.unionByName, [s.withColumn("ord", F.lit(i)) for i, s in enumerate(signals)])
    led = every.join(confirmations, key).withColumn("lead_days", F.datediff("confirmed", "earliest"))
    best = led.groupBy(key).agg(F.min_by(F.struct("signal", "earliest", "lead_days"), F.struct((-F.col("lead_days")).alias("a"), "ord")).alias("b"), F.count("*").alias("n_signals"))
    return confirmations.join(best, key, "left").select(key, "confirmed", "b.signal", "b.earliest", "b.lead_days", F.coalesce("n_signals", F.lit(0)).alias("n_signals"))


def lead_summary(best: DataFrame) -> DataFrame:
    """Figures over the confirmations that have a signal."""
    return best.agg(F.count("*").alias("n"), F.count("lead_days").alias("n_with_signal"), F.avg("lead_days").alias("mean_lead"), F.median("lead_days").alias("median_lead"), F.min("lead_days").alias("min_lead"), F.max("lead_days").alias("max_lead"))


def earliest_before(cases: DataFrame, confirmations: DataFrame, keys: list[str], date: str, signal: str, where: Column) -> DataFrame:
    """(first key, signal, earliest): the first qualifying case of a confirmation's keys (group and code) before it, however long."""
    led = cases.where(where).join(confirmations, keys).where(F.col(date) < F.col("confirmed"))
    return led.groupBy(keys[0]).agg(F.min(date).alias("earliest")).select(keys[0], F.lit(signal).alias("signal"), "earliest")


def index_positives(labels: DataFrame, indices: DataFrame) -> DataFrame:
    """Positives of index groups on other days than the index day: index_id, event_id, lead (days after it), is_post.

    labels: event_id, group_id, date, label; indices: index_id, group_id, index_date.  What lies before the index
    could not be caught.
    """
    at = labels.where("label = 1").join(indices.select("index_id", "group_id", "index_date"), "group_id").where("date <> index_date")
    lead = F.datediff("date", "index_date")
    return at.select("index_id", "event_id", lead.alias("lead"), (lead > 0).alias("is_post"))


def traced_curve(contacts: DataFrame, positives: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold: flagged contacts whose next event is a positive after the index (tp) or not (fp), positives not flagged (fn), rates and lead.

    contacts: index_id, next_id, risk.  Positives count for indices that have contacts.  All thresholds come from
    one pass over the contacts and one over the positives.
    """
    post = positives.where("is_post").select("index_id", F.col("event_id").alias("next_id"), "lead")
    marked = contacts.join(post, ["index_id", "next_id"], "left")
    hit, risk = F.col("lead").isNotNull(), F.col("risk")
    sums = marked.agg(*[c.alias(f"{name}{i}") for i, t in enumerate(thresholds) for name, c in (("tp", F.count_if(hit & (risk >= t))), ("fp", F.count_if(~hit & (risk >= t))), ("lead", F.avg(F.when(risk >= t, F.col("lead")))))])
    best = contacts.groupBy("index_id", "next_id").agg(F.max("risk").alias("risk"))
    known = post.join(contacts.select("index_id").distinct(), "index_id", "left_semi").distinct()
    caught = known.join(best, ["index_id", "next_id"], "left").agg(*[(F.count("*") - F.count_if(risk >= t)).alias(f"fn{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn"), F.col(f"lead{i}").alias("mean_lead")) for i, t in enumerate(thresholds)])
    found = sums.crossJoin(caught).select(F.inline(rows))  # one row each
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    found = found.withColumns({"flagged": tp + fp, "sensitivity": tp / F.greatest(tp + fn, F.lit(1)), "precision": tp / F.greatest(tp + fp, F.lit(1))})
    return found.withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("sensitivity"), F.col("precision") + F.col("sensitivity")))


def traced_by_index(contacts: DataFrame, positives: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Each index with its contacts by tier, those flagged, and its positives after (and caught) and before it."""
    flagged = F.col("risk") >= threshold
    tiers = contacts.groupBy("index_id").agg(F.count("*").alias("n_contacts"), F.count_if(flagged).alias("n_flagged"), *[F.count_if(F.col("tier") == t).alias(f"tier{t}") for t in (1, 2, 3)])
    sides = positives.groupBy("index_id").agg(F.count_if("is_post").alias("n_post"), F.count_if(~F.col("is_post")).alias("n_pre"))
    caught = contacts.where(flagged).select("index_id", F.col("next_id").alias("event_id")).distinct().join(positives.where("is_post"), ["index_id", "event_id"], "left_semi").groupBy("index_id").agg(F.count("*").alias("n_caught"))
    return tiers.join(sides, "index_id", "left").join(caught, "index_id", "left").fillna(0, ["n_post", "n_pre", "n_caught"])


def contacts_by_stratum(contacts: DataFrame, strata: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, stratum, n_indices, n_contacts) of indices in each stratum; strata: index_id and a column for each dimension."""
    long = strata.select("index_id", F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("stratum")) for d in dimensions])))
    counts = contacts.groupBy("index_id").agg(F.count("*").alias("k"))
    return long.join(counts, "index_id").groupBy("dimension", "stratum").agg(F.count("*").alias("n_indices"), F.sum("k").alias("n_contacts"))
