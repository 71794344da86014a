"""Access, consent and routing policy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.functions.numbers import code_sum_bucket


def allowed(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Requests (role, resource) with allowed true where a rule (role, resource) says so."""
    marks = rules.select("role", "resource").distinct().withColumn("allowed", F.lit(True))
    return requests.join(marks, ["role", "resource"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def panel(rows: DataFrame, assignments: DataFrame, provider: str, kind: str | None, member: str = "ref", sees_rows: bool = True) -> DataFrame:
    """Rows of members on a provider's panel, of one kind; a role without row access sees none."""
    if not sees_rows:
        return rows.limit(0)
    own = assignments.where(F.col("provider_id") == provider).select(member)
    found = rows.join(own, member, "left_semi")
    return found.where(F.col("kind") == kind) if kind else found


def co_members(members: DataFrame, assignments: DataFrame) -> DataFrame:
    """For each member: co-members of its kind on its provider's panel, and how many others there are.

    Both come from sums, not from pairs; refs are unique.  A member alone in its group has no row.
    """
    at = members.join(assignments, "ref").select("group_id", "ref", "kind", "provider_id")
    panels = at.groupBy("group_id", "kind", "provider_id").agg(F.count("*").alias("_same"))
    groups = panels.groupBy("group_id").agg(F.sum("_same").alias("_all"))
    sums = panels.join(groups, "group_id").where("_all > 1")
    found = at.join(sums, ["group_id", "kind", "provider_id"])
    return found.select("ref", (F.col("_same") - 1).alias("n_visible"), (F.col("_all") - F.col("_same")).alias("n_hidden"))


def consented(rows: DataFrame, consents: DataFrame, group: str = "group_id") -> DataFrame:
    """Rows of groups that have not declined; a group without a consent row stays."""
    return rows.join(consents.where("status = 'inactive' OR decision = 'deny'").select(group).distinct(), group, "left_anti")


def pointers(signals: DataFrame, consents: DataFrame, disease_class: Column, group: str = "group_id") -> DataFrame:
    """What another provider may see of a signal: that there is one, the other kind, the class of code; nothing if declined."""
    return consented(signals, consents, group).select(group, F.lit(True).alias("has_signal"), F.col("kind").alias("other_kind"), disease_class.alias("code_class")).distinct()


def consent_rule(groups: DataFrame, declined: list[str], group: str = "group_id") -> DataFrame:
    """decision and its basis by rule: declined list, nothing to share, else granted."""
    basis = F.when(F.col(group).isin(declined), "declined").when(F.col("n_other_kind") == 0, "nothing_to_share").otherwise("granted")
    return groups.withColumn("decision_basis", basis).withColumn("decision", F.when(F.col("decision_basis") == "declined", "deny").otherwise("permit"))


def consent_summary(consents: DataFrame) -> DataFrame:
    n, no = F.count("*"), F.count_if(F.col("decision") == "deny")
    return consents.agg(n.alias("n"), no.alias("n_declined"), F.bround(no / F.greatest(n, F.lit(1)), 4).alias("decline_rate"))


def visible_alerts(alerts: DataFrame, role: str, hidden: dict[str, list[str]]) -> DataFrame:
    """Alerts without the kinds hidden from a role."""
    return alerts.where(~F.col("kind").isin(hidden[role])) if hidden.get(role) else alerts


def provider_for(rows: DataFrame, region: Column, key: Column, regions: dict[str, list[str]], default: str) -> DataFrame:
    """The region's provider; regions with several deal their members by a sum of character codes."""
    out = F.lit(default)
    for name, providers in regions.items():
        pick = F.lit(providers[0]) if len(providers) == 1 else F.element_at(F.array(*map(F.lit, providers)), code_sum_bucket(key, len(providers)) + 1)
        out = F.when(region == name, pick).otherwise(out)
    return rows.withColumn("provider_id", out)


def panels(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("provider_id").agg(F.sort_array(F.collect_list("ref")).alias("refs"), F.count("*").alias("n"))


def destinations(rules: list[tuple[str, Column]]) -> Column:
    """The destinations whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))


def staff(rows: DataFrame, role: str, place: str) -> DataFrame:
    return rows.where((F.col("role") == role) & (F.col("facility") == place))


def masked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with columns emptied."""
    return reduce(lambda df, c: df.withColumn(c, F.lit(None).cast(dict(df.dtypes)[c])), columns, rows)
