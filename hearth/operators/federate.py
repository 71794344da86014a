"""Federation: overlapping sites, local models, weighted averaging, per-site stores, manifests, fan-out."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.session import stored


def in_sites(rows: DataFrame, selectors: dict[str, Column]) -> DataFrame:
    """Each row once for every site whose selector holds (sites may overlap)."""
    names = F.array_compact(F.array(*[F.when(cond, F.lit(site)) for site, cond in selectors.items()]))
    return rows.withColumn("site_id", F.explode(names))


def weighted_mean(vectors: DataFrame, weight: str, vector: str, keys: list[str] = ()) -> DataFrame:
    """The mean of vectors by position, weighted; partial sums are combined before the shuffle."""
    long = vectors.select(*keys, F.col(weight).alias("_w"), F.posexplode(vector).alias("position", "_v"))
    return long.groupBy(*keys, "position").agg((F.sum(F.col("_w") * F.col("_v").cast("double")) / F.sum("_w")).alias("value"))


def smoothed(old: np.ndarray, new: np.ndarray, rate: float = 0.5) -> np.ndarray:
    return old + rate * (new - old)


def held_out(rows: DataFrame, key: str, percent: int = 25, seed: str = "") -> DataFrame:
    """A column that marks about so many per cent of keys, the same on every run."""
    return rows.withColumn("held_out", F.pmod(F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("long"), F.lit(100)) < percent)


#: How many rows one stands for.
TIMES = "_times"


def site_gradients(rows: DataFrame, features: list[str], label: str, weights: np.ndarray, site: str = "site_id", own: dict[str, np.ndarray] | None = None, times: str | None = None) -> DataFrame:
    """(site, n, n_pos, gradient): each site's logistic gradient, as sums over its rows.

    Sums are combined before the shuffle, so that no site's rows are gathered in
    one place; sites of one class are left out by the caller.
    own: weights of sites that are not at the shared ones; times: how many rows one stands for.
    """
    name, n = F.col(site).cast("string"), F.col(times) if times else F.lit(1)
    x = [F.lit(1.0), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]]
    y = F.col(label).cast("double")

    def at(i: int) -> Column:
        return reduce(lambda acc, kv: F.when(name == kv[0], float(kv[1][i])).otherwise(acc), (own or {}).items(), F.lit(float(weights[i])))

    score = reduce(lambda a, b: a + b, [v * at(i) for i, v in enumerate(x)])
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score))))
    miss = rows.select(name.alias(site), n.alias("_n"), y.alias("_y"), (p - y).alias("_miss"), *[v.alias(f"_x{i}") for i, v in enumerate(x)])
    return miss.groupBy(site).agg(F.sum("_n").cast("long").alias("n"), F.sum(F.col("_n") * F.col("_y")).cast("long").alias("n_pos"), F.array(*[F.sum(F.col("_n") * F.col("_miss") * F.col(f"_x{i}")) for i in range(len(x))]).alias("gradient"))


def federated_fit(rows: DataFrame, features: list[str], label: str, rounds: int = 10, local_steps: int = 5, rate: float = 0.5, learning_rate: float = 1.0, site: str = "site_id") -> tuple[np.ndarray, list[dict]]:
    """A logistic model by federated averaging with warm starts.

    Every round each site takes `local_steps` gradient steps from the shared weights, and the
    sites' weights are averaged by their rows and mixed in at `rate`.  Only a
    vector of each site reaches the driver; sites with one class do not take part.
    Rows are stored once, equal ones as one with their number, as every step passes
    over all of them.
    """
    ready = rows.select(F.col(site).cast("string").alias(site), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features], F.col(label).cast("double").alias(label))
    distinct = stored(ready.groupBy(site, *features, label).agg(F.count("*").alias(TIMES)), "sites")
    shared = np.zeros(len(features) + 1)
    history = []
    for number in range(rounds):
        local: dict[str, np.ndarray] = {}
        weight: dict[str, int] = {}
        for _ in range(local_steps):
            for r in site_gradients(distinct, features, label, shared, site, local, TIMES).collect():
                if 0 < r.n_pos < r.n:
                    local[r[site]] = local.get(r[site], shared) - learning_rate * np.array(r.gradient) / r.n
                    weight[r[site]] = r.n
        if not local:
            break
        total = sum(weight.values())
        mean = sum(weight[s] * w for s, w in local.items()) / total
        shared = smoothed(shared, mean, rate)
        history.append({"round": number + 1, "sites": len(local), "rows": total, "norm": float(np.linalg.norm(shared))})
    return shared, history


def local_fits(rows: DataFrame, features: list[str], label: str, site: str = "site_id", steps: int = 12, penalty: float = 1.0) -> dict[str, tuple[int, np.ndarray]]:
    """{site: (rows, weights)}: a logistic model of each site by Newton's method, classes balanced, with a ridge on all but the intercept.

    Every step sums each site's gradient and curvature by Arrow batch inside the
    tasks; only a matrix of features x features for each site reaches the driver.
    Sites with one class have no model.
    """
    d = len(features) + 1
    shape = f"{site} string, i int, v double"
    columns = [F.col(site).cast("string").alias(site), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features], F.col(label).cast("double").alias(label)]
    ready = rows.select(*columns)
    sizes = {r[site]: (r.n, r.p) for r in ready.groupBy(site).agg(F.count("*").alias("n"), F.sum(label).alias("p")).collect() if 0 < r.p < r.n}
    weights = {s: np.zeros(d) for s in sizes}
    for _ in range(steps):
        known = dict(weights)

        def run(frames, known=known):
            for frame in frames:
                for name, part in frame.groupby(site):
                    if name not in known:
                        continue
                    n, positive = sizes[name]
                    x, y = np.column_stack([np.ones(len(part)), part[features].to_numpy(float)]), part[label].to_numpy(float)
                    share = np.where(y > 0, n / (2 * positive), n / (2 * (n - positive)))
                    p = 1 / (1 + np.exp(-np.clip(x @ known[name], -30, 30)))
                    sums = np.concatenate([x.T @ (share * (p - y)), ((x * (share * p * (1 - p))[:, None]).T @ x).ravel()])
                    yield pd.DataFrame({site: name, "i": np.arange(len(sums), dtype=np.int32), "v": sums})

        sums = {s: np.zeros(d + d * d) for s in weights}
        for r in ready.mapInPandas(run, shape).groupBy(site, "i").agg(F.sum("v").alias("v")).collect():
            sums[r[site]][r.i] = r.v
        ridge = penalty * np.diag([0.0, *[1.0] * (d - 1)])
        for s, v in sums.items():
            weights[s] = weights[s] - np.linalg.solve(v[d:].reshape(d, d) + ridge, v[:d] + ridge @ weights[s])
    return {s: (sizes[s][0], w) for s, w in weights.items()}


def averaged(local: dict[str, tuple[int, np.ndarray]], rounds: int = 10, rate: float = 0.5) -> np.ndarray:
    """The shared weights after rounds of averaging by rows, each mixed in at `rate`; sites refit from the same rows every round."""
    mean = sum(n * w for n, w in local.values()) / sum(n for n, _ in local.values())
    shared = np.zeros_like(mean)
    for _ in range(rounds):
        shared = smoothed(shared, mean, rate)
    return shared


def site_scores(test: DataFrame, features: list[str], label: str, local: dict[str, tuple[int, np.ndarray]], shared: np.ndarray, site: str = "site_id") -> DataFrame:
    """(model, site, y, p) of held-out rows under their site's own model and under the shared one."""
    parts = [predicted(test, features, shared).select(F.lit("federated").alias("model"), F.col(site).alias("site"), F.col(label).cast("int").alias("y"), "p")]
    for s, (_, w) in sorted(local.items()):
        parts.append(predicted(test.where(F.col(site) == s), features, w).select(F.lit("local").alias("model"), F.col(site).alias("site"), F.col(label).cast("int").alias("y"), "p"))
    return reduce(DataFrame.unionByName, parts)


def predicted(rows: DataFrame, features: list[str], weights: np.ndarray) -> DataFrame:
    terms = [F.lit(float(weights[0])), *[F.lit(float(w)) * F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f, w in zip(features, weights[1:])]]
    return rows.withColumn("p", 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms))))


def routed_sites(rows: DataFrame, assignments: DataFrame, providers: DataFrame, key: str, fallback: str | None = None) -> DataFrame:
    """Rows with the site of their provider, or the fallback; without either they go."""
    joined = rows.join(assignments, key, "left").join(providers, "provider_id", "left")
    return joined.withColumn("site_id", F.coalesce("site_id", F.lit(fallback))).where("site_id IS NOT NULL")


def with_provenance(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows with a provenance struct from the site table."""
    others = [c for c in sites.columns if c != "site_id"]
    return rows.join(sites.select("site_id", F.struct(*others).alias("provenance")), "site_id", "left")


def manifest(rows: DataFrame, member: str, group: str) -> tuple[DataFrame, DataFrame]:
    """The member index and the group index (participating sites, counts)."""
    members = rows.select(member, "site_id", "provider_id").distinct() if "provider_id" in rows.columns else rows.select(member, "site_id").distinct()
    groups = rows.groupBy(group).agg(F.sort_array(F.collect_set("site_id")).alias("participating_sites"), F.count_distinct(member).alias("n_members"))
    return members, groups


def fetch(store: DataFrame, site: str, filters: dict[str, object], at: str) -> tuple[DataFrame, DataFrame]:
    """Rows of one site (its partition alone is read) under exact filters, and a log row of the request."""
    found = store.where(F.col("site_id") == site)
    for c, v in filters.items():
        found = found.where(F.col(c) == v)
    log = found.agg(F.count("*").alias("n_results")).select(F.lit(at).alias("ts"), F.lit(site).alias("target"), F.lit(str(sorted(filters.items()))).alias("query"), F.when(F.col("n_results") > 0, 200).otherwise(404).alias("status"), "n_results")
    return found, log


def fan_out(asked: DataFrame, groups: DataFrame, store: DataFrame, group: str) -> DataFrame:
    """Each asked group's rows from all sites that hold it."""
    at = asked.join(groups, group).select(group, F.explode("participating_sites").alias("site_id"))
    return store.join(at, [group, "site_id"], "left_semi")


def counters(store: DataFrame, kind: str) -> DataFrame:
    return store.groupBy("site_id").agg(F.count("*").alias("n_rows"), F.count_distinct(kind).alias("n_kinds"))
