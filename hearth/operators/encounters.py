"""The 51 features of an encounter, from tables of encounters, members, regions, conditions and two series, as one plan.

encounters: event_id, group_id, ref, kind, start (ISO text), vitals (struct), complaint
members: ref, group_id, kind, birth, gender, species     regions: group_id, population, eqi, endemic, name, lat, lon
conditions: group_id, ref, code, onset     disease: group_id, year, month, n     vectors: group_id, period, value
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.functions.dates import age_years, day_number, iso_date, season_flags
from hearth.functions.strings import contains_any, split_pair
from hearth.operators import features

# Keyword bags, species groups and thresholds whose features must agree with other systems.
COMPLAINTS = {
    "respiratory": ["cough", "shortness", "dyspnea", "pneumonia", "respiratory", "sob"],
    "fever": ["fever", "febrile", "temp", "pyrexia"],
    "neuro": ["headache", "confusion", "encephal", "altered mental", "neuro", "seizure"],
    "gi": ["diarrhea", "vomit", "nausea", "gastro", "abdominal"],
    "rash_skin": ["rash", "petechiae", "lesion", "skin", "bite", "wound"],
    "musculo": ["myalgia", "arthralgia", "muscle", "joint"],
    "fatigue": ["fatigue", "lethargy", "malaise", "weakness"],
    "exposure": ["exposure", "contact", "bitten", "scratched", "soil", "dust", "tick", "rodent"],
    "zoo_specific": ["valley fever", "cocci", "ehrlich", "rmsf", "lepto", "hantavirus", "plague", "west nile", "rabies", "q fever", "psittacosis", "tularemia", "salmonell"],
}
SPECIES = {
    "dog": ["dog"],
    "cat": ["cat"],
    "livestock": ["cow", "goat", "sheep", "chicken", "horse"],
    "bird": ["parrot", "chicken", "bird"],
    "reptile": ["reptile", "lizard", "snake", "turtle", "bearded_dragon"],
}
RURAL_BELOW, TRIBAL = 100_000, ["Apache", "Navajo"]
FEVER_ABOVE, HR_ABOVE, RR_ABOVE, SPO2_BELOW = 100.4, 100, 20, 94


def vital_columns(v: str = "vitals") -> dict[str, Column]:
    """Seven measurements, null if missing, and four flags that count a missing one as normal."""
    systolic, diastolic = split_pair(F.regexp_replace(F.col(f"{v}.bp"), r"\s", ""))
    plain = {name: F.col(f"{v}.{source}").cast("double") for name, source in (("v_temp_f", "temp_f"), ("v_hr", "hr"), ("v_rr", "rr"), ("v_spo2", "spo2"))}
    spo2 = F.col(f"{v}.spo2")
    flags = {"v_fever": F.col(f"{v}.temp_f") > FEVER_ABOVE, "v_tachy": F.col(f"{v}.hr") > HR_ABOVE, "v_tachypnea": F.col(f"{v}.rr") > RR_ABOVE, "v_hypoxia": (spo2 > 0) & (spo2 < SPO2_BELOW)}
    made = {name: F.coalesce(hit, F.lit(False)).cast("int") for name, hit in flags.items()}
    return plain | {"v_bp_sys": systolic.cast("double"), "v_bp_dia": diastolic.cast("double"), "v_glucose": F.col(f"{v}.glucose").cast("double")} | made


def group_columns(members: DataFrame, person: str = "Person") -> DataFrame:
    """Seven columns of each group: persons, animals, and which animals there are."""
    kinds = {f"hh_has_{name}": F.coalesce(F.max(F.col("species").isin(codes).cast("int")), F.lit(0)) for name, codes in SPECIES.items()}
    return members.groupBy("group_id").agg(F.count_if(F.col("kind") == person).alias("hh_n_humans"), F.count_if(F.col("kind") != person).alias("hh_n_animals"), *[c.alias(n) for n, c in kinds.items()])


def region_columns(regions: DataFrame) -> DataFrame:
    """Eight columns of each group's region; what is missing counts as zero, an unknown level as low."""
    people = F.coalesce(F.col("population").cast("double"), F.lit(0.0))
    level = F.coalesce("endemic", F.lit("low"))
    return regions.select(
        "group_id", people.alias("co_population"), F.coalesce(F.col("eqi").cast("double"), F.lit(0.0)).alias("co_epa_eqi"), (level == "high").cast("int").alias("co_cocci_high"), (level == "medium").cast("int").alias("co_cocci_med"),
        (people < RURAL_BELOW).cast("int").alias("co_is_rural"), F.coalesce(F.col("name").isin(TRIBAL), F.lit(False)).cast("int").alias("co_is_tribal"), F.coalesce(F.col("lat").cast("double"), F.lit(0.0)).alias("co_lat"), F.coalesce(F.col("lon").cast("double"), F.lit(0.0)).alias("co_lon"),
    )


def activity_columns(encounters: DataFrame) -> DataFrame:
    """event_id with its group's encounters in the 30 and 90 days before its day, and their distinct members and complaints.

    Days are summed first; distinct values are counted from the days on which a
    value was last seen, so that no window gathers a group's rows.
    """
    e = encounters.select("event_id", "group_id", "ref", F.substring(F.lower(F.coalesce("complaint", F.lit(""))), 1, 40).alias("cc"), day_number(iso_date(F.col("start"))).alias("day"))
    counts = e.groupBy("group_id", "day").agg(F.count("*").alias("n"))
    w = Window.partitionBy("group_id").orderBy("day")
    out = counts.select("group_id", "day", *[F.coalesce(F.sum("n").over(w.rangeBetween(-days, -1)), F.lit(0)).alias(f"hh_enc_{days}d") for days in (30, 90)])
    for name, value in (("subjects", "ref"), ("cc", "cc")):
        # a value seen on day a covers the days a+1 .. a+90, or up to the day before it is seen again: each day counts it once
        seen = e.select("group_id", F.col(value).alias("v"), "day").distinct()
        upto = F.least(F.col("day") + 90, F.coalesce(F.lead("day").over(Window.partitionBy("group_id", "v").orderBy("day")), F.col("day") + 90))
        spans = seen.withColumn("upto", upto)
        steps = spans.select("group_id", (F.col("day") + 1).alias("day"), F.lit(1).alias("d")).unionByName(spans.select("group_id", (F.col("upto") + 1).alias("day"), F.lit(-1).alias("d")))
        asked = counts.select("group_id", "day", F.lit(0).alias("d"), F.lit(True).alias("ask"))
        both = steps.groupBy("group_id", "day").agg(F.sum("d").alias("d")).select("group_id", "day", "d", F.lit(False).alias("ask")).unionByName(asked)
        running = both.withColumn("k", F.sum("d").over(w.rangeBetween(Window.unboundedPreceding, 0))).where("ask").select("group_id", "day", F.col("k").alias(f"hh_distinct_{name}_90d"))
        out = out.join(running, ["group_id", "day"])
    return e.select("event_id", "group_id", "day").join(out, ["group_id", "day"]).drop("group_id", "day")


def series_columns(disease: DataFrame, vectors: DataFrame, recent_year: int, since_year: int, vector_z: float = 3.0) -> DataFrame:
    """Three columns of each group: z of the largest count, whether the vector series has risen, recent cases."""
    recent = disease.groupBy("group_id").agg(F.sum(F.when(F.col("year") >= recent_year, F.col("n")).otherwise(0)).cast("double").alias("surv_recent_cases"))
    tops = features.region_anomaly(disease, "group_id", "n", F.col("year") >= since_year).select("group_id", F.col("z").alias("surv_z_score"))
    rn = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("period")))
    last = vectors.withColumn("rn", rn).groupBy("group_id").agg(F.count("*").alias("k"), F.avg("value").alias("mean"), F.coalesce(F.nullif(F.stddev_pop("value"), F.lit(0.0)), F.lit(1.0)).alias("sd"), F.avg(F.when(F.col("rn") <= 4, F.col("value"))).alias("last"))
    risen = last.select("group_id", ((F.col("k") >= 4) & ((F.col("last") - F.col("mean")) / F.col("sd") > vector_z)).cast("int").alias("surv_vector_anomaly"))
    return recent.join(tops, "group_id", "full").join(risen, "group_id", "full")


def matrix(encounters: DataFrame, members: DataFrame, regions: DataFrame, conditions: DataFrame, disease: DataFrame, vectors: DataFrame, recent_year: int, since_year: int, vector_z: float = 3.0, person: str = "Person") -> DataFrame:
    """event_id, group_id, ref, start and 51 features; encounters of unknown groups are left out."""
    day = iso_date(F.col("start"))
    who = members.select("ref", iso_date(F.col("birth")).alias("_birth"), F.col("gender").alias("_gender"))
    rows = encounters.join(who, "ref", "left").withColumns({
        "is_animal": (F.col("kind") != person).cast("int"), "age_years": age_years(F.col("_birth"), day), "sex_female": F.coalesce(F.lower("_gender").startswith("f"), F.lit(False)).cast("int"),
        **vital_columns(), **{f"cc_{name}": contains_any(F.col("complaint"), words).cast("int") for name, words in COMPLAINTS.items()}, **season_flags(day),
    }).drop("_birth", "_gender", "kind", "vitals", "complaint")
    asks = encounters.select("event_id", "group_id", "ref", day.alias("date"))
    others = features.others_recent(asks, conditions.withColumnRenamed("onset", "date"), 90).select("event_id", (F.col("n_other_cases") > 0).cast("int").alias("hh_other_species_cond_90d"), F.col("n_other_codes").alias("hh_distinct_codes_90d"))
    known = rows.join(group_columns(members, person), "group_id").join(region_columns(regions), "group_id", "left")
    return features.assembled(known, [(activity_columns(encounters), "event_id"), (others, "event_id"), (series_columns(disease, vectors, recent_year, since_year, vector_z), "group_id")])
