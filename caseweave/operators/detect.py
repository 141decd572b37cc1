"""Pattern detectors over contact, transfer and presence edges. Findings are leads for human review, never verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseweave.plans.blocks import dealt, pairs_carrying
from caseweave.plans.scratch import Scratch


def contacts_by_case(edges: DataFrame) -> DataFrame:
    """Contacts per unordered pair and case: (a, b, case_id, n, weight, weights, first_ts, last_ts), weights being how many are summed. Self contacts and null ends are left out."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "case_id", "ts", "weight")
    return dealt(e, "a", "b").groupBy("a", "b", "case_id").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.count("weight").alias("weights"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def pair_counts(edges: DataFrame) -> DataFrame:
    """Contacts per unordered pair: (a, b, n, cases, avg_weight, first_ts, last_ts). Self contacts and null ends are left out."""
    return pairs_of_cases(contacts_by_case(edges))


def pairs_of_cases(by_case: DataFrame) -> DataFrame:
    """``pair_counts`` of contacts that are counted by case."""
    mean = F.try_divide(F.sum("weight"), F.sum("weights")).alias("avg_weight")
    return by_case.groupBy("a", "b").agg(F.sum("n").alias("n"), F.count("case_id").alias("cases"), mean, F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def contact_bursts(edges: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs with at least ``threshold`` contacts; severity high from 3 times, medium from 2 times the threshold, else low."""
    severity = F.when(F.col("n") >= 3 * threshold, "high").when(F.col("n") >= 2 * threshold, "medium").otherwise("low")
    return pair_counts(edges).where(F.col("n") >= threshold).withColumn("severity", severity)


def circular_flows(edges: DataFrame) -> DataFrame:
    """Directed 3-cycles of distinct nodes, one row each with the smallest node first: (a, b, c, cases, severity)."""
    e = edges.where("src <> dst").groupBy("src", "dst").agg(F.collect_set("case_id").alias("cs"))
    ab = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("cs").alias("c1")).where("a < b")
    bc = e.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("cs").alias("c2"))
    ca = e.select(F.col("src").alias("c"), F.col("dst").alias("a"), F.col("cs").alias("c3"))
    found = ab.join(bc, "b").where("c > a").join(ca, ["c", "a"])
    found = found.withColumn("cases", F.size(F.array_distinct(F.concat("c1", "c2", "c3"))))
    return found.select("a", "b", "c", "cases", F.when(F.col("cases") > 1, "high").otherwise("medium").alias("severity"))


def long_circular_flows(edges: DataFrame, length: int = 4) -> DataFrame:
    """Directed cycles over ``length`` distinct nodes (three intermediaries for 4), one row each with the smallest node first: (path array, cases).

    Grows paths of distinct nodes by one join a step, only over nodes above the first; parallel transfers are one edge. Paths carry no cases: those of a cycle's edges are looked up once it is closed.
    """
    e = edges.where("src <> dst").select("src", "dst").distinct()
    found = e.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("src").alias("first"), F.col("dst").alias("last"))
    step = e.select(F.col("src").alias("last"), F.col("dst").alias("next"))
    for _ in range(length - 2):
        found = found.join(step.hint("shuffle_merge"), "last").where((F.col("next") > F.col("first")) & ~F.array_contains("path", F.col("next")))
        found = found.select(F.concat("path", F.array("next")).alias("path"), "first", F.col("next").alias("last"))
    closed = found.join(step.withColumnRenamed("next", "first").hint("shuffle_merge"), ["last", "first"], "left_semi").select("path")
    closed = Scratch(edges.sparkSession).write(closed)
    ends = F.transform("path", lambda x, i: F.struct(x.alias("src"), F.coalesce(F.get("path", i + 1), F.element_at("path", 1)).alias("dst")))
    cases = edges.select("src", "dst", "case_id").distinct()
    with_cases = closed.select("path", F.explode(ends).alias("x")).select("path", "x.*").join(cases.hint("shuffle_merge"), ["src", "dst"])
    return with_cases.groupBy("path").agg(F.count_distinct("case_id").cast("int").alias("cases"))


def repeated_transfers(edges: DataFrame, low: float = 30000.0, high: float = 50000.0) -> DataFrame:
    """Ordered pairs with two or more transfers; structuring when two or more amounts lie in [low, high)."""
    near = (F.col("amount") >= low) & (F.col("amount") < high)
    out = edges.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.count_if(near).alias("near_limit"))
    return out.where("n >= 2").withColumn("structuring", F.col("near_limit") >= 2)


def directional_funding(transfers: DataFrame, contacts: DataFrame, min_contacts: int = 2) -> DataFrame:
    """Pairs with a transfer, ``min_contacts`` contacts and a common case."""

    def by_pair(e: DataFrame, n: str, cases: str) -> DataFrame:
        p = e.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "case_id")
        return p.groupBy("a", "b").agg(F.count("*").alias(n), F.collect_set("case_id").alias(cases))

    met = by_pair(transfers, "transfers", "ct").join(by_pair(contacts, "contacts", "cc").where(F.col("contacts") >= min_contacts), ["a", "b"])
    return met.where(F.arrays_overlap("ct", "cc")).select("a", "b", "transfers", "contacts", F.size(F.array_intersect("ct", "cc")).alias("common_cases"))


def cross_case_names(entities: DataFrame) -> DataFrame:
    """Names of a type in more than one case: (entity_type, name, cases, severity); vehicles medium, others high."""
    out = entities.groupBy("entity_type", "name").agg(F.count_distinct("case_id").alias("cases")).where("cases > 1")
    return out.withColumn("severity", F.when(F.col("entity_type") == "Vehicle", "medium").otherwise("high"))


def co_locations(presence: DataFrame, explained: DataFrame, min_joint: int = 1) -> DataFrame:
    """Pairs of persons at one location without an edge of ``explained`` (a, b) between them: (p1, p2, location, joint).

    ``presence``: (person, location, slot); a joint presence is a common slot. Presences are made distinct first, so a busy place counts each person once a slot.
    A person brings all slots at the location and the explained partners to where pairs meet, and a pair counts in its first common slot, so pairs are neither shuffled nor grouped.
    """
    there = presence.where("person IS NOT NULL AND location IS NOT NULL AND slot IS NOT NULL").groupBy("location", "person").agg(F.array_sort(F.collect_set("slot")).alias("slots"))
    there = there.select("location", F.explode("slots").alias("slot"), "person", "slots")
    known = explained.select(F.least("a", "b").alias("person"), F.greatest("a", "b").alias("partner")).distinct()
    places = there.select("location", "slot", "person")
    beside = places.join(known.hint("shuffle_merge"), "person").join(places.withColumnRenamed("person", "partner").hint("shuffle_merge"), ["location", "slot", "partner"], "left_semi")
    beside = beside.groupBy("location", "slot", "person").agg(F.collect_list("partner").alias("partners"))
    met = pairs_carrying(there.join(beside.hint("shuffle_merge"), ["location", "slot", "person"], "left"), ["location", "slot"], "person", ["slots", "partners"])
    one = (F.size("slots_a") == 1) | (F.size("slots_b") == 1)
    common = F.array_intersect("slots_a", "slots_b")
    met = met.where(F.col("partners_a").isNull() | ~F.array_contains("partners_a", F.col("b"))).where(one | (F.element_at(common, 1) == F.col("slot")))
    out = met.select(F.col("a").alias("p1"), F.col("b").alias("p2"), "location", F.when(one, 1).otherwise(F.size(common)).cast("long").alias("joint")).where(F.col("joint") >= min_joint)
    return out.withColumn("severity", F.when(F.col("joint") >= 3, "high").when(F.col("joint") == 2, "medium").otherwise("low"))


def short_lived_numbers(contacts: DataFrame, max_days: int = 7) -> DataFrame:
    """Numbers (number, first_ts, last_ts, n, days, severity): medium when active for ``max_days`` days or less, else low."""
    ends = contacts.select(F.col("src").alias("number"), "ts").unionByName(contacts.select(F.col("dst").alias("number"), "ts")).where("number IS NOT NULL")
    out = ends.groupBy("number").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    days = F.floor((F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts")) / 86400)
    return out.withColumn("days", days).withColumn("severity", F.when(days <= max_days, "medium").otherwise("low"))


#: Keyword and event label, in order of inspection.
EVENT_KEYWORDS = (
    ("arrest", "arrest"), ("seizure", "seizure"), ("recovered", "recovery"), ("killed", "homicide"), ("murder", "murder"), ("shooting", "shooting"),
    ("attack", "attack"), ("robbery", "robbery"), ("extortion", "extortion"), ("raided", "raid"), ("intercepted", "interception"), ("incident", "incident"),
)


def rolling_bursts(contacts: DataFrame, hours: int = 24, minimum: int = 10) -> DataFrame:
    """Pairs whose contacts reach ``minimum`` within ``hours`` hours: (a, b, peak, first_ts)."""
    c = contacts.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "ts")
    w = Window.partitionBy("a", "b").orderBy("us").rangeBetween(-hours * 3_600_000_000, 0)
    return c.withColumn("n", F.count("*").over(w)).groupBy("a", "b").agg(F.max("n").alias("peak"), F.min("ts").alias("first_ts")).where(F.col("peak") >= minimum)


def as_alerts(found: DataFrame, alert_type: str, entities: list[str], severity: str = "severity") -> DataFrame:
    """Findings in the alert schema with a deterministic key; ``human_review_required`` always holds."""
    ids = F.array(*[F.col(c).cast("string") for c in entities])
    return found.select(
        F.sha2(F.concat_ws("|", F.lit(alert_type), *[F.col(c).cast("string") for c in entities]), 256).alias("alert_key"), F.lit(alert_type).alias("alert_type"),
        F.concat_ws(" - ", *[F.col(c).cast("string") for c in entities]).alias("title"), F.col(severity).alias("severity"), ids.alias("entity_ids"), F.lit("active").alias("status"), F.lit(True).alias("human_review_required"),
    )


def new_alerts(alerts: DataFrame, existing: DataFrame) -> DataFrame:
    """One alert per (alert_type, title) that ``existing`` doesn't have."""
    return alerts.dropDuplicates(["alert_type", "title"]).join(existing.select("alert_type", "title"), ["alert_type", "title"], "left_anti")


def run_all(detectors: dict[str, DataFrame], rules: DataFrame) -> DataFrame:
    """Union of the alerts of the enabled rules; a detector without a rule is on. The few rules are sent to the alerts, which are not shuffled for them."""
    out = None
    for df in detectors.values():
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    off = rules.where(~F.col("is_enabled")).select(F.col("rule_type").alias("alert_type"))
    return out.join(F.broadcast(off), "alert_type", "left_anti")
