"""Findings set against documented events: range joins over time, correlated bursts and burner numbers, and detectors that run apart from each other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseweave.operators.detect import EVENT_KEYWORDS, contacts_by_case, pairs_of_cases
from caseweave.operators.text import event_check
from caseweave.plans.blocks import dealt
from caseweave.plans.scratch import Scratch

#: Seconds of the smallest bin; events of one bin and case are compared by their exact times.
BIN_SECONDS = 60
#: Times of events up to which a case's windows meet them one by one, which is less than the blocks of a window.
FEW_TIMES = 32
#: Classes of confidence.
CONFIRMED, UNUSUAL, UNEXPLAINED = "confirmed", "statistically_unusual", "unexplained"


def document_events(docs: DataFrame) -> DataFrame:
    """(case_id, event_id, ts, keyword, label) of documents (doc_id, case_id, ts, text) that state an event: the first keyword, in fixed order, whose first mention nothing denies.

    Documents without a confirmed keyword, text or time give none.
    """
    docs = docs.where("text IS NOT NULL AND ts IS NOT NULL").select("case_id", F.col("doc_id").alias("event_id"), "ts", F.lower("text").alias("low"))  # once a text, not once a keyword
    low = F.col("low")
    hits = [F.when(F.contains(low, F.lit(k)), F.when(event_check(low, k, low)["occurred"], F.struct(F.lit(k).alias("keyword"), F.lit(label).alias("label")))) for k, label in EVENT_KEYWORDS]
    found = docs.select("case_id", "event_id", "ts", F.coalesce(*hits).alias("hit"))
    return found.where("hit IS NOT NULL").select("case_id", "event_id", "ts", "hit.keyword", "hit.label")


def _blocks(lo: Column, hi: Column, levels: int) -> Column:
    """The bins lo..hi as at most two blocks a level, block k of level l being the bins k * 2**l up to the next."""
    at = F.struct(lo.alias("lo"), hi.alias("hi"), F.array().cast("array<struct<level:int,k:bigint>>").alias("out"))

    def step(s: Column, level: Column) -> Column:
        some = s["lo"] <= s["hi"]
        left = some & (F.pmod(s["lo"], F.lit(2)) == 1)
        right = some & (F.pmod(s["hi"], F.lit(2)) == 0) & ~(left & (s["lo"] == s["hi"]))
        block = lambda k: F.struct(level.cast("int").alias("level"), k.alias("k"))
        none = F.array().cast("array<struct<level:int,k:bigint>>")
        out = F.concat(s["out"], F.when(left, F.array(block(s["lo"]))).otherwise(none), F.when(right, F.array(block(s["hi"]))).otherwise(none))
        lo_, hi_ = s["lo"] + left.cast("long"), s["hi"] - right.cast("long")
        over = lo_ > hi_  # nothing is left, and halves of crossed ends must not meet again
        return F.struct(F.when(over, F.lit(1).cast("long")).otherwise(F.shiftright(lo_, 1)).alias("lo"), F.when(over, F.lit(0).cast("long")).otherwise(F.shiftright(hi_, 1)).alias("hi"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), at, step)["out"]


def correlate(windows: DataFrame, events: DataFrame, days: int = 3) -> DataFrame:
    """First event of the same case within ``days`` days around each window: (id, case_id, event_id, label, n_events); the first is that of the smallest event_id.

    windows: (id, case_id, first_ts, last_ts); events: (case_id, event_id, ts, label). Both ends count. In a case of more than ``FEW_TIMES`` times of events no window meets single events but those in the minute
    bins of its two ends: the bins between are covered by blocks of 1, 2, 4, ... bins, whose first event and count are aggregated beforehand, so a case of many windows and many events costs their sum times a
    logarithm, not their product. Null times, cases or ends match nothing; equal events count once each.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    slack = days * 86_400_000_000
    scratch = Scratch(windows.sparkSession)
    w = windows.select("id", "case_id", (micros("first_ts") - slack).alias("lo"), (micros("last_ts") + slack).alias("hi")).dropna().where("lo <= hi")
    exact = events.select("case_id", micros("ts").alias("us"), F.struct("event_id", "label").alias("first")).dropna(subset=["case_id", "us"])
    exact = scratch.write(exact.groupBy("case_id", "us").agg(F.min("first").alias("first"), F.count("*").alias("n")))
    busy = scratch.write(exact.groupBy("case_id").agg(F.count("*").alias("times")).where(F.col("times") > FEW_TIMES).select("case_id"))
    if busy.isEmpty():
        inside = _inside(w, exact)
    else:
        w = scratch.write(w)
        few, many = ([df.join(busy.hint("shuffle_merge"), "case_id", how) for df in (w, exact)] for how in ("left_anti", "left_semi"))
        inside = _inside(*few).unionByName(_inside_blocks(scratch, *many))
    met = inside.groupBy("id", "case_id").agg(F.min("first").alias("first"), F.sum("n").alias("n_events"))
    return met.select("id", "case_id", "first.event_id", "first.label", "n_events")


def _inside(w: DataFrame, exact: DataFrame) -> DataFrame:
    met = dealt(w, "case_id").join(exact.hint("shuffle_merge"), "case_id")
    return met.where((F.col("us") >= F.col("lo")) & (F.col("us") <= F.col("hi"))).select("id", "case_id", "first", "n")


def _inside_blocks(scratch: Scratch, w: DataFrame, exact: DataFrame) -> DataFrame:
    size = BIN_SECONDS * 1_000_000
    w = scratch.write(w.withColumns({"lo_bin": F.floor(F.col("lo") / size), "hi_bin": F.floor(F.col("hi") / size)}))
    longest = w.agg(F.max(F.col("hi_bin") - F.col("lo_bin"))).first()[0] or 0
    levels = max(int(longest), 1).bit_length() + 1
    exact = scratch.write(exact.withColumn("bin", F.floor(F.col("us") / size)))
    up = exact.groupBy("case_id", "bin").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    up = up.select("case_id", "first", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda i: F.call_function("shiftright", F.col("bin"), i.cast("int")))).alias("level", "k"))
    up = up.groupBy("case_id", "level", "k").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    inner = w.select("id", "case_id", F.explode(_blocks(F.col("lo_bin") + 1, F.col("hi_bin") - 1, levels)).alias("block")).select("id", "case_id", "block.level", "block.k")
    inside = inner.join(up.hint("shuffle_merge"), ["case_id", "level", "k"]).select("id", "case_id", "first", "n")
    ends = w.select("id", "case_id", "lo", "hi", F.explode(F.array_distinct(F.array("lo_bin", "hi_bin"))).alias("bin"))
    edge = ends.join(exact.hint("shuffle_merge"), ["case_id", "bin"]).where((F.col("us") >= F.col("lo")) & (F.col("us") <= F.col("hi"))).select("id", "case_id", "first", "n")
    return inside.unionByName(edge)


def first_correlation(found: DataFrame, cases: DataFrame, events: DataFrame, days: int = 3) -> DataFrame:
    """Findings (id, first_ts, last_ts, ...) with event_id, event_label and event_case of the first correlated event over their cases (id, case_id), in order of case; null where there is none."""
    windows = dealt(cases.select("id", "case_id"), "id").distinct().join(found.select("id", "first_ts", "last_ts").hint("shuffle_merge"), "id")
    hit = correlate(windows, events, days).groupBy("id").agg(F.min(F.struct("case_id", "event_id", "label")).alias("hit"))
    out = found.join(hit.hint("shuffle_merge"), "id", "left")
    return out.withColumns({"event_id": F.col("hit.event_id"), "event_label": F.col("hit.label"), "event_case": F.col("hit.case_id")}).drop("hit")


def correlated_bursts(contacts: DataFrame, events: DataFrame, threshold: int = 2) -> DataFrame:
    """Bursts of contacts per unordered pair with evidence: (a, b, n, cases, avg_weight, first_ts, last_ts, event_id, event_label, severity, confidence, explanation).

    From 3 times the threshold on high, from 2 times medium, else low; a pair whose contacts fall around an event of one of its cases is high and confirmed. Self contacts and null ends are left out.
    """
    scratch = Scratch(contacts.sparkSession)
    total = F.sum("n").over(Window.partitionBy("a", "b"))
    by_case = scratch.write(contacts_by_case(contacts).withColumn("total", total).where(F.col("total") >= threshold).drop("total"))
    pairs = scratch.write(pairs_of_cases(by_case)).withColumn("id", F.struct("a", "b"))
    out = first_correlation(pairs, by_case.select(F.struct("a", "b").alias("id"), "case_id"), events).drop("id", "event_case")
    hit = F.col("event_id").isNotNull()
    by_count = F.when(F.col("n") >= 3 * threshold, "high").when(F.col("n") >= 2 * threshold, "medium").otherwise("low")
    told = F.concat(F.col("n").cast("string"), F.lit(" contacts of "), F.col("a").cast("string"), F.lit(" and "), F.col("b").cast("string"))
    why = F.when(hit, F.concat(told, F.lit(" around a documented "), "event_label")).otherwise(F.concat(told, F.lit(", "), F.format_number(F.col("n") / threshold, 1), F.lit(" times the threshold")))
    return out.withColumns({"severity": F.when(hit, "high").otherwise(by_count), "confidence": F.when(hit, CONFIRMED).when(F.col("n") >= 2 * threshold, UNUSUAL).otherwise(UNEXPLAINED), "explanation": why})


def burner_numbers(contacts: DataFrame, burners: DataFrame, events: DataFrame, max_days: int = 7) -> DataFrame:
    """Activity of numbers marked as burners (number): (number, first_ts, last_ts, n, days, event_id, event_label, severity, confidence, explanation).

    High and confirmed around an event of a case of theirs, medium and unusual within ``max_days`` days, else low and unexplained. Numbers without contacts give none.
    """
    ends = dealt(contacts.select(F.explode(F.array("src", "dst")).alias("number"), "case_id", "ts"), "number").join(burners.select("number").distinct().hint("shuffle_merge"), "number")
    scratch = Scratch(contacts.sparkSession)
    ends = scratch.write(ends.groupBy("number", "case_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")))
    found = scratch.write(ends.groupBy("number").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n").alias("n")).where("first_ts IS NOT NULL"))
    days = F.floor((F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts")) / 86400)
    out = first_correlation(found.withColumns({"days": days, "id": F.col("number")}), ends.select(F.col("number").alias("id"), "case_id"), events).drop("id", "event_case")
    hit, brief = F.col("event_id").isNotNull(), F.col("days") <= max_days
    told = F.concat(F.lit("used on "), F.col("days").cast("string"), F.lit(" days"), F.when(hit, F.concat(F.lit(" around a documented "), "event_label")).otherwise(""))
    return out.withColumns({"severity": F.when(hit, "high").when(brief, "medium").otherwise("low"), "confidence": F.when(hit, CONFIRMED).when(brief, UNUSUAL).otherwise(UNEXPLAINED), "explanation": told})


def new_contact_bursts(contacts: DataFrame, hours: int = 24, minimum: int = 10) -> DataFrame:
    """Pairs without prior contact that reach ``minimum`` contacts within ``hours`` hours of their first: (a, b, n, first_ts, last_ts of the burst). Both ends of the span count; null times don't."""
    c = contacts.where("src <> dst AND ts IS NOT NULL").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("ts").cast("timestamp").alias("ts"))
    first = c.groupBy("a", "b").agg(F.min("ts").alias("first_ts"), F.count("*").alias("all")).where(F.col("all") >= minimum).drop("all")
    inside = c.join(first.hint("shuffle_merge"), ["a", "b"]).where(F.unix_micros("ts") - F.unix_micros("first_ts") <= hours * 3_600_000_000)
    return inside.groupBy("a", "b", "first_ts").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).where(F.col("n") >= minimum)


_ALERT = ["alert_key", "alert_type", "title", "severity", "confidence", "explanation", "entity_ids", "evidence", "status", "human_review_required"]


def assembled_alerts(found: DataFrame, alert_type: str, entities: list[str], evidence: list[str], source_ids: str | None = None) -> DataFrame:
    """Findings in the alert schema: a key that is the same in each run, at most ten ids, a map of the ``evidence`` columns (nulls left out) with at most ten ``source_ids``, explanation and class of confidence.

    A finding without confidence is unexplained, without explanation empty, without severity medium. ``human_review_required`` always holds.
    """
    have = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in found.columns else F.lit(default)
    names = [F.col(c).cast("string") for c in entities]
    items = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in evidence]
    if source_ids:
        items.append(F.struct(F.lit("source_records").alias("key"), F.array_join(F.slice(F.transform(source_ids, lambda x: x.cast("string")), 1, 10), ",").alias("value")))
    facts = F.map_from_entries(F.filter(F.array(*items), lambda x: x["value"].isNotNull()))
    key = F.sha2(F.concat_ws("|", F.lit(alert_type), *names), 256)
    values = [key, F.lit(alert_type), F.concat_ws(" - ", *names), have("severity", "medium"), have("confidence", UNEXPLAINED), have("explanation", ""), F.slice(F.array(*names), 1, 10), facts, F.lit("active"), F.lit(True)]
    return found.select(*[v.alias(n) for n, v in zip(_ALERT, values, strict=True)])


def run_isolated(spark, detectors: dict[str, Callable[[float | None], DataFrame]], rules: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(alerts, failures): every enabled detector is run and written by itself, so that one that fails, when planned or in a task, leaves the others' alerts.

    ``detectors``: alert type to a function of the rule's threshold (null or no rule: None, the detector's default) that returns alerts. rules: (rule_type, is_enabled, threshold); a
    disabled rule keeps its detector from running at all, a repeated rule counts with its largest threshold and is off if any of it is. failures: (detector, error). One alert per type and title is kept,
    of the least key, and none that ``existing`` (alert_type, title) has.
    """
    scratch = Scratch(spark)
    named = rules.where(F.col("rule_type").isin(list(detectors))).groupBy("rule_type").agg(F.min(F.coalesce("is_enabled", F.lit(True))).alias("on"), F.max("threshold").alias("threshold")).collect()  # as many rows as detectors
    of = {r.rule_type: r for r in named}
    done, failed = [], []
    for name, detect in detectors.items():
        if name in of and not of[name].on:
            continue
        try:
            done.append(scratch.write(detect(of[name].threshold if name in of else None).select(*_ALERT)))
        except Exception as error:  # noqa: BLE001  whatever a detector raises is its own affair
            failed.append((name, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"))
    failures = spark.createDataFrame(failed, "detector string, error string")
    if not done:
        text = "alert_key string, alert_type string, title string, severity string, confidence string, explanation string, entity_ids array<string>, evidence map<string,string>, status string, human_review_required boolean"
        return spark.createDataFrame([], text), failures
    every = done[0]
    for df in done[1:]:
        every = every.unionByName(df)
    once = every.groupBy("alert_type", "title").agg(F.min_by(F.struct(*[c for c in _ALERT if c not in ("alert_type", "title")]), "alert_key").alias("x")).select("alert_type", "title", "x.*").select(*_ALERT)
    if existing is not None:
        once = once.join(existing.select("alert_type", "title").distinct().hint("shuffle_merge"), ["alert_type", "title"], "left_anti").select(*_ALERT)
    return once, failures
