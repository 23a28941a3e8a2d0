"""Study analytics: sessions, weeks, reviews, units, news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators import ordering

#: Minutes of validity and plan, weekly goals, review factors by grade, step threshold.
LEAST_MINUTES, MOST_MINUTES = 5, 180
PLANNED = {"mattina": 30, "artefatto": 60, "lettura": 40, "paper": 45, "ripasso": 20}
SURVIVAL, BASE, SURGE = 120, 300, 480
FACTORS = {1: 1.2, 2: 2.2, 3: 3.4}
STEP_PERCENT = 80


def planned(kind: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in PLANNED.items() for x in pair))[kind]


def closed(start_ms: Column, end_ms: Column, kind: Column) -> Column:
    """struct(valid, minutes, note) of a finished session."""
    minutes = F.floor((end_ms - start_ms) / 60000 + F.lit(0.5)).cast("int")
    valid = (end_ms > start_ms) & (minutes >= LEAST_MINUTES)
    long = minutes > MOST_MINUTES
    note = F.when(~valid, F.lit("not recorded")).when(long, F.lit("left running")).when(minutes > 2 * planned(kind), F.lit("over twice the plan"))
    return F.struct(valid.alias("valid"), F.when(valid, F.when(long, planned(kind)).otherwise(minutes)).alias("minutes"), note.alias("note"))


def level(minutes: Column) -> Column:
    return F.when(minutes >= SURGE, "surge").when(minutes >= BASE, "base").otherwise("sopravvivenza")


def weekly(sessions: DataFrame, who: str = "user_id") -> DataFrame:
    """Minutes per person and Monday week, by kind, with level and what is missing to the base goal."""
    wide = sessions.groupBy(who, F.to_date(F.date_trunc("week", "start")).alias("week")).agg(F.sum("minutes").alias("minutes"), *(F.sum(F.when(F.col("kind") == k, F.col("minutes")).otherwise(0)).alias(k) for k in PLANNED))
    m = F.col("minutes")
    return wide.withColumns({"level": level(m), "missing": F.greatest(F.lit(0), BASE - m), "below": m < SURVIVAL})


def weeks_below(sessions: DataFrame, today: str, who: str = "user_id", most: int = 12) -> DataFrame:
    """Consecutive weeks before this one below the survival goal; weeks without sessions count."""
    week = F.to_date(F.date_trunc("week", F.lit(today).cast("timestamp")))
    people = sessions.select(who).distinct()
    spine = people.select(who, F.explode(F.sequence(F.lit(1), F.lit(most))).alias("back")).withColumn("week", F.date_sub(week, F.col("back") * 7))
    sums = sessions.groupBy(who, F.to_date(F.date_trunc("week", "start")).alias("week")).agg(F.sum("minutes").alias("m"))
    j = spine.join(sums, [who, "week"], "left").withColumn("fine", F.coalesce("m", F.lit(0)) >= SURVIVAL)
    return j.groupBy(who).agg((F.coalesce(F.min(F.when(F.col("fine"), F.col("back"))), F.lit(most + 1)) - 1).alias("weeks_below"))


def reviewed(stability: Column, grade: Column) -> Column:
    """Days to the next review after a grade from 0 to 3."""
    factor = F.when(grade == 1, FACTORS[1]).when(grade == 2, FACTORS[2]).when(grade == 3, FACTORS[3])
    return F.when(grade == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(stability * factor + F.lit(0.5)).cast("int")))


def review_history(grades: Column) -> Column:
    """The state after a whole ordered list of grades."""
    return F.aggregate(grades, F.lit(1), lambda days, g: F.coalesce(reviewed(F.greatest(days, F.lit(1)), g), days))


def threshold(total: Column) -> Column:
    return F.ceil(total * STEP_PERCENT / 100)


def units(material: DataFrame, kinds: list[str]) -> DataFrame:
    """Progress per topic of columns <kind>_done, <kind>_total: the mean of capped ratios over kinds that exist."""
    def ratio(k: str) -> Column:
        return F.when(F.col(f"{k}_total") > 0, F.least(F.col(f"{k}_done") / threshold(F.col(f"{k}_total")), F.lit(1.0)))

    ratios = F.filter(F.array(*map(ratio, kinds)), lambda r: r.isNotNull())
    n, total = F.size(ratios), F.aggregate(ratios, F.lit(0.0), lambda a, r: a + r)
    started = F.aggregate(F.array(*(F.col(f"{k}_done") for k in kinds)), F.lit(0).cast("bigint"), lambda a, d: a + d.cast("bigint")) > 0
    state = F.when(n == 0, "senza_verifiche").when(F.forall(ratios, lambda r: r >= 1.0), "completa").when(started, "in_corso").otherwise("da_iniziare")
    return material.withColumns({"progress": F.round(F.when(n > 0, total / n).otherwise(0.0), 6), "state": state})


def news_day(published: Column, collected: Column) -> Column:
    """The day an article counts for: its publication unless that lies after its collection."""
    return F.to_date(F.when(published <= collected, published).otherwise(collected))


def day_group(day: Column, today: str) -> Column:
    n = F.greatest(F.lit(0), F.datediff(F.lit(today).cast("date"), day))
    return F.when(n == 0, "oggi").when(n == 1, "ieri").when(n < 7, "questa settimana").otherwise("prima")


def within_budget(files: DataFrame, budget: int, group: str, *order: Column | str) -> DataFrame:
    """The first files of each group whose sizes together stay within a budget of bytes."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumn("upto", F.sum("size").over(w)).where(F.col("upto") <= budget)


def within_whole_budget(files: DataFrame, budget: int, *order: Column) -> DataFrame:
    """The first of all files, in one order, whose sizes together stay within a budget of bytes."""
    return ordering.running_total(files, list(order), "size", "upto", most=budget)


def next_occurrence(now: Column, weekday: int, hour: int) -> Column:
    """The next time, after now, of a weekday (Monday 0) at a full hour."""
    today = F.pmod(F.dayofweek(now) + 5, F.lit(7))
    first = F.make_interval(days=F.pmod(F.lit(weekday) - today, F.lit(7)), hours=F.lit(hour))
    at = F.date_trunc("day", now) + first
    return F.when(at > now, at).otherwise(at + F.expr("interval 7 days"))


def assigned(units_: list[dict], followed: list[str], before: dict[str, str] | None = None) -> dict[str, str]:
    """Which unit each followed topic works on.

    Every topic has a ranked list of units that it may work on: its own while there is something left
    to do, the one it worked on before, then the other open ones of its area in plan order from its own
    on, those last that another topic which is back on its own unit worked on before.  Topics choose by
    the kind of their best choice (own, former, other), within a kind in the order they are followed in,
    or of the plan for other units; nobody gets a unit that is taken.  A topic without choice keeps its own.

    units_ are dicts with slug, area, open (something left to do) and checks, in plan order: a few dozen
    that depend on one another, so this runs on the driver.
    """
    own, former, other = range(3)
    before = before or {}
    plan = {u["slug"]: (nth, u) for nth, u in enumerate(units_)}
    topics = {s: nth for nth, s in enumerate(dict.fromkeys(followed)) if s in plan and plan[s][1]["checks"]}
    result: dict[str, str] = {}

    def bid(topic: str) -> tuple[tuple[int, int], str] | None:
        """(kind and turn, unit) of the topic's best free unit."""
        nth, mine = plan[topic]
        free = [u for u in units_ if u["open"] and u["slug"] not in result.values()]
        if any(u is mine for u in free):
            return (own, topics[topic]), topic
        kept = {before[t] for t in topics if result.get(t) == t and t in before}
        near = [u["slug"] for u in free if mine["area"] and u["area"] == mine["area"]]
        if before.get(topic) in near:
            return (former, topics[topic]), before[topic]
        near.sort(key=lambda s: (s in kept, (plan[s][0] - nth) % len(units_)))
        return ((other, nth), near[0]) if near else None

    waiting = dict(topics)
    while bids := {t: b for t in waiting if (b := bid(t))}:
        topic = min(bids, key=lambda t: bids[t][0])
        result[topic] = bids[topic][1]
        del waiting[topic]
    return {t: result.get(t, t) for t in topics}


def scenarios(exercises: DataFrame, notes: DataFrame) -> DataFrame:
    """exercises(id, template), notes(exercise_id, note_id, body, hlc): whether any note differs from its
    template, and the note to open - the latest written one, else the latest."""
    j = exercises.join(notes.withColumnRenamed("exercise_id", "id"), "id", "left")
    solved = F.coalesce(F.trim("body") != F.trim("template"), F.lit(False)) & (F.coalesce(F.trim("body"), F.lit("")) != "")
    return j.groupBy("id").agg(F.max_by("note_id", F.struct(solved, F.col("hlc"))).alias("note_id"), F.max(solved).alias("solved"))
