"""Date, number and collection expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Seoul"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_window(day: Column | str, zone: str = ZONE) -> tuple[Column, Column]:
    """UTC start and end (exclusive) of a calendar day of a zone."""
    start = _c(day).cast("date")
    return F.to_utc_timestamp(start.cast("timestamp"), zone), F.to_utc_timestamp(F.date_add(start, 1).cast("timestamp"), zone)


def next_daily(now: Column | str, hour: int, minute: int = 0, zone: str = ZONE) -> Column:
    """The next time of day in a zone, strictly later than now; in UTC."""
    local = F.from_utc_timestamp(_c(now), zone)
    due = F.date_trunc("day", local) + F.expr(f"make_dt_interval(0, {hour}, {minute})")
    return F.to_utc_timestamp(F.when(due > local, due).otherwise(due + F.expr("interval 1 day")), zone)


def next_weekly(now: Column | str, weekday: int, hour: int, minute: int = 0, zone: str = ZONE) -> Column:
    """The next such weekday (Monday 0) and time in a zone, strictly later than now; in UTC."""
    local = F.from_utc_timestamp(_c(now), zone)
    ahead = F.pmod(F.lit(weekday) - F.weekday(local), F.lit(7))
    due = F.timestamp_add("DAY", ahead, F.date_trunc("day", local)) + F.expr(f"make_dt_interval(0, {hour}, {minute})")
    return F.to_utc_timestamp(F.when(due > local, due).otherwise(due + F.expr("interval 7 day")), zone)


def retention_cutoff(now: Column | str, days: int, zone: str = ZONE) -> Column:
    """Midnight in a zone, so many days ago; in UTC."""
    return F.to_utc_timestamp(F.date_sub(F.from_utc_timestamp(_c(now), zone).cast("date"), days).cast("timestamp"), zone)


def parsed_timestamp(text: Column | str, formats: tuple[str, ...] = ("yyyy.MM.dd HH:mm", "yyyy-MM-dd HH:mm", "yyyy.MM.dd", "yyyy-MM-dd"), zone: str = ZONE) -> Column:
    """The first format that fits, read as local time of a zone; in UTC, null if none fits."""
    return F.to_utc_timestamp(F.coalesce(*[F.try_to_timestamp(_c(text), F.lit(f)) for f in formats]), zone)


def age_days(at: Column | str, now: Column | str) -> Column:
    """Whole days between two times, at least 0."""
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(_c(now)) - F.unix_timestamp(_c(at))) / 86400))


def backoff_seconds(attempt: Column | str, base: int = 30, cap: int = 3600) -> Column:
    """Seconds before the next attempt: base, doubled for each further one, at most cap."""
    return F.least(F.lit(cap).cast("double"), base * F.pow(F.lit(2.0), _c(attempt) - 1)).cast("long")


def retry_after(value: Column | str, now: Column | str, cap: int = 3600) -> Column:
    """Seconds of a Retry-After header, given as a number or an HTTP date; null if neither."""
    v = _c(value)
    at = F.try_to_timestamp(F.regexp_extract(v, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    seconds = F.coalesce(F.expr("null").cast("long"), F.try_to_number(F.trim(v), F.lit("S999999999")).cast("long"), F.greatest(F.lit(0).cast("long"), F.unix_timestamp(at) - F.unix_timestamp(_c(now))))
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(cap).cast("long"), seconds))


def decay_score(recommended: Column | str, views: Column | str, comments: Column | str, age: Column | str, half_life: float = 45.0, weight: float = 5.0, fresh_days: int | None = None, fresh_bonus: float = 50.0) -> Column:
    """Weighted popularity, halved every half_life days; young posts may get a bonus."""
    score = _c(recommended) * weight + F.log(_c(views) + 1) * 2 + _c(comments)
    if fresh_days is not None:
        score = score + F.when(_c(age) <= fresh_days, fresh_bonus).otherwise(0.0)
    return score * F.pow(F.lit(0.5), _c(age) / half_life)


def quality_boost(recommended: Column | str, views: Column | str, tip: Column | str, branch: Column | str, age: Column | str, official: Column | str) -> Column:
    """Small bonus of a passage: capped at 0.012, and 0.02 more for official sources outside the cap."""
    count = lambda c: F.log1p(F.greatest(F.lit(0), F.coalesce(_c(c), F.lit(0))))
    fresh = F.coalesce(0.003 * F.exp(-_c(age) / 365), F.lit(0.0))
    boost = F.least(F.lit(0.004), count(recommended) / 1000) + F.least(F.lit(0.0025), count(views) / 4000)
    boost = boost + F.when(_c(tip), 0.0025).otherwise(0.0) + F.when(_c(branch), 0.0015).otherwise(0.0) + fresh
    return F.least(F.lit(0.012), boost) + F.when(_c(official), 0.02).otherwise(0.0)


def anchor_boost(terms: Column | str, title: Column | str, text: Column | str, source_key: Column | str) -> Column:
    """Bonus for linked terms (normalised like title and text): 0.04 in the title or an article's text, else 0.006 in the text; at most 0.06."""
    article = F.startswith(_c(source_key), F.lit("article:"))
    each = lambda t: F.when(F.contains(_c(title), t) | (article & F.contains(_c(text), t)), 0.04).when(F.contains(_c(text), t), 0.006).otherwise(0.0)
    return F.least(F.lit(0.06), F.aggregate(_c(terms), F.lit(0.0), lambda acc, t: acc + each(t)))


def in_scope(groups: Column | str, searchable: Column | str) -> Column:
    """Whether a normalised text has a term of every group; no groups always pass."""
    return F.forall(_c(groups), lambda g: F.exists(g, lambda t: F.contains(_c(searchable), t)))


def cosine(one: Column | str, other: Column | str) -> Column:
    """Cosine of two arrays of numbers, in doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    a, b = _c(one), _c(other)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def valid_embedding(vector: Column | str, dim: int, tolerance: float = 1e-3) -> Column:
    """Whether a vector has the dimension, finite values and unit length."""
    v = _c(vector)
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & (F.abs(F.sqrt(square) - 1) <= tolerance), F.lit(False))


def level_rate(level: Column | str, monster: Column | str) -> Column:
    """Rate for a difference of levels: 1.10 to 1, 1.05 at 2, 1 to 4, 0.95 to 9, then 0.05 less a level, at least 0.10."""
    d = F.abs(_c(monster) - _c(level))
    return F.when(d <= 1, 1.10).when(d == 2, 1.05).when(d <= 4, 1.0).when(d <= 9, 0.95).when(d <= 20, F.round(0.90 - (d - 10) * 0.05, 2)).otherwise(F.greatest(F.lit(0.10), F.round(0.40 - (d - 20) * 0.05, 2)))


def hunting(level: Column | str, monster: Column | str, base: Column | str, rate_percent: Column | str, kills: Column | str, needed: Column | str, percent: Column | str) -> Column:
    """struct(per_kill, per_hour, hour_percent, hours_to_level): unrounded figures of an hour's hunting."""
    per_kill = _c(base) * level_rate(level, monster) * (_c(rate_percent) / 100.0)
    per_hour = (per_kill * _c(kills)).cast("long")
    left = (_c(needed) * (F.greatest(F.lit(0.0), 100.0 - _c(percent)) / 100.0)).cast("long")
    hours = F.when(per_hour > 0, left / per_hour).otherwise(0.0)
    return F.struct(per_kill.alias("per_kill"), per_hour.alias("per_hour"), (per_hour / _c(needed) * 100.0).alias("hour_percent"), hours.alias("hours_to_level"))


def potions(level: Column | str, percent: Column | str, count: Column | str, table: dict[int, int], sure_level: int, cap_level: int, cap_exp: int | None = None, top: int = 300) -> Column:
    """struct(level, percent, gained) after so many potions, as a fold over them.

    Up to sure_level a potion gives exactly the level's need and keeps the percentage; above, it gives the need of
    cap_level (or cap_exp), carried over as many levels as it fills. At the top level nothing more happens.
    """
    needs = F.create_map(*[F.lit(x) for k, v in sorted(table.items()) for x in (k, float(v))])
    need = lambda at: F.element_at(needs, at)
    fixed = float(cap_exp if cap_exp is not None else table[cap_level])
    lowest = min(table[k] for k in table if k < top)
    most = int(fixed // lowest) + 2

    def state(lv: Column, exp: Column, pct: Column, gained: Column) -> Column:
        return F.struct(lv.cast("int").alias("level"), exp.cast("double").alias("exp"), pct.cast("double").alias("pct"), gained.cast("double").alias("gained"))

    def climb(s: Column) -> Column:
        up = lambda a, _: F.when((a["level"] < top) & (a["exp"] >= need(a["level"])), state(a["level"] + 1, a["exp"] - need(a["level"]), a["pct"], a["gained"])).otherwise(a)
        return F.aggregate(F.sequence(F.lit(1), F.lit(most)), s, up)

    def drink(s: Column, _: Column) -> Column:
        sure = state(s["level"] + 1, F.floor(F.coalesce(need(s["level"] + 1), need(s["level"])) * (s["pct"] / 100.0)), s["pct"], s["gained"] + need(s["level"]))
        filled = climb(state(s["level"], s["exp"] + fixed, s["pct"], s["gained"] + fixed))
        settled = F.transform(F.array(filled), lambda f: state(f["level"], f["exp"], F.when(f["level"] < top, f["exp"] / need(f["level"]) * 100.0).otherwise(100.0), f["gained"]))[0]
        return F.when(s["level"] >= top, s).when(s["level"] <= sure_level, sure).otherwise(settled)

    start = state(_c(level), F.floor(need(_c(level)) * (_c(percent) / 100.0)), _c(percent), F.lit(0.0))
    done = F.when(_c(count) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(_c(count), F.lit(1))), start, drink)).otherwise(start)
    pct = lambda s: F.when(s["level"] < top, s["exp"] / need(s["level"]) * 100.0).otherwise(100.0)
    return F.transform(F.array(done), lambda s: F.struct(s["level"].alias("level"), pct(s).alias("percent"), s["gained"].cast("long").alias("gained")))[0]


def resolved(name: Column | str, names: dict[str, tuple[str, ...]]) -> Column:
    """The canonical name that a given name or alias stands for, blanks and case ignored; null for unknown ones."""
    flat = lambda c: F.lower(F.replace(F.trim(c), F.lit(" "), F.lit("")))
    out = F.lit(None).cast("string")
    for canonical, aliases in reversed(names.items()):
        out = F.when(flat(_c(name)).isin(*[n.lower().replace(" ", "") for n in (canonical, *aliases)]), canonical).otherwise(out)
    return out
