"""One UTC instant for times written in many notations, precisions and zones."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallix.session import checkpoint

DAY = 86_400_000_000

#: Zone abbreviations and their offsets in minutes. Those with two common meanings aren't here.
ZONE_MINUTES = {"Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "NPT": 345, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

_TIME = r"(?:[T ,]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([AaPp])\.?[Mm]\.?)?)?"
_ZONE = r" ?(Z|z|[A-Za-z]{2,5}|(?:UTC|GMT)? ?[+-]\d{1,2}:?\d{2}|[+-]\d{2})?"
#: Each notation: its pattern, and where year, month, day, hour, minute, second, fraction, half of day and zone are.
ISO = (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TIME}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9")
COMPACT = (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8")
NUMERIC = (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}){_TIME}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9")
DAY_FIRST = (rf"^(?:[A-Za-z]{{3,9}}\.?,? )?(\d{{1,2}})(?:st|nd|rd|th)?[ -]([A-Za-z]{{3,9}})\.?,?[ -](\d{{4}}){_TIME}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9")
MONTH_FIRST = (rf"^(?:[A-Za-z]{{3,9}}\.?,? )?([A-Za-z]{{3,9}})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}){_TIME}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9")


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a proleptic Gregorian date; null if there is no such date."""
    there = y.between(1, 9999) & m.between(1, 12) & d.between(1, 31)
    first = F.when(there, F.make_date(y, m, F.lit(1)))
    return F.when(d <= F.day(F.last_day(first)), F.unix_date(first) + d - 1)


def parse(df: DataFrame, text: str, order: str) -> DataFrame:
    """df with `__us` (the instant, where the text itself fixes it), `__local` (local microseconds, where it doesn't).

    order names a column with dmy, mdy or ymd (null: ymd): how all-numeric dates without a leading year read.
    Both are null for placeholders, impossible dates, empty and null texts and any other text.
    """
    t = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    number = t.rlike(r"^[+-]?\d{1,17}(\.\d+)?$")
    asked = F.lower(F.trim(F.coalesce(F.col(order), F.lit(""))))
    a, b, c = "$1", "$2", "$3"
    rest = "|$4|$5|$6|$7|$8|$9"
    numeric = F.when(asked == "mdy", F.regexp_replace(t, NUMERIC[0], f"{c}|{a}|{b}{rest}")).when((asked != "dmy") & ~t.rlike(r"^\d{1,2}.\d{1,2}.\d{4}"), F.regexp_replace(t, NUMERIC[0], f"{a}|{b}|{c}{rest}")).otherwise(F.regexp_replace(t, NUMERIC[0], f"{c}|{b}|{a}{rest}"))
    fields = F.when(number, None).when(t.rlike(ISO[0]), F.regexp_replace(t, *ISO)).when(t.rlike(NUMERIC[0]), numeric)
    for p in (COMPACT, DAY_FIRST, MONTH_FIRST):
        fields = fields.when(t.rlike(p[0]), F.regexp_replace(t, *p))
    # Each inline() keeps what it makes from being inlined, again and again, into all that uses it.
    out = df.select("*", F.inline(F.array(F.struct(F.split(fields, r"\|").alias("__f"), F.when(number, t.try_cast("decimal(38,9)")).alias("__n")))))
    part = lambda i: F.get("__f", F.lit(i))
    whole = lambda i, empty=0: F.when(part(i) == "", empty).otherwise(part(i).try_cast("int"))
    month = F.when(part(1).rlike(r"^\d"), part(1).try_cast("int")).otherwise(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(part(1), 1, 3))).cast("int"))
    year = F.when(F.length(part(0)) == 2, F.lit(2000) + part(0).try_cast("int")).otherwise(part(0).try_cast("int"))
    half = F.lower(part(7))
    hour = F.when(half == "", whole(3)).when(whole(3).between(1, 12), whole(3) % 12 + F.when(half == "p", 12).otherwise(0))
    sound = hour.between(0, 23) & whole(4).between(0, 59) & whole(5).between(0, 59)
    fraction = F.when(part(6) == "", 0).otherwise(F.rpad(F.substring(part(6), 1, 6), 6, "0").try_cast("int"))
    day_us = _days(year, month, whole(2)).cast("long") * DAY
    local = F.when(sound, day_us + (hour * 3600 + whole(4) * 60 + whole(5)).cast("long") * 1_000_000 + fraction)
    zone = F.upper(F.regexp_replace(part(8), r"^(?:UTC|GMT|utc|gmt) ?(?=[+-])", ""))
    hhmm = F.when(F.length("__d") <= 2, F.col("__d").try_cast("int") * 60).otherwise(F.expr("try_cast(left(__d, length(__d) - 2) as int) * 60 + try_cast(right(__d, 2) as int)"))
    known = F.create_map(*[F.lit(x) for pair in ZONE_MINUTES.items() for x in pair])
    out = out.select(*df.columns, "__n", F.inline(F.array(F.struct(local.alias("__l"), zone.alias("__z"), F.regexp_replace(F.substring(zone, 2, 9), ":", "").alias("__d")))))
    minutes = F.when(F.col("__z").rlike(r"^[+-]"), F.when(F.col("__z").startswith("-"), -hhmm).otherwise(hhmm)).otherwise(F.try_element_at(known, F.col("__z")))
    epoch = F.when(F.abs("__n") >= F.lit(100_000_000_000), F.col("__n") * 1000).otherwise(F.col("__n") * 1_000_000)
    instant = F.when(F.col("__n").isNotNull(), F.round(epoch, 0).try_cast("long")).when(F.col("__z") != "", F.col("__l") - minutes.cast("long") * 60_000_000)
    made = F.struct(instant.alias("__us"), F.when(F.col("__n").isNull() & (F.col("__z") == ""), F.col("__l")).alias("__local"))
    return out.select(*df.columns, F.inline(F.array(made)))


def local_to_utc(local: Column, zone: Column) -> Column:
    """Microseconds UTC of local microseconds in a zone: of two the first, of none moved on by the skip."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), zone))


def violations(parsed: DataFrame, source: str, seq: str, candidates: list[str], stream: str | None = None, per_bucket: int = 8, tolerance_h: float = 24.0) -> DataFrame:
    """(source, n, rated): for each source how far each candidate's offset history is from the order of arrival.

    parsed comes from `parse`. Rows (of one stream, if they come in several) arrive in the order of seq, so the median
    instant of a bucket of about `per_bucket` neighbouring rows tells when its rows were made. A candidate's violation
    at a local time is how far the converted time is from the median, at most `tolerance_h` hours (late rows weigh no
    more than that). rated has (v: mean violation in microseconds, i: the candidate's number, zone), the least first.
    The candidates are zones with their whole offset history, so changes to summer time count.
    """
    size = F.lit(per_bucket)
    base = parsed.select(F.col(source).alias("__source"), (F.col(stream) if stream else F.lit("")).alias("__stream"), F.floor(F.col(seq) / size).alias("__b"), "__us", "__local").where("__us is not null or __local is not null")
    medians = base.where("__us is not null").groupBy("__stream", "__b").agg(F.percentile_approx("__us", 0.5, 1000).alias("__m"))
    local = base.where("__local is not null").join(medians, ["__stream", "__b"])
    most = int(tolerance_h * 3.6e9)
    loss = [F.avg(F.least(F.lit(most), F.abs(local_to_utc(F.col("__local"), F.lit(z)) - F.col("__m")))).alias(f"z{i}") for i, z in enumerate(candidates)]
    rated = local.groupBy("__source").agg(F.count(F.lit(1)).alias("n"), *loss)
    order = F.array_sort(F.array(*[F.struct(F.col(f"z{i}").alias("v"), F.lit(i).alias("i"), F.lit(z).alias("zone")) for i, z in enumerate(candidates)]))
    return rated.select(F.col("__source").alias("source"), "n", order.alias("rated"))


def estimate_zones(parsed: DataFrame, source: str, seq: str, candidates: list[str], stream: str | None = None, per_bucket: int = 8, tolerance_h: float = 24.0) -> DataFrame:
    """(source, zone, n, violation_h, margin_h): the zone with the fewest violations, and how much worse the next one is."""
    hours = lambda c: F.round(c / 3.6e9, 4)
    best, next_ = F.get("rated", F.lit(0)), F.get("rated", F.lit(1))
    return violations(parsed, source, seq, candidates, stream, per_bucket, tolerance_h).select("source", best["zone"].alias("zone"), "n", hours(best["v"]).alias("violation_h"), hours(next_["v"] - best["v"]).alias("margin_h"))


def java_zone(name: Column) -> Column:
    """Whether a text has the form of a zone of the IANA list that is sure to be known."""
    return name.isin(sorted(n for n in zoneinfo.available_timezones() if "/" in n or n in ("UTC", "GMT")))


def to_instants(df: DataFrame, text: str, source: str, seq: str, profiles: DataFrame, stream: str | None = None, unknown: str | None = "UTC", guess_undeclared: bool = True, per_bucket: int = 8, margin_h: float = 0.25) -> DataFrame:
    """df with `utc_us`: the instant of each row's text, null where it names none.

    profiles has source, zone_name and date_order. Text without a zone is local time in the zone of its source. Zones
    are estimated by the order of arrival (see violations): of all declared zones, and `unknown`, a source has
    the offset history with the fewest violations. What is declared comes first: another zone is taken only if the
    declared one's mean violation is larger by `margin_h` hours and the noise of n rows, 12 / sqrt(n) hours. A source
    without a declared zone stands to `unknown` in the same way; with guess_undeclared=False (where a statement fixes the zone
    of such sources) it is of `unknown`, whatever its rows say.

    Defined cases: null, empty or placeholder texts, impossible dates and unknown zone names give null; a null
    source is a source without a profile; two profiles of one source count as the one with the least zone name;
    more than 1,000 different zones are an error; an empty table gives none; other columns pass through.
    """
    own = profiles.select(F.col("source").alias("__ps"), F.col("zone_name").alias("__zone"), F.col("date_order").alias("__order")).where("__ps is not null")
    own = own.withColumn("__zone", F.when(java_zone(F.col("__zone")), F.col("__zone")))
    own = own.groupBy("__ps").agg(F.min(F.struct("__zone", "__order")).alias("__p")).select("__ps", "__p.*")
    names = {r[0] for r in own.select("__zone").where("__zone is not null").distinct().limit(1001).collect()} | ({unknown} if unknown else set())
    if len(names) > 1001:
        raise ValueError("more than 1,000 zones")
    parsed = checkpoint(parse(df.join(own, df[source] == own["__ps"], "left"), text, "__order"))  # costs most, and is read three times
    asked = parsed if guess_undeclared else parsed.where("__zone is not null or __us is not null")
    rated = violations(asked, source, seq, sorted(names), stream, per_bucket).join(own, F.col("source") == F.col("__ps"), "left")
    first = F.coalesce("__zone", F.lit(unknown))
    best, stated = F.get("rated", F.lit(0)), F.get(F.filter("rated", lambda r: r["zone"] == first), F.lit(0))
    beaten = F.coalesce(stated["v"] - best["v"] < (margin_h + 12 / F.sqrt("n")) * 3.6e9, stated["v"].isNotNull())
    zones = checkpoint(rated.select(F.col("source").alias("__es"), F.when(beaten, first).otherwise(best["zone"]).alias("__best")))
    parsed = parsed.join(zones, parsed[source].eqNullSafe(zones["__es"]), "left")
    # A source none of whose local times can be aligned has no violations at all: what is declared holds.
    zone = F.coalesce("__best", "__zone", F.lit(unknown)) if guess_undeclared else F.when(F.col("__zone").isNull(), F.lit(unknown)).otherwise(F.coalesce("__best", "__zone"))
    at = F.coalesce("__us", local_to_utc(F.col("__local"), zone))
    return parsed.select(*[F.col(c) for c in df.columns], at.alias("utc_us"))
