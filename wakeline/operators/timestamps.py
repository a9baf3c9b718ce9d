"""Mixed timestamp texts to one UTC instant (problem 1).

Every text gets its valid interpretations (format candidates). Zoned texts, texts with the
year in front and texts with a month name have one; numeric dates that end in the year have
up to two (day first, month first). An expectation-maximisation over format mixtures per
source (station) learns how often a source writes each format, or something that only looks
like a date, from the texts that fit only one and from how soon after the instant the row was
received; a declared order is a prior on the mixture. The posterior chooses the
interpretation; below ``confidence`` the row is left ``ambiguous`` with a null instant, and
``unreadable`` if it most likely is no date of this source's.

Defined results: null, blank and unreadable texts give status ``unreadable`` and a null
instant; a text without zone whose source has no clock zone is unreadable; so is a local
time a clock skips when it is put forward. Where a clock shows a time twice, the later
instant that is not after ``received_at`` counts (the earlier one if both are after it, the
later one if ``received_at`` is null). Repeated rows are treated row by row. Texts of any
length are read whole. Columns named like the outputs are replaced.
"""

from __future__ import annotations

import datetime
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.session import bounded_local

#: Fixed values of the text forms.
BLANKS = " \t\n\r\u000b\u000c 　﻿"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
NAMED_ZONES = {"Z": 0, "UTC": 0, "GMT": 0, "CET": 3600, "CEST": 7200}
RX_CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z$"
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
ZONE = r"(?P<zone>Z|UTC|GMT|CEST|CET|[+-]\d{2}(?::?\d{2})?)"
CLOCK = r"(?P<h>\d{2}):(?P<i>\d{2}):(?P<s>\d{2})"
RX_YEAR_FIRST = re.compile(rf"(?P<y>\d{{4}})([-/])(?P<m>\d{{2}})\2(?P<d>\d{{2}})[T ]{CLOCK}(?:[.,](?P<frac>\d+))? ?{ZONE}?$", re.A | re.I)
RX_BASIC = re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})T(?P<h>\d{{2}})(?P<i>\d{{2}})(?P<s>\d{{2}})(?:[.,](?P<frac>\d+))?{ZONE}?$", re.A | re.I)
RX_YEAR_LAST_TEXT = r"^[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4} "
RX_YEAR_LAST = re.compile(r"(?P<one>\d{1,2})([-/.])(?P<two>\d{1,2})\2(?P<y>\d{4}|\d{2}) (?P<h>\d{1,2})([:.])(?P<i>\d{2})\6(?P<s>\d{2})(?: ?(?P<half>[AP]M))?$", re.A | re.I)
RX_MONTH_NAME = re.compile(rf"(?:(?P<wd>{'|'.join(WEEKDAYS)}), )?(?P<d>\d{{1,2}}) (?P<mon>{'|'.join(MONTHS)}) (?P<y>\d{{4}}) {CLOCK}(?: ?{ZONE})?$", re.A | re.I)
RX_EPOCH = re.compile(r"\d{9,10}$|\d{12,13}$", re.A)
EPOCH_DAY = 719163
DAY_US = 86_400_000_000


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _staged(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns through a generator of one row each, so that the optimizer computes them once and doesn't inline them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def _canonical_us(t: Column) -> Column:
    """Microseconds of a canonical text; null if it names no real date and time."""
    h, mi, sec = (_int(F.substring(t, i, 2)) for i in (12, 15, 18))
    frac = F.substring_index(F.substring(t, 21, 40), "Z", 1)
    us = F.when(frac == "", 0).otherwise(_int(F.rpad(F.substring(frac, 1, 6), 6, "0")))
    days = F.when(F.substring(t, 1, 4) != "0000", F.unix_date(F.substring(t, 1, 10).try_cast("date")))
    return F.when((h < 24) & (mi < 60) & (sec < 60), days.cast("bigint") * DAY_US + (h.cast("bigint") * 3600 + mi * 60 + sec) * 1_000_000 + us)


def _clock_us(y: int, m: int, d: int, h: int, mi: int, sec: int, frac: str = "") -> int | None:
    """Microseconds of clock fields since 1970; None unless they name a real date and time."""
    if h > 23 or mi > 59 or sec > 59:
        return None
    try:
        day = datetime.date(y, m, d).toordinal() - EPOCH_DAY
    except ValueError:
        return None
    return day * DAY_US + (h * 3600 + mi * 60 + sec) * 1_000_000 + int(frac[:6].ljust(6, "0") if frac else 0)


def _offset_us(zone: str) -> int | None:
    """Offset of a zone text in microseconds; None if it is out of range."""
    z = zone.upper()
    if z in NAMED_ZONES:
        return NAMED_ZONES[z] * 1_000_000
    digits = z[1:].replace(":", "")
    hh, mm = int(digits[:2]), int(digits[2:4] or 0)
    return None if hh > 18 or mm > 59 else (-1 if z[0] == "-" else 1) * (hh * 3600 + mm * 60) * 1_000_000


def parse_text(t: str | None) -> tuple[str, int | None, int | None, int | None]:
    """(family, us_a, us_b, offset) of a trimmed text: clock readings, b the month-first one, and the zone's offset.

    A reading is None where the text names no real date and time that way; offset is None without a zone.
    """
    none = ("unreadable", None, None, None)
    if t is None:
        return none
    zone = ""
    if m := RX_YEAR_FIRST.match(t) or RX_BASIC.match(t):
        y, mo, d, h, mi, sec = (int(m[k]) for k in ("y", "m", "d", "h", "i", "s"))
        family, zone = "year_first", m["zone"] or ""
        a, b = _clock_us(y, mo, d, h, mi, sec, m["frac"] or ""), None
    elif m := RX_YEAR_LAST.match(t):
        one, two, h, mi, sec = (int(m[k]) for k in ("one", "two", "h", "i", "s"))
        y = int(m["y"]) + (2000 if len(m["y"]) == 2 else 0)
        if m["half"]:
            if not 1 <= h <= 12:
                return none
            h = h % 12 + (12 if m["half"].upper() == "PM" else 0)
        family = "year_last"
        a, b = _clock_us(y, two, one, h, mi, sec), _clock_us(y, one, two, h, mi, sec)
    elif m := RX_MONTH_NAME.match(t):
        family, zone = "month_name", m["zone"] or ""
        a, b = _clock_us(int(m["y"]), MONTHS.index(m["mon"].lower()) + 1, int(m["d"]), int(m["h"]), int(m["i"]), int(m["s"])), None
        if a is not None and m["wd"] and WEEKDAYS[(a // DAY_US + 3) % 7] != m["wd"].lower():
            return none
    elif RX_EPOCH.match(t):
        return "epoch", int(t) * (1_000 if len(t) >= 12 else 1_000_000), None, 0
    else:
        return none
    if a is None and b is None:
        return none
    if not zone:
        return family, a, b, None
    off = _offset_us(zone)
    return none if off is None else (family, a, b, off)


PARSED = "struct<family string, us_a bigint, us_b bigint, off bigint>"


def _parse_texts(texts: pd.Series) -> pd.DataFrame:
    rows: list = [(None, None, None, None)] * len(texts)
    for i in texts.notna().to_numpy().nonzero()[0]:
        rows[i] = parse_text(texts.iat[i])
    cols = list(zip(*rows)) or [[], [], [], []]
    return pd.DataFrame({"family": pd.Series(cols[0], dtype=object)} | {n: pd.array(c, dtype="Int64") for n, c in zip(("us_a", "us_b", "off"), cols[1:])})


def _parsed(df: DataFrame, text: Column) -> DataFrame:
    """Add __family, __us_a, __us_b and __off; only the texts that aren't canonical go to Python."""
    df = _staged(df, __t=text)
    df = _staged(df, __canon=F.coalesce(F.col("__t").rlike(RX_CANONICAL), F.lit(False)))
    df = df.withColumn("__p", F.pandas_udf(_parse_texts, PARSED)(F.when(~F.col("__canon"), F.col("__t"))))
    return _staged(
        df,
        __family=F.when(F.col("__canon"), F.lit("canonical")).otherwise(F.coalesce("__p.family", F.lit("unreadable"))),
        __us_a=F.when(F.col("__canon"), _canonical_us(F.col("__t"))).otherwise(F.col("__p.us_a")),
        __us_b=F.col("__p.us_b"),
        __off=F.when(F.col("__canon"), F.lit(0).cast("bigint")).otherwise(F.col("__p.off")),
    ).drop("__t", "__canon", "__p")


def _clock_to_instant(local: Column, zone: Column, received_us: Column) -> Column:
    """Instant of a station clock's reading; skipped times give null, repeated ones follow the module's rule."""
    early = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), zone))

    def shows(u: Column) -> Column:
        return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(u), zone)) == local

    late = F.lit(None).cast("bigint")
    for minutes in (120, 60, 30):  # widths by which clocks are put back
        u = early + F.lit(minutes * 60_000_000)
        late = F.when(shows(u), u).otherwise(late)
    real = F.when(shows(early), early)
    return F.when(real.isNull() | late.isNull(), real).when(received_us.isNull() | (late <= received_us), late).otherwise(real)


def is_canonical(ts: Column) -> Column:
    """Apart from blanks around it written as yyyy-MM-ddTHH:mm:ssZ, with or without a fraction after a point."""
    return F.btrim(ts, F.lit(BLANKS)).rlike(RX_CANONICAL)


def _delay_bin(received_us: Column, local: Column, zone: Column) -> Column:
    """Coarse delay between a clock reading and its reception in days, within -60..60; null where either is null."""
    instant = F.coalesce(F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), zone)), local)
    days = F.floor((received_us - instant) / DAY_US + 0.5)
    return F.when(days.isNotNull(), F.least(F.greatest(days, F.lit(-60)), F.lit(60)).cast("int"))


#: The share of texts that only look like a date, before a source's own are seen, and their density beside real arrivals.
STRAY, STRAY_DENSITY = 0.01, 1e-3


def fit_format_mixture(counts: pd.DataFrame, iterations: int = 50, declared_weight: float = 1e9) -> pd.DataFrame:
    """EM over the mixture of day-first, month-first and stray texts of one source: shares pi_a, pi_b and pi_x.

    counts: rows (source, declared, ok_a, ok_b, delay_a, delay_b, n) of distinct evidence;
    their number is bounded by 2 * 2 * 122 * 122 whatever the number of texts. Under the right
    reading a row arrives about at once (late ones some days after, never before); under the
    wrong one the delay is spread out. A declared order is a Dirichlet prior of
    ``declared_weight`` times the texts seen.
    """

    def arrival(delay: float) -> float:
        if delay is None or (isinstance(delay, float) and math.isnan(delay)):
            return 1.0
        return 0.9 if delay == 0 else (0.1 / 60 if delay > 0 else 1e-4 / 60)

    declared, seen = counts["declared"].iloc[0], float(counts["n"].sum())
    alpha = [0.05 + declared_weight * seen * (declared == "DMY"), 0.05 + declared_weight * seen * (declared == "MDY"), STRAY / 10]
    like = [(arrival(da) if oa else 0.0, arrival(db) if ob else 0.0, STRAY_DENSITY) for oa, ob, da, db in zip(counts["ok_a"], counts["ok_b"], counts["delay_a"], counts["delay_b"])]
    weight = counts["n"].tolist()
    pi = [x / sum(alpha) for x in alpha]
    for _ in range(iterations):
        mass = list(alpha)
        for lk, n in zip(like, weight):  # E step
            z = [p * x for p, x in zip(pi, lk)]
            for k in range(3):
                mass[k] += n * z[k] / sum(z)
        new = [x / sum(mass) for x in mass]  # M step
        if max(abs(x - y) for x, y in zip(new, pi)) < 1e-12:
            break
        pi = new
    pi[2] = max(pi[2], STRAY)  # few texts, or a prior's weight, say nothing of strays
    return pd.DataFrame({"source": [counts["source"].iloc[0]], "pi_a": [pi[0]], "pi_b": [pi[1]], "pi_x": [pi[2]]})


def normalize_timestamps(
    points: DataFrame, stations: DataFrame, *, confidence: float = 0.9, max_sources: int = 100_000, non_canonical_only: bool = False
) -> DataFrame:
    """Add ts_us (instant in microseconds), ts_status and ts_posterior to points.

    points needs ts, station_id, received_at; stations needs station_id, clock_zone, date_order.
    ts_status is canonical, resolved, ambiguous or unreadable. With non_canonical_only the rows
    written canonically are left out before anything else is computed.
    """
    st = stations.groupBy(F.col("station_id").alias("__sid")).agg(F.min("clock_zone").alias("__zone"), F.min(F.upper("date_order")).alias("__declared"))
    st, few = bounded_local(st, max_sources)
    pts = points.drop("ts_us", "ts_status", "ts_posterior")
    trimmed = F.btrim(F.col("ts"), F.lit(BLANKS))
    if non_canonical_only:
        pts = pts.filter(~F.coalesce(trimmed.rlike(RX_CANONICAL), F.lit(False)))
    received = F.unix_micros(F.col("received_at").cast("timestamp"))

    year_last = points.select("ts", F.col("station_id").alias("source"), received.alias("__received")).filter(trimmed.rlike(RX_YEAR_LAST_TEXT))
    zones = (F.broadcast(st) if few else st).select(F.col("__sid").alias("source"), "__zone", F.col("__declared").alias("declared"))
    evidence = (
        _parsed(year_last, trimmed)
        .join(zones, "source", "left")
        .select(
            "source",
            "declared",
            F.col("__us_a").isNotNull().alias("ok_a"),
            F.col("__us_b").isNotNull().alias("ok_b"),
            _delay_bin(F.col("__received"), F.col("__us_a"), F.col("__zone")).alias("delay_a"),
            _delay_bin(F.col("__received"), F.col("__us_b"), F.col("__zone")).alias("delay_b"),
        )
        .groupBy("source", "declared", "ok_a", "ok_b", "delay_a", "delay_b")
        .agg(F.count("*").alias("n"))
    )
    mixture, small = bounded_local(evidence.groupBy("source").applyInPandas(lambda pdf: fit_format_mixture(pdf), "source int, pi_a double, pi_b double, pi_x double"), max_sources)
    params = st.join(mixture.withColumnRenamed("source", "__sid"), "__sid", "left")
    params = F.broadcast(params) if small and few else params

    us_a, us_b = F.col("__us_a"), F.col("__us_b")
    year_last_text = F.col("__family") == "year_last"

    def arrival(us: Column) -> Column:
        d = _delay_bin(F.col("__received"), us, F.col("__zone"))
        return F.when(us.isNull(), 0.0).when(d.isNull(), 1.0).when(d == 0, 0.9).when(d > 0, 0.1 / 60).otherwise(1e-4 / 60)

    za, zb = F.coalesce("pi_a", F.lit(0.5)) * arrival(us_a), F.coalesce("pi_b", F.lit(0.5)) * arrival(us_b)
    zx = F.coalesce("pi_x", F.lit(STRAY)) * STRAY_DENSITY
    joined = _parsed(pts.withColumn("__received", received), trimmed).join(params, F.col("station_id") == F.col("__sid"), "left")
    # Readings that name one instant share their likelihood.
    same = F.coalesce(us_a == us_b, F.lit(False))
    joined = _staged(joined, __z=F.when(year_last_text, F.array(F.when(same, za + zb).otherwise(za), F.when(same, 0.0).otherwise(zb), zx)))
    joined = _staged(joined, __post=F.transform("__z", lambda z: z / F.aggregate("__z", F.lit(0.0), lambda acc, v: acc + v)))
    local = F.when(~year_last_text, us_a).when(F.col("__post")[0] >= confidence, us_a).when(F.col("__post")[1] >= confidence, us_b)
    joined = _staged(joined, __local=local)
    instant = F.when(F.col("__family") == "canonical", F.col("__local")).when(F.col("__off").isNotNull(), F.col("__local") - F.col("__off")).when(
        F.col("__local").isNotNull() & F.col("__zone").isNotNull(), _clock_to_instant(F.col("__local"), F.col("__zone"), F.col("__received"))
    )
    joined = _staged(joined, ts_us=instant)
    status = (
        F.when(F.col("ts_us").isNotNull(), F.when(F.col("__family") == "canonical", "canonical").otherwise("resolved"))
        .when(year_last_text & F.col("__local").isNull() & (F.col("__post")[2] < 0.5), "ambiguous")
        .otherwise("unreadable")
    )
    posterior = F.when(F.col("ts_us").isNotNull(), F.when(year_last_text, F.array_max("__post")).otherwise(1.0))
    return (
        joined.withColumn("ts_status", status)
        .withColumn("ts_posterior", posterior.cast("double"))
        .drop("__family", "__us_a", "__us_b", "__off", "__received", "__z", "__post", "__local", "__sid", "__zone", "__declared", "pi_a", "pi_b", "pi_x")
    )


def found_timestamps(points: DataFrame, stations: DataFrame) -> DataFrame:
    """id and epoch_us of the readable rows that are not written canonically."""
    cols = points.select("id", "ts", "station_id", "received_at")
    done = normalize_timestamps(cols, stations, non_canonical_only=True)
    return done.filter(F.col("ts_us").isNotNull()).select(F.col("id"), F.col("ts_us").alias("epoch_us"))
