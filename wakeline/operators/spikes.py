"""Implausible readings (problem 2): a Kalman filter per vessel and field over its own pings.

A local-level state-space model predicts each reading; its scale is the vessel's own behaviour. A reading
whose standardised innovation is above the threshold is flagged and its update withheld. The filter runs
forwards and backwards, and only what leaps from both sides is a spike, so a change that lasts is none.
Stuck sensors show as vanishing innovations: runs of ten or more equal readings that the vessel's other
readings contradict.

Long histories are cut into blocks with a halo of 256 rows on both sides (``blocks``), so a vessel with a third of all
rows is many tasks and a vessel that reports seldom is never cut. All blocks of a batch are filtered in step with
numpy, in pieces that start with a few rows before them; where a piece's state then is not the one the piece before
ended in, it is filtered again from that, until all agree, so the pieces don't show.

Defined results: null readings are never flagged; rows without mmsi or readable time get only the range
test; both copies of a repeated ping are judged by their own readings; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators.blocks import in_blocks
from wakeline.session import partitions_for

#: A vessel's usual noise and pace are measured over half a day, or over more until so many rows are seen.
SPAN_S, SPAN_ROWS = 12 * 3600, 30
RUN = 10
#: Degrees of latitude a second that no vessel makes (60 m/s).
FASTEST_DEG = 60 / 111_195
#: Metres a second: any vessel can make the first, none the second.
ABLE = (8.0, 60.0)
#: Valid ranges.
RANGES = {"sog": (0.0, 102.2), "cog": (0.0, 360.0), "lat": (-90.0, 90.0), "lon": (-180.0, 180.0)}


def _wrap(d: np.ndarray, period: float | None) -> np.ndarray:
    return d if period is None else (d + period / 2) % period - period / 2


def _filter(z, t, start, length, skip, r, q, gate, floor, period, state, out) -> tuple[np.ndarray, np.ndarray]:
    """Run all pieces in step from state, writing their flags into out; the states after skip rows and at the end.

    State per piece: level, variance, its time, the last rejected reading, that one's time, rejected instants that agree.
    """
    order = np.argsort(-length, kind="stable")
    start, length, skip = start[order], length[order], skip[order]
    x, p, last, pend, pend_t, held = state[:, order]
    begun = state[:, order].copy()
    for k in range(int(length.max()) if len(length) else 0):
        m = int(np.searchsorted(-length, -k, side="left"))
        at = np.flatnonzero(skip[:m] == k)
        if k and len(at):
            begun[:, at] = np.stack([x, p, last, pend, pend_t, held])[:, at]
        idx = start[:m] + k
        zz = z[idx]
        ok = ~np.isnan(zz)
        if not ok.any():
            continue
        rr, qq = r[idx], q[idx]
        first = ok & np.isnan(x[:m])
        dt = np.maximum(t[idx] - last[:m], 1.0)
        pp = p[:m] + qq * dt * dt
        s = pp + rr
        innov = _wrap(zz - x[:m], period)
        far = ok & ~first & (np.abs(innov) > np.maximum(gate * np.sqrt(s), floor))
        near_pend = far & (np.abs(_wrap(zz - pend[:m], period)) <= np.maximum(gate * np.sqrt(qq * dt * dt + rr), floor))
        held[:m] = np.where(near_pend, held[:m] + (t[idx] != pend_t[:m]), np.where(far, 1, np.where(ok, 0, held[:m])))
        restart = far & (held[:m] >= 3)
        tell = ok & (k >= skip[:m])
        out[idx[tell]] = np.where(first, -1, (far & ~restart))[tell]
        use = ok & ~first & ~far
        gain = pp / s
        x[:m] = np.where(use, x[:m] + gain * innov, np.where(first | restart, zz, x[:m]))
        if period is not None:
            x[:m] = np.where(use, (x[:m] + period) % period if period == 360.0 else _wrap(x[:m], period), x[:m])
        p[:m] = np.where(use, (1 - gain) * pp, np.where(first | restart, rr, p[:m]))
        last[:m] = np.where(use | first | restart, t[idx], last[:m])
        pend[:m], pend_t[:m] = np.where(far, zz, pend[:m]), np.where(far, t[idx], pend_t[:m])
        held[:m] = np.where(restart, 0, held[:m])
    back = np.argsort(order)
    return begun[:, back], np.stack([x, p, last, pend, pend_t, held])[:, back]


def _differ(a: np.ndarray, b: np.ndarray, r: np.ndarray, period: float | None) -> np.ndarray:
    """States whose filters would go on differently: level by a hundredth of its deviation, variance, time, rejects."""
    level = np.nan_to_num(np.abs(_wrap(a[0] - b[0], period))) > 0.01 * np.sqrt(np.maximum(a[1], b[1]) + r)
    rejects = (a[5] != b[5]) | ((a[5] > 0) & ((a[3] != b[3]) | (a[4] != b[4])))
    return (np.isnan(a[0]) != np.isnan(b[0])) | level | (np.abs(a[1] - b[1]) > 0.02 * (a[1] + r)) | (a[2] != b[2]) | rejects


def kalman_flags(z: np.ndarray, t: np.ndarray, start: np.ndarray, length: np.ndarray, r: np.ndarray, q: np.ndarray, gate: float, floor: float, period: float | None = None) -> np.ndarray:
    """Signed leap flags of one pass: 1 flagged, 0 fitting, -1 where the pass has no earlier reading.

    Per row r is the measurement variance and q the variance gained per squared second. Rejected readings of three
    instants that agree with each other restart the level there. Groups are filtered in pieces (see the module).
    """
    out = np.full(len(z), -1, dtype=np.int8)
    if not len(start):
        return out
    start, length, skip, group = _pieces(start, length)
    fresh = np.tile(np.array([[np.nan], [0], [0], [np.nan], [np.nan], [0]]), len(start))
    begun, ended = _filter(z, t, start, length, skip, r, q, gate, floor, period, fresh, out)
    home, rows = start + skip, length - skip
    follows = np.r_[False, group[1:] == group[:-1]]
    while True:
        ks = np.flatnonzero(follows)
        ks = ks[_differ(begun[:, ks], ended[:, ks - 1], r[home[ks]], period)]
        if not len(ks):
            return out
        begun[:, ks] = ended[:, ks - 1]
        _, ended[:, ks] = _filter(z, t, home[ks], rows[ks], np.zeros(len(ks), dtype=int), r, q, gate, floor, period, begun[:, ks].copy(), out)


def _pieces(start: np.ndarray, length: np.ndarray, rows: int = 256, warm: int = 48) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut long groups into pieces that start with the rows before them: (start, length, rows to skip, group)."""
    count = np.maximum(1, -(-length // rows))
    group = np.repeat(np.arange(len(start)), count)
    part = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)
    home = part * rows
    skip = np.minimum(home, warm)
    return start[group] + home - skip, np.minimum(rows, length[group] - home) + skip, skip, group


def _both_ways(z, t, start, length, r, q, gate, floor, period=None):
    ahead = kalman_flags(z, t, start, length, r, q, gate, floor, period)
    n = len(z)
    rstart = n - (start + length)
    back = kalman_flags(z[::-1], -t[::-1], rstart[::-1], length[::-1], r[::-1], q[::-1], gate, floor, period)[::-1]
    return (ahead == 1) & (back == 1), ((ahead == 1) & (back == -1)) | ((back == 1) & (ahead == -1))


def out_and_back(z: np.ndarray, t: np.ndarray, gid: np.ndarray, flagged: np.ndarray, reach: np.ndarray, floor: float, period: float | None = None) -> np.ndarray:
    """flagged and the readings out of reach from those before and after them, which reach each other.

    reach is what the vessel can make in a second. One or two instants in a row may be out; a repeated ping is
    held against the instants beside it. What is found is left out and the rest is looked through again.
    """
    flagged = flagged.copy()
    for _ in range(4):
        rows = np.flatnonzero(~flagged & ~np.isnan(z))
        if not len(rows):
            break
        x, tt, g, c = z[rows], t[rows], gid[rows], reach[rows]
        first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (tt[1:] != tt[:-1])])
        instant, last = np.cumsum(np.isin(np.arange(len(rows)), first)) - 1, np.r_[first[1:], len(rows)] - 1
        found = np.zeros(len(rows), dtype=bool)
        for back, on in ((1, 1), (1, 2), (2, 1)):
            i, j = instant - back, instant + on
            inside = (i >= 0) & (j < len(first))
            i, j = np.maximum(i, 0), np.minimum(j, len(first) - 1)
            inside &= (g[first[i]] == g) & (g[first[j]] == g)
            # Of the copies beside it the one that lies nearer counts.
            near = lambda k: np.where(np.abs(_wrap(x - x[first[k]], period)) <= np.abs(_wrap(x - x[last[k]], period)), first[k], last[k])
            a, b = near(i), near(j)
            d1, d2, dt1, dt2 = _wrap(x - x[a], period), _wrap(x - x[b], period), tt - tt[a], tt[b] - tt
            away = (np.abs(d1) > c * dt1 + floor) & (np.abs(d2) > c * dt2 + floor) & (d1 * d2 > 0)
            found |= inside & away & (np.abs(_wrap(x[b] - x[a], period)) <= c * (dt1 + dt2) + floor)
        if not found.any():
            break
        flagged[rows[found]] = True
    return flagged


def _metres(lat1, lon1, lat2, lon2):
    a, b, c, d = map(np.radians, (lat1, lon1, lat2, lon2))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * 6_371_000 * np.arcsin(np.sqrt(np.minimum(1, h)))


def _spans(t: np.ndarray, gid: np.ndarray) -> np.ndarray:
    """Number of the stretch over which a row's usual noise is measured: half a day of a group, or SPAN_ROWS rows."""
    half = np.floor(t / SPAN_S)
    first = np.flatnonzero(np.r_[True, (half[1:] != half[:-1]) | (gid[1:] != gid[:-1])]) if len(t) else np.zeros(0, dtype=int)
    ends = np.r_[first[1:], len(t)]
    left = np.searchsorted(gid, gid[first], side="right") - first  # rows of the group from here on
    open_since, starts = 0, []
    for k, (a, b) in enumerate(zip(first, ends)):
        if k == 0 or gid[a] != gid[a - 1] or (a - open_since >= SPAN_ROWS and left[k] >= SPAN_ROWS):
            open_since = a
            starts.append(a)
    mark = np.zeros(len(t), dtype=int)
    mark[starts] = 1
    return np.cumsum(mark) - 1


def _flag(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """Flags by field of whole (mmsi, __block) groups, sorted by group and time."""
    key = pdf[["mmsi", "__block"]].to_numpy()
    edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
    length = np.diff(np.r_[edge, len(key)])
    gid = np.repeat(np.arange(len(edge)), length)
    t = pdf["ts_us"].to_numpy() / 1e6
    span = _spans(t, gid)
    v = {}
    for f, (lo, hi) in RANGES.items():
        x = pdf[f].to_numpy(dtype=float, na_value=np.nan).copy()
        x[~((x >= lo) & ((x < hi) if f == "cog" else (x <= hi)))] = np.nan
        v[f] = x

    def per_span(x: np.ndarray, qtl: float) -> np.ndarray:
        by = pd.Series(x).groupby(span).quantile(qtl).fillna(0).to_numpy()
        return by[span]

    def step(x: np.ndarray, period=None) -> np.ndarray:
        """Change from the group's previous reading that is not null."""
        prev = pd.Series(x).groupby(gid).ffill().groupby(gid).shift().to_numpy()
        return np.abs(_wrap(x - prev, period))

    def beside(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group's readings just before and after that are not null."""
        g = pd.Series(x)
        return g.groupby(gid).ffill().groupby(gid).shift().to_numpy(), g.groupby(gid).bfill().groupby(gid).shift(-1).to_numpy()

    seen_before = lambda x: beside(np.where(np.isnan(x), np.nan, t))[0]
    seen_after = lambda x: beside(np.where(np.isnan(x), np.nan, t))[1]
    dt = np.r_[np.nan, np.diff(t)]
    dt[edge] = np.nan
    flags = {}
    told = pd.Series(v["sog"]).groupby(gid).rolling(5, center=True, min_periods=1).median().to_numpy() / 1.943844
    narrow = np.maximum(np.cos(np.radians(np.nan_to_num(v["lat"]))), 0.01)
    for f, period in (("lat", None), ("lon", 360.0)):
        d = step(v[f], period)
        rate = per_span(d / np.maximum(dt, 20), 0.85) if len(d) else d
        # What the vessel usually makes, or says it makes now: after rest a step of one and a half of it is no leap (gate 4 of 1.5 x this speed).
        speed = np.clip(np.fmax(rate, 0.25 * told / 111_195 / (1.0 if f == "lat" else narrow)), 3e-6, 6e-4)
        both, single = _both_ways(v[f], t, edge, length, np.full(len(t), 1e-8), (1.5 * speed) ** 2, 4.0, 0.02, period)
        # With readings on one side only, a leap must be faster than any vessel.
        old, new = beside(v[f])
        limit = FASTEST_DEG / (1.0 if f == "lat" else narrow)
        fast = np.fmax(np.abs(_wrap(v[f] - old, period)) / np.maximum(t - seen_before(v[f]), 1), np.abs(_wrap(new - v[f], period)) / np.maximum(seen_after(v[f]) - t, 1)) > limit
        flags[f] = both | (single & fast)
    # A fast vessel's gate is wide; what is too far from the readings on both sides for its speed is found against these.
    # The slower of the steps to and from a reading tells the usual speed: a leap spoils one reading's, not two.
    pace = _metres(*(beside(v[f])[0] for f in ("lat", "lon")), v["lat"], v["lon"]) / np.maximum(dt, 20)
    pace = np.fmin(pace, np.r_[np.where(gid[1:] == gid[:-1], pace[1:], np.nan), np.nan]) if len(t) else pace
    usual = per_span(pace, 0.85)
    able = np.clip(1.5 * np.fmax(usual, told), *ABLE) / 111_195
    for f, period in (("lat", None), ("lon", 360.0)):
        reach = able if f == "lat" else able / narrow
        flags[f] = out_and_back(v[f], t, gid, flags[f], reach, 0.02, period)
    lat, lon = np.where(flags["lat"], np.nan, v["lat"]), np.where(flags["lon"], np.nan, v["lon"])
    g = pd.DataFrame({"lat": lat, "lon": lon, "t": np.where(np.isnan(lat + lon), np.nan, t)})
    before, after = g.groupby(gid).ffill().groupby(gid).shift(), g.groupby(gid).bfill().groupby(gid).shift(-1)
    here_lat, here_lon = g["lat"].fillna(before["lat"]), g["lon"].fillna(before["lon"])
    d1, d2 = _metres(before["lat"], before["lon"], here_lat, here_lon), _metres(here_lat, here_lon, after["lat"], after["lon"])
    around = np.maximum((t - before["t"]).fillna(0) + (after["t"] - t).fillna(0), 1.0)
    implied = ((d1.fillna(0) + d2.fillna(0)) / around * 1.943844).to_numpy()
    known = (d1.notna() | d2.notna()).to_numpy()

    ds = step(v["sog"])
    noise = np.maximum(per_span(ds, 0.7), 0.3)
    leap, single = _both_ways(v["sog"], t, edge, length, noise**2, np.full(len(t), 1e-5), 4.5, 4.0)
    flags["sog"] = (leap | (single & (np.abs(v["sog"] - implied) > 15))) & (~known | (np.abs(v["sog"] - implied) > np.maximum(4.0, 0.3 * implied)))
    dc = step(v["cog"], 360.0)
    cn = np.clip(per_span(np.where(implied > 2, dc, np.nan), 0.7), 2.0, 12.0)
    leap, _ = _both_ways(v["cog"], t, edge, length, cn**2, np.full(len(t), 2e-3), 4.0, 28.0, 360.0)
    # The readings on both sides must agree with each other: at rest closely, under way up to a turn.
    old, new = beside(v["cog"])
    apart, rise = np.abs(_wrap(new - old, 360.0)), np.abs(_wrap(v["cog"] - old, 360.0))
    calm = pd.Series(np.where(np.isnan(dc), 0, dc)).rolling(9, center=True, min_periods=1).median().to_numpy()
    under_way = (implied > 2) & (np.nan_to_num(v["sog"], nan=9.0) > 1)
    flags["cog"] = leap & np.where(under_way, apart <= np.maximum(25.0, 0.5 * rise), (apart <= 15.0) & (calm < 8.0))

    # Vanishing innovations: runs of equal readings.
    mad = lambda s, by: (s - s.groupby(by).transform("median")).abs().groupby(by).transform("median")
    for f in RANGES:
        rows = np.flatnonzero(~np.isnan(v[f]) & ~flags[f])
        if not len(rows):
            continue
        x, gg, tt = v[f][rows], gid[rows], t[rows]
        new = np.r_[True, (x[1:] != x[:-1]) | (gg[1:] != gg[:-1])]
        run = np.cumsum(new) - 1
        fresh = np.r_[True, (tt[1:] != tt[:-1])] | new
        n = np.bincount(run, weights=fresh)
        sel = rows[n[run] >= RUN]
        if not len(sel):
            continue
        by = run[n[run] >= RUN]
        s = pd.DataFrame({"lat": lat[sel], "lon": lon[sel], "sog": np.where(flags["sog"][sel], np.nan, v["sog"][sel]), "cog": v["cog"][sel], "imp": implied[sel]})
        moves = ((mad(s["lat"], by) > 0) | (mad(s["lon"], by) > 0)).to_numpy()
        pace = s["imp"].groupby(by).transform("median").to_numpy()
        if f == "sog":
            stuck = (v["sog"][sel] > 0.5) | (moves & (pace > 2.0))
        elif f == "cog":
            stuck = moves
        else:
            other = mad(s["lon" if f == "lat" else "lat"], by).to_numpy() > 1e-3
            stuck = ((s["sog"].groupby(by).transform("median") > 2) & (mad(s["cog"], by) > 0.3)).to_numpy() | other
        flags[f] = flags[f].copy()
        flags[f][sel[stuck]] = True
    return flags


def _whole_groups(batches: Iterator[pd.DataFrame], least: int = 40_000) -> Iterator[pd.DataFrame]:
    """Join batches so that every (mmsi, __block) group is whole."""
    kept: list[pd.DataFrame] = []
    for pdf in batches:
        kept.append(pdf)
        if sum(map(len, kept)) >= least:
            both = pd.concat(kept, ignore_index=True)
            same = (both["mmsi"] == both["mmsi"].iat[-1]) & (both["__block"] == both["__block"].iat[-1])
            cut = len(both) - int(same.sum())
            if cut:
                yield both.iloc[:cut]
            kept = [both.iloc[cut:]]
    if kept and sum(map(len, kept)):
        yield pd.concat(kept, ignore_index=True)


def flag_readings(points: DataFrame) -> DataFrame:
    """(id, field) of each implausible reading; points needs id, mmsi, ts_us, lat, lon, sog, cog."""
    cols = points.select("id", "mmsi", "ts_us", *RANGES)
    outside = [F.when((F.col(f) < lo) | ((F.col(f) >= hi) if f == "cog" else (F.col(f) > hi)) | F.isnan(f), F.lit(f)) for f, (lo, hi) in RANGES.items()]
    ranged = cols.select("id", F.explode(F.array_compact(F.array(*outside))).alias("field"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(batches):
            pdf = pdf.reset_index(drop=True)
            flags, home, ids = _flag(pdf), pdf["__home"].to_numpy(), pdf["id"].to_numpy()
            yield pd.concat([pd.DataFrame({"id": ids[home & flags[f]], "field": f}) for f in RANGES], ignore_index=True)

    leaps = _ordered(cols, partitions_for(points)).mapInPandas(run, "id bigint, field string")
    return ranged.unionByName(leaps).distinct()


def _ordered(cols: DataFrame, partitions: int) -> DataFrame:
    return in_blocks(cols).repartition(partitions, "mmsi", "__block").sortWithinPartitions("mmsi", "__block", "ts_us", "id")


def clean_positions(points: DataFrame) -> DataFrame:
    """Rows in blocks (id, mmsi, ts_us, lat, lon, __block, __home) whose lat and lon are neither null, out of range nor flagged."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(batches):
            pdf = pdf.reset_index(drop=True)
            flags = _flag(pdf)
            fine = ~(flags["lat"] | flags["lon"])
            for f in ("lat", "lon"):
                x = pdf[f].to_numpy(dtype=float, na_value=np.nan)
                fine &= (x >= RANGES[f][0]) & (x <= RANGES[f][1])
            yield pdf.loc[fine, ["id", "mmsi", "ts_us", "lat", "lon", "__block", "__home"]]

    parts = partitions_for(points)
    kept = _ordered(points.select("id", "mmsi", "ts_us", *RANGES), parts).mapInPandas(run, "id bigint, mmsi bigint, ts_us bigint, lat double, lon double, __block bigint, __home boolean")
    return kept.repartition(parts, "mmsi", "__block")
