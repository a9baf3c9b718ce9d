"""Distances, boxes and other scalar expressions over columns. Null in, null out, unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sphere's radius and the kilometres of a degree of latitude and of a knot.
EARTH_KM, DEGREE_KM, KNOT_KMH = 6371.0, 111.32, 1.852


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; clamped, so antipodes give half the circumference and no NaN."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h))) * (2 * EARTH_KM)  # least() would skip a null


def local_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance at the middle latitude, whose cosine is 0.10 at least."""
    shrink = F.greatest(F.lit(0.10), F.cos(F.radians((lat1 + lat2) / 2)))
    return F.hypot((lat2 - lat1) * DEGREE_KM, (lon2 - lon1) * DEGREE_KM * shrink)


def allowed_km(sog1: Column, sog2: Column, hours: Column, margin: float = 1.2, growth: float = 0.3) -> Column:
    """How far a vessel may get in hours at the greater of two speeds (a null one is skipped), 50 m at least."""
    km = F.greatest(sog1, sog2) * KNOT_KMH * hours * (margin * (1.0 + growth * hours))
    return F.greatest(km, F.lit(0.05))


def heading_change(before: Column, after: Column) -> Column:
    """Turn between two headings as a share of a half circle, 0 to 1."""
    d = F.abs(after - before)
    return F.least(d, 360.0 - d) / 180.0


def in_box(lat: Column, lon: Column, t: Column, box) -> Column:  # noqa: ANN001
    """Inclusive on all six bounds; box maps bound names to columns or numbers."""
    return lat.between(box["lat_min"], box["lat_max"]) & lon.between(box["lon_min"], box["lon_max"]) & t.between(box["t_start"], box["t_end"])


def budget(n: Column, ratio: float) -> Column:
    """Points to keep of n: the ratio's share rounded up, two at least, n at most."""
    return F.least(n, F.greatest(F.lit(2), F.ceil(n * F.lit(float(ratio))))).cast("bigint")


def unit_interval(text: Column) -> Column:
    """A text's place in [0, 1) by the first 8 bytes of its SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("double") / F.lit(2.0**64)


def clean_unit(x: Column, default: float = 0.0) -> Column:
    """x held to [0, 1]; null, NaN and infinite values give default."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(default))


def share(x: Column) -> Column:
    """Percentages above 1 as fractions."""
    return F.when(x > 1, x / 100.0).otherwise(x)


def hh_mm(t: Column) -> Column:
    """Clock of a time in seconds."""
    m = F.floor(F.pmod(t, F.lit(86_400)) / 60)
    return F.format_string("%02d:%02d", F.floor(m / 60), F.pmod(m, F.lit(60)))


def clock_features(t: Column) -> tuple[Column, Column]:
    angle = F.pmod(t, F.lit(86_400)) / 86_400.0 * F.lit(2.0) * F.pi()
    return F.sin(angle), F.cos(angle)


def lenient_int(text: Column) -> Column:
    """'12.0' is 12; blank and unreadable texts give null."""
    return F.btrim(text).try_cast("double").try_cast("bigint")


def lenient_double(text: Column) -> Column:
    return F.btrim(text).try_cast("double")


def lenient_text(text: Column) -> Column:
    return F.nullif(F.btrim(text), F.lit(""))


def first_timestamp(text: Column) -> Column:
    """dd/MM/yyyy HH:mm:ss, yyyy-MM-dd HH:mm:ss, or what Spark reads by itself; the first that succeeds, else null."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("dd/MM/yyyy HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text))


def distance_text(km: Column) -> Column:
    """Metres below a kilometre, else kilometres with two decimals."""
    return F.when(km < 1, F.format_string("%.0f m", km * 1000)).otherwise(F.format_string("%.2f km", km))


def rectangle_ring(box) -> Column:  # noqa: ANN001
    """Closed ring of (lon, lat) corners, counter-clockwise from the south-west."""
    corner = lambda x, y: F.array(box[x].cast("double"), box[y].cast("double"))
    return F.array(corner("lon_min", "lat_min"), corner("lon_max", "lat_min"), corner("lon_max", "lat_max"), corner("lon_min", "lat_max"), corner("lon_min", "lat_min"))
