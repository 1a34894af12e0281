"""Column functions of the monitoring formulas; every one gives null for null unless it says otherwise."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of the linear scores.
BOUNDS = {"velocity": (0.5, 2.0), "step": (0.5, 2.0), "los": (20.0, 60.0), "slope": (10.0, 20.0), "rain_7d": (20.0, 60.0), "rain_30d": (60.0, 150.0), "pm2_5": (15.0, 35.0)}
#: Weights of the motion score and of the whole score.
MOTION = {"velocity": 0.40, "step": 0.35, "los": 0.25}
WEIGHTS = {"motion": 0.45, "terrain": 0.15, "hydroclimate": 0.25, "atmosphere": 0.15}
#: Least score of each class above Low.
CLASSES = {"Critical": 80.0, "High": 60.0, "Moderate": 35.0}
#: Concentration bounds of PM2.5 with (index low, index high, concentration low, concentration high).
AQI = ((12.0, 0, 50, 0.0, 12.0), (35.4, 51, 100, 12.1, 35.4), (55.4, 101, 150, 35.5, 55.4))
AQI_CAP = 200.0
#: Wavelengths (nm) of the bands of the near-infrared regression.
VNIR_NM = (443.0, 490.0, 740.0, 783.0, 842.0, 865.0)
#: The thresholds of water pixels.
WATER = {"shadow": 0.9, "slope": 1.0, "intercept": -500.0, "swir": 1000.0, "angle": 0.15, "blue": 2000.0}


def missing(value: Column) -> Column:
    """NaN is a missing value: null."""
    return F.nanvl(value, F.lit(None).cast("double"))


def linear_score(x: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high, linear between."""
    return F.when(x.isNotNull(), F.greatest(F.least((x - low) / (high - low + 1e-12), F.lit(1.0)), F.lit(0.0)))


def motion_score(velocity: Column, step: Column, los: Column) -> Column:
    parts = {"velocity": velocity, "step": F.abs(step), "los": F.abs(los)}
    return reduce(lambda a, b: a + b, [F.lit(MOTION[k]) * linear_score(x, *BOUNDS[k]) for k, x in parts.items()])


def risk_score(motion: Column, terrain: Column, hydroclimate: Column, atmosphere: Column) -> Column:
    """0 to 100; a null component makes it null."""
    parts = {"motion": motion, "terrain": terrain, "hydroclimate": hydroclimate, "atmosphere": atmosphere}
    return F.lit(100.0) * reduce(lambda a, b: a + b, [F.lit(WEIGHTS[k]) * x for k, x in parts.items()])


def risk_class(score: Column) -> Column:
    """Low, Moderate, High or Critical; Low for null."""
    return reduce(lambda rest, c: F.when(score >= c[1], c[0]).otherwise(rest), sorted(CLASSES.items(), key=lambda c: c[1]), F.lit("Low"))


def risk_rank(name: Column) -> Column:
    """0 to 3, for sorting classes."""
    return F.array_position(F.array(*map(F.lit, ("Low", "Moderate", "High", "Critical"))), name).cast("int") - 1


def raster_risk(velocity: Column, step: Column, los: Column, slope: Column) -> Column:
    """Points of a map cell: 3 for velocity, 3 for step, 2 for displacement, 1 for slope; null gives none."""
    tests = ((velocity, 2.0, 3), (step, 10.0, 3), (los, 50.0, 2), (slope, 15.0, 1))
    return reduce(lambda a, b: a + b, [F.when(F.abs(x) >= least, points).otherwise(0) for x, least, points in tests])


def us_aqi(pm2_5: Column) -> Column:
    """Simplified index of fine dust; null and high values give the cap, negative ones 0."""
    rest: Column = F.lit(AQI_CAP)
    for most, low, high, begin, end in reversed(AQI):
        rest = F.when(pm2_5 <= most, F.lit((high - low) / (end - begin)) * (pm2_5 - begin) + low).otherwise(rest)
    return F.when(pm2_5 < 0, 0.0).otherwise(rest)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def spectral_angle(spectrum: Column, reference: Column) -> Column:
    """Radians between two spectra (arrays of the same length); pi/2 if one is all zero."""
    norm = F.sqrt(dot(spectrum, spectrum)) * F.sqrt(dot(reference, reference))
    cosine = F.when(norm != 0, dot(spectrum, reference) / norm).otherwise(0.0)
    return F.when(norm.isNotNull(), F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))))


def least_angle(spectrum: Column, references: Sequence[Sequence[float]]) -> Column:
    """Smallest spectral angle to any reference."""
    return F.array_min(F.array(*[spectral_angle(spectrum, F.array(*[F.lit(float(x)) for x in r])) for r in references]))


def shadow_index(bands: Sequence[Column]) -> Column:
    """n-th root of the product of (1 - reflectance) over n bands scaled by 10000, 0 if the product is negative."""
    product = reduce(lambda a, b: a * b, [1.0 - b.cast("double") / 10000.0 for b in bands])
    return F.when(product.isNotNull(), F.pow(F.greatest(product, F.lit(0.0)), 1.0 / len(bands)))


def band_regression(bands: Sequence[Column], wavelengths: Sequence[float] = VNIR_NM) -> tuple[Column, Column]:
    """(slope, intercept) of the least-squares line of reflectance over wavelength, in closed form."""
    mean = sum(wavelengths) / len(wavelengths)
    spread = sum((x - mean) ** 2 for x in wavelengths)
    slope = reduce(lambda a, b: a + b, [b.cast("double") * ((x - mean) / spread) for b, x in zip(bands, wavelengths, strict=True)])
    level = reduce(lambda a, b: a + b, [b.cast("double") for b in bands]) / len(bands)
    return slope, level - slope * mean


def ratio_index(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), null where the sum is 0: NDVI, NDWI, NDSI and the like."""
    return (a - b) / F.nullif(a + b, F.lit(0.0))


def phasor_angle(phase: Column) -> Column:
    """Aggregate: the angle of the mean unit phasor."""
    return F.atan2(F.avg(F.sin(phase)), F.avg(F.cos(phase)))


def degrees_to_metres(dlat: Column, dlon: Column, lat: Column) -> tuple[Column, Column]:
    """(north, east) metres of a difference in degrees."""
    return dlat * 111320.0, dlon * 111320.0 * F.cos(F.radians(lat))


def slope_degrees(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))


def utm_zone(lon: Column) -> Column:
    return F.floor((lon + 180.0) / 6.0).cast("int") + 1


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat < 0, 32700).otherwise(32600) + utm_zone(lon)


def utm_coordinates(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """(easting, northing) in a UTM zone on WGS84, by the transverse Mercator series to the sixth order."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi = F.radians(lat)
    lam = F.radians(lon - (zone * 6 - 183))
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c, w = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2), lam * F.cos(phi)
    arc = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = k0 * n * (w + (1 - t + c) * F.pow(w, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(w, 5) / 120) + 500000.0
    rise = w * w / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(w, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(w, 6) / 720
    north = k0 * (arc + n * F.tan(phi) * rise) + F.when(lat < 0, 10000000.0).otherwise(0.0)
    return east, north


def los_mm(phase: Column, mm_per_radian: float) -> Column:
    """Displacement of a wrapped phase along the line of sight."""
    return phase * mm_per_radian


def cell_key(lat: Column, lon: Column, digits: int = 6) -> Column:
    """lat_lon as a text with fixed digits; null without both."""
    part = lambda c: F.regexp_replace(F.format_number(c, digits), ",", "")
    return F.concat(part(lat), F.lit("_"), part(lon))
