"""Banding, labels and small scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline import config as C
from wakeline.functions.geo import _c, clip
from wakeline.functions.lookups import FLAG_ROWS, NAV_STATUS, TYPE_RANGES


def chain(cases, default) -> Column:
    """First true condition wins."""
    out = None
    for cond, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def finite(x) -> Column:
    """Number or null: text that is no number, NaN and infinities become null."""
    d = _c(x).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def type_group(code) -> Column:
    c = finite(code).try_cast("int")
    return chain([(c.between(lo, hi), name) for lo, hi, name in TYPE_RANGES], "UNKNOWN")


def nav_label(code) -> Column:
    c = _c(code).try_cast("int")
    names = F.create_map(*[F.lit(v) for kv in NAV_STATUS.items() for v in kv])
    return F.when(c.isNull(), "Unknown").otherwise(
        F.coalesce(F.try_element_at(names, c), F.concat(F.lit("Status "), c.cast("string"))))


def with_flag(df: DataFrame, mmsi: str = "mmsi", out: str = "flag") -> DataFrame:
    """Flag state from the first three digits (a fixed table of fewer than 200 rows, broadcast)."""
    table = df.sparkSession.createDataFrame(FLAG_ROWS, "_mid string, _flag string")
    return (df.withColumn("_mid", F.substring(F.col(mmsi).cast("string"), 1, 3))
            .join(F.broadcast(table), "_mid", "left")
            .withColumn(out, F.coalesce("_flag", F.lit("Unknown"))).drop("_mid", "_flag"))


def score_band(score) -> Column:
    s = _c(score)
    return chain([(s >= t, n) for n, t in C.SCORE_BANDS] + [(s < C.MIN_SCORE, "CLEARED")], "BACKGROUND_TRAFFIC")


def confidence_band(p) -> Column:
    return chain([(_c(p) >= t, n) for n, t in C.CONFIDENCE_BANDS], "REJECTED")


def severity(score, threshold: float = C.ANOMALY_THRESHOLD) -> Column:
    ratio = _c(score) / threshold
    return chain([(_c(score) < threshold, "normal"), (ratio >= C.SEVERITY_CRITICAL, "critical"),
                  (ratio >= C.SEVERITY_HIGH, "high")], "elevated")


def douglas(wind_ms) -> Column:
    return chain([(_c(wind_ms) < lim, s) for lim, s in C.DOUGLAS], 9)


def deviation_verdict(km) -> Column:
    d = _c(km)
    return chain([(d.isNull(), F.lit(None).cast("string")), (d <= C.MEDIAN_ERR_KM, "expected"),
                  (d <= C.P90_ERR_KM, "unremarkable"), (d <= 3 * C.P90_ERR_KM, "deviated")], "sharp_manoeuvre")


def detectability(u10) -> Column:
    """Slick visibility by wind: too calm or too rough hides oil."""
    w = _c(u10)
    return chain([(w < 2.0, "POOR"), (w < 3.0, "MARGINAL"), (w <= 10.0, "OPTIMAL"), (w <= 13.0, "MARGINAL")], "POOR")


def cpa_score(cpa_km, radius_km=C.SEARCH_RADIUS_KM) -> Column:
    d, r = _c(cpa_km), _c(radius_km)
    return F.when(d.isNull() | (d >= r), F.lit(0.0)).otherwise(clip(1.0 - F.sqrt(d / r), 0.0, 1.0))


def vessel_prior(group) -> Column:
    g = F.upper(F.coalesce(_c(group), F.lit("UNKNOWN")))
    return chain([(g == k, v) for k, v in C.TYPE_PRIOR.items()], C.TYPE_PRIOR_DEFAULT)


def anomaly_unit_score(peak, threshold: float = C.ANOMALY_THRESHOLD) -> Column:
    p = _c(peak)
    return F.when(p.isNull() | (p <= 0), F.lit(0.0)).otherwise(
        clip(F.log1p(p / threshold) / F.log1p(F.lit(6.0)), 0.0, 1.0))
