"""Ping cleaning: time parsing, reject classes, domain checks, de-duplication, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline import config as C
from wakeline.functions.geo import _c
from wakeline.functions.labels import chain, finite

# Accepted text patterns after ISO-8601 (day-first only with dashes).
TIME_PATTERNS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss",
                 "dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd HH:mm"]
REJECTS = ["no_mmsi", "time", "coords", "null_island", "duplicate"]


def _shape(pattern: str) -> str:
    """What every text that the pattern reads looks like. Only such texts are parsed, as a failed attempt costs many times a match."""
    return "(?i)^" + pattern.replace("'", "").replace("yyyy", r"[+-]?\d{4,}").replace("MM", r"\d{2}").replace("dd", r"\d{2}").replace(
        "HH", r"\d{2}").replace("mm", r"\d{2}").replace("ss", r"\d{2}") + "$"


def parse_ts(col, dtype: str = "string") -> Column:
    """Instant from text, a number (epoch s, or ms above 1e11) or a timestamp; unreadable -> null."""
    c = _c(col)
    if dtype in ("timestamp", "timestamp_ntz"):
        return c.cast("timestamp")
    if dtype in ("int", "bigint", "smallint", "tinyint", "float", "double") or dtype.startswith("decimal"):
        v = c.cast("double")
        s = F.when(v > 1e11, v / 1000.0).otherwise(v)
        return F.when(F.abs(s) < 2.5e11, F.timestamp_micros(F.round(s * 1e6).cast("bigint")))
    t = F.trim(c)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"),
                 F.try_to_timestamp(F.translate(t, ",", ".")))
    return F.coalesce(iso, *[F.when(t.rlike(_shape(p)), F.try_to_timestamp(t, F.lit(p))) for p in TIME_PATTERNS])


def classify(ais: DataFrame, drop_null_island: bool = True) -> DataFrame:
    """Typed pings plus `reject_reason` (first failing row test, null if usable; duplicates come later)."""
    types = dict(ais.dtypes)
    mmsi = finite("mmsi").try_cast("bigint")
    out = (ais.withColumn("mmsi", mmsi)
           .withColumn("ts", parse_ts("timestamp", types["timestamp"]))
           .withColumn("latitude", finite("latitude")).withColumn("longitude", finite("longitude")))
    lat, lon = F.col("latitude"), F.col("longitude")
    tests = [(F.col("mmsi").isNull(), "no_mmsi"), (F.col("ts").isNull(), "time"),
             (lat.isNull() | lon.isNull() | (F.abs(lat) > 90) | (F.abs(lon) > 180), "coords")]
    if drop_null_island:
        tests.append(((F.abs(lat) < 1e-6) & (F.abs(lon) < 1e-6), "null_island"))
    return out.withColumn("reject_reason", chain(tests, F.lit(None).cast("string")))


def null_out_of_domain(ais: DataFrame) -> DataFrame:
    """Impossible speed, course, heading or turn rate become null; the row stays."""
    have = set(ais.columns)
    rules = {"sog": lambda v: v.between(0.0, C.SOG_CAP_KN), "cog": lambda v: (v >= 0.0) & (v < 360.0),
             "heading": lambda v: (v >= 0.0) & (v < 360.0), "rot": lambda v: v.between(-128.0, 128.0)}
    return ais.select(*[
        F.when(rules[c](finite(c)), finite(c)).alias(c) if c in rules
        else finite(c).alias(c) if c in ("length", "width", "draft") and c in have else F.col(c)
        for c in ais.columns])


def mark_duplicates(ais: DataFrame, order: str = "seq") -> DataFrame:
    """Usable pings after the first of each (mmsi, instant, position to 6 decimals) are marked duplicate.

    The window key is one instant of one vessel at one place; the row holding the smallest `order` is kept.
    """
    key = [F.col("mmsi"), F.col("ts"), F.round("latitude", 6), F.round("longitude", 6), F.col("reject_reason")]
    rn = F.row_number().over(W.partitionBy(*key).orderBy(order))
    usable = ais.filter(F.col("reject_reason").isNull())
    bad = ais.filter(F.col("reject_reason").isNotNull())
    marked = usable.withColumn("_rn", rn).withColumn(
        "reject_reason", F.when(F.col("_rn") > 1, F.lit("duplicate"))).drop("_rn")
    return marked.unionByName(bad)


def dedup(ais: DataFrame, order: str = "seq") -> DataFrame:
    """First row per key. An aggregate, not a window, so copies of one ping are merged before the shuffle."""
    rest = [c for c in ais.columns if c != order]
    key = [F.col("mmsi").alias("_k1"), F.col("ts").alias("_k2"), F.round("latitude", 6).alias("_k3"),
           F.round("longitude", 6).alias("_k4")]
    best = ais.groupBy(*key).agg(F.min_by(F.struct(order, *rest), F.col(order)).alias("r"))
    return best.select("r.*").select(*ais.columns)


def usable(ais: DataFrame, drop_null_island: bool = True) -> DataFrame:
    """Row-level cleaning only: a narrow pass, no shuffle. Enough for track building, whose one-fix-per-instant step
    also removes exact copies."""
    ok = classify(ais, drop_null_island).filter(F.col("reject_reason").isNull())
    return null_out_of_domain(ok.drop("reject_reason", "timestamp"))


def clean(ais: DataFrame, order: str = "seq", drop_null_island: bool = True) -> DataFrame:
    """Usable, de-duplicated pings with out-of-domain readings nulled."""
    return dedup(usable(ais, drop_null_island), order)


def clean_report(ais: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows in, kept, dropped by reason. Rejected rows fold to one key per reason, copies to one per ping, map-side."""
    c = classify(ais)
    ok = F.col("reject_reason").isNull()
    fold = [F.when(ok, e).alias(n) for n, e in (("_m", F.col("mmsi")), ("_t", F.col("ts")),
                                               ("_a", F.round("latitude", 6)), ("_b", F.round("longitude", 6)))]
    per = c.groupBy(*keys, "reject_reason", *fold).agg(F.count(F.lit(1)).alias("_n"))
    count_if = lambda cond, e: F.coalesce(F.sum(F.when(cond, e)), F.lit(0))
    return per.groupBy(*keys).agg(
        F.sum("_n").alias("input"), count_if(ok, F.lit(1)).cast("long").alias("kept"),
        *[count_if(F.col("reject_reason") == r, F.col("_n")).alias(f"dropped_{r}") for r in REJECTS[:-1]],
        count_if(ok, F.col("_n") - 1).alias("dropped_duplicate"),
        F.count_distinct(F.when(ok, F.col("_m"))).alias("vessels"))
