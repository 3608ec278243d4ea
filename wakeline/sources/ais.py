"""AIS inputs: CSV scan, header aliases, mixed track inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.lookups import CANONICAL, HEADER_ALIASES


def canonical_name(header: str) -> str:
    k = header.lstrip("﻿").strip().lower().replace(" ", "_")
    return HEADER_ALIASES.get(k, k)


def canonicalise(df: DataFrame) -> DataFrame:
    """Rename headers to canonical columns; if two map to one name the later column wins."""
    last = {}
    for i, c in enumerate(df.columns):
        last[canonical_name(c)] = i
    src = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return src.select(*[F.col(f"_c{i}").alias(n) for n, i in last.items()])


def read_ais_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header row, every field text, canonical names. A file without any row is an error when it is cleaned."""
    df = spark.read.option("header", True).option("inferSchema", False).option("encoding", "UTF-8").csv(path)
    if not df.columns:
        raise ValueError(f"no header row in {path}")
    return canonicalise(df)


def with_canonical_columns(df: DataFrame) -> DataFrame:
    """Add the canonical columns that the input lacks as nulls."""
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in CANONICAL if c not in df.columns])


def union_tracks(frames: list[DataFrame]) -> DataFrame:
    """Bag union of record groups. A group may be flat rows or rows holding a `records` array of structs."""
    if not frames:
        raise ValueError("no track input")
    nested = ["records" in f.columns for f in frames]
    if any(nested) and not all(nested):
        raise ValueError("cannot mix record groups with flat records")
    flat = [f.select(F.explode("records").alias("r")).select("r.*") if n else f for f, n in zip(frames, nested)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(canonicalise, flat))
