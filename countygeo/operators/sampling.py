"""Pool building: filtered scan, reservoir, thinning, point table, histogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countygeo.functions import geo
from countygeo.functions import scalar as sc
from countygeo.operators.ranking import first_per_key, top_k_per_key


def scan_panos(panos: DataFrame) -> DataFrame:
    """Usable rows of the master table, four columns (SRC1)."""
    return panos.where(
        (F.col("kind") == "normal")
        & F.col("adcode").isNotNull()
        & F.col("adcode_status").isin("local", "api")
        & F.col("lng").isNotNull()
        & F.col("lat").isNotNull()
    ).select("panoid", "lng", "lat", "adcode")


def exclude_prefixes(df: DataFrame, prefixes: Sequence[str] = sc.EXCLUDE_PREFIXES) -> DataFrame:
    """Drop ids of excluded vehicles (SRC2)."""
    return df.where(~sc.has_excluded_prefix("panoid", prefixes))


def first_rows(df: DataFrame, n: int, order: Sequence[str] = ("panoid",)) -> DataFrame:
    """Trial run on the first ``n`` rows of an explicit order (SRC3)."""
    return df.orderBy(*order).limit(n)


def candidates(scan: DataFrame) -> DataFrame:
    """Scan rows whose id parses, shaped as pool rows (FIL1, SC1, SC8, SC17)."""
    return scan.withColumn("__id", sc.parse_panoid("panoid")).where(F.col("__id").isNotNull()).select(
        "panoid", "adcode", sc.round6("lng").alias("lng"), sc.round6("lat").alias("lat"),
        sc.part_of("adcode").alias("part"), "__id.*")


def reservoir(df: DataFrame, per_county: int = sc.PER_COUNTY, focus: int = sc.FOCUS_PER_COUNTY,
              factor: int = sc.RESERVOIR_FACTOR, seed: int = sc.SEED) -> DataFrame:
    """Uniform sample of at most ``factor * quota`` rows per county (WIN1).

    Bottom-k of a row hash is a uniform sample without replacement, and it can be
    merged, which the streaming form relies on.
    """
    quota = sc.quota_for("adcode", per_county, focus)
    keyed = df.withColumn("__draw", sc.shuffle_key(seed, "panoid"))
    return top_k_per_key(keyed, ["adcode"], ["__draw", "panoid"], quota * factor,
                         k_max=max(per_county, focus) * factor).drop("__draw")


def thin_grid(df: DataFrame, size_m: float, order: Sequence[str], keys: Sequence[str] = ("adcode",)) -> DataFrame:
    """First row of every metric cell under ``order`` (WIN2)."""
    cells = df.withColumns({"__gx": geo.grid_x("lng", "lat", size_m), "__gy": geo.grid_y("lat", size_m)})
    rest = [c for c in df.columns if c not in keys]
    return first_per_key(cells, [*keys, "__gx", "__gy"], order, rest).select(*df.columns)


def sample_pool(scan: DataFrame, per_county: int = sc.PER_COUNTY, focus: int = sc.FOCUS_PER_COUNTY,
                factor: int = sc.RESERVOIR_FACTOR, size_m: float = sc.SAMPLE_GRID_M,
                seed: int = sc.SEED) -> DataFrame:
    """Reservoir, then thinning and quota in one shuffled order (WIN1-WIN3).

    Keeping the first row per cell and then the first ``quota`` of those, both in
    the same order, is the greedy accept loop. Rows per county are bounded by the
    reservoir before the plain window runs.
    """
    kept = reservoir(candidates(scan), per_county, focus, factor, seed)
    mixed = kept.withColumn("__order", sc.shuffle_key(f"{seed}/thin", "panoid"))
    thinned = thin_grid(mixed, size_m, ["__order", "panoid"])
    rank = F.row_number().over(W.partitionBy("adcode").orderBy("__order", "panoid"))
    return (thinned.withColumn("__rank", rank)
            .where(F.col("__rank") <= sc.quota_for("adcode", per_county, focus))
            .drop("__order", "__rank"))


def point_table(scan: DataFrame, size_m: float = sc.POINTS_GRID_M, limit: int = sc.POINTS_PER_COUNTY) -> DataFrame:
    """Real points per county: first point of each cell, first ``limit`` cells (WIN4).

    Cells collapse on the map side, so what is ranked is the area of a county,
    not its rows.
    """
    thinned = thin_grid(scan.select("panoid", "adcode", "lng", "lat"), size_m, ["panoid"])
    rank = F.row_number().over(W.partitionBy("adcode").orderBy("panoid"))
    return (thinned.withColumn("__rank", rank).where(F.col("__rank") <= limit)
            .select("adcode", (F.col("__rank") - 1).alias("seq"), "lng", "lat"))


def county_counts(df: DataFrame, name: str = "n") -> DataFrame:
    """Rows per county and per province in one pass (AGG1, AGG2).

    Provinces are summed from the county counts, so rows are shuffled once.
    """
    per_county = df.groupBy("adcode").agg(F.count("*").alias(name)).withColumn(
        "province", sc.province_code("adcode", on_short="null"))
    per_province = per_county.groupBy("province").agg(F.sum(name).alias(name))
    return per_county.select(F.lit("county").alias("level"), F.col("adcode").alias("code"), name).unionByName(
        per_province.select(F.lit("province").alias("level"), F.col("province").alias("code"), name))


def coverage_histogram(scan: DataFrame, pool: DataFrame, per_county: int = sc.PER_COUNTY,
                       focus: int = sc.FOCUS_PER_COUNTY, legacy_quota: bool = True) -> DataFrame:
    """Available and selected rows with quotas, per county and province (AGG3).

    ``legacy_quota`` gives a province ``per_county`` times its counties even where
    counties have the doubled quota, as the histogram file always did.
    """
    available = scan.groupBy("adcode").agg(F.count("*").alias("available"))
    selected = pool.groupBy("adcode").agg(F.count("*").alias("selected"))
    counties = available.join(selected, "adcode", "left").select(
        "adcode", sc.province_code("adcode", on_short="null").alias("province"), "available",
        F.coalesce("selected", F.lit(0)).alias("selected"),
        sc.quota_for("adcode", per_county, focus).cast("bigint").alias("quota"))
    province_quota = F.count("*") * per_county if legacy_quota else F.sum("quota")
    provinces = counties.groupBy("province").agg(
        F.sum("available").alias("available"), F.sum("selected").alias("selected"),
        province_quota.alias("quota"))
    return counties.select(
        F.lit("county").alias("level"), F.col("adcode").alias("code"), "available", "selected", "quota",
    ).unionByName(provinces.select(
        F.lit("province").alias("level"), F.col("province").alias("code"), "available", "selected", "quota"))


def coverage_totals(scan: DataFrame, pool: DataFrame, points: DataFrame, per_county: int = sc.PER_COUNTY,
                    focus: int = sc.FOCUS_PER_COUNTY, focus_prefix: str = sc.FOCUS_PREFIX) -> DataFrame:
    """One row of totals (AGG4)."""
    counties = scan.groupBy("adcode").agg(F.count("*").alias("available"))
    is_focus = F.col("adcode").startswith(focus_prefix)
    from_scan = counties.agg(
        F.sum("available").alias("scanned_rows"),
        F.count_distinct(sc.province_code("adcode", on_short="null")).alias("provinces_with_data"),
        F.count_if(is_focus).alias("focus_counties"),
        F.count_if(is_focus & (F.col("available") > 0)).alias("focus_counties_covered"),
        F.count_if(F.col("available") < sc.quota_for("adcode", per_county, focus)).alias("counties_under_quota"))
    from_pool = pool.agg(
        F.count("*").alias("sample_rows"),
        F.count_if(F.col("part") == sc.FOCUS_PART).alias("focus_rows"),
        F.count_if(F.col("part") == sc.OTHER_PART).alias("other_rows"))
    from_points = points.agg(F.count_distinct("adcode").alias("counties_with_points"),
                             F.count("*").alias("points_total"))
    # Each side is one row by construction.
    one = F.lit(1)
    return (from_scan.withColumn("__one", one).join(from_pool.withColumn("__one", one), "__one")
            .join(from_points.withColumn("__one", one), "__one").drop("__one"))


def under_quota(scan: DataFrame, per_county: int = sc.PER_COUNTY, focus: int = sc.FOCUS_PER_COUNTY) -> DataFrame:
    """Counties that have fewer rows than their quota."""
    quota: Column = sc.quota_for("adcode", per_county, focus).cast("bigint")
    return scan.groupBy("adcode").agg(F.count("*").alias("available")).withColumn("quota", quota).where(
        F.col("available") < F.col("quota"))
