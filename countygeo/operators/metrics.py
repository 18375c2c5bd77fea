"""Accuracy, recall and distance metrics over prediction tables.

A prediction row is (sample_id, target, ranked): the class index, -1 when
unknown, and the best class indices in order. Metrics are sums per target class,
so one shuffle of at most one row per class and task yields all of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countygeo.functions import geo
from countygeo.operators.ranking import linear_quantiles
from countygeo.runtime import broadcast_if_small, checkpoint, fits_broadcast


def hit_at(k: int, target: str = "target", ranked: str = "ranked") -> Column:
    """Target among the first ``k``; k beyond the class count is harmless (AGG12, AMJ4)."""
    return F.array_contains(F.slice(ranked, 1, k), F.col(target))


def _share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def target_rank(scores: Column | str, target: Column | str = "target") -> Column:
    """1-based rank of the target among all scores, lower index first on ties; null for an unknown target."""
    values = F.col(scores) if isinstance(scores, str) else scores
    own = F.col(target) if isinstance(target, str) else target
    mine = F.get(values, own)
    before = F.transform(values, lambda v, i: ((v > mine) | ((v == mine) & (i < own))).cast("int"))
    return F.when(own >= 0, 1 + F.aggregate(before, F.lit(0), lambda a, b: a + b))


def top_k_accuracy(preds: DataFrame, ks: Sequence[int], rank: str = "target_rank") -> DataFrame:
    """Share of rows whose target is among the first k, for several k (AGG12).

    The rank comes from all scores, so any k is right and one beyond the class count gives 1.
    """
    return preds.agg(*[_share(F.col(rank) <= k).alias(f"top{k}") for k in ks])


def class_recall(preds: DataFrame) -> DataFrame:
    """Recall of the best class per target that occurs (AGG13)."""
    return preds.where(F.col("target") >= 0).groupBy("target").agg(
        _share(hit_at(1)).alias("recall"), F.count("*").alias("n"))


def class_recall_full(preds: DataFrame, classes: DataFrame) -> DataFrame:
    """Recall for every class, null where a class has no rows (AGG13)."""
    recall = class_recall(preds).withColumnRenamed("target", "class_idx")
    return classes.select("class_idx").join(F.broadcast(recall.select("class_idx", "recall")), "class_idx", "left")


def macro_recall(preds: DataFrame) -> DataFrame:
    """Mean recall over the classes that occur (AGG14)."""
    return class_recall(preds).agg(F.avg("recall").alias("macro_recall"))


def majority_baseline(preds: DataFrame) -> DataFrame:
    """Share of the most frequent evaluated target (AGG15)."""
    return class_recall(preds).agg((F.max("n") / F.sum("n")).alias("majority_baseline"))


def near_pairs(classes: DataFrame, radius_km: float = 150.0) -> DataFrame:
    """(target, other) classes whose centroids are within the radius, each class with itself too.

    Centroids lie on the unit sphere, cut into cubes as wide as the chord of the
    radius; a class meets only those of its own and the 26 neighbouring cubes.
    Poles and the antimeridian need no case of their own. A class without a
    centroid is near none.
    """
    side = max(2 * math.sin(min(radius_km * 1000.0 / (2 * geo.EARTH_R), math.pi / 2)), 1e-9) * (1 + 1e-9)
    lng, lat = F.radians("lng"), F.radians("lat")
    cube = {"i": F.floor(F.cos(lat) * F.cos(lng) / side), "j": F.floor(F.cos(lat) * F.sin(lng) / side), "k": F.floor(F.sin(lat) / side)}
    placed = classes.where(F.col("lng").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lng") & ~F.isnan("lat")).select("class_idx", "lng", "lat", *[v.alias(c) for c, v in cube.items()])
    around = placed.select(F.col("class_idx").alias("target"), F.col("lng").alias("t_lng"), F.col("lat").alias("t_lat"), *cube)
    for c in cube:
        around = around.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    return around.join(placed, list(cube)).where(geo.haversine_km("t_lng", "t_lat", "lng", "lat") <= radius_km).select(
        "target", F.col("class_idx").alias("other"))


def near_classes(classes: DataFrame, radius_km: float = 150.0) -> DataFrame:
    """Classes whose centroid is within the radius, one row (target, near) per class; broadcast only if the pairs are few."""
    pairs = checkpoint(near_pairs(classes, radius_km))
    lists = pairs.groupBy("target").agg(F.sort_array(F.collect_list("other")).alias("near"))
    out = classes.select(F.col("class_idx").alias("target")).join(lists, "target", "left").withColumn("near", F.coalesce("near", F.array().cast("array<int>")))
    return F.broadcast(out) if fits_broadcast(pairs) and fits_broadcast(classes) else out


def near_consistency(preds: DataFrame, classes: DataFrame, k: int = 5, radius_km: float = 150.0) -> DataFrame:
    """Share of rows with any of the first k classes near the true one (AGG19)."""
    joined = preds.join(near_classes(classes, radius_km), "target")
    return joined.agg(_share(F.arrays_overlap(F.slice("ranked", 1, k), F.col("near"))).alias("near_consistency"))


def summarize(preds: DataFrame, classes: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """The full metric record per key: one job for all metrics (AGG20, AGG22).

    Partial sums of the map tasks take the place of merging processes (AGG44).
    Rows with target -1 count only toward the known fraction.
    """
    keys = list(keys)
    rows = preds
    near = F.lit(None).cast("boolean")
    if classes is not None:
        rows = rows.join(near_classes(classes), "target", "left")
        near = F.arrays_overlap(F.slice("ranked", 1, 5), F.col("near"))
    per_class = rows.groupBy(*keys, "target").agg(
        F.count("*").alias("c"), *[F.count_if(hit_at(k)).alias(f"h{k}") for k in (1, 5, 10)],
        F.count_if(near).alias("hn"))
    known = F.col("target") >= 0

    def total(name: str) -> Column:
        return F.sum(F.when(known, F.col(name)))

    n = total("c")
    out = per_class.groupBy(*keys).agg(
        *[(total(f"h{k}") / n).alias(f"top{k}") for k in (1, 5, 10)],
        F.avg(F.when(known, F.col("h1") / F.col("c"))).alias("macro_recall"),
        (F.max(F.when(known, F.col("c"))) / n).alias("majority_baseline"),
        F.coalesce(n, F.lit(0)).alias("n"),
        *([(total("hn") / n).alias("top5_nearby_150km")] if classes is not None else []),
        (F.coalesce(n, F.lit(0)) / F.sum("c")).alias("known_fraction"))
    return out.withColumns({"all_top1": F.col("top1") * F.col("known_fraction"),
                            "all_top5": F.col("top5") * F.col("known_fraction")})


def auxiliary_accuracy(df: DataFrame, heads: dict[str, tuple[str, str]]) -> DataFrame:
    """Accuracy of further heads over their known targets (AGG21).

    ``heads`` maps an output name to its (prediction, target) columns.
    """
    out = []
    for name, (pred, target) in heads.items():
        known = F.col(target) >= 0
        right = F.count_if(known & (F.col(pred) == F.col(target)))
        out.append((right / F.greatest(F.lit(1), F.count_if(known))).alias(name))
    return df.agg(*out)


def with_error_km(df: DataFrame, out: str = "km") -> DataFrame:
    """Distance between prediction (lng, lat) and truth (AGG16)."""
    return df.withColumn(out, geo.haversine_km("lng", "lat", "truth_lng", "truth_lat"))


def distance_summary(df: DataFrame, km: str = "km", keys: Sequence[str] = ()) -> DataFrame:
    """Median, quartiles, mean and hit shares of an error column (AGG17), exact."""
    keys = list(keys)
    quantiles = linear_quantiles(df, keys, km, {"median_km": 0.5, "p25_km": 0.25, "p75_km": 0.75})
    plain = df.groupBy(*keys).agg(
        F.avg(km).alias("mean_km"), _share(F.col(km) <= 25).alias("within_25km"),
        _share(F.col(km) <= 100).alias("within_100km"))
    return _join_on(plain, quantiles, keys)


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join two grouped results; without keys both have one row."""
    if keys:
        return left.join(right, list(keys))
    one = F.lit(1)
    return left.withColumn("__one", one).join(right.withColumn("__one", one), "__one").drop("__one")


def mean_game_score(df: DataFrame, km: str = "km") -> DataFrame:
    """Mean guessing-game score (AGG18)."""
    return df.agg(F.avg(geo.game_score(km)).alias("geo_score"))


def centroid_error(preds: DataFrame, classes: DataFrame) -> DataFrame:
    """Error of the best class's centroid against the truth (JN18)."""
    cents = classes.select(F.col("class_idx").alias("__best"), "lng", "lat")
    return with_error_km(preds.withColumn("__best", F.get("ranked", F.lit(0))).join(
        broadcast_if_small(cents), "__best").drop("__best"))
