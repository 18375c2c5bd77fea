"""Score arrays to probabilities, candidates and coordinates.

A sample's scores stay one array, so softmax, fusion and top-k are row-local:
no shuffle, and the long (sample, class) table never exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countygeo.functions.arrays import bind, softmax
from countygeo.functions.scalar import _col, floored_log

# Fixed value: smallest probability and temperature.
FLOOR = 1e-12


def wide_scores(long: DataFrame, sample: str = "sample_id", index: str = "class_idx", value: str = "logit") -> DataFrame:
    """Long scores gathered into one array per sample (D11, AMJ1).

    A group holds at most one value per class.
    """
    items = F.sort_array(F.collect_list(F.struct(index, value)))
    return long.groupBy(sample).agg(F.transform(items, lambda s: s[value]).alias("logits"))


def long_scores(wide: DataFrame, sample: str = "sample_id", value: str = "logit") -> DataFrame:
    """Array scores as rows (AMJ1)."""
    return wide.select(sample, F.posexplode("logits").alias("class_idx", value))


def as_log(values: Column | str, from_logits: bool) -> Column:
    """Array of log scores: logits as they are, probabilities with a floor."""
    v = _col(values)
    return v if from_logits else F.transform(v, lambda p: floored_log(p))


def map_to_log(probs: Column | str, codes: Column) -> Column:
    """Probability map aligned to ``codes`` as log probabilities (AMJ2, G5)."""
    p = _col(probs)
    return F.transform(codes, lambda a: floored_log(F.coalesce(p[a], F.lit(0.0))))


def fuse(df: DataFrame, env: str, text: str | None = None, w_env: float = 1.0, w_text: float = 1.0,
         temperature: float = 1.0, from_logits: bool = False, out: str = "probs") -> DataFrame:
    """Log-linear fusion of one or two clues into a distribution (WIN8).

    Arrays of different length raise when the row is evaluated.
    """
    temp = max(temperature, FLOOR)
    a = as_log(env, from_logits)
    if text is None:
        joined = F.transform(a, lambda x: x * w_env / temp)
    else:
        b = as_log(text, from_logits)
        same = F.size(env) == F.size(text)
        mixed = F.zip_with(a, b, lambda x, y: (x * w_env + y * w_text) / temp)
        joined = F.when(same, mixed).otherwise(
            F.raise_error(F.lit("clues differ in length")).cast("array<double>"))
    return df.withColumn(out, softmax(joined))


def ranked_classes(scores: Column | str, k: int) -> Column:
    """Indices of the ``k`` best classes, lower index first on ties (WIN9, TOP4)."""
    return F.transform(ranked_pairs(scores, k), lambda s: s["idx"])


def ranked_pairs(scores: Column | str, k: int) -> Column:
    """Best ``k`` (idx, score) structs by falling score (WIN9, AMJ1)."""
    keyed = F.transform(_col(scores), lambda v, i: F.struct((-v).alias("neg"), i.alias("idx")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k),
                       lambda s: F.struct(s["idx"].alias("idx"), (-s["neg"]).alias("score")))


def usable_candidates(probs: Column | str, classes: Column | str, k: int) -> Column:
    """Top ``k`` positive candidates among classes that have points (FIL5, G6).

    ``classes`` is the class array with ``adcode`` and ``has_points``. Gives
    structs (adcode, p) by falling probability; raises when none is usable.
    """
    if k < 1:
        raise ValueError(f"a candidate list needs room for one county at least, not {k}")
    cls = _col(classes)
    keyed = F.transform(_col(probs), lambda p, i: F.struct((-p).alias("neg"), i.alias("idx")))
    usable = F.filter(keyed, lambda s: (s["neg"] < 0) & F.get(cls, s["idx"])["has_points"])
    best = F.transform(F.slice(F.array_sort(usable), 1, k),
                       lambda s: F.struct(F.get(cls, s["idx"])["adcode"].alias("adcode"), (-s["neg"]).alias("p")))
    none = F.raise_error(F.lit("no usable candidate")).cast("array<struct<adcode:string,p:double>>")
    return bind(best, lambda b: F.when(F.size(b) > 0, b).otherwise(none))


def candidate_points(candidates: DataFrame, points: DataFrame, spread: str = "uniform") -> DataFrame:
    """Points of every candidate county with their weights (JN11).

    ``candidates`` is (sample_id, adcode, p), already cut to the top k. The weight
    is p/n ("uniform") or p for each of the county's n points. A county without
    points raises.
    """
    sizes = points.groupBy("adcode").agg(F.count("*").alias("__n"))
    weight = F.col("p") / F.col("__n") if spread == "uniform" else F.col("p")
    bare = F.raise_error(F.concat(F.lit("no points in candidate county "), F.col("adcode"))).cast("double")
    return (candidates.join(sizes, "adcode", "left").join(points.select("adcode", "lng", "lat"), "adcode", "left")
            .select("sample_id", "adcode", F.when(F.col("__n").isNull(), bare).otherwise(F.col("lng")).alias("lng"), "lat",
                    weight.alias("w")))


def probability_map(codes: Column, probs: Column | str) -> Column:
    """{adcode: p} of one sample (AMJ2, SNK7)."""
    return F.map_from_arrays(codes, _col(probs))
