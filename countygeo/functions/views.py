"""View plan: which views of a panorama would be cut, as columns (SC18-SC28)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countygeo.functions.scalar import _col, unit_draw

# Wanted level and target size per part.
TIER = {"sichuan": 3, "national": 2}
TARGET_SIZE = {"sichuan": (2048, 1024), "national": (1024, 512)}
TILE_PX = 512
FETCH_LEVELS = (2, 3, 4, 5)
SCREENSHOT_ASPECTS = (1.0, 4 / 3, 16 / 9)

LAYER_SCHEMA = "array<struct<ImgLevel:int,BlockX:int,BlockY:int>>"


@dataclass(frozen=True)
class ViewConfig:
    """Parameters of the view plan, checked on construction (SC23)."""

    n_max: int = 8
    min_views: int = 1
    single_view_prob: float = 0.15
    fov: float = 90.0
    fov_range: tuple[float, float] | None = None
    pitch_range: tuple[float, float] | None = None
    screenshot_prob: float = 0.0

    def __post_init__(self) -> None:
        if not 1 <= self.min_views <= self.n_max <= 8:
            raise ValueError(f"view counts out of order: {self.min_views} to {self.n_max} within 1 to 8")
        if not 0 <= self.single_view_prob <= 1:
            raise ValueError(f"share of single views is no share: {self.single_view_prob}")


def _steps(lo: float, hi: float, n: int) -> list[float]:
    return [lo + (hi - lo) * i / (n - 1) for i in range(n)]


def _pick(values: list[float], draw: Column) -> Column:
    """One of a few fixed values by a unit draw."""
    options = F.array(*[F.lit(float(v)) for v in values])
    return F.element_at(options, F.least(F.floor(draw * len(values)), F.lit(len(values) - 1)).cast("int") + 1)


def surround_headings(n: Column | int, offset: Column | float = 0.0) -> Column:
    """Evenly spaced headings starting at ``offset`` (SC18)."""
    count = n if isinstance(n, Column) else F.lit(n)
    start = offset if isinstance(offset, Column) else F.lit(float(offset))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: start + i * 360.0 / count)


def random_headings(n: int, seed: int | str, *cols) -> Column:
    """``n`` sorted random headings, fixed by seed and row (SC19)."""
    return F.array_sort(F.array(*[unit_draw(f"{seed}/heading{i}", *cols) * 360.0 for i in range(n)]))


def view_count(cfg: ViewConfig, coin: Column, pick: Column) -> Column:
    """Number of views: the minimum with some probability, else uniform (SC21)."""
    if cfg.n_max == cfg.min_views:
        return F.lit(cfg.n_max)
    low = max(2, cfg.min_views)
    spread = cfg.n_max - low + 1
    many = (F.lit(low) + F.floor(pick * spread)).cast("int")
    return F.when(coin < cfg.single_view_prob, F.lit(cfg.min_views)).otherwise(many)


def mask_array(n: Column, size: int) -> Column:
    """First ``n`` of ``size`` slots are true (AMJ7)."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: i < n)


def with_view_plan(df: DataFrame, cfg: ViewConfig, key: str, epoch: Column | int = 0, seed: int = 0,
                   training: bool = True, eval_mode: str = "random") -> DataFrame:
    """Add the view plan of each row (SC22): one projection, no shuffle."""
    if eval_mode not in ("random", "single", "panorama"):
        raise ValueError("eval_mode must be random, single or panorama")
    ep = epoch if isinstance(epoch, Column) else F.lit(epoch)

    def draw(salt: str) -> Column:
        return unit_draw(seed, key, ep, F.lit(salt))

    if not training and eval_mode != "random":
        n = F.lit(1 if eval_mode == "single" else cfg.n_max)
    else:
        n = view_count(cfg, draw("coin"), draw("count"))
    offset = draw("offset") * 360.0 if training or eval_mode != "panorama" else F.lit(0.0)
    fov = _pick(_steps(*cfg.fov_range, 5), draw("fov")) if training and cfg.fov_range else F.lit(cfg.fov)
    pitch = _pick(_steps(*cfg.pitch_range, 3), draw("pitch")) if training and cfg.pitch_range else F.lit(0.0)
    shot = (n == 1) & (draw("shot") < cfg.screenshot_prob) if training else F.lit(False)

    out = df.withColumns({"n_views": n.cast("int"), "view_offset": offset, "view_fov": fov,
                          "view_pitch": pitch, "is_shot": shot})
    return out.withColumns({
        "aspect": F.when(F.col("is_shot"), _pick(list(SCREENSHOT_ASPECTS), draw("aspect"))),
        "headings": F.when(F.col("is_shot"), F.array("view_offset")).otherwise(
            F.slice(surround_headings(cfg.n_max, F.col("view_offset")), F.lit(1), F.col("n_views"))),
        "vmask": mask_array(F.col("n_views"), cfg.n_max),
    })


# --------------------------------------------------------------------------
# Image layers
# --------------------------------------------------------------------------

def grid_for_level(z: Column | str) -> Column:
    """Tile grid (columns, rows) of a level (SC24)."""
    z = _col(z).cast("int")
    return F.struct(F.call_function("shiftleft", F.lit(1), z - 1).alias("tiles_x"),
                    F.call_function("shiftleft", F.lit(1), z - 2).alias("tiles_y"))


def service_metadata(text: Column | str) -> Column:
    """Service answer as a struct: layers, date, obsolete flag and id (AMJ6)."""
    return F.from_json(_col(text), f"struct<ImgLayer:{LAYER_SCHEMA},Date:string,Obsolete:int,ID:string>")


def pick_layer(layers: Column | str, want: Column) -> Column:
    """Wanted level, else the highest one; the last duplicate wins (SC25).

    Gives a struct (level, bx, by, exact), null when there is no layer.
    """
    ranked = F.transform(
        F.filter(_col(layers), lambda x: x["ImgLevel"].isNotNull()),
        lambda x, i: F.struct(
            (x["ImgLevel"] == want).alias("exact"), x["ImgLevel"].alias("level"), i.alias("pos"),
            x["BlockX"].alias("bx"), x["BlockY"].alias("by")),
    )
    return F.array_max(ranked)


def pick_nearest_layer(layers: Column | str, want_px: int = 2048) -> Column:
    """Layer whose width is closest to ``want_px``, the first one on ties (SC26)."""
    ranked = F.transform(
        _col(layers),
        lambda x, i: F.struct(
            F.abs(x["BlockX"] * TILE_PX - want_px).alias("gap"), i.alias("pos"),
            x["ImgLevel"].alias("level"), x["BlockX"].alias("bx"), x["BlockY"].alias("by")),
    )
    return F.array_min(ranked)


def fallback_levels(z: Column | str, levels: tuple[int, ...] = FETCH_LEVELS, n: int = 2) -> Column:
    """The ``n`` other levels nearest to ``z``, lower level first on ties (SC27)."""
    z = _col(z).cast("int")
    others = F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v != z)
    ranked = F.array_sort(F.transform(others, lambda v: F.struct(F.abs(v - z).alias("gap"), v.alias("level"))))
    return F.transform(F.slice(ranked, 1, n), lambda s: s["level"])


def tier_of(part: Column | str) -> Column:
    """Level fetched for a part (SC28)."""
    pairs = [x for k, v in TIER.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[_col(part)]


def target_size(part: Column | str) -> Column:
    """Target (width, height) of a part (SC28)."""
    pairs = [x for k, (w, h) in TARGET_SIZE.items()
             for x in (F.lit(k), F.struct(F.lit(w).alias("width"), F.lit(h).alias("height")))]
    return F.create_map(*pairs)[_col(part)]
