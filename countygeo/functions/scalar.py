"""Column functions over ids, administrative codes, dates and labels.

Everything here is a built-in Spark expression, so it stays inside whole-stage
code generation and can be pushed around freely by the optimizer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Collection parameters.
EXCLUDE_PREFIXES = ("230",)
FOCUS_PREFIX = "51"
FOCUS_PART = "sichuan"
OTHER_PART = "national"
PER_COUNTY = 50
FOCUS_PER_COUNTY = 100
SAMPLE_GRID_M = 300.0
POINTS_PER_COUNTY = 500
POINTS_GRID_M = 1000.0
METERS_PER_DEG_LAT = 111320.0
RESERVOIR_FACTOR = 4
SEED = 20260926

# Municipalities whose districts have no prefecture level.
MUNICIPALITY_PREFIXES = ("11", "12", "31", "50")

# Id suffixes of personal uploads, which are not survey vehicles.
PERSONAL_SUFFIXES = ("IN", "OI", "UZ")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------
# Deterministic draws
# --------------------------------------------------------------------------

def shuffle_key(seed: int | str, *cols: Column | str) -> Column:
    """Hex digest that orders rows pseudo-randomly.

    Depends on the seed and the row only, never on partitioning, so a retried
    task or another cluster size gives the same order.
    """
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_col(c).cast("string") for c in cols]))


def unit_draw(seed: int | str, *cols: Column | str) -> Column:
    """Uniform double in [0, 1) from the first 52 bits of the digest (SC20)."""
    digits = F.substring(shuffle_key(seed, *cols), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


# --------------------------------------------------------------------------
# Ids and administrative codes
# --------------------------------------------------------------------------

def parse_panoid(panoid: Column | str) -> Column:
    """Struct (vehicle, date, city) cut from the id; null if shorter than 16 (SC1)."""
    p = _col(panoid)
    return F.when(
        F.length(p) >= 16,
        F.struct(
            F.concat_ws("_", F.substring(p, 1, 3), F.substring(p, 7, 4), F.right(p, F.lit(2))).alias("vehicle"),
            F.substring(p, 11, 6).alias("date"),
            F.substring(p, 4, 3).alias("city"),
        ),
    )


def has_excluded_prefix(panoid: Column | str, prefixes: Sequence[str] = EXCLUDE_PREFIXES) -> Column:
    """True for ids to be left out of collection (SC/SRC2)."""
    cond = F.lit(False)
    for prefix in prefixes:
        cond = cond | _col(panoid).startswith(prefix)
    return cond


def province_code(adcode: Column | str, on_short: str = "self") -> Column:
    """First two digits + '0000'; short input gives null or itself (SC2)."""
    if on_short not in ("null", "self"):
        raise ValueError("on_short must be 'null' or 'self'")
    a = _col(adcode)
    whole = F.concat(F.substring(a, 1, 2), F.lit("0000"))
    out = F.when(F.length(a) >= 2, whole)
    return out if on_short == "null" else out.otherwise(a)


def label_city(adcode: Column | str) -> Column:
    """City code used as a training label (SC3).

    Counties run directly by a province ('90' in the middle) have no city and
    take the province code.
    """
    a = _col(adcode)
    return (
        F.when(a.isNull() | (F.length(a) < 6), a)
        .when(F.substring(a, 3, 2) == "90", F.concat(F.substring(a, 1, 2), F.lit("0000")))
        .otherwise(F.concat(F.substring(a, 1, 4), F.lit("00")))
    )


def display_city(adcode: Column | str) -> Column:
    """City code used for readable names (SC4).

    Municipality districts go to the municipality and '90' counties stay
    themselves, which differs from ``label_city`` on purpose.
    """
    a = _col(adcode)
    return (
        F.when(a.isNull() | (F.length(a) < 6), a)
        .when(F.substring(a, 1, 2).isin(*MUNICIPALITY_PREFIXES), F.concat(F.substring(a, 1, 2), F.lit("0000")))
        .when(F.substring(a, 3, 2) == "90", a)
        .otherwise(F.concat(F.substring(a, 1, 4), F.lit("00")))
    )


def group_key(vehicle: Column | str, date: Column | str, panoid: Column | str) -> Column:
    """Unit of splitting: vehicle and day, or the sample alone (SC7)."""
    v, d = F.coalesce(_col(vehicle), F.lit("")), F.coalesce(_col(date), F.lit(""))
    return F.when((v != "") & (d != ""), F.concat_ws("|", v, d)).otherwise(
        F.concat(F.lit("solo|"), _col(panoid))
    )


def quota_for(adcode: Column | str, per_county: int = PER_COUNTY, focus: int = FOCUS_PER_COUNTY,
              focus_prefix: str = FOCUS_PREFIX) -> Column:
    """Rows wanted from a county (SC8)."""
    return F.when(_col(adcode).startswith(focus_prefix), F.lit(focus)).otherwise(F.lit(per_county))


def part_of(adcode: Column | str, focus_prefix: str = FOCUS_PREFIX) -> Column:
    """Part a county belongs to (SC8)."""
    return F.when(_col(adcode).startswith(focus_prefix), F.lit(FOCUS_PART)).otherwise(F.lit(OTHER_PART))


def round6(x: Column | str) -> Column:
    """Six decimals, ties to even (SC17)."""
    return F.bround(_col(x), 6)


# --------------------------------------------------------------------------
# Labels and dates
# --------------------------------------------------------------------------

def vehicle_label(vehicle: Column | str) -> Column:
    """Upper-cased vehicle, empty for personal uploads or no vehicle (SC13)."""
    v = F.upper(F.coalesce(_col(vehicle), F.lit("")))
    return F.when(F.element_at(F.split(v, "_"), -1).isin(*PERSONAL_SUFFIXES), F.lit("")).otherwise(v)


def year_label(date: Column | str) -> Column:
    """Year of an eight-digit date, else 'unknown' (SC14)."""
    d = F.coalesce(_col(date), F.lit(""))
    return F.when(d.rlike("^[0-9]{8}$"), F.substring(d, 1, 4)).otherwise(F.lit("unknown"))


def report_year(date: Column | str) -> Column:
    """First four characters of the date, '?' when there is none (SC15)."""
    return F.substring(F.coalesce(F.nullif(_col(date), F.lit("")), F.lit("?")), 1, 4)


def epoch_day_year(day: Column | str) -> Column:
    """Year of a day counted from 1970-01-01, as a string (SC16)."""
    return F.year(F.date_from_unix_date(_col(day).cast("int"))).cast("string")


def shifted_code(code: Column | str) -> Column:
    """Code minus one, zero-padded to six digits; null for zero (SC16)."""
    c = _col(code)
    return F.when(c != 0, F.lpad((c - 1).cast("string"), 6, "0"))


def is_panorama(width: Column | str, height: Column | str, tolerance: float | None = 0.02) -> Column:
    """2:1 image test; ``tolerance=None`` asks for exactly 2:1 (SC30)."""
    w, h = _col(width), _col(height)
    if tolerance is None:
        return w == h * 2
    return F.abs(w / h - 2.0) <= tolerance


def fingerprint(content: Column | str) -> Column:
    """SHA-256 of bytes or text (SC31)."""
    return F.sha2(_col(content).cast("binary"), 256)


def floored_log(p: Column | str, floor: float = 1e-12) -> Column:
    """Logarithm that never goes below log(floor): a zero does not veto (SC32)."""
    return F.ln(F.greatest(_col(p), F.lit(floor)))
