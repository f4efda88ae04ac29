"""Thresholds, fixed lookup values and layer parameters.

Everything here is a plain value that must equal the published behaviour of
the pipeline being re-implemented (filters, minimum samples, lookup tables,
colour stops, zoom ranges, projection constants).
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class StatsParams:
    """Filter / sample-size parameters of the statistics operators."""

    min_price_m2: float = 100.0
    max_price_m2: float = 50000.0
    min_sales: int = 5
    residential_types: tuple[str, ...] = ("Maison", "Appartement")
    sale_nature: str = "Vente"
    # Quantile mode: "exact" (interpolating, = quantile_cont), "approx"
    # (percentile_approx, mergeable; equals quantile_disc once the accuracy
    # is >= group size) or "sketch" (all levels of ``all_level_stats`` from
    # KLL sketches merged upward from one scan).
    quantile_mode: str = "exact"
    approx_accuracy: int = 10000


DEFAULT = StatsParams()

# Minimum samples of the individual reports.
MIN_SALES_TOP_EXPENSIVE = 100
TOP_EXPENSIVE_LIMIT = 10

# ---------------------------------------------------------------------------
# Fixed values (must match the published pipeline exactly)
# ---------------------------------------------------------------------------

# Department code -> 2016 region code (101 entries; "20" is deliberately absent).
DEPT_TO_REGION = {
    "01": "84", "02": "32", "03": "84", "04": "93", "05": "93", "06": "93",
    "07": "84", "08": "44", "09": "76", "10": "44", "11": "76", "12": "76",
    "13": "93", "14": "28", "15": "84", "16": "75", "17": "75", "18": "24",
    "19": "75", "21": "27", "22": "53", "23": "75", "24": "75", "25": "27",
    "26": "84", "27": "28", "28": "24", "29": "53", "2A": "94", "2B": "94",
    "30": "76", "31": "76", "32": "76", "33": "75", "34": "76", "35": "53",
    "36": "24", "37": "24", "38": "84", "39": "27", "40": "75", "41": "24",
    "42": "84", "43": "84", "44": "52", "45": "24", "46": "76", "47": "75",
    "48": "76", "49": "52", "50": "28", "51": "44", "52": "44", "53": "52",
    "54": "44", "55": "44", "56": "53", "57": "44", "58": "27", "59": "32",
    "60": "32", "61": "28", "62": "32", "63": "84", "64": "75", "65": "76",
    "66": "76", "67": "44", "68": "44", "69": "84", "70": "27", "71": "27",
    "72": "52", "73": "84", "74": "84", "75": "11", "76": "28", "77": "11",
    "78": "11", "79": "75", "80": "32", "81": "76", "82": "76", "83": "93",
    "84": "93", "85": "52", "86": "75", "87": "75", "88": "44", "89": "27",
    "90": "27", "91": "11", "92": "11", "93": "11", "94": "11", "95": "11",
    "971": "01", "972": "02", "973": "03", "974": "04", "976": "06",
}

# Metropolitan regions (the country outline is dissolved from these).
METRO_REGIONS = ("11", "24", "27", "28", "32", "44", "52", "53", "75", "76", "84", "93", "94")

# Paris / Lyon / Marseille: parent commune, pseudo-canton code, name, and the
# inclusive range of arrondissement codes rolled up into the parent.
PLM = (
    # parent, pseudo_canton, name, first_arrondissement, last_arrondissement
    ("75056", "75_PARIS", "Paris", 75101, 75120),
    ("69123", "69_LYON", "Lyon", 69381, 69389),
    ("13055", "13_MARSEILLE", "Marseille", 13201, 13216),
)

# Douglas-Peucker tolerance per level, metres in EPSG:2154; unknown level -> 0.001.
SIMPLIFY_TOLERANCE = {
    "country": 1500.0,
    "region": 300.0,
    "departement": 150.0,
    "canton": 100.0,
    "commune": 30.0,
    "arrondissement": 30.0,
}
SIMPLIFY_TOLERANCE_DEFAULT = 0.001
PARCEL_SIMPLIFY_TOLERANCE = 0.5
COORD_PRECISION = 5

# Choropleth: linear interpolation over (price, colour) stops; missing -> 3000.
PRICE_COLOR_STOPS = ((1000.0, "#27ae60"), (4000.0, "#f1c40f"), (7000.0, "#e67e22"), (12000.0, "#ff0000"))
PRICE_COLOR_MISSING = 3000.0

# Zoom ranges of the map layers (minzoom inclusive, maxzoom exclusive).
APP_ZOOM_LAYERS = (
    ("country", 0, 5),
    ("regions", 5, 7),
    ("departements", 7, 9),
    ("cantons", 9, 11),
    ("communes", 11, 17),
)
# Zoom ranges of the tile layers (both ends inclusive).
TILE_ZOOM_LAYERS = (
    ("country", 0, 5),
    ("regions", 5, 7),
    ("departments", 7, 10),
    ("postcodes", 10, 12),
    ("communes", 12, 15),
)
PARCEL_TILE_ZOOMS = (16, 20)
# Communes of a department are preloaded from this zoom on.
COMMUNE_PRELOAD_ZOOM = 10

# Lambert-93 (EPSG:2154) on GRS80, public EPSG definition.
GRS80_INV_F = 298.257222101
LAMBERT93_LON0_DEG = 3.0
LAMBERT93_X0 = 700000.0
LAMBERT93_N = 0.7256077650532695
LAMBERT93_C = 11754255.426096
LAMBERT93_YS = 12655612.049876
