"""Viewport -> departments -> communes to load (range join + anti-join).

``overlap_join`` is a grid-bucketed rectangle overlap join over a pyramid of
grids (cell sizes base * 2^level).  Each rectangle of the big side (the
viewports) goes to the level whose cells are at least its size, so it
covers at most 2 x 2 cells whatever its size (a zoomed-out viewport is not
copied into hundreds of cells); each rectangle of the other side (features,
bounded by the geography) is bucketed at every level.  The sides are
equi-joined on (level, cell), the exact closed-overlap test refines, and a
pair is kept only in the cell holding the lower-left corner of the
intersection, so no distinct is needed.  Neither side is broadcast by the
code; AQE decides at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.functions.geo import bbox
from lotlens.params import COMMUNE_PRELOAD_ZOOM


def _own_level(minx: str, miny: str, maxx: str, maxy: str, base: float, levels: int):
    ext = F.greatest(F.col(maxx) - F.col(minx), F.col(maxy) - F.col(miny), F.lit(1e-9))
    return F.least(F.lit(levels - 1), F.greatest(F.lit(0), F.ceil(F.log2(ext / base)).cast("int")))


def _cells(df: DataFrame, minx: str, miny: str, maxx: str, maxy: str, size) -> DataFrame:
    size = size if not isinstance(size, (int, float)) else F.lit(float(size))
    cx0, cx1 = F.floor(F.col(minx) / size), F.floor(F.col(maxx) / size)
    cy0, cy1 = F.floor(F.col(miny) / size), F.floor(F.col(maxy) / size)
    return (df.withColumn("_cx", F.explode(F.sequence(cx0, cx1)))
              .withColumn("_cy", F.explode(F.sequence(cy0, cy1))))


def overlap_join(left: DataFrame, right: DataFrame, lrect: tuple[str, str, str, str],
                 rrect: tuple[str, str, str, str], cell_size: float, levels: int = 6) -> DataFrame:
    """Pairs (left row, right row) whose closed rectangles overlap.

    ``left`` is the large side (one level each, <= 4 cells); ``right`` is
    bucketed at all ``levels`` levels of the pyramid.
    """
    lw, ls, le, ln = lrect
    rw, rs, re_, rn = rrect
    size = lambda lv: F.lit(float(cell_size)) * F.pow(F.lit(2.0), lv)
    lc = _cells(left.withColumn("_lv", _own_level(lw, ls, le, ln, cell_size, levels)),
                lw, ls, le, ln, size(F.col("_lv")))
    rc = _cells(right.withColumn("_lv", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))),
                rw, rs, re_, rn, size(F.col("_lv")))
    j = lc.join(rc, ["_lv", "_cx", "_cy"])
    overlap = ((F.col(re_) >= F.col(lw)) & (F.col(rw) <= F.col(le))
               & (F.col(rn) >= F.col(ls)) & (F.col(rs) <= F.col(ln)))
    ref_x = F.floor(F.greatest(F.col(lw), F.col(rw)) / size(F.col("_lv")))
    ref_y = F.floor(F.greatest(F.col(ls), F.col(rs)) / size(F.col("_lv")))
    return j.where(overlap & (F.col("_cx") == ref_x) & (F.col("_cy") == ref_y)).drop("_lv", "_cx", "_cy")


def feature_bounds(layer: DataFrame) -> DataFrame:
    """(code, minx, miny, maxx, maxy) of each feature."""
    b = bbox(F.col("geometry"))
    return layer.select("code", b["minx"].alias("minx"), b["miny"].alias("miny"),
                        b["maxx"].alias("maxx"), b["maxy"].alias("maxy"))


def visible_departments(viewports: DataFrame, dept_bounds: DataFrame, cell_size: float = 50000.0) -> DataFrame:
    """(event_id, user_id, ts, zoom, dept) for every closed bbox overlap."""
    j = overlap_join(viewports, dept_bounds, ("west", "south", "east", "north"),
                     ("minx", "miny", "maxx", "maxy"), cell_size)
    return j.select("event_id", "user_id", "ts", "zoom", F.col("code").alias("dept"))


def departments_to_load(visible: DataFrame, min_zoom: int = COMMUNE_PRELOAD_ZOOM) -> DataFrame:
    """For each user, the first viewport (ts, event_id) at which a department
    becomes visible at zoom >= min_zoom: it is loaded then and never again."""
    first = (visible.where(F.col("zoom") >= min_zoom)
             .groupBy("user_id", "dept")
             .agg(F.min(F.struct("ts", "event_id")).alias("_f")))
    return first.select("user_id", "dept", F.col("_f.event_id").alias("event_id"), F.col("_f.ts").alias("ts"))


def communes_to_load(to_load: DataFrame, communes_by_dept: DataFrame) -> DataFrame:
    """Commune features fetched by each load: join on the department key
    (a partition-pruned read when the commune files are partitioned by dept)."""
    return to_load.join(communes_by_dept, "dept").select("user_id", "event_id", "dept", "code")
