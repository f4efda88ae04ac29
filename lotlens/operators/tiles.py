"""Tile assignment: feature bbox -> slippy-map tiles for each zoom of its layer.

(layer, z, x, y, code) rows come from ``explode(sequence(..))`` over the tile
ranges of the bbox; within a tile features are ranked by their sales.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlens.functions.geo import bbox, tile_x, tile_y
from lotlens.params import PARCEL_TILE_ZOOMS, TILE_ZOOM_LAYERS
from lotlens.session import checkpoint_dir

#: The zoom whose tiles place the centres of features.
_TOP = 20


def _zoom_lookup(layer, which: int):
    """minzoom (1) or maxzoom (2) of a tile layer, as a map lookup (no join)."""
    m = F.create_map(*[x for row in TILE_ZOOM_LAYERS for x in (F.lit(row[0]), F.lit(row[which]))])
    return m[layer]


def assign_tiles(features: DataFrame, layer: str | None = None) -> DataFrame:
    """features (layer, code, geometry lon/lat) -> (layer, z, x, y, code).

    The zoom range of each layer comes from the tile-layer dimension (both
    ends inclusive); ``layer`` overrides the column for single-layer input.
    """
    b = bbox(F.col("geometry"))
    lay = F.lit(layer) if layer else F.col("layer")
    f = features.select(lay.alias("layer"), "code",
                        b["minx"].alias("minlon"), b["miny"].alias("minlat"),
                        b["maxx"].alias("maxlon"), b["maxy"].alias("maxlat"),
                        _zoom_lookup(lay, 1).alias("minzoom"), _zoom_lookup(lay, 2).alias("maxzoom"))
    z = f.where(F.col("minzoom").isNotNull()).withColumn("z", F.explode(F.sequence("minzoom", "maxzoom")))
    xs = z.withColumn("x", F.explode(F.sequence(tile_x(F.col("minlon"), F.col("z")),
                                                tile_x(F.col("maxlon"), F.col("z")))))
    ys = xs.withColumn("y", F.explode(F.sequence(tile_y(F.col("maxlat"), F.col("z")),
                                                 tile_y(F.col("minlat"), F.col("z")))))
    return ys.select("layer", F.col("z").cast("int").alias("z"), "x", "y", "code")


def assign_parcel_tiles(parcels: DataFrame) -> DataFrame:
    """Parcels on zooms 16..20, no per-tile cap."""
    b = bbox(F.col("geometry"))
    f = parcels.select(F.col("parcel_id").alias("code"), b["minx"].alias("minlon"), b["miny"].alias("minlat"),
                       b["maxx"].alias("maxlon"), b["maxy"].alias("maxlat"))
    z = f.withColumn("z", F.explode(F.sequence(F.lit(PARCEL_TILE_ZOOMS[0]), F.lit(PARCEL_TILE_ZOOMS[1]))))
    xs = z.withColumn("x", F.explode(F.sequence(tile_x(F.col("minlon"), F.col("z")),
                                                tile_x(F.col("maxlon"), F.col("z")))))
    ys = xs.withColumn("y", F.explode(F.sequence(tile_y(F.col("maxlat"), F.col("z")),
                                                 tile_y(F.col("minlat"), F.col("z")))))
    return ys.select(F.lit("parcels").alias("layer"), "z", "x", "y", "code")


def rank_in_tile(tiles: DataFrame, weights: DataFrame) -> DataFrame:
    """``rank`` of every feature in its (layer, z, x, y): more sales first, then
    the smaller code; nothing is dropped. ``weights``: layer, code, n_sales (a
    region and a department may share a code)."""
    t = tiles.join(weights, ["layer", "code"], "left")
    w = Window.partitionBy("layer", "z", "x", "y").orderBy(F.desc_nulls_last("n_sales"), F.asc("code"))
    return t.withColumn("rank", F.row_number().over(w)).select("layer", "z", "x", "y", "code", "rank")


def curve_order(x: Column, y: Column) -> Column:
    """Place of a tile on the Z-order curve: the bits of x and y (at most 31) in turn."""
    def spread(v: Column) -> Column:
        v = v.cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                            (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v
    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def with_gaps(features: DataFrame) -> DataFrame:
    """Adds ``gap``: how far (layer, curve, code) lies behind its neighbour on the curve, null
    for the first of a layer. Ordered by range partitions, so that no task holds
    a layer; only the last place of each partition passes on to the next."""
    order = ["layer", "curve", "code"]
    checkpoint_dir(features.sparkSession)
    rows = features.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("_part", F.spark_partition_id()).checkpoint()
    ends = rows.groupBy(F.col("layer").alias("_layer"), F.col("_part").alias("_end")).agg(F.max("curve").alias("_last"))
    carried = ends.select("_layer", "_end", F.lag("_last").over(Window.partitionBy("_layer").orderBy("_end")).alias("_carried"))
    joined = rows.join(carried, (F.col("layer") == F.col("_layer")) & (F.col("_part") == F.col("_end")))
    before = F.lag("curve").over(Window.partitionBy("layer", "_part").orderBy("curve", "code"))
    return (joined.withColumn("gap", F.col("curve") - F.coalesce(before, F.col("_carried")))
            .drop("_layer", "_end", "_carried", "_part"))


def first_zooms(features: DataFrame, low: Column, high: Column, budget: int) -> DataFrame:
    """features (layer, code, geometry lon/lat) -> (layer, code, first_zoom): the smallest
    zoom of ``low`` to ``high`` at which a feature is shown.

    A tile shows the ``budget`` features with the widest gaps on the Z-order curve of
    their centres, so dense ones go first; at the top zoom all are shown. A tile's
    features are among those of the tile above it, where their ranks can only be
    larger: what is shown once stays. Features without a geometry have no row;
    ``code`` is unique in its layer.
    """
    b, top = bbox(F.col("geometry")), F.lit(_TOP)
    centre = features.where(F.col("geometry").isNotNull()).select(
        "layer", "code", low.cast("int").alias("low"), high.cast("int").alias("high"),
        tile_x((b["minx"] + b["maxx"]) / 2, top).alias("cx"), tile_y((b["miny"] + b["maxy"]) / 2, top).alias("cy"))
    placed = with_gaps(centre.withColumn("curve", curve_order(F.col("cx"), F.col("cy"))))
    at = placed.where("low < high").withColumn("z", F.explode(F.sequence("low", F.col("high") - 1)))
    # a tile is named by its zoom and its stretch of the curve
    at = at.withColumn("tile", F.expr(f"shiftright(curve, 2 * ({_TOP} - z))"))
    in_tile = Window.partitionBy("layer", "z", "tile").orderBy(F.desc_nulls_first("gap"), F.asc("code"))
    shown = at.withColumn("rank", F.row_number().over(in_tile)).where(F.col("rank") <= budget).select("layer", "code", "z")
    always = placed.select("layer", "code", F.col("high").alias("z"))
    return shown.unionByName(always).groupBy("layer", "code").agg(F.min("z").alias("first_zoom"))


# Published level -> tile layer name (cantons have no tile layer).
LEVEL_TO_TILE_LAYER = {"country": "country", "region": "regions", "departement": "departments",
                       "postcode": "postcodes", "commune": "communes"}


def assign_all_layers(published: DataFrame) -> DataFrame:
    """Tiles of every tiled layer in one frame (layer union, parcels excluded)."""
    m = F.create_map(*[x for k, v in LEVEL_TO_TILE_LAYER.items() for x in (F.lit(k), F.lit(v))])
    f = published.withColumn("layer", m[F.col("level")]).where(F.col("layer").isNotNull())
    return assign_tiles(f.select("layer", "code", "geometry")).where(F.col("layer") != "parcels")


def layer_for_zoom(zoom):
    """Map layer visible at ``zoom`` (minzoom <= zoom < maxzoom), as an
    expression over the fixed zoom table — a range lookup without a join."""
    from lotlens.params import APP_ZOOM_LAYERS
    expr = None
    for name, lo, hi in APP_ZOOM_LAYERS:
        cond = (zoom >= lo) & (zoom < hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def tile_layers_at(zoom):
    """Tile layers that hold ``zoom``, both ends inclusive, so two at a border."""
    names = F.array(*(F.when((zoom >= lo) & (zoom <= hi), F.lit(name)) for name, lo, hi in TILE_ZOOM_LAYERS))
    return F.array_compact(names)
