"""lotlens — property-sale price analytics as Spark DataFrame jobs.

Layers:
  sources/    readers: lot adapter over the test tables, French CSV lots,
              GeoJSON / stats JSON, materialised tables
  functions/  column expressions (codes, ratios, colours, coordinates)
  operators/  DataFrame operators (clean, stats, roll-ups, reports,
              geometry, parcels, tiles, viewports, publishing)
  plans/      end-to-end jobs (etl / precompute / split) and the query
              registry used by ``__spark_entry__``
"""

__all__ = ["session", "params"]
