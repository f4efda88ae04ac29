"""Make a k-times larger copy of the test tables (key-shifted), for scale runs.

usage: python tools/replicate.py SRC_DIR DST_DIR K
Orders and lineitems are copied K times with shifted order keys and dates; customers,
parts and the other tables are copied once (so communes stay the same and
only the sales volume grows).
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from lotlens.session import get_spark  # noqa: E402


def main():
    src, dst, k = sys.argv[1], sys.argv[2], int(sys.argv[3])
    spark = get_spark("local[8]", 16)
    o = spark.read.parquet(f"{src}/orders.parquet")
    li = spark.read.parquet(f"{src}/lineitem.parquet")
    span = o.agg(F.max("o_orderkey")).first()[0] + 1
    copy = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_copy")
    # each copy is a distinct sale: new order key and a date shifted by the copy number
    (o.select("*", copy).withColumn("o_orderkey", F.col("o_orderkey") + F.col("_copy") * span)
      .withColumn("o_orderdate", F.col("o_orderdate") + F.make_interval(days=F.col("_copy").cast("int")))
      .drop("_copy").write.mode("overwrite").parquet(f"{dst}/orders.parquet"))
    (li.select("*", copy).withColumn("l_orderkey", F.col("l_orderkey") + F.col("_copy") * span)
       .drop("_copy").write.mode("overwrite").parquet(f"{dst}/lineitem.parquet"))
    for t in ("customer", "part", "events", "nation", "region", "supplier"):
        spark.read.parquet(f"{src}/{t}.parquet").write.mode("overwrite").parquet(f"{dst}/{t}.parquet")


if __name__ == "__main__":
    main()
