"""Dependency questions over tables of cells and rectangles too large for one machine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators import ordered


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name in the one that driver and executors share; where none is named, on this machine if it is the whole
    cluster, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{named or tempfile.gettempdir()}/gridloom-reach-{uuid.uuid4().hex}"


def readers(cells: DataFrame, rects: DataFrame) -> DataFrame:
    """cells (sheet, row, col) with n, how many rectangles (sheet, r0, c0, r1, c1) hold each. No cell meets a rectangle: in
    each column the borders are summed up in the order of rows, which are dealt into ranges."""
    wide = rects.withColumn("col", F.explode(F.sequence("c0", "c1")))
    steps = wide.select("sheet", "col", F.col("r0").cast("long").alias("row"), F.lit(1).cast("long").alias("n")).unionByName(wide.select("sheet", "col", (F.col("r1") + 1).cast("long").alias("row"), F.lit(-1).cast("long").alias("n")))
    steps = steps.groupBy("sheet", "col", "row").agg(F.sum("n").alias("n"))
    asked = cells.select("sheet", "col", F.col("row").cast("long").alias("row"))
    return ordered.asof(steps, asked, ["sheet", "col"], "row", {"n": "sum"}).select("sheet", "row", "col", "n")


def auto_inputs(cells: DataFrame, rects: DataFrame, limit: int = 20) -> DataFrame:
    """The cells that most rectangles hold, then by place."""
    return readers(cells, rects).where("n > 0").orderBy(F.desc("n"), "sheet", "row", "col").limit(limit)


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node, level: everything that ``start`` (node) reaches along edges (src, dst), and in how many steps at least. Each
    round is one join with the last round's new nodes, which are written once beside those of earlier rounds."""
    spark, root = edges.sparkSession, shared_folder(edges.sparkSession)
    node = start.select("node").schema
    schema = T.StructType([*node.fields, T.StructField("level", T.IntegerType())])
    front, level = start.select("node").distinct(), 0
    while True:
        front.write.parquet(f"{root}/level={level}")
        front = spark.read.schema(node).parquet(f"{root}/level={level}")
        seen = spark.read.schema(schema).parquet(root)
        if front.isEmpty():
            return seen
        front = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        level += 1
