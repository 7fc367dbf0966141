"""One document of each group of near copies: SimHash links and verified MinHash links together.

SimHash joins texts whose fingerprints differ in few bits, MinHash texts of which most runs of five words agree; each finds
near copies that the other's threshold misses. A group is what links of either kind join.

Rows that share an id are one document, of which the row with the least text (nulls first) stays. A row without an id is a
document of its own, equal rows of that kind one; it gives way to documents with an id. Null and empty texts are near copies
of each other. An empty table gives no rows. All columns are returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import minhash, simhash
from gridloom.llm.common import Scratch
from gridloom.llm.components import components


def unused(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_of_each(docs: DataFrame) -> DataFrame:
    scratch, node, place = Scratch(docs.sparkSession), unused(docs, "_node"), unused(docs, "_place")
    stand_in = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))  # beyond all ids in use
    rows = docs.withColumn(node, F.coalesce(F.col("doc_id").cast("long"), stand_in))
    plain = rows.select(F.col(node).alias("doc_id"), "text")
    edges = None
    for found in (simhash.groups(plain), minhash.near_duplicates(plain)):
        own = found.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
        edges = own if edges is None else edges.unionByName(own)
    gone = components(edges, scratch).where("node <> root").select(F.col("node").alias(node)).distinct()
    left = rows.join(gone, node, "left_anti")
    several = left.groupBy(node).agg(F.count("*").alias("n")).where("n > 1").select(node)
    first = Window.partitionBy(node).orderBy(F.col("text").asc_nulls_first())
    repeated = left.join(several, node, "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    return left.join(several, node, "left_anti").unionByName(repeated).select(*(F.col(f"`{c}`") for c in docs.columns))
