"""The k most similar vectors of every vector (Euclidean distance).

Cross-polytope buckets collect candidates, every candidate is ranked by its exact double-precision
distance. Exact copies are one vector while searching and are expanded afterwards: of a group of
copies only the k + 1 smallest ids can be a neighbour of anything.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import vectors as V
from quarry.session import Scratch

_SCHEMA = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("d2", pa.float64())])


def nearest_neighbours(df: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 5, max_distance: float = float("inf"), tables: int = 3, seed: int = 7, cap: int = V.BLOCK_CAP) -> DataFrame:
    """Columns ``id, other, distance``: for every valid vector its k nearest others.

    Equal distances: the smaller id is nearer. Vectors farther than ``max_distance`` are left out.
    Recall is a matter of ``tables``; distances are exact. Invalid vectors (see
    ``vectors``) neither ask nor answer; an empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "similar")
    v = V.Vectors(df, id_col, vec_col, dim, scratch)
    members = v.members
    rows = V.bucket_rows(v, tables, seed, cap)
    max_d2 = max_distance * max_distance
    found = V.for_each_block(rows, dim, _SCHEMA, "id long, other long, d2 double", lambda b: V.block_neighbours(b, k, max_d2))
    best = merge_neighbours(found, k)
    # Ids of a group that can be anybody's neighbour: the first k + 1 (one of them may be the asker).
    heads = members.withColumn("rank", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("rank") <= k + 1)
    heads = scratch.write(heads.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("head")))
    near = best.join(heads.select(F.col("rep").alias("other"), F.slice("head", 1, k).alias("near")), "other").select(F.col("id").alias("rep"), F.explode("near").alias("other"), "d2")
    outside = near.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list(F.struct("d2", "other"))), 1, k).alias("out"))
    own = heads.join(outside, "rep", "left")
    asked = members.join(own, "rep").select(
        "id",
        F.slice(
            F.concat(
                F.transform(F.filter("head", lambda x: x != F.col("id")), lambda x: F.struct(F.lit(0.0).alias("d2"), x.alias("other"))),
                F.coalesce("out", F.array().cast("array<struct<d2:double,other:bigint>>")),
            ),
            1, k,
        ).alias("nb"),
    )
    return asked.select("id", F.explode("nb").alias("n")).select("id", F.col("n.other").alias("other"), F.sqrt("n.d2").alias("distance"))


def merge_neighbours(found: DataFrame, k: int) -> DataFrame:
    """Best k distinct partners per id over all tables and blocks: ``id, other, d2``."""
    lists = found.groupBy("id").agg(F.collect_set(F.struct("d2", "other")).alias("nb"))
    return lists.select("id", F.explode(F.slice(F.sort_array("nb"), 1, k)).alias("n")).select("id", "n.other", "n.d2")


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """Unordered pairs (pid_a < pid_b) of which one names the other."""
    return neighbours.select(F.least("id", "other").alias("pid_a"), F.greatest("id", "other").alias("pid_b")).distinct()
