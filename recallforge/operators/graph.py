"""Connected components of edges, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallforge.sources.shared import Scratch


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(id, root): every id of the edges (a, b) with the smallest id that it is connected with; nulls are no ids.

    A round gives every id the smallest one among itself, its neighbours and what those point at, so a path is halved; it
    ends when nothing changes.  A hot id costs its edges only, as neighbours are aggregated before they are shuffled.
    """
    both = edges.filter("a is not null and b is not null and a <> b")
    both = scratch.table(both.select("a", "b").unionByName(both.selectExpr("b a", "a b")).distinct(), "edges")
    state = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")), "parts")
    for _ in range(rounds):
        near = both.join(state.selectExpr("id b", "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        low = state.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("root", "m").alias("m"))
        # what an id points at may have found a smaller one, too
        new = low.join(low.select(F.col("id").alias("m"), F.col("m").alias("next")), "m", "left").select("id", F.coalesce("next", "m").alias("root"))
        new = scratch.table(new, "parts")
        if new.join(state.withColumnRenamed("root", "was"), "id").filter("root <> was").isEmpty():
            return new
        state = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")
