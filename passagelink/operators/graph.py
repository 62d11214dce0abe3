"""Connected components of records tied by shared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from passagelink.session import materialize


def components(df: DataFrame, ident: str, keys: list[str]) -> DataFrame:
    """Connected components of records tied by equal identifiers or keys. Columns out: ident, component_id.

    One row for each distinct non-null identifier; component_id is the smallest identifier of the component. Null keys
    tie nothing.

    A key's records are tied to its smallest record, which leaves a forest of stars, whatever a key's size. Each round
    then ties every record's larger neighbours, and after them its smaller ones, to its smallest neighbour (the two
    alternating star operations of Kiveris et al., Connected components in MapReduce and beyond, 2014). Both take the
    minimum per record by partial aggregation. Chains shrink by a constant factor a round.
    """
    nodes = df.filter(F.col(ident).isNotNull())
    edges = None
    for k in keys:
        one = nodes.filter(F.col(k).isNotNull()).select(F.col(ident).cast("string").alias("v"), F.col(k).alias("k")).distinct()
        star = one.join(one.groupBy("k").agg(F.min("v").alias("u")), "k").filter("u < v").select("u", "v")
        edges = star if edges is None else edges.unionByName(star)
    edges = materialize(edges.distinct())  # u < v
    state = None
    while True:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.join(low, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        # now the smaller neighbours of each record go to the smallest of them
        low = edges.groupBy("v").agg(F.min("u").alias("m"))
        tied = edges.join(low, "v").select("m", F.explode(F.array("u", "v")).alias("v")).filter("m < v").select(F.col("m").alias("u"), "v").distinct()
        # finished when a round changes no edge, as the number and the sum of the edges' hashes show
        seen = Observation()
        edges = materialize(tied.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        now = dict(seen.get)
        if now == state:
            break
        state = now
    every = nodes.select(F.col(ident).cast("string").alias("v")).distinct()
    return every.join(edges, "v", "left").select(F.col("v").alias(ident), F.coalesce("u", "v").alias("component_id"))
