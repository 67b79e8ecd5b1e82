"""Connected components of a graph of links, by contraction.

Every round points each node to its smallest neighbour, follows the pointers to their ends by pointer jumping, and keeps
of the links only those between different ends, which are the next round's nodes.  A node without a smaller neighbour
has one in the next round, so the nodes halve at least every two rounds.  A link is looked up once at each end in a
round and is gone when its ends meet: a dense group costs its links once, not once a round.  What a round leaves is
written to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.runtime import cut


def _ends(pointers: DataFrame) -> DataFrame:
    """(node, label) with each node's pointer followed to its end, a node that points to itself."""
    while True:
        up = pointers.filter("node <> label").select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = pointers.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"), F.col("above").isNotNull().alias("moved"))
        jumped = cut(jumped, narrow=True)
        pointers = jumped.select("node", "label")
        if not jumped.filter("moved").limit(1).count():
            return pointers


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b); the component is its smallest node.  Loops and repeats are fine."""
    # from one evaluation: links that are computed anew may be another spanning forest
    edges = cut(links.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), narrow=True)
    labels = None
    while True:
        ways = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("near")), F.struct(F.col("v").alias("node"), F.col("u").alias("near"))))
        nearest = edges.select(ways.alias("x")).select("x.node", "x.near").groupBy("node").agg(F.min("near").alias("near"))
        ends = _ends(cut(nearest.select("node", F.least("node", "near").alias("label")), narrow=True))
        if labels is None:
            labels = ends
        else:
            above = ends.select(F.col("node").alias("label"), F.col("label").alias("above"))
            labels = cut(labels.join(above, "label", "left").select("node", F.coalesce("above", "label").alias("label")), narrow=True)
        u, v = (ends.select(F.col("node").alias(c), F.col("label").alias(f"{c}_end")) for c in "uv")
        apart = edges.join(u, "u").join(v, "v").filter("u_end <> v_end").select(F.least("u_end", "v_end").alias("u"), F.greatest("u_end", "v_end").alias("v"))
        edges = cut(apart.distinct(), narrow=True)
        if not edges.limit(1).count():
            return labels.select("node", F.col("label").alias("component"))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' component under the links (a, b), in memory."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        nxt = label.copy()
        np.minimum.at(nxt, a, low)
        np.minimum.at(nxt, b, low)
        nxt = nxt[nxt]
        if (nxt == label).all():
            return label
        label = nxt
