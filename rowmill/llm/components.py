"""Connected components of a graph of links, by alternating large-star and small-star steps.

Each step groups the links by an end, takes the smallest neighbour and links to that instead. Only minima are
aggregated, before the shuffle, and joined back, so the many links of one hub never meet in a task as a group.
Every step is written to the shared folder. Links are first contracted within each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' component, for links a[i] - b[i]."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def contract(links: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """Links (a, b) with a > b that join the same nodes, stars within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                ends = np.stack([batch.column(i).slice(at, rows).to_numpy() for i in (0, 1)])
                nodes, place = np.unique(ends, return_inverse=True)
                place = place.reshape(ends.shape)
                low = labels(len(nodes), place[0], place[1])
                out = np.flatnonzero(low != np.arange(len(nodes)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[low[out]])], ["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node and component (its smallest member) of every node that has a link; links are (a, b) of longs.

    The steps end when one changes nothing: after about the logarithm of the longest chain of contracted links."""
    now = written(contract(links.filter("a != b")), name)
    state = None
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("least"))
        large = both.join(low, both.a == low.hub).select(F.col("b").alias("a"), "a", F.least("least", "hub").alias("m")).toDF("v", "u", "m").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("least"))
        small = large.join(least, large.a == least.hub).select(F.explode(F.array(F.struct(F.col("a"), F.col("least").alias("b")), F.struct(F.greatest("b", "least").alias("a"), F.col("least").alias("b")))).alias("x")).select("x.*").filter("a != b").distinct()
        now = written(small, name)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = seen
