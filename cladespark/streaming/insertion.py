"""Sequences that arrive as a stream, placed on a frozen backbone tree."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cladespark.operators.distance import Metric
from cladespark.operators.kernels import NEAREST
from cladespark.operators.placement import Frozen, grown


class Backbone:
    """A tree that stays as it is, its tips and how far its nodes are from the root. It has to fit a task."""

    def __init__(self, tips: pd.DataFrame, metric: Metric, nearest: int = NEAREST):
        """tips: ord and what metric needs; the tree is made of them in this order."""
        self.tips = tips.reset_index(drop=True)
        self.frozen: Frozen = grown(self.tips, metric, nearest)
        self.numbers = {e[:2]: k for k, e in enumerate(self.frozen.edges)}
        self.depth = {self.frozen.tree.root: 0.0}
        for child, parent, length in self.frozen.edges:  # parents come before their children
            self.depth[child] = self.depth[parent] + length

    def place(self, rows: pd.DataFrame, metric: Metric) -> pd.DataFrame:
        tree, out = self.frozen.tree, []
        halves, splits, pendants = tree.places(metric(rows, self.tips))
        for ord_, half, split, pendant in zip(rows["ord"].tolist(), halves.tolist(), splits.tolist(), pendants.tolist()):
            x, y, length = int(tree.src[half]), int(tree.dst[half]), float(tree.length[half])
            down = self.frozen.above.get(y) == x
            edge, split = ((y, x), split) if down else ((x, y), length - split)
            out.append((ord_, self.numbers[edge], split, pendant, self.depth[edge[1]] + split + pendant))
        return pd.DataFrame(out, columns=["ord", "edge", "split", "pendant", "depth"])


def placements(stream: DataFrame, backbone: Backbone, metric: Metric) -> DataFrame:
    """stream: ord and what metric needs. Each row's place: ord, edge, split (from the edge's upper end), pendant, depth.

    Each row depends on the backbone only, so the plan has no state and works alike on batch and stream DataFrames."""
    shared = stream.sparkSession.sparkContext.broadcast(backbone)

    def place(batches):
        for rows in batches:
            for k in range(0, len(rows), 256):
                yield shared.value.place(rows.iloc[k : k + 256], metric)

    return stream.mapInPandas(place, "ord long, edge long, split double, pendant double, depth double")


def insert_stream(stream: DataFrame, backbone: Backbone, metric: Metric, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the placements of a stream to Parquet files, each row exactly once."""
    return placements(stream, backbone, metric).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
