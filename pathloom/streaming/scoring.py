"""Streaming counterpart of prediction: pairs arrive as a stream and are scored batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pathloom.operators.decision_set import DecisionSet
from pathloom.operators.graph import Graph
from pathloom.plans.workflow import predict


def score_stream(pairs: DataFrame, graph: Graph, model: DecisionSet, out: str, checkpoint: str) -> StreamingQuery:
    """Starts scoring a stream of oriented pairs (a, b) into Parquet; each batch replaces its own folder, so a batch run again isn't doubled."""

    def batch(df: DataFrame, number: int) -> None:
        predict(graph, model, df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pairs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
