"""Incremental merge: a stream of node, edge and warning documents into a versioned Parquet store.

Each micro-batch is merged with the store's last version, which is the left side and wins, and becomes
the next version. A batch that runs again after a failure writes its own version anew, so results are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skeinwork.operators.merge import merge
from skeinwork.schemas import EDGES, NODES, WARNINGS, Graph, graph_of

SECTIONS = {"nodes": NODES, "edges": EDGES, "warnings": WARNINGS}


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(section, value) lines, as ``emit.formats.graph_rows`` writes them."""
    return spark.readStream.schema("section string, value string").json(folder)


def batch_graph(batch: DataFrame) -> Graph:
    """The graph of a batch of (section, value)."""
    parts = {name: batch.filter(F.col("section") == name).select(F.from_json("value", ddl).alias("x")).select("x.*") for name, ddl in SECTIONS.items()}
    return graph_of(batch.sparkSession, **parts)


def write_version(g: Graph, store: str, version: int) -> None:
    for name in SECTIONS:
        getattr(g, name).write.mode("overwrite").parquet(f"{store}/{name}/version={version}")


def read_version(spark: SparkSession, store: str, version: int) -> Graph:
    return graph_of(spark, **{name: spark.read.parquet(f"{store}/{name}/version={version}") for name in SECTIONS})


def start(documents: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Start merging; version n of the store is the merge of batches 0 to n."""

    def absorb(batch: DataFrame, batch_id: int) -> None:
        g = batch_graph(batch)
        if batch_id > 0:
            g = merge(read_version(batch.sparkSession, store, batch_id - 1), g)
        else:
            g = merge(g)
        write_version(g, store, batch_id)

    return documents.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
