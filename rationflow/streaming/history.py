"""K1: formulation requests arrive as a stream; every micro-batch is solved
against the (static) facets and its successes are appended to the history table.

The checkpoint belongs to the table and the stream's name: a stream that is
started again goes on where it was, and another name is another stream.  An
epoch is committed under the query's id, which lives as long as the checkpoint,
so the first epochs of two streams are not the same epoch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import ration
from ..operators.facets import Facets
from ..session import new_table
from ..sinks import commits

HISTORY_COLS = ("scenario_id", "user_id", "ts", "animal", "age_weeks", "weight_kg", "cp_req", "energy_req",
                "status", "total_cost")


def history_schema(requests: DataFrame) -> StructType:
    own = {f.name: f for f in requests.schema.fields}
    out = StructType()
    for c in HISTORY_COLS:
        out = out.add(own[c]) if c in own else out.add(c, "string" if c == "status" else "double")
    return out


def history_stream(spark: SparkSession, requests: DataFrame, facets: Facets, table_path: str | None = None,
                   name: str = "requests", once: bool = True) -> tuple[DataFrame, str]:
    """Start (and with ``once`` finish) the append stream; returns the
    history table as a batch DataFrame and its path.  Only requests with a
    ration are recorded."""
    table_path = table_path or new_table(spark, "history")
    checkpoint = f"{table_path.rstrip('/')}/_streams/{name}"

    def append(batch: DataFrame, epoch: int) -> None:
        query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        solved = ration.solve(batch, facets).where(F.col("status") == "optimal")
        commits.append(solved.select(*HISTORY_COLS), table_path, query, epoch)

    w = requests.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    q = (w.trigger(availableNow=True) if once else w).start()
    if once:
        q.awaitTermination()
    return commits.read(spark, table_path, history_schema(requests)), table_path
