"""Fits and scores over streams.

The state of a streaming fit is that of the batch aggregation: a row for each
group, never rows. It is emitted whole after each batch and solved there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import FitError
from ..operators.fit import solve
from ..operators.moments import FACTOR, STATE, STREAM_TERMS, by_sql, by_tasks, merge
from ..operators.score import score_rows
from ..schema import FitSchema


def streaming_states(stream: DataFrame, schema: FitSchema) -> DataFrame:
    """A streaming aggregation of co-moments over a stream of training rows, for a few terms."""
    if schema.p > STREAM_TERMS:
        raise FitError("BAD_TERMS", f"{schema.p} terms; this aggregation holds up to {STREAM_TERMS}")
    return by_sql(schema.training(stream), schema.p)


def start_fit(stream: DataFrame, schema: FitSchema, sink, checkpoint: str, trigger: dict | None = None, solver: str = "normal", sql_terms: int = STREAM_TERMS) -> StreamingQuery:
    """Calls sink(fits, batch_id) after each batch with the fits of all rows so far.

    With more than `sql_terms` terms, and for QR, a batch's states are merged into those of the batch before, which are kept as a table for each batch
    beside the checkpoint: a batch that is run again starts from the same table and gives the same one.
    """
    trigger = trigger or {"availableNow": True}
    if solver == "normal" and schema.p <= sql_terms:

        def each(states: DataFrame, batch: int) -> None:
            sink(solve(states), batch)

        writer = streaming_states(stream, schema).writeStream.outputMode("complete").foreachBatch(each)
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()

    factor = solver == "qr"
    kind = FACTOR if factor else STATE
    table = f"{checkpoint.rstrip('/')}-states"

    def add(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        new = by_tasks(rows, schema.p, factor)
        if batch:
            new = merge(spark.read.schema(kind).parquet(f"{table}/{batch - 1}").withColumn("part", F.lit(0)).unionByName(new.withColumn("part", F.lit(1))), schema.p, factor)
        new.write.mode("overwrite").parquet(f"{table}/{batch}")
        sink(solve(spark.read.schema(kind).parquet(f"{table}/{batch}"), solver), batch)

    return schema.training(stream).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def score_stream(cases: DataFrame, model: DataFrame, scale: int = 4) -> DataFrame:
    """A stream of cases (group, x) joined to a fixed model: rows go out as they come."""
    return score_rows(cases, model, None, scale)


