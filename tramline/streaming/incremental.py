"""Alignment of cases as they arrive: each micro-batch of complete cases is aligned and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans.align import align, matches


def align_stream(cases: DataFrame, path: str, checkpoint: str, config: Config = Config()) -> StreamingQuery:
    """cases: a stream of (case_id, xml, text). Each batch goes to its own folder, so a repeated batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        run = align(batch.select("case_id", "xml"), batch.select("case_id", "text"), config)
        matches(run, config).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cases.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
