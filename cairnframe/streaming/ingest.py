"""Growing artifacts: micro-batches appended to a saved table.

The artifact store itself knows no streams; this is Structured Streaming at its
edge.  Each batch is written below the object's ``columns`` under its own batch
number, so a batch that is tried again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairnframe.functions.types import ROW_ID, check_names
from cairnframe.sources.files import Files
from cairnframe.sources.store import write_descriptor


def append_stream(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that appends ``stream`` to the table at ``path`` (made if it does not exist)."""
    spark = stream.sparkSession
    files = Files(spark)
    check_names(stream.columns)
    if not files.exists(f"{path}/OBJECT"):
        files.make(path)
        write_descriptor(files, path, "data_frame", {"data_frame": {"row_names": False, "columns": [c for c in stream.columns if c != ROW_ID]}})

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if ROW_ID in batch.columns else batch.withColumn(ROW_ID, F.monotonically_increasing_id() + (F.lit(number).cast("long") * (1 << 40)))
        rows.write.mode("overwrite").parquet(f"{path}/columns/__batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
