"""Running a stream over what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def finished(stream: DataFrame, folder: str) -> StreamingQuery:
    """Process all that has come and write it to ``folder``/out; the next run goes on from ``folder``/state.

    The state store is the one that keeps several kinds of state for a key; the session's
    setting is as before afterwards.
    """
    conf = stream.sparkSession.conf
    former = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, former) if former else conf.unset(PROVIDER)
    query.awaitTermination()
    return query
