"""An extension: new secondary records against the primary records' keys, as they arrive.

The primary side's keys are a table; each micro-batch is an ordinary key join with it. Caps need
counts of all secondary records, so a stream uses the keys that an earlier batch run found to be
within their caps (``live_keys``), and gives the pairs that a batch run over the same records gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kindred.operators import blocking
from kindred.operators.keys import V4, Blocking, prepare, primary_keys, target_keys


def live_keys(s1: DataFrame, targets: DataFrame, config: Blocking = V4) -> DataFrame:
    """entity_id, sig, key of the primary records, without the keys that known targets overfill."""
    own = primary_keys(prepare(s1, config.how, config.strip_tld), config)
    posted = blocking.wanted(target_keys(prepare(targets, config.how, config.strip_tld), config), own)
    full = posted.select("sig", "key").distinct().join(blocking.within_caps(posted, config.caps).select("sig", "key").distinct(), ["sig", "key"], "left_anti")
    return own.join(full, ["sig", "key"], "left_anti")


def stream_candidates(stream: DataFrame, keys: DataFrame, path: str, checkpoint: str, config: Blocking = V4) -> StreamingQuery:
    """Appends each micro-batch's candidate pairs, as Parquet in a folder of the batch's number, so that a repeated batch replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        found = target_keys(prepare(batch, config.how, config.strip_tld), config)
        blocking.candidates(keys, found, config.signals).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
