"""Elevation files as they arrive: a file stream of tiles, embedded and appended, each file once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import SignatureConfig
from ..operators.embed import embed
from ..sources import dem


def ingest(spark: SparkSession, source: str, out: str, config: SignatureConfig, patch_size: int = 64, pattern: str = "*_dem.npy", files_per_batch: int = 64) -> StreamingQuery:
    """Embed what is under ``source`` and not yet in ``out``; the stream's checkpoint remembers which files were read.

    Stops when it has caught up (``availableNow``); started again, it goes on with files that are new since.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(source)
    embedded = embed(dem.patches(stream, patch_size), config, ("tile_id", "local_id", "row", "col", "y_start", "x_start"))
    return (
        embedded.writeStream.format("parquet").option("path", f"{out}/vectors").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    )
