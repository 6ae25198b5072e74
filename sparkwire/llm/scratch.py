"""Tables written to the folder that driver and executors share.

Long lineages are cut by writing a table below ``spark.checkpoint.dir`` and
reading it again. Such a table survives the loss of any executor, stays
columnar and can be read by several later jobs.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one is set only where none is, in a single process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="sparkwire-")
    spark.sparkContext.setCheckpointDir(own)
    return shared_dir(spark)


class Scratch:
    """A folder of intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._drop_all)

    def place(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return the table read back, with its schema given (no inference job)."""
        place = self.place(name)
        with self._small_batches():
            df.write.option("compression", "zstd").parquet(place)
        out = self.spark.read.schema(df.schema).parquet(place)
        out._sparkwire_place = place
        return out

    @contextmanager
    def _small_batches(self):
        """Rows hold whole texts, sets or sketches: fewer to a batch than Spark's 10000 keep tasks and workers small."""
        held = self.spark.conf.get(_BATCH)
        self.spark.conf.set(_BATCH, str(min(int(held), BATCH_ROWS)) if int(held) > 0 else str(BATCH_ROWS))
        try:
            yield
        finally:
            self.spark.conf.set(_BATCH, held)

    def drop(self, *tables: DataFrame | str) -> None:
        for t in tables:
            self._delete(t if isinstance(t, str) else t._sparkwire_place)

    def _delete(self, place: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _drop_all(self) -> None:
        try:
            self._delete(self.path)
        except Exception:  # noqa: BLE001 - the session may be gone when the interpreter ends
            pass


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"
