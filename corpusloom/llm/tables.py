"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: its shuffle files go when it is written, since whatever follows reads the table;
#: and Arrow batches are small, since the memory outside the heap that an executor takes for them stays taken.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only where that is unset and the master local, as in tests, a folder of this machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corpusloom-"))
    return folder or sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def _under(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    conf = spark.conf
    before = {k: conf.get(k, None) for k in settings}
    for k, v in settings.items():
        conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                conf.unset(k)
            else:
                conf.set(k, v)


def written(df: DataFrame, path: str, **options: str) -> None:
    """Writes df as Parquet under _SETTINGS."""
    with _under(df.sparkSession, _SETTINGS):
        df.write.options(**options).parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """df, computed once: a Parquet table in the checkpoint folder, whose files outlive executors.

    The plan that follows starts at the table, without what the optimiser knew of df.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    written(df, path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the checkpoint folder for the time of a job: deleted at its end, whether it succeeds or not."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            self._delete(path)
        self.paths.clear()

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def table(self, df: DataFrame) -> DataFrame:
        """df, computed once, until the end of the job."""
        path = f"{checkpoint_dir(self.spark).rstrip('/')}/table-{uuid.uuid4().hex}"
        self.paths.append(path)
        written(df, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, table: DataFrame) -> None:
        """Deletes a table of table(), which nothing reads any more."""
        self.paths.remove(table._scratch_path)
        self._delete(table._scratch_path)

    def keep(self, df: DataFrame) -> DataFrame:
        """df, computed once, as a table that stays: a job's result."""
        return materialise(df)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once, with its partitions and their order kept."""
    checkpoint_dir(df.sparkSession)
    with _under(df.sparkSession, {k: v for k, v in _SETTINGS.items() if ".arrow." in k}):
        return df.checkpoint(eager=True)
