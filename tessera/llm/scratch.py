"""Written tables between the steps of an operator.

A step that later steps read more than once is written as Parquet below the
shared folder that the cluster names in ``spark.checkpoint.dir``, so a lost
executor costs a reread and not a recomputation.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows in one Arrow batch for operators that hand whole texts to Python.
TEXT_BATCH_ROWS = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see; a temporary one only where none is set and all run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors see")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def text_batches(spark: SparkSession) -> None:
    """Bound the texts in one Arrow batch of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


_made: dict = {}


def once(value, name, make):
    """What ``make`` makes of a broadcast value, made once in a Python worker as long as the value is the same."""
    held = _made.get(name)
    if held is None or held[0] is not value:
        held = _made[name] = (value, make(value))
    return held[1]


def extended(schema: StructType, ddl: str) -> StructType:
    """A schema with more fields."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


class Scratch:
    """Tables of one operator run, in a folder of their own."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{operator}-{uuid.uuid4().hex}"
        self._n = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read from its files."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
