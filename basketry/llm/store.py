"""Binary files in a folder that every executor shares, written and read by
Spark's own sources, so any file system Spark knows will do and a lost
executor costs only its tasks.

``write_blobs`` writes a file per partition, or several: the values of the partition
one after another, each followed by the byte 0x0A (the line separator of
Spark's text source).  File formats of this package let that byte be the
last byte of each blob.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_blobs(blobs: DataFrame, column: str, folder: str, per_file: int = 0) -> None:
    """``per_file``: values after which a partition goes on in a new file."""
    values = blobs.select(F.col(column).cast("string").alias("value"))
    values.write.mode("overwrite").option("maxRecordsPerFile", per_file).text(folder)


def read_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: path, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


#: Bytes of rows that Spark hands to a Python worker at once, unless the
#: session says otherwise: long texts would else fill its memory, as Spark
#: counts rows only.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare_session(spark: SparkSession) -> None:
    """Bound the batches sent to Python workers, and send this package to the
    executors once per application, so that its functions can be loaded
    there whatever their Python path."""
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_basketry_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="basketry-")) / "basketry.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._basketry_shipped = True
