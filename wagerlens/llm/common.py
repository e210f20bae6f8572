"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zipfile
from collections import OrderedDict
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The most rows that any operator broadcasts; beyond it a shuffle join is used.
BROADCAST_ROWS = 200_000

#: Words are runs of anything but space, tab, LF, VT, FF and CR: what ``bytes.split()`` gives on UTF-8.
ASCII_SPACE = "\\x20\\x09-\\x0D"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, as ``--py-files`` would, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_wagerlens_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    bundle = Path(tempfile.mkdtemp(prefix="wagerlens-")) / "wagerlens.zip"
    with zipfile.ZipFile(bundle, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(bundle))
    context._wagerlens_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only a local master may leave that unset; it then gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_wagerlens_folder", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.sparkContext._wagerlens_folder = tempfile.mkdtemp(prefix="wagerlens-")
    return f"{root.rstrip('/')}/wagerlens-{uuid.uuid4().hex}"


#: Things that a worker process keeps for the tasks to come; each has bounds of its own.
RESIDENTS = 2
_residents: OrderedDict[str, Any] = OrderedDict()


def resident(key: str, build: Callable[[], Any]) -> Any:
    """What ``build`` gives, made once in a worker process for a key, as long as it is among the last ``RESIDENTS`` that were used."""
    if key not in _residents:
        while len(_residents) >= RESIDENTS:
            _residents.popitem(last=False)
        _residents[key] = build()
    _residents.move_to_end(key)
    return _residents[key]


def version(kind: str, path: str) -> str:
    """A name of a file's content, as a key for ``resident``."""
    return f"{kind}:{hashlib.sha256(Path(path).read_bytes()).hexdigest()}"


#: Rows that one task writes of a step whose number of rows is known beforehand.
TASK_ROWS = 100_000


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write a step to the shared folder and read it back: lineage ends here, and a lost executor loses nothing.

    If about so many ``rows`` are expected, they are written by as many tasks as these need, four at least.
    """
    folder = shared_folder(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(4, -(-rows // TASK_ROWS)))
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written frame for broadcast if its counted rows are few, else leave the join to shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The two columns (doc_id, text) only, whatever else the frame holds."""
    ship(docs.sparkSession)
    return docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_column: Column, folds: int = 5) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds, F.lit(0))
