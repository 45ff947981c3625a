"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geomart.session import scratch_path

#: Bytes of text that one numpy pass holds; longer texts are a pass of their own.
PASS_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The table cuts the lineage; when an executor is lost, later stages read
    the files again instead of recomputing what led to them.
    """
    path = scratch_path(df.sparkSession, "llm", name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: str = "text") -> Column:
    """With the document id this tells repeated ids with different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def total_text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def partitions_for(spark: SparkSession, work_bytes: int, target: int) -> int:
    """Partitions that hold about ``target`` bytes each, at least as many as
    the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-work_bytes // target))


def passes(frames: Iterator[pd.DataFrame], text: str = "text", most: int = PASS_BYTES) -> Iterator[pd.DataFrame]:
    """Cut Arrow batches into runs of rows whose text has about ``most`` bytes."""
    for frame in frames:
        if not len(frame):
            continue
        size = frame[text].str.len().fillna(0).to_numpy(dtype="int64").cumsum()
        part = size // most
        cuts = [0, *((part[1:] != part[:-1]).nonzero()[0] + 1).tolist(), len(frame)]
        for a, b in zip(cuts, cuts[1:]):
            yield frame.iloc[a:b]


def carried(docs: DataFrame, added: list[str]) -> list[Column]:
    """Columns of ``docs`` that an operator hands on; one named like a column
    that the operator adds gives way to it."""
    return [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]


#: Bytes of an Arrow batch that a Python worker holds, unless the session says
#: otherwise: texts are long, and the default of 64 MB is a few hundred as strings.
BATCH_BYTES = 8 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once: they need
    not have it on their path, nor share a folder with the driver. Arrow batches
    of the session get a bound that suits long texts."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    zipped = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(zipped, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(zipped))
    _shipped.add(sc.applicationId)
