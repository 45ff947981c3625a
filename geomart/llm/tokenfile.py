"""Token-id files: plane-shuffled, zstandard-compressed blocks with a chunk index.

Layout of a token file (a folder, written by Spark's committed Parquet writer,
so a lost executor leaves nothing half written):

* ``chunks/``: one row per chunk, a run of whole documents of about
  ``chunk_ids`` ids in ascending ``doc_id`` order (a longer document is a chunk
  of its own): ``shard, chunk, shard_start, n_ids, doc_ids, doc_lengths,
  payload, plane_ends``.
* ``index/``: one row per chunk: ``shard, chunk, start`` (ids of all chunks
  before it), ``n_ids, n_docs, first_doc, last_doc, n_bytes``.

``payload`` holds the chunk's blocks of ``block_ids`` ids. A block of n
unsigned 32-bit ids is transposed into 4 byte planes of n bytes or 32 bit
planes of ceil(n / 8) bytes; every plane is a zstandard frame of its own, and
``plane_ends`` says where each frame ends in the payload.

Cases: a null text has no ids but its end id; null ``doc_id`` sorts first;
rows that share a ``doc_id`` stand next to each other, each with its own
place; an empty table gives files without rows. Columns other than the id and
the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geomart.llm.common import passes, text_key
from geomart.llm.tokens import encoder

BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 19

CHUNK_SCHEMA = "shard int, chunk int, shard_start long, n_ids long, doc_ids array<long>, doc_lengths array<long>, payload binary, plane_ends array<long>"


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """One block of unsigned 32-bit ids as byte or bit planes."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [octets[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    if len(parts) == 4:
        octets = np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in parts], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


def pack_chunk(ids: np.ndarray, planes: str, block_ids: int, level: int) -> tuple[bytes, list[int]]:
    import zstandard

    z = zstandard.ZstdCompressor(level=level)
    frames = [z.compress(p) for a in range(0, len(ids), block_ids) for p in to_planes(ids[a : a + block_ids], planes)]
    return b"".join(frames), np.cumsum([len(f) for f in frames]).tolist()


def unpack_chunk(payload: bytes, plane_ends: list[int], n_ids: int, planes: str, block_ids: int) -> np.ndarray:
    import zstandard

    z, per, out = zstandard.ZstdDecompressor(), 4 if planes == "byte" else 32, []
    bounds = [0, *plane_ends]
    for block, a in enumerate(range(0, n_ids, block_ids)):
        cut = bounds[block * per : (block + 1) * per + 1]
        out.append(from_planes([z.decompress(payload[x:y]) for x, y in zip(cut, cut[1:])], min(block_ids, n_ids - a)))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def write_token_file(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    planes: str = "byte",
    block_ids: int = BLOCK_IDS,
    chunk_ids: int = CHUNK_IDS,
    level: int = 3,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode every whole text, append ``end_id`` and write a token file.

    Documents are dealt into shards by ranges of ``doc_id``; one task writes
    one shard chunk by chunk and holds one chunk at a time.
    """
    if planes not in ("byte", "bit"):
        raise ValueError(f"planes must be 'byte' or 'bit', not {planes!r}")
    end = np.array([end_id], "<u4").tobytes()

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard, chunk, start = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        names: list[int | None] = []
        n = 0

        def flush() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(held), "<u4")
            payload, ends = pack_chunk(ids, planes, block_ids, level)
            return pd.DataFrame([{"shard": shard, "chunk": chunk, "shard_start": start, "n_ids": len(ids), "doc_ids": list(names), "doc_lengths": [len(x) // 4 for x in held], "payload": payload, "plane_ends": ends}])

        for frame in passes(frames):
            encoded = encoder(tokenizer_path).encode(frame["text"].tolist())
            ids = [int(i) if has else None for i, has in zip(frame["doc_id"].fillna(0), frame["doc_id"].notna())]
            for name, x in zip(ids, encoded):
                if held and n + len(x) // 4 + 1 > chunk_ids:
                    yield flush()
                    chunk, start = chunk + 1, start + n
                    held, names, n = [], [], 0
                held.append(x + end)
                names.append(name)
                n += len(x) // 4 + 1
        if held:
            yield flush()

    dealt = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("_k", text_key())
    # The second key splits a doc_id that very many rows share.
    dealt = dealt.repartitionByRange("doc_id", "_k").sortWithinPartitions("doc_id", "_k").drop("_k")
    dealt.mapInPandas(write, CHUNK_SCHEMA).write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = read_chunks(docs.sparkSession, path)
    chunks.select(
        "shard", "chunk", (F.col("shard_start") + F.col("_before")).alias("start"), "n_ids",
        F.size("doc_ids").alias("n_docs"), F.element_at("doc_ids", 1).alias("first_doc"), F.element_at("doc_ids", -1).alias("last_doc"),
        F.octet_length("payload").alias("n_bytes"),
    ).write.parquet(f"{path}/index")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows and, as ``_before``, the ids of all shards before theirs."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")
    # One row per shard, that is per task of the job that wrote the file: the
    # driver holds as many rows as it has scheduled tasks.
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = before.collect()
    table = spark.createDataFrame([(r["shard"], r["_before"]) for r in rows], "shard int, _before long")
    return chunks.join(F.broadcast(table), "shard")


def read_token_file(spark: SparkSession, path: str, planes: str = "byte", block_ids: int = BLOCK_IDS) -> DataFrame:
    """``doc_id, start, ids`` of every document; ``start`` counts the ids of all
    documents before it, ``ids`` are little-endian unsigned 32-bit integers."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids = unpack_chunk(row.payload, list(row.plane_ends), row.n_ids, planes, block_ids)
                lengths = np.array(row.doc_lengths, np.int64)
                ends = np.cumsum(lengths)
                yield pd.DataFrame({
                    "doc_id": pd.array([None if pd.isna(i) else int(i) for i in row.doc_ids], "Int64"),
                    "start": row.start + ends - lengths,
                    "ids": [ids[e - n : e].tobytes() for e, n in zip(ends, lengths)],
                })

    chunks = read_chunks(spark, path).select((F.col("shard_start") + F.col("_before")).alias("start"), "n_ids", "doc_ids", "doc_lengths", "payload", "plane_ends")
    return chunks.mapInPandas(read, "doc_id long, start long, ids binary")
