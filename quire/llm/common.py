"""Helpers shared by the operators of this package.

*Blocks.* Several operators must bring a document together with facts that
were worked out elsewhere (ids of its words, verdicts on its positions).
Instead of moving one Spark row per word or byte, documents are dealt into
blocks of bounded size by a hash of their id and travel as compressed Arrow
payloads (``pack_blocks``). The number of blocks follows the bytes of the
input, so a block stays bounded at any scale, and the hash makes a hot source
or a group of copies spread over all blocks.
"""

from __future__ import annotations

import os
import sys
import types
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 16 << 20
#: A task packs its rows for all blocks each time it has gathered this much.
FLUSH_BYTES = 32 << 20


def worker_cache() -> dict:
    """What a Python worker keeps between tasks (loaded vocabularies and the
    like). The package's functions reach workers by value, so their own
    globals are new in each task; this lives in the worker's module table."""
    held = sys.modules.setdefault("_quire_llm_worker", types.ModuleType("_quire_llm_worker"))
    return held.__dict__.setdefault("kept", {})


def give_back() -> None:
    """Return memory that a Python worker no longer uses to the system: idle
    workers of earlier stages count as executor memory, too."""
    import ctypes
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def block_count(df: DataFrame, size: Column, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks of about ``block_bytes`` hold ``size`` summed over
    ``df``. Small inputs get up to one block per core, so that they still
    run in parallel."""
    total = int(df.agg(F.sum(size).alias("n")).first()["n"] or 0)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-total // block_bytes), min(2 * cores, total >> 18))


def block_of(key: str, n: int, text: str | None = None) -> Column:
    """Block of a row: a hash of its id, the same on every retry. Rows without
    an id go by ``text``, so that a crowd of them spreads, too."""
    other = [F.when(F.col(key).isNull(), F.col(text))] if text else []
    return F.pmod(F.xxhash64(F.col(key).cast("string"), *other, F.lit("block")), F.lit(n)).cast("int")


def to_payload(t: pa.Table | pa.RecordBatch) -> bytes:
    """An Arrow table as one compressed IPC stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write(t)
    return sink.getvalue().to_pybytes()


def from_payload(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def packed(batches: Iterable[pa.RecordBatch], block: str = "block") -> Iterator[pa.RecordBatch]:
    """Rows as ``(block, payload)`` inside a task: what it has gathered for one
    block becomes a compressed payload each time ``FLUSH_BYTES`` are held."""
    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in held if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by(block).combine_chunks()
        keys = t[block].to_numpy()
        body = t.drop_columns([block])
        cut = [0, *((keys[1:] != keys[:-1]).nonzero()[0] + 1).tolist(), len(keys)]
        for lo, hi in zip(cut, cut[1:]):
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[lo]], pa.int32()), pa.array([to_payload(body.slice(lo, hi - lo))], pa.binary())],
                names=["block", "payload"])

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= FLUSH_BYTES:
            yield from emit(held)
            held, size = [], 0
    yield from emit(held)
    del held
    give_back()


def pack_blocks(df: DataFrame, block: str = "block") -> DataFrame:
    """Rows of ``df`` as ``(block, payload)``: each task gathers what it reads
    for one block into a compressed payload, so a shuffle by block moves few
    rows and little data."""
    return df.mapInArrow(lambda batches: packed(batches, block), "block int, payload binary")


def unpack(payloads: Iterable[bytes]) -> pa.Table | None:
    """All payloads of a block as one table (``None`` when there are none)."""
    parts = [from_payload(p) for p in payloads]
    return pa.concat_tables(parts).combine_chunks() if parts else None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names."""
    from quire.session import ensure_checkpoint_dir
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage so
    that a lost executor only costs the part it was working on."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
