"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import matchgrid
from matchgrid.session import drop_work, table, work_folder, written  # noqa: F401

# Executors need no copy of this package: its functions travel with the plan.
cloudpickle.register_pickle_by_value(matchgrid)

#: Rows that a function sees at once; long texts count, so it stays at a few MB.
BATCH_ROWS = 400
#: Rows of the batches that Spark sends to Python, at most, and the bytes from which a batch is sent as it is.
SENT_ROWS = 2000
SENT_BYTES = 4 << 20

Batches = Iterator[pa.RecordBatch]


def map_arrow(df: DataFrame, fn: Callable[[Batches], Batches], schema: str, batch_rows: int = BATCH_ROWS, cached: bool = False) -> DataFrame:
    """``mapInArrow`` with small batches, so that memory follows one batch only.

    Spark sends up to 64 MB at once by default, which JVM and worker both hold; its
    bounds are lowered to ``SENT_ROWS`` and ``SENT_BYTES`` where they are higher, always to
    these values. What a function sees is sliced here, whatever the bounds.
    Workers serve one step after another: unless ``fn`` is ``cached``, what an earlier one left in
    ``worker_cache`` goes first.
    """
    conf, read = df.sparkSession.conf, df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= SENT_ROWS:
        conf.set(name, str(SENT_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if read(conf.get(name)) > SENT_BYTES:
        conf.set(name, str(SENT_BYTES))

    def sliced(batches: Batches) -> Batches:
        if not cached:
            release_cache()
        return fn(b.slice(k, batch_rows) for b in batches for k in range(0, max(1, b.num_rows), batch_rows))

    return df.mapInArrow(sliced, schema)


def worker_cache() -> dict:
    """What outlives a task in its Python worker, until a step that does not use it; functions that travel with a plan have no module of their own."""
    return vars(sys.modules.setdefault("_matchgrid_worker", types.ModuleType("_matchgrid_worker"))).setdefault("kept", {})


def release_cache() -> None:
    """Empties ``worker_cache`` and gives the memory back to the system."""
    kept = worker_cache()
    if kept:
        kept.clear()
        pa.default_memory_pool().release_unused()
        # Freed memory stays with the C library otherwise; other ones than glibc have no such call.
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def materialize(df: DataFrame, name: str, instead_of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``written``; the driver lets go of the step's shuffle files, plans and tasks now, not when it next happens to collect its garbage.

    Its heap shrinks to a small multiple of what is still needed, so that many steps of many partitions do not fill it.
    """
    out = written(df, name, instead_of)
    df.sparkSession._jvm.System.gc()
    return out


#: Keys that count as hot, at most, and the least rows of one.
HOT_KEYS, HOT_ROWS = 10_000, 200


def join_keyed(rows: DataFrame, keyed: DataFrame, key: str | list[str], counts: str = "n_rows") -> DataFrame:
    """Inner join of ``rows`` with one row for each ``key``; ``counts`` is the rows of the key.

    Keys with more than one in ``HOT_KEYS`` of all rows are at most ``HOT_KEYS``,
    whatever the input, so they are broadcast; the rows of the others meet
    their key by a shuffle, in which none is large.
    """
    keys = [key] if isinstance(key, str) else key
    total, most = keyed.agg(F.coalesce(F.sum(counts), F.lit(0)), F.coalesce(F.max(counts), F.lit(0))).first()
    least = max(HOT_ROWS, total // HOT_KEYS)
    if most <= least:
        return rows.join(keyed.drop(counts), keys)
    hot = F.col(counts) > least
    head = F.broadcast(keyed.where(hot))
    rest = rows.join(F.broadcast(keyed.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(head, keys).unionByName(rest.join(keyed.where(~hot), keys)).drop(counts)


#: Rows of a list of keys (some 8 to 30 bytes each) that is broadcast, at most.
BROADCAST_ROWS = 1_000_000


def few(keys: DataFrame) -> bool:
    """Whether a written list of keys may be broadcast."""
    return keys.count() <= BROADCAST_ROWS


def among(rows: DataFrame, keys: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """Rows that are (``left_anti``: are not) in a written list of keys; only beyond a bound do the rows move for it."""
    return rows.join(F.broadcast(keys) if few(keys) else keys, on, how)


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, cast; extra columns never clash."""
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()])


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null counts as empty, lone surrogates as '?'."""
    return b"" if text is None else text.encode("utf-8", "replace")


