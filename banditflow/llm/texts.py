"""Helpers shared by the operators of this subpackage: Arrow maps over text columns, hashing, row keys."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lower-case A-Z only; every other byte stays (bytes of multi-byte characters are all >= 0x80).
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

U64 = np.uint64

#: Rows of a batch that are worked on at once.
ROWS = 1024

_KEPT: dict[Hashable, object] = {}
_USED: set[Hashable] = set()


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """``make()``, which this process keeps until a task ends that did not ask for it."""
    _USED.add(key)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def tidy() -> None:
    """At the end of a task: what it did not ask for, and free memory, go back.

    Spark's Python workers live on between tasks and operators; what one of them keeps counts for all that follow.
    """
    for key in _KEPT.keys() - _USED:
        del _KEPT[key]
    _USED.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)  # the C library keeps freed blocks otherwise
    except (AttributeError, OSError):  # another C library
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with ``tidy`` after its last batch."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return task


def slices(batch: pa.RecordBatch, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows."""
    return (batch.slice(lo, rows) for lo in range(0, batch.num_rows, rows))


def map_texts(
    df: DataFrame,
    fn: Callable[[], Callable[[list], dict]],
    fields: list[tuple[str, str]],
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns computed from whole texts, batch by batch (Arrow).

    ``fn()`` is called once per task and returns a function from a list of texts (bytes, a null is
    ``b""``) to ``{column: values}``.  ``fields`` are (name, DDL type) pairs.  Columns of ``df`` in
    ``keep`` (default: all) pass through unchanged; one that has the name of a new column is
    replaced by it.
    """
    new = [name for name, _ in fields]
    carried = [c for c in (df.columns if keep is None else keep) if c not in new]
    types = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType(
        [T.StructField(c, types[c]) for c in carried]
        + [T.StructField(c, T._parse_datatype_string(kind)) for c, kind in fields]
    )
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(schema[c].dataType) for c in new]
    # the text travels as bytes under a name no column has
    body = "__text_bytes__"
    src = df.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").cast("binary").alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for whole in batches:
            for batch in slices(whole):
                if work is None:
                    work = fn()
                texts = [x if x is not None else b"" for x in batch.column(body).to_pylist()]
                got = work(texts)
                columns = [batch.column(i) for i in range(len(carried))]
                columns += [c if isinstance(c := got[n], pa.Array) else pa.array(c, kind) for n, kind in zip(new, arrow)]
                yield pa.RecordBatch.from_arrays(columns, names=[*carried, *new])

    return src.mapInArrow(tidied(run), schema)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two never-null keys of a document row: (id, a null id being the smallest; hash of the text).

    Rows that share an id but not a text stay apart; exact repeats of a row share the key.
    """
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("_k"),
        F.xxhash64(F.coalesce(F.col(text).cast("binary"), F.lit(b""))).alias("_h"),
    ]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place (uint64 arithmetic wraps)."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class WordIds(dict):
    """word (bytes) -> 64-bit hash, filled on demand; emptied at ``limit`` words so memory stays bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(words: list[bytes], ids: WordIds) -> np.ndarray:
    return np.fromiter(map(ids.__getitem__, words), dtype=U64, count=len(words))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes (none when there are fewer)."""
    if len(h) < n:
        return np.empty(0, U64)
    m = len(h) - n + 1
    out = np.full(m, n, U64)
    for j in range(n):
        out *= U64(0x9E3779B97F4A7C15)
        out += h[j : j + m]
        out ^= out >> U64(29)
    return mix64(out)
