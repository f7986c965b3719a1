"""What the training-data operators share: the shared folder, tables, Arrow rows and ranged files."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from proofline.storage import materialise, new_path, shared_dir  # noqa: F401

WS = "\t\n\x0b\x0c\r "  # the separators of `[^\x20\x09-\x0D]+`


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets(spark: SparkSession) -> int:
    """Into how many parts keys are dealt; it follows spark.sql.shuffle.partitions, which is set by data size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


@lru_cache(maxsize=1)
def lean() -> None:
    """Give freed memory back at once: a worker lives on after its task, beside those of later stages."""
    trim_threshold, mmap_threshold, arenas = -1, -3, -8  # mallopt's parameters
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        for parameter, value in ((mmap_threshold, 4 << 20), (trim_threshold, 16 << 20), (arenas, 2)):
            ctypes.CDLL("libc.so.6").mallopt(parameter, value)
        pa.set_memory_pool(pa.system_memory_pool())


def with_own_columns(docs: DataFrame, work: Callable[[DataFrame], DataFrame], kept: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """`work(docs)` with the columns of docs, where work must not meet names that it uses itself.

    All columns but `kept` get other names for the work and their own, by position, in the result; work gives them back.
    """
    inner = [n if n in kept else f"__own_{i}" for i, n in enumerate(docs.columns)]
    return work(docs.toDF(*inner)).select(*inner).toDF(*docs.columns)


def rows_of(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches as Python tuples, a slice of 256 rows at a time; runs in workers."""
    lean()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


def sized(rows: Iterable[tuple], size_of, limit: int) -> Iterator[list[tuple]]:
    """Lists of consecutive rows; a list is closed once its sizes reach `limit`."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


class Out:
    """Collects rows and gives Arrow batches of a schema once they are large enough."""

    def __init__(self, schema: pa.Schema, rows: int = 4096):
        self.schema, self.most = schema, rows
        self.columns: list[list] = [[] for _ in schema]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)

    def ready(self, force: bool = False) -> Iterator[pa.RecordBatch]:
        if self.columns[0] and (force or len(self.columns[0]) >= self.most):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
            self.columns = [[] for _ in self.schema]


def from_text(docs: DataFrame, added: list[tuple[str, str]], measure, slice_chars: int = 1_000_000, replace_text: bool = False) -> DataFrame:
    """`docs` with columns that `measure(texts)` derives from its text, a slice of texts at a time.

    measure returns one sequence per added column, and the new texts before them if replace_text. Input columns named as
    an added one (in any case) are replaced; all others are kept.
    """
    names_added = {n.lower() for n, _ in added}
    keep = [f for f in docs.schema if f.name.lower() not in names_added]
    names, at_text = [f.name for f in keep], next(i for i, f in enumerate(keep) if f.name.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            texts, at = ((t.as_py(),) for t in batch.column(at_text)), 0
            for part in sized(texts, lambda r: len(r[0] or ""), slice_chars):
                out = measure([p[0] for p in part])
                columns = list(batch.slice(at, len(part)).columns)
                if replace_text:
                    columns[at_text] = pa.array(out[0], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x) for x in out[replace_text:])], names=[*names, *(n for n, _ in added)])
                at += len(part)

    types = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"{n} {t}" for n, t in added)])
    return docs.select(*(f"`{n}`" for n in names)).mapInArrow(run, types)
