"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.storage import drop, shared_dir, stored  # noqa: F401  the operators take them from here

#: The white space that ends a word: space and the controls 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that a Python worker gets at a time: a text may be long, and two workers share what an executor's heap leaves.
BATCH = "2000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # nobody has chosen another number
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def one_blas_thread() -> None:
    """Matrix products of this process by one thread: a task has one core, and threads that wait for small products
    take the time of other tasks."""
    try:
        with open("/proc/self/maps") as f:
            found = {line.split()[-1] for line in f if "openblas" in line}
    except OSError:  # not Linux: threads stay as they are
        return
    for path in found:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def row_key() -> Column:
    """A hash of a row's doc_id and text, so that rows that share an id, or have none, are told apart."""
    return F.xxhash64("doc_id", "text")


def remainder(key: str, n: int) -> Column:
    """crc32 of the key's text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n


def utf8(text: str | None) -> bytes:
    """Null is the empty text."""
    return text.encode("utf-8", "surrogatepass") if text else b""


class Cache:
    """Values of recurring strings, in the dict of. fill(list of missing strings) gives their values, in order; past
    limit entries it starts anew, so that memory stays bounded while frequent strings come back at once."""

    def __init__(self, fill: Callable[[list], list], limit: int = 250_000):
        self.of: dict = {}
        self.fill, self.limit = fill, limit

    def learn(self, lists: list[list]) -> None:
        """Makes sure that all strings of the lists are there."""
        missing: set = set()
        for own in lists:
            missing |= set(own).difference(self.of)
        if len(self.of) + len(missing) > self.limit:
            self.of.clear()
            missing = set().union(*lists)
        if missing:
            strings = list(missing)
            self.of.update(zip(strings, self.fill(strings), strict=True))


def portions(rows: Iterator, size: Callable, most: int) -> Iterator[list]:
    """Rows in lists whose sizes sum to about most; a larger row stands alone."""
    part, total = [], 0
    for row in rows:
        n = size(row)
        if part and total + n > most:
            yield part
            part, total = [], 0
        part.append(row)
        total += n
    if part:
        yield part


def whole_groups(batches: Iterator, n_keys: int) -> Iterator[tuple]:
    """Of Arrow batches sorted by their first n_keys columns: (table, group bounds), each group whole in one table."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    kept = None
    for batch in batches:
        if not len(batch):
            continue
        new = pa.Table.from_batches([batch])
        new = new if kept is None else pa.concat_tables([kept, new]).combine_chunks()
        cuts = np.zeros(len(new) - 1, bool)
        for k in range(n_keys):
            col = new.column(k).combine_chunks()
            cuts |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(cuts) + 1
        if len(at):
            yield new.slice(0, int(at[-1])), np.concatenate([[0], at])
            kept = new.slice(int(at[-1]))
        else:
            kept = new
    if kept is not None:
        yield kept, np.array([0, len(kept)])


def cut_at(data, lengths) -> list:
    """Consecutive slices of the lengths."""
    out, at = [], 0
    for n in lengths:
        out.append(data[at : at + n])
        at += n
    return out
