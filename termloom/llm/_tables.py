"""Sorted lookup tables in the shared folder, read through memory maps.

A table of 64-bit keys and a fixed-width value is cut into buckets by the keys' leading bits; each bucket is two flat files, written
under a temporary name and renamed, so that a repeated task leaves the same file. Executors map the buckets they probe: a table's
size is bounded by the folder, not by an executor's memory, and nothing passes through the driver but bucket counts. Where files can't be
mapped (object stores), a worker reads the buckets it probes and keeps the last used ones, up to a number of bytes.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.plans.shared import fresh_dir, materialize, release

from ._spark import batch

#: Rows of a bucket, about.
BUCKET_ROWS = 4 << 20
#: Bytes that a worker keeps of files that it can't map.
HELD_BYTES = 256 << 20


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _local(uri: str) -> str | None:
    x = urlparse(uri)
    return x.path if x.scheme in ("", "file") else None


class Files:
    """Flat files of a folder: mapped where they can be, else read whole and kept up to a number of bytes, the last used."""

    def __init__(self, uri: str):
        self.uri = uri
        self._held: OrderedDict[tuple[str, str], np.ndarray] = OrderedDict()
        self._bytes = 0

    def read(self, name: str, kind) -> np.ndarray:
        key = name, np.dtype(kind).str
        got = self._held.get(key)
        if got is not None:
            self._held.move_to_end(key)
            return got
        local = _local(self.uri)
        if local is not None:
            path = f"{local}/{name}"
            got = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
        else:
            fs, path = open_fs(self.uri)
            with fs.open_input_stream(f"{path}/{name}") as f:
                got = np.frombuffer(f.readall(), kind)
            self._bytes += got.nbytes
            while self._held and self._bytes > HELD_BYTES:
                self._bytes -= self._held.popitem(last=False)[1].nbytes
        self._held[key] = got
        return got


def store(df: DataFrame, label: str, columns: dict[str, str] | str) -> Table:
    """Write rows of a ``key`` (long; distinct, taken as unsigned) and value columns of the given numpy types (one type: ``value``)."""
    if isinstance(columns, str):
        columns = {"value": columns}
    spark, names = df.sparkSession, list(columns)
    df = materialize(df.select("key", *names), label + "-rows")
    bits = max(1, int(np.ceil(np.log2(max(2, df.count() / BUCKET_ROWS)))))
    uri = fresh_dir(spark, label)
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)

    def write(batches):
        fs, path = open_fs(uri)
        bucket, tmp, n, files = None, "", 0, {}

        def close():
            for kind, f in files.items():
                f.close()
                fs.move(f"{path}/{tmp}.{kind}", f"{path}/{bucket}.{kind}")

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("bucket").to_numpy()
            arrays = {"key": b.column("key").to_numpy()} | {c: b.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in columns.items()}
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for s, e in zip(cuts, cuts[1:]):
                if ids[s] != bucket:
                    if bucket is not None:
                        close()
                        yield batch("bucket n", np.array([bucket]), np.array([n]))
                    bucket, tmp, n = int(ids[s]), f".{uuid.uuid4().hex}", 0
                    files = {kind: fs.open_output_stream(f"{path}/{tmp}.{kind}") for kind in arrays}
                for kind, x in arrays.items():
                    files[kind].write(x[s:e].tobytes())
                n += int(e - s)
        if bucket is not None:
            close()
            yield batch("bucket n", np.array([bucket]), np.array([n]))

    parted = df.select(F.shiftrightunsigned("key", 64 - bits).alias("bucket"), "key", *names).repartition(1 << bits, "bucket").sortWithinPartitions("bucket", "key")
    counts = np.zeros(1 << bits, np.int64)
    for r in parted.mapInArrow(write, "bucket long, n long").collect():  # one row a bucket
        counts[r.bucket] = r.n
    release(spark, df)
    return Table(uri, bits, columns, counts)


class Table:
    """Handle that travels with tasks; files are mapped on first use."""

    def __init__(self, uri: str, bits: int, columns: dict[str, str], counts: np.ndarray):
        self.uri, self.bits, self.columns, self.counts = uri, bits, columns, counts
        self.before = np.cumsum(counts) - counts
        self.files = Files(uri)

    def __getstate__(self):
        return self.uri, self.bits, self.columns, self.counts

    def __setstate__(self, state):
        self.__init__(*state)

    def __len__(self) -> int:
        return int(self.counts.sum())

    def _file(self, k: int, kind: str) -> np.ndarray:
        kind_type = np.dtype("u8" if kind == "key" else self.columns[kind])
        return self.files.read(f"{k}.{kind}", kind_type) if self.counts[k] else np.zeros(0, kind_type)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each unsigned 64-bit key in the order of all keys, -1 if it isn't there."""
        out = np.full(len(keys), -1, np.int64)
        if not len(keys):
            return out
        order = np.argsort(keys)
        q = keys[order]
        edges = np.searchsorted(q >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(edges)):
            a, b = edges[k], edges[k + 1]
            have = self._file(int(k), "key")
            if len(have):
                slot = np.minimum(np.searchsorted(have, q[a:b]), len(have) - 1)
                ok = have[slot] == q[a:b]
                out[order[a:b][ok]] = self.before[k] + slot[ok]
        return out

    def values(self, at: np.ndarray, default=0, column: str = "value") -> np.ndarray:
        """A column at numbers that ``find`` gave."""
        out = np.full(len(at), default, self.columns[column])
        bucket = np.searchsorted(self.before, at, "right") - 1
        for k in np.unique(bucket[at >= 0]):
            ok = np.flatnonzero((bucket == k) & (at >= 0))
            out[ok] = self._file(int(k), column)[at[ok] - self.before[k]]
        return out

    def lookup(self, keys: np.ndarray, default=0, column: str = "value") -> np.ndarray:
        """A column's values at unsigned 64-bit keys, ``default`` where there is none."""
        return self.values(self.find(keys), default, column)
