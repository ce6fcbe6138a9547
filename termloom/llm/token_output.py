"""Token-ID output: zstandard with a shared dictionary, each document compressed by itself.

File format of a shard ``<n>.tok`` (little-endian):
  magic ``TOKZ0001``; 8 bytes of the SHA-256 of the dictionary; width of an id in bytes (1 byte);
  then the documents' zstandard frames one after another, each over the document's ids (end id included) as unsigned integers of that width;
  then the index: doc_id int64 and its null flag, frame offset int64, number of ids int64, one array after another;
  then the number of documents and the index's offset, int64 each.
``dictionary`` and ``manifest.json`` lie beside the shards. Any document is read by one seek: index, frame, decompression with the shared
dictionary; its dictionary hash tells a wrong dictionary before anything is decoded.

Ids come from the tokenizers library; it sees each distinct piece of text once (see ``_pieces``). The dictionary is trained on a bounded
sample of documents (``SAMPLE`` of them, those of the smallest hashed ids; of long ones chunks from all over them). Documents are sorted by doc_id over all shards: shard bounds are quantiles of the
ids, so what is shuffled is compressed ids and not text. Shards are written under a temporary name and renamed; a repeated task leaves the
same file. Only one line a shard reaches the driver.

Defined cases: null counts as the empty text, which has the end id alone; null ids come first; rows that share an id keep their own entries, ordered by
content; an empty table gives an empty result (and no shard); other columns are not read. A very long text is one frame.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.plans.shared import fresh_dir

from . import _vec as V
from ._pieces import Pieces
from ._spark import batch, table
from ._tables import open_fs
from .bpe import production_path

MAGIC = b"TOKZ0001"
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 1000, 8 << 20, 64 << 10, 3
END_ID = 0


class LibraryEncoder:
    """The tokenizers library behind the piece cache."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = 1 + max(vocab.values())
        lengths = np.zeros(self.size, np.int64)  # a byte-level token has a character a byte
        for t, i in vocab.items():
            lengths[i] = len(t)
        self.lengths = lengths
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Pieces(self._encode, self._encode_text, specials)

    def _encode_text(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces that begin with a space are encoded many at a time, as they part from each other anyway."""
        out: list[bytes] = [b""] * len(pieces)
        joined = [i for i, p in enumerate(pieces) if p[:1] == b" "]
        groups = [joined[a : a + 1000] for a in range(0, len(joined), 1000)]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast([b"".join([pieces[i] for i in g]).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            at = np.cumsum(self.lengths[ids])
            cuts = np.searchsorted(at, np.cumsum([len(pieces[i]) for i in g]), "left") + 1
            raw, start = ids.tobytes(), 0
            for i, c in zip(g, cuts.tolist()):
                out[i] = raw[start : 4 * c]
                start = 4 * c
        rest = [i for i, p in enumerate(pieces) if p[:1] != b" "]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32).tobytes()
        return out


@cache
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _width(size: int) -> np.dtype:
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def _with_end(ids: np.ndarray, offs: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Rows with the end id appended."""
    n = len(offs) - 1
    out = np.full(len(ids) + n, END_ID, kind)
    at = np.ones(len(out), bool)
    ends = offs[1:] + np.arange(n)
    at[ends] = False
    out[at] = ids
    return out, np.concatenate([[0], ends + 1])


def spread(blob: bytes, most: int, chunk: int = 512) -> bytes:
    """The bytes, or, of more than ``most``, chunks that are spread evenly over them."""
    if len(blob) <= most:
        return blob
    n = max(1, most // chunk)
    starts = (np.arange(n) * (len(blob) - min(chunk, most)) // max(1, n - 1) // 4 * 4).tolist()
    return b"".join(blob[s : s + chunk] for s in starts)[:most]


def train_dictionary(docs: DataFrame, path: str, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary from the serialized ids of the ``sample`` documents of the smallest hashed ids, ``sample_bytes`` in all; empty if these are too few."""
    chosen = [r[0] for r in docs.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(sample).collect()]
    if not chosen:
        return b""
    lib = encoder(path)

    share = sample_bytes // len(chosen)

    def serialize(batches):
        lib = encoder(path)
        for b in V.text_slices(batches):
            ids, offs = lib.pieces.ids(b.column("text"))
            flat, offs = _with_end(ids, offs, _width(lib.size))
            blobs = [spread(flat[s:e].tobytes(), share) for s, e in zip(offs.tolist(), offs[1:].tolist())]
            yield batch("h blob", b.column("h"), pa.array(blobs, pa.binary()))

    picked = docs.select(F.xxhash64("doc_id").alias("h"), "text").where(F.col("h") <= chosen[-1]).limit(4 * sample)
    blobs = picked.mapInArrow(serialize, "h long, blob binary")
    rows = sorted((r.h, bytes(r.blob)) for r in blobs.toLocalIterator())[:sample]
    del lib
    try:
        return zstandard.train_dictionary(size, [b for _, b in rows if b]).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        return b""


def _compress(path: str, dictionary: bytes):
    def run(batches):
        lib = encoder(path)
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        z = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=True)
        for b in V.text_slices(batches):
            ids, offs = lib.pieces.ids(b.column("text"))
            flat, offs = _with_end(ids, offs, _width(lib.size))
            mem, w = memoryview(flat.view(np.uint8)), flat.itemsize
            frames = [z.compress(mem[s * w : e * w]) for s, e in zip(offs.tolist(), offs[1:].tolist())]
            yield batch("doc_id n_tokens frame", b.column("doc_id"), np.diff(offs), pa.array(frames, pa.binary()))

    return run


def _write(uri: str, digest: bytes, width: int):
    """Rows come sorted by shard, doc_id and frame; each shard is streamed to its file."""

    def run(batches):
        fs, path = open_fs(uri)
        shard, out, tmp = None, None, ""
        ids: list[np.ndarray] = []

        def close():
            if shard is None:
                return None
            cols = [np.concatenate(x) for x in zip(*ids)]
            at = out.tell()
            offsets = len(MAGIC) + 9 + np.cumsum(cols[3]) - cols[3]
            for c in (cols[0].astype("<i8"), cols[1].astype("<i8"), offsets.astype("<i8"), cols[2].astype("<i8"), np.array([len(cols[0]), at], "<i8")):
                out.write(c.tobytes())
            out.close()
            fs.move(tmp, f"{path}/{shard}.tok")
            return batch("shard n_docs n_tokens", np.array([shard]), np.array([len(cols[0])]), np.array([cols[2].sum()]))

        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if key[s] != shard:
                    done = close()
                    if done is not None:
                        yield done
                    shard, ids, tmp = int(key[s]), [], f"{path}/.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(tmp)
                    out.write(MAGIC + digest[:8] + bytes([width]))
                part = b.slice(s, e - s)
                data, offs = V.buffers(part.column("frame"))
                out.write(data.tobytes())
                d = part.column("doc_id")
                ids.append((d.fill_null(0).to_numpy(), d.is_null().to_numpy(zero_copy_only=False).astype(np.int64), part.column("n_tokens").to_numpy(), np.diff(offs)))
        done = close()
        if done is not None:
            yield done

    return run


def write_tokens(docs: DataFrame, uri: str, path: str, shards: int | None = None) -> int:
    """Write docs (doc_id, text) as shards below ``uri``, in ascending doc_id order; returns the number of documents."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(docs, path)
    width = _width(encoder(path).size).itemsize
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)] or [0.5], 10000)).first()[0] or []
    cuts = sorted(set(cuts))
    shard = F.lit(0)
    if cuts:
        ladder = F.array(*[F.lit(c).cast("long") for c in cuts])
        shard = F.coalesce(F.size(F.filter(ladder, lambda c: c <= F.col("doc_id"))), F.lit(0))
    fs, where = open_fs(uri)
    fs.create_dir(where, recursive=True)
    with fs.open_output_stream(f"{where}/dictionary") as f:
        f.write(dictionary)
    digest = hashlib.sha256(dictionary).digest()
    frames = docs.mapInArrow(_compress(path, dictionary), "doc_id long, n_tokens long, frame binary")
    rows = frames.withColumn("shard", F.when(F.col("doc_id").isNull(), 0).otherwise(shard)).repartition(shards, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "frame")
    parts = rows.mapInArrow(_write(uri, digest, width), "shard long, n_docs long, n_tokens long").collect()  # one row a shard
    start, listing = 0, []
    for p in sorted(parts):
        listing.append({"shard": p.shard, "n_docs": p.n_docs, "n_tokens": p.n_tokens, "start": start})
        start += p.n_tokens
    manifest = {"dictionary_sha256": digest.hex(), "id_bytes": width, "end_id": END_ID, "tokens": start, "shards": listing}
    with fs.open_output_stream(f"{where}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return sum(p.n_docs for p in parts)


class Shard:
    """Random access to the documents of one shard."""

    def __init__(self, uri: str, shard: int):
        fs, path = open_fs(uri)
        with fs.open_input_stream(f"{path}/dictionary") as f:
            dictionary = f.readall()
        self.file = fs.open_input_file(f"{path}/{shard}.tok")
        head = self.file.read_at(len(MAGIC) + 9, 0)
        if head[:8] != MAGIC or head[8:16] != hashlib.sha256(dictionary).digest()[:8]:
            raise ValueError("not a token file of this dictionary")
        self.kind = np.dtype(f"<u{head[16]}")
        self.z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        n, self.end = np.frombuffer(self.file.read_at(16, self.file.size() - 16), "<i8").tolist()
        index = np.frombuffer(self.file.read_at(32 * n, self.end), "<i8").reshape(4, n)
        self.doc_id, self.null, self.offset, self.n_tokens = index

    def ids(self, i: int) -> np.ndarray:
        """The ids of the shard's i-th document, its end id included."""
        stop = self.offset[i + 1] if i + 1 < len(self.offset) else self.end
        raw = self.z.decompress(self.file.read_at(int(stop - self.offset[i]), int(self.offset[i])))
        return np.frombuffer(raw, self.kind)

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each document of that id, by binary search in the index."""
        a = int(self.null.sum())
        lo, hi = (a + int(np.searchsorted(self.doc_id[a:], doc_id, side)) for side in ("left", "right"))
        return [self.ids(i) for i in range(lo, hi)]


def read_tokens(spark: SparkSession, uri: str, digest_only: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of all documents, from the files."""
    fs, path = open_fs(uri)
    with fs.open_input_stream(f"{path}/manifest.json") as f:
        shards = [(s["shard"], s["start"]) for s in json.loads(f.readall())["shards"]]

    def run(batches):
        for b in batches:
            for shard, start in zip(b.column("shard").to_pylist(), b.column("start").to_pylist()):
                x = Shard(uri, shard)
                starts = start + np.cumsum(x.n_tokens) - x.n_tokens
                for a in range(0, len(x.doc_id), 2000):
                    docs = [x.ids(i).astype("<u4") for i in range(a, min(a + 2000, len(x.doc_id)))]
                    part = slice(a, a + len(docs))
                    columns = [pa.array(x.doc_id[part], mask=x.null[part] == 1), pa.array(starts[part]), pa.array([len(d) for d in docs], pa.int64()), pa.array([zlib.crc32(d) for d in docs], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if not digest_only:
                        columns.append(pa.array([d.tolist() for d in docs], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<long>")
    if not shards:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame(shards, "shard int, start long").repartition(min(len(shards), 1000), "shard")
    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = fresh_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), uri, production_path())
    return read_tokens(spark, uri)
