import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from termloom.llm import bpe
from termloom.llm import token_output as O

PATH = bpe.production_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rnd = random.Random(1)
    letters = " \n\t 　 \x85\x1c 'sretvml dABCéñß中国🎉1२Ⅷ.,|-_<>endoftext"
    out = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    out += ["".join(rnd.choice(["<|endoftext|>", " ", "a", " b", "\n"]) for _ in range(9)) for _ in range(200)]
    return [*out, "", " ", "  a", "x  ", "a" * 5000, "ab " * 3000, "<|endoftext|>", "don't we'll"]


def test_backtracking_encoder_equals_the_library(library):
    t = texts()
    v = bpe.vocabulary(PATH)
    ids, offs = v.pieces.ids(pa.array(t))
    want = library.encode_batch(t, add_special_tokens=False)
    assert all(ids[a:b].tolist() == w.ids for a, b, w in zip(offs, offs[1:], want))
    data, at = bpe._valid(*v.decode_bytes(ids, offs))
    decoded = library.decode_batch([w.ids for w in want], skip_special_tokens=False)
    assert [data[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == decoded


def test_library_behind_pieces(library):
    t = texts()
    ids, offs = O.encoder(PATH).pieces.ids(pa.array([*t, None]))
    want = [*(w.ids for w in library.encode_batch(t, add_special_tokens=False)), []]
    assert all(ids[a:b].tolist() == w for a, b, w in zip(offs, offs[1:], want))


def test_pieces_start_anew_when_full(monkeypatch, library):
    monkeypatch.setattr(bpe, "PIECES", 50)
    v = bpe.Vocabulary(PATH)
    t = texts()[:500]
    for part in (t[:250], t[250:]):
        ids, offs = v.pieces.ids(pa.array(part))
        assert all(ids[a:b].tolist() == library.encode(x, add_special_tokens=False).ids for a, b, x in zip(offs, offs[1:], part))


def test_invalid_bytes_are_replaced_as_in_the_library(spark, library):
    rows = [(1, [8582]), (2, [149, 220, 8582, 149]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    out = {r.doc_id: r.text for r in bpe.decode(df, PATH, ["doc_id"]).collect()}
    assert out == {d: None if i is None else library.decode(i, skip_special_tokens=False) for d, i in rows}


def test_round_trip_query(spark, library):
    rows = [(1, "Hello world <|endoftext|> x", "k"), (2, None, "k"), (2, "", "k"), (3, "é " * 70_000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(tuple(r) for r in bpe.round_trip(df, PATH).collect())
    want = []
    for d, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode(df, PATH, ["doc_id"]).count() == 4
    assert bpe.round_trip(df.limit(0), PATH).collect() == []


def expected(rows, library):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("n", [0, 3, 300])
def test_files(spark, library, tmp_path, n):
    t = texts()
    rows = [(i * 7 % 1000, t[i]) for i in range(n)] + ([(5001, None), (None, "null id"), (5002, "w " * 30_000)] if n else [])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    uri = f"file://{tmp_path}/out"
    assert O.write_tokens(df, uri, PATH, shards=4) == len(rows)
    got = sorted((tuple(r) for r in O.read_tokens(spark, uri).collect()), key=lambda r: r[1])
    assert got == expected(rows, library)
    if n:
        assert sorted((r.doc_id, len(r.ids)) for r in O.read_tokens(spark, uri, digest_only=False).where("doc_id is not null").collect()) == sorted((r[0], r[2]) for r in got if r[0] is not None)
        shard = next(s for s in range(4) if (tmp_path / "out" / f"{s}.tok").exists() and len(O.Shard(uri, s).find(5002)))
        assert O.Shard(uri, shard).find(5002)[0][-1] == 0
        (tmp_path / "out" / "dictionary").write_bytes(b"another")
        with pytest.raises(ValueError):
            O.Shard(uri, shard)


def test_rows_that_share_an_id(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (1, "c d e"), (1, "a b")], "doc_id long, text string")
    uri = f"file://{tmp_path}/out"
    O.write_tokens(df, uri, PATH, shards=3)
    rows = sorted(O.read_tokens(spark, uri).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [0, rows[0].n_tokens, rows[0].n_tokens + rows[1].n_tokens]


def test_spread_chunks():
    blob = bytes(range(256)) * 100
    assert O.spread(blob, 1 << 20) == blob
    got = O.spread(blob, 4096)
    assert len(got) == 4096 and got[:512] == blob[:512] and got[-512:] == blob[-512:]
    assert O.spread(blob, 100) == blob[:100]


def test_pieces_are_kept_up_to_a_number_of_bytes():
    from termloom.llm._pieces import _AROUND, Pieces
    import pyarrow as pa

    p = Pieces(lambda pieces: [bytes([len(x) % 250, 0, 0, 0]) for x in pieces], lambda t: b"", [], 20 * (_AROUND + 20))
    for k in range(40):
        texts = pa.array([f"w{k}x{i} and more" for i in range(30)] + ["long" * 100])
        ids, offs = p.ids(texts)
        assert len(offs) == 32 and offs[-1] == len(ids)
        assert p.held <= p.most and len(p.cache) <= 22 and all(len(x) <= 256 for x in p.cache)


def test_other_columns_and_null_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", "x", 7), (None, "c d", "y", 8), (None, None, "z", 9)], "doc_id long, text string, ids string, n_tokens long")
    path = bpe.production_path()
    n = O.write_tokens(df, f"file://{tmp_path}/t", path)
    rows = O.read_tokens(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    assert n == 3 and [r.doc_id for r in rows] == [None, None, 1]
    enc = bpe.encode(df, path, ["doc_id", "n_tokens"])
    assert sorted(map(str, bpe.decode(enc, path, ["doc_id", "n_tokens"]).collect())) == sorted(["Row(doc_id=1, n_tokens=7, text='a b')", "Row(doc_id=None, n_tokens=8, text='c d')", "Row(doc_id=None, n_tokens=9, text='')"])
    assert {r.doc_id: r.n_tokens for r in bpe.round_trip(df, path).collect() if r.doc_id} == {1: len(enc.where("doc_id = 1").first().ids)}
