"""Hard negatives, whitening and token files against brute force, on odd rows and small given tables."""

import os
import tempfile
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docmetrics.llm import hard_negatives, token_files, whitening

SF = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")
SCHEMA = "vec_id long, embedding array<float>, label int, x string, anchor long, score double, block int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], la, "x", 7, 0.5, 3) for i, v, la in rows], SCHEMA)


def odd_vectors(n=300, d=6, seed=0):
    """Equal vectors, ties, repeated rows, nulls everywhere, not finite, other lengths, negative ids."""
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.integers(-3, 4, d) / 8).tolist(), int(rng.integers(3))) for i in range(n)]
    rows += [(1000 + i, [0.5] * d, i % 2) for i in range(200)]  # one vector held by many
    rows += [rows[0], rows[0], rows[5], (-100, rows[7][1], 1), (300, [0.25] * d, 0), (300, [0.375] * d, 1)]
    rows += [(400, None, 1), (500, [None, *[0.1] * (d - 1)], 1), (600, [float("nan")] * d, 1), (700, [float("inf")] * d, 1), (701, [1e30] * d, 1),
             (800, [0.5] * d, None), (None, [0.5] * d, 1), (900, [0.5] * (d - 1), 1), (901, [], 1), (902, [0.0] * d, 2), (1100, [0.0] * d, 2)]
    return rows


def brute_negatives(rows, d, every=100, positives=5, negatives=10, low=30, high=90):
    kept = {(i, la, tuple(int(np.floor(256 * np.float64(np.float32(c)))) for c in v)) for i, v, la in rows
            if i is not None and la is not None and v is not None and len(v) == d and all(c is not None and np.isfinite(c) and abs(c) < 1e6 for c in v)}
    out = []
    for i, la, x in kept:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j, lb) for j, lb, y in kept if j != i)
        for s, j, _ in [r for r in scored if r[2] == la][:positives]:
            fit = [r for r in scored if r[2] != la and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k, _) in enumerate(fit)]
    return sorted(out)


def mined(df, **more):
    rows = df.withColumn("x", hard_negatives.entries(df["embedding"]))
    return sorted(map(tuple, hard_negatives.hard_negatives(rows, rows.where("vec_id % 100 = 0"), **more).collect()))


@pytest.mark.parametrize("leaf, tile", [(64, 4096), (4, 40)])
def test_hard_negatives_odd(spark, monkeypatch, leaf, tile):
    """Many small tiles and leaves give the rows of one tile, and of brute force."""
    monkeypatch.setattr(hard_negatives.packed, "__defaults__", (leaf, tile))
    rows = odd_vectors()
    got = mined(vectors(spark, rows))
    assert got == brute_negatives(rows, 6) and len(got) > 50


def test_hard_negatives_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 2)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 3)
    rows = odd_vectors(seed=4)
    assert mined(vectors(spark, rows), positives=2, negatives=3) == brute_negatives(rows, 6, positives=2, negatives=3)


def test_hard_negatives_empty(spark):
    df = vectors(spark, [])
    assert mined(df) == []
    assert mined(vectors(spark, [(100, None, 1), (200, [], 1), (300, [], 2), (1, [], 1), (2, [], 3)])) == [
        (100 * a, p, r, n, 0, 0) for a, p, r, n in []] + brute_negatives([(200, [], 1), (300, [], 2), (1, [], 1), (2, [], 3)], 0)


@there
def test_hard_negatives_given(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, hard_negatives.op11_hard_negatives(spark, SF).collect())) == sorted(con.execute(hard_negatives.OP11_SQL).fetchall())


def test_tree_boxes_prune_and_hold():
    """Products of rows lie in the interval of their leaf, and tiles of a hot vector stay small."""
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (500, 8))
    boxes = hard_negatives.Boxes(x.reshape(50, 10, 8).min(axis=1), x.reshape(50, 10, 8).max(axis=1), np.zeros(50, int), np.zeros(50, int))
    q = rng.integers(-50, 50, (20, 8)).astype(float)
    least, most = boxes.products(q)
    scores = (q @ x.T).reshape(20, 50, 10)
    assert (scores.min(axis=2) >= least).all() and (scores.max(axis=2) <= most).all()
    ids = np.arange(20_000)
    keys = np.column_stack([np.where(ids < 10_000, 1, ids % 7), np.where(ids < 10_000, 3, rng.integers(0, 100, 20_000))]) + hard_negatives.spread(ids)[:, None]
    sizes = np.bincount(hard_negatives.tile_of(hard_negatives.cuts_of(keys[::5], 16), keys))
    assert len(sizes) >= 16 and sizes.max() < 3 * 20_000 / 16


# ------------------------------------------------------------------ whitening


def test_whitening_odd(spark):
    rows = odd_vectors(d=20, seed=1)
    got = whitening.whitened(vectors(spark, rows)).collect()
    kept = [(i, [int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v]) for i, v, _ in rows
            if v is not None and len(v) == 20 and all(c is not None and np.isfinite(c) and abs(c) < 2**30 for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, s = len(fit), fit.sum(axis=0)
    off = (fit * n - s) / n
    v = off.T @ off / n
    values, x = (a[..., ::-1] for a in np.linalg.eigh(v))
    assert len(got) == 16 * len(kept) and {r.n for r in got} == {n}
    want = {}
    for i, row in kept:
        y = np.array(row)
        want.setdefault((i, int(((n * y - s) ** 2).sum())), ((n * y - s) / n) @ x[:, :16] / np.sqrt(values[:16]))
    signs = {}
    for r in got:
        w = want[(r.vec_id, r.deviation)][r.component - 1]
        if abs(w) > 1e-6:
            assert signs.setdefault(r.component, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
        assert abs(abs(w) - abs(r.whitened)) < 1e-9
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12 and r.identity_error < 1e-10


def test_whitening_edges(spark):
    assert whitening.whitened(vectors(spark, [])).collect() == []
    assert whitening.whitened(vectors(spark, [(1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (3, None, 1)])).collect() == []
    two = whitening.whitened(vectors(spark, [(1, [0.5, 0.25], 1), (1, [0.5, 0.25], 1), (None, [0.25, 0.25], 1)])).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, round(abs(r.whitened), 9), r.explained) for r in two) == [(0, 1, 2, 1.0, 1.0), (1, 1, 2, 1.0, 1.0), (1, 1, 2, 1.0, 1.0)]
    big = np.array([[2**36, 5], [0, 7]])
    off, dev = whitening.centred(big, 2, [2**36, 12])
    assert dev == [None, None] and off.tolist() == [[2.0**35, -1.0], [-(2.0**35), 1.0]]


@given(st.integers(0, 2**32 - 1), st.sampled_from(["spread", "equal", "close", "falling", "rank"]), st.integers(1, 24))
@settings(max_examples=60, deadline=None)
def test_eigenvectors_are_double_precision(seed, kind, d):
    rng = np.random.default_rng(seed)
    values = {"spread": rng.random(d) + np.arange(d), "equal": np.ones(d), "close": 1 + 1e-9 * rng.random(d), "falling": np.logspace(0, -6, d),
              "rank": np.where(np.arange(d) < d // 2, 0, 1.0 + np.arange(d))}[kind]
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    a = (q * values) @ q.T * 1e5
    a = (a + a.T) / 2
    got, x = whitening.eigenvectors(a)
    size = max(1e-300, np.abs(a).max())
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-13
    assert np.abs(a @ x - x * got).max() < 1e-13 * size * d
    assert (np.diff(got) <= 1e-12 * size).all()


def test_clusters_need_their_own_solve():
    """float32 can't tell the close values apart; the refined vectors do."""
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    values = np.concatenate([1 + 1e-8 * np.arange(6), 3 + np.arange(6.0)])
    a = (q * values) @ q.T
    got, x = whitening.eigenvectors((a + a.T) / 2)
    turned = np.abs(q[:, np.argsort(-values)].T @ x)
    assert np.abs(got - np.sort(values)[::-1]).max() < 1e-14
    assert np.abs(turned - np.eye(12)).max() < 1e-6  # the close ones are known to about 1e-16 / 1e-8


# ------------------------------------------------------------------ token files

ODD = ["", " ", "<|endoftext|> <|ENDOFTEXT|>x<|startoftext|>", "don't 'tis 'S o'RE x'll", "\x0b\x1c\x85\xa0  a", "日本語テスト。Ünï!!..x", "…“quoted”, naïve's l'été!?--", "a̱ H̱ İ ẞ Σς",
       "1234 a1b2 ½ Ⅷ ٣", "!!é!! 'é' (é) é's", "\x00\x01 a\x00b", "x" * 300, "😀👍🏽 é̂"]


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_pieces_have_the_ids_of_their_text():
    path, lib = library()
    enc = token_files.Encoder(path, 2, most=50)

    @given(st.text(st.sampled_from("aAeEzZ'’sStTlL.,!$%<|>09×÷ÿŸſµª²¼İı¸΅̱̇éÉßİIΣ日ー \t\n\x0b\x85\xa0 #*-_"), max_size=14))
    @settings(max_examples=1500, deadline=None)
    def same(text):
        assert np.frombuffer(enc(text.encode()), "<u2").tolist() == lib.encode(text, add_special_tokens=False).ids

    same()
    for text in ODD:
        assert np.frombuffer(enc(text.encode()), "<u2").tolist() == lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 100, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    h, mark = token_files.key_hashes(rng.permutation(10 * n + 1)[:n] - n, np.zeros(n, bool), np.zeros(n, np.int64))
    f = token_files.PerfectHash.build(h)
    assert sorted(f.find(h).tolist()) == list(range(n))
    again, end = token_files.PerfectHash.from_bytes(f.to_bytes() + b"entries")
    assert end == len(f.to_bytes()) and (again.find(h) == f.find(h)).all()
    assert len(f.to_bytes()) < 600 + n  # about 4 bits a key
    if n:
        with pytest.raises(ValueError):
            token_files.PerfectHash.build(np.concatenate([h, h[:1]]))


@pytest.mark.parametrize("shard_bytes, part_keys", [(1 << 20, 1 << 18), (900, 16)])
def test_token_files_odd(spark, shard_bytes, part_keys):
    """Whole documents come back under their keys; starts are sums over all documents before."""
    path, lib = library()
    rows = [(i * 3 - 20, ODD[i % len(ODD)]) for i in range(60)] + [(7, None), (7, "a"), (7, "b"), (7, "b"), (None, "n"), (None, None), (None, "n")]
    rows += [(1000, f"hot {i % 5}") for i in range(300)] + [(2000, " ".join(f"word{i}" for i in range(20_000)))]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, start long, ids string").repartition(5)
    folder = tempfile.mkdtemp(prefix="token-files-")
    manifest = token_files.write_tokens(docs, folder, path, shard_bytes=shard_bytes, part_keys=part_keys).orderBy("shard").collect()
    got = token_files.read_tokens(spark, folder, token_files.keys_of(docs)).collect()
    ids = {t: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t in rows}
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in got) == sorted((i is None, i or 0, ids[t]) for i, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    order = [(r.doc_id is None, r.doc_id or 0, r.copy) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    assert sum(m.tokens for m in manifest) == at and sum(m.docs for m in manifest) == len(rows)
    assert (len(manifest) > 5) == (shard_bytes < 1000)
    raw = b"".join(open(f"{folder}/{m.file}", "rb").read() for m in manifest)
    assert np.frombuffer(raw, "<u2").astype("<u4").tobytes() == b"".join(bytes(r.ids) for r in sorted(got, key=lambda r: r.start))
    reader = token_files.TokenReader(folder)
    for r in got[::7]:
        assert reader.get(r.doc_id, r.copy).astype("<u4").tobytes() == bytes(r.ids)
    assert reader.get(123_456) is None and reader.get(1000, 300) is None and reader.get(1000, 299) is not None and reader.get(None, 2) is not None
    absent = spark.createDataFrame([(99_999, 0), (7, 5), (7, None), (7, 3)], "doc_id long, copy long")
    assert sorted((r.doc_id, r.copy) for r in token_files.look_up(spark, folder, absent).collect()) == [(7, 0), (7, 3)]


def test_token_files_are_the_same_again(spark):
    path, _ = library()
    docs = spark.createDataFrame([(i % 40, f"text {i % 90} " * (i % 30)) for i in range(400)], "doc_id long, text string")
    out = []
    for parts in (1, 7):
        folder = tempfile.mkdtemp(prefix="token-files-")
        manifest = token_files.write_tokens(docs.repartition(parts), folder, path).collect()
        out.append([(m.file, m.docs, m.tokens, m.sha256) for m in manifest])
    assert out[0] == out[1]


def test_token_files_empty(spark):
    path, _ = library()
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = tempfile.mkdtemp(prefix="token-files-")
    assert token_files.write_tokens(docs, folder, path).collect() == []
    assert token_files.read_tokens(spark, folder, token_files.keys_of(docs)).collect() == []
    assert token_files.TokenReader(folder).get(1) is None


@there
def test_token_files_given(spark):
    _, lib = library()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op13_token_files(spark, SF).collect()}
    at = 0
    for i, text in duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall():
        ids = np.array([*lib.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert got.pop(i) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not got
