"""WARC, chat, token files, packing, vectors and the pipeline: round trips and brute force."""

import hashlib
import io
import random
import zlib

import duckdb
import numpy as np
import pytest

from codeatlas.llm import chat, idcoder, packing, queries, tokenfiles, tokens, vectors, warc
from codeatlas.llm.common import open_store, shared_folder


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_warc_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 64)
    big = "é<p>" * 50_000
    rows = [(5, "http://a/ ü\r\nx", big), (3, None, big), (3, "u", big), (None, "n", big), (7, "u", None), (8, "u", ""),
            (9, "u", "short"), (4, "u", "short"), (None, "u", None)]
    pages = spark.createDataFrame([(*r, 0, 0) for r in rows], "page_id long, url string, html string, digest int, chunk int")
    got = sorted(map(tuple, warc.archive(pages).collect()), key=repr)

    def row(i, html, kind, to):
        data = (html or "").encode()
        return i, len(data), hashlib.sha256(data).hexdigest(), kind, to

    want = [row(5, big, "revisit", 3), row(3, big, "response", None), row(3, big, "revisit", 3), row(None, big, "revisit", 3),
            *(row(i, h, "response", None) for i, h in ((7, None), (8, ""), (9, "short"), (4, "short"), (None, None)))]
    assert got == sorted(want, key=repr)
    assert warc.archive(pages.where("false")).count() == 0


def test_chunk_rows_carry_running_digests(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 64)
    monkeypatch.setattr(warc, "CHUNK_BATCH", 200)
    pages = spark.createDataFrame([(1, "u", "é" * 500), (2, None, None), (3, "u", "x" * 128)], "page_id long, url string, html string")
    rows = sorted(warc.chunk_table(pages).collect(), key=lambda r: (r["page_id"], r["chunk_no"]))
    for page, html in ((1, "é" * 500), (2, ""), (3, "x" * 128)):
        own, data = [r for r in rows if r["page_id"] == page], html.encode()
        assert b"".join(r["chunk"] for r in own) == data and [r["chunk_no"] for r in own] == list(range(max(1, -(-len(data) // 64))))
        assert [r["running"] for r in own] == [hashlib.sha256(data[:64 * (k + 1)]).hexdigest() for k in range(len(own))]
        assert {(r["n_bytes"], r["digest"]) for r in own} == {(len(data), own[-1]["running"])}


def test_id_blocks_of_large_vocabularies():
    import struct

    rng = np.random.default_rng(3)
    for top in (1 << 17, 1 << 24, (1 << 32) - 1):
        blocks = [rng.integers(0, top, n).astype(np.uint32) for n in (0, 1, 700, 2048)] + [np.array([top - 1, 0, 65_535, 65_536] * 40, np.uint32),
                                                                                              np.array([5] * 300, np.uint32)]
        coded = idcoder.encode_blocks(blocks) + idcoder.encode_blocks(blocks[:1])
        heads = [(struct.unpack(idcoder.HEAD, c[:16]), c[16:]) for c in coded]
        assert all((a == b).all() for a, b in zip([*blocks, blocks[0]], idcoder.decode_blocks(heads), strict=True))
        assert len(coded[4]) < 100 and len(coded[5]) < 60          # repeated ids are predicted


def test_warc_damage_is_found(spark):
    folder = shared_folder(spark, "damaged")
    pages = spark.createDataFrame([(1, "u", "x" * 5000)], "page_id long, url string, html string")
    path = warc.write_warc(pages, folder).first()["path"]
    data = open_store(folder)[0].open_input_stream(path, compression=None).read()
    assert len(list(warc.read_records(io.BytesIO(data)))) == 1
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data[:-20])))


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "<", "[", "[[INST]<<s>", "", None, "[NONE][AS]\\", "a\nb", "😀</s"]
    random.seed(4)
    roles = ["system", "user", "assistant", "tool[AS]", None, ""]
    rows = [(c, t, random.choice(roles), "".join(x or "" for x in random.choices(nasty, k=3)) if random.random() < .9 else None)
            for c in (1, 2, 3, None) for t in range(40)] + [(9, 0, "user", "q"), (9, 1, "assistant", "a"), (9, 1, "assistant", "a"), (9, None, "user", "z")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, state int, loss int")
    got = {r["conv_id"]: r for r in chat.format_and_read(df).collect()}
    none_first = lambda x: (x is not None, x or "")                          # noqa: E731  Spark sorts nulls first
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is None, r[1] or 0, none_first(r[2]), none_first(r[3])))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"]) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not got[9]["valid"]
    assert chat.format_and_read(df.where("false")).count() == 0


def test_chat_states(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "u"), (3, 0, "assistant", "a")]
    got = {r["conv_id"]: (r["valid"], r["complete"]) for r in chat.format_and_read(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, False)}


def test_encoder_equals_library(plain):
    random.seed(1)
    parts = ["a", "B", "é", "1", "_", ".", ",", " ", "\n", "\t", "'s", "!", "\xa0", "　", "ß", "中", "\0", "<|endoftext|>", "  ",
             "\r\n", "́", "½", "\x1c", " word", "The"]
    texts = ["".join(random.choices(parts, k=random.randint(1, 14))) for _ in range(4000)]
    enc = tokens.Encoder(queries.tokenizer_path())
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want and enc.encode(texts) == want
    assert enc.encode([None, ""]) == [b"", b""]


def test_encoder_with_a_full_cache(plain, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 3)
    enc = tokens.Encoder(queries.tokenizer_path())
    texts = ["one two three four. five", "six two, one nine"]
    assert enc.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert len(enc.cache) == 3


def test_encoder_asks_the_model_for_words_and_marks(plain, monkeypatch):
    """Words, marks and words with marks need no whole tokenizer, each chunk only once while the cache is full too."""
    texts = ["word!! Wörter### word", "word!! other(), x_ naïve", "((", "word!! word"]
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 2)
    enc = tokens.Encoder(queries.tokenizer_path())
    asked = []
    piece = enc._piece
    monkeypatch.setattr(enc, "_piece", lambda p: asked.append(p) or piece(p))
    monkeypatch.setattr(enc, "_each", lambda _: pytest.fail("whole tokenizer"))
    assert enc.encode(texts) == want
    assert asked.count(" word") <= 1 and asked.count("word") == 1
    assert len(enc.cache) == 2 and not enc.cache.more


def _wanted(rows, plain, end):
    return [(i, np.array((plain.encode(t, add_special_tokens=False).ids if t else []) + [end], "<u4")) for i, t in rows]


def test_id_blocks():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 65536, 3000), np.zeros(5000), rng.integers(0, 3, 100), np.array([65535]), np.zeros(0),
              np.tile(rng.integers(0, 50_000, 40), 50)]
    blocks = [b.astype(np.uint16) for b in blocks]
    import struct

    coded = idcoder.encode_blocks(blocks)
    heads = [(struct.unpack(idcoder.HEAD, c[:16]), c[16:]) for c in coded]
    assert all((a == b).all() for a, b in zip(blocks, idcoder.decode_blocks(heads), strict=True))
    assert idcoder.encode_blocks([blocks[5]]) == [coded[5]]                 # blocks are independent
    assert len(coded[5]) < 0.2 * 2 * len(blocks[5])
    with pytest.raises(ValueError):
        idcoder.decode_blocks([(heads[0][0], heads[0][1][:-2] + b"xx")])
    with pytest.raises(ValueError):
        idcoder.encode_blocks([np.array([2**32 - 1])])


def test_id_blocks_lay_their_intervals_rarely(monkeypatch):
    """The classes' bounds move at positions that don't depend on the other blocks, not at every one."""
    import struct

    calls = []
    intervals = idcoder._intervals
    monkeypatch.setattr(idcoder, "_intervals", lambda *args: calls.append(0) or intervals(*args))
    rng = np.random.default_rng(8)
    blocks = [(rng.zipf(1.3, n) % 50_000).astype(np.uint32) for n in (2048, 2048, 2000, 129, 128, 9, 8, 1, 0)]
    coded = idcoder.encode_blocks(blocks)
    assert len(calls) < 30
    assert [idcoder.encode_blocks([b])[0] for b in blocks] == coded
    heads = [(struct.unpack(idcoder.HEAD, c[:16]), c[16:]) for c in coded]
    assert all(len(words) == 2 * head[1] for head, words in heads)
    assert all((a == b).all() for a, b in zip(blocks, idcoder.decode_blocks(heads), strict=True))


def test_token_files(spark, docs, odd_docs, clashing, plain, no_docs, monkeypatch):
    monkeypatch.setattr(tokenfiles, "FILE_IDS", 30_000)
    monkeypatch.setattr(tokenfiles, "FILE_DOCS", 20)
    got = sorted(tuple(r) for r in tokenfiles.encode_and_read(docs, queries.tokenizer_path()).collect())
    start, want = 0, []
    for i, ids in _wanted(sorted((r["doc_id"], r["text"]) for r in docs.collect()), plain, 2):
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    rows = tokenfiles.encode_and_read(clashing, queries.tokenizer_path()).collect()
    want = sorted(((i, len(x), zlib.crc32(x.tobytes())) for i, x in _wanted([(r["doc_id"], r["text"]) for r in odd_docs.collect()], plain, 2)), key=repr)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=repr) == want
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert tokenfiles.encode_and_read(no_docs, queries.tokenizer_path()).count() == 0


def test_token_files_of_one_id_and_of_empty_texts(spark, monkeypatch):
    """Tasks and files follow the number of documents too; rows of one id are cut by their text."""
    monkeypatch.setattr(tokenfiles, "FILE_DOCS", 50)
    monkeypatch.setattr(tokenfiles, "TASK_ROWS", 30)
    rows = [(None, f"text {i}") for i in range(400)] + [(i, "") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = shared_folder(spark, "ids")
    manifest = tokenfiles.write_ids(docs, folder, queries.tokenizer_path())
    files = manifest.orderBy("file_no").collect()
    assert max(f["docs"] for f in files) <= 50 and sum(f["docs"] for f in files) == 1000
    got = tokenfiles.read_ids(manifest, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [*range(600), *[None] * 400]
    assert [r["start"] for r in got[:601]] == list(range(601))
    before = np.cumsum([0, *(f["docs"] for f in files)])
    assert len({f["file_no"] >> 32 for f, n in zip(files, before, strict=False) if n >= 600}) > 3     # tasks of the one id


def test_pack_covers_everything():
    rng = np.random.default_rng(3)
    for lengths in ([], [1], [1024], [1500, 700, 3], [int(x) for x in rng.geometric(0.003, 500)], [513] * 50, [100] * 7):
        seqs = packing.pack(lengths)
        seen = [np.zeros(n, int) for n in lengths]
        for tier, pieces in seqs:
            n = sum(p[2] for p in pieces)
            assert n <= 1024 and n == tier and tier & (tier - 1) == 0
            for d, a, k in pieces:
                seen[d][a:a + k] += 1
        assert all((s == 1).all() for s in seen)


def test_packing(docs, clashing, odd_docs, plain, no_docs):
    path = queries.tokenizer_path()
    for df, base in ((docs, docs), (clashing, odd_docs)):
        got = packing.packed(df, path).toPandas()
        whole = {}
        for i, ids in _wanted([(r["doc_id"], r["text"]) for r in base.collect()], plain, 0):
            whole.setdefault(i, []).append(ids)
        for r in got.itertuples():
            ids = whole[None if r.doc_id != r.doc_id else int(r.doc_id)]
            part = [x for x in ids if len(x) == r.doc_tokens and zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32]
            assert part and r.ids == part[0][r.start:r.start + r.length].tobytes()
        assert got["length"].sum() == sum(len(x) for v in whole.values() for x in v)
        for _, s in got.sort_values("offset").groupby("sequence_id"):
            assert (s["offset"].to_numpy() == np.cumsum(s["length"]) - s["length"]).all() and s["length"].sum() <= 1024
    assert packing.packed(no_docs, path).count() == 0


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 150)
    monkeypatch.setattr(vectors, "ROWS_PER_CENTRE", 60)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 16))
    x = np.concatenate([base, base[:150] + rng.normal(scale=.1, size=(150, 16)), base[:20], base[:1] + rng.normal(scale=.03, size=(80, 16))]).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], int(i % 7 == 0)) for i in range(len(x))]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [None] * 16, 0), (n + 4, rows[0][1], None),
             (n + 5, [float("inf")] * 16, 1), (n + 6, [], 0), (n + 7, [1.0, 2.0], 0), (n + 8, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, cid int, shard int")
    got = {r["vec_id"]: r for r in vectors.near_vectors(df).collect()}
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    true = np.zeros(len(rows), int)
    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i], rows[j]
            if a[2] is None or a[2] != b[2] or not a[1] or not b[1] or len(a[1]) != len(b[1]) or None in a[1] or None in b[1]:
                continue
            u, v = np.array(a[1]), np.array(b[1])
            if np.isfinite(u).all() and np.isfinite(v).all() and u.any() and v.any() and u @ v / np.sqrt((u @ u) * (v @ v)) >= .93:
                true[[i, j]] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    links = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (links <= true).all() and links.sum() >= 0.95 * true.sum()
    if (links == true).all():
        assert [got[i]["component_id"] for i in range(len(rows))] == [find(i) for i in range(len(rows))]
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert vectors.near_vectors(df.where("false")).count() == 0


def test_vectors_dense_ball_in_a_hot_label(spark):
    """4500 near copies of one vector under one label, at production parameters: every link counts."""
    rng = np.random.default_rng(3)
    ball = rng.normal(size=(1, 32)) + rng.normal(scale=.3, size=(4500, 32))
    x = np.concatenate([ball, rng.normal(size=(600, 32))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = vectors.near_vectors(df).toPandas().sort_values("vec_id")
    unit = vectors._unit(x.astype(np.float64))
    near = unit @ unit.T >= vectors.THRESHOLD
    np.fill_diagonal(near, False)
    assert near.sum() > 1_000_000 and (got["n_links"].to_numpy() == near.sum(1)).all()
    low = np.arange(len(x))
    while True:
        then = np.minimum(low, np.where(near, low[None, :], len(x)).min(1))
        if (then == low).all():
            break
        low = then
    assert (got["component_id"].to_numpy() == low).all() and (got["audited_recall"] == 1).all()


def test_vectors_link_found_from_one_side_only(spark):
    """1 (home 100) and 2 (home 200) link and are members of both shards. The way between them leads over 3, which
    only shard 200 holds, so only 2's search finds the link; 3's links are found there too, each once."""
    def at(degrees):
        return [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]

    both = [100, 200]
    rows = []
    for shard, cids in ((100, (1, 2, 4)), (200, (1, 2, 3))):
        for cid in cids:
            angle, near, shards, home, size = {1: (0, [3], both, 100, 1), 2: (20, [3], both, 200, 5), 3: (10, [1, 2], [200], 200, 1),
                                               4: (-10, [1], [100], 100, 1)}[cid]
            rows.append((cid, shard, at(angle), near, shards, home, size))
    full = spark.createDataFrame(rows, "cid long, shard long, vec array<float>, near array<long>, shards array<long>, home_shard long, size long")
    got = vectors._searched(full, .93).toPandas()
    assert got.groupby("cid")["links"].sum().to_dict() == {1: 5 + 1 + 1, 2: 1 + 1, 3: 1 + 5, 4: 1}
    assert set(got["low"][got["cid"] == 2]) & {1}


def test_pipeline(spark, sf, odd_docs, no_docs):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    out = cp.run(spark, sf).toPandas()
    assert len(cp.STAGES) == 4 and set(out["doc_id"]) <= set(rows)
    for start in (odd_docs, no_docs):
        df = start
        for k, (_, stage) in enumerate(cp.STAGES):
            df = stage(spark, df, sf)
            assert k == len(cp.STAGES) - 1 or df.columns == start.columns
        df.count()


@pytest.mark.parametrize("shape", ["scaled", "one number", "one hot"])
def test_vectors_that_share_directions(spark, shape):
    """More than SHARD_ROWS distinct vectors of one label whose cosines tie, at production parameters."""
    n = vectors.SHARD_ROWS + 500
    vec = {"scaled": lambda s: [float(s), 0.0, 0.0, 0.0], "one number": lambda s: [float(s) if s % 3 else -float(s)],
           "one hot": lambda s: [float(s) if s % 4 == i else 0.0 for i in range(4)]}[shape]
    side = {"scaled": lambda s: 0, "one number": lambda s: s % 3 == 0, "one hot": lambda s: s % 4}[shape]
    df = spark.createDataFrame([(s, vec(s), 1) for s in range(1, n + 1)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    groups = {}
    for s in range(1, n + 1):
        groups.setdefault(side(s), []).append(s)
    assert got == {s: (len(g) - 1, g[0], s == g[0]) for g in groups.values() for s in g}


def test_vector_shards_end_without_progress(spark, monkeypatch):
    """All rows nearest to the same centres: dealt by hash, so splitting ends and no vector is lost."""
    monkeypatch.setattr(vectors, "SHARD_ROWS", 50)
    monkeypatch.setattr(vectors, "ROWS_PER_CENTRE", 1000)
    monkeypatch.setattr(vectors, "SHRINK", 0.0)
    df = spark.createDataFrame([(i, 1, [1.0, i * 1e-6]) for i in range(300)], "cid long, shard long, vec array<float>")
    out = vectors.shards_of(df).toPandas()
    assert out.groupby("shard").size().max() <= 50 and set(out["cid"]) == set(range(300))
    assert out[out["home"]].groupby("cid").size().eq(1).all()
