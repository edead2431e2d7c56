"""Vectors, archives, shards, mixing and the pipeline against brute force."""

import hashlib
import heapq
import math
import shutil
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from seqlake.llm import mixing, sharding, topk_search, vector_dedup, warc

from .conftest import union_find


# ---------------------------------------------------------------- vectors

def vector_rows(seed=3, dim=12):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for _ in range(25):
        c = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((i, (c + rng.normal(size=dim) * rng.choice([0, 0.1, 0.3])).astype(np.float32).tolist()))
            i += 1
    rows += [(i, None), (i + 1, []), (i + 2, [0.0] * dim), (i + 3, [float("nan")] * dim),
             (i + 4, [1.0, None] + [0.0] * (dim - 2)), (i + 5, [float("inf")] + [1.0] * (dim - 1)),
             (i + 6, [1.0, 2.0]), (i + 7, [2.0, 4.0]), (i + 8, [2.0 * x for x in rows[0][1]]),
             (None, rows[0][1]), (None, [3.0, 1.0, 2.0]), rows[1]]
    return rows


VEC = "vec_id bigint, embedding array<float>"


def usable(v):
    return bool(v) and None not in v and bool(np.isfinite(np.array(v, dtype=np.float64)).all())


@pytest.mark.parametrize("blocks", [12, 2])
def test_near_vectors(spark, blocks, monkeypatch):
    monkeypatch.setattr(vector_dedup, "MIN_BLOCKS", blocks)
    monkeypatch.setattr(vector_dedup, "TILE", 16)
    monkeypatch.setattr(vector_dedup, "LEAD", 4)
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], VEC + ", cls int")
    got = vector_dedup.near_vectors(df).collect()
    links, n = [], Counter()
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if usable(x) and usable(y) and len(x) == len(y):
                x, y = np.array(x, dtype=np.float64), np.array(y, dtype=np.float64)
                d = np.linalg.norm(x) * np.linalg.norm(y)
                if d and x @ y / d >= 0.9:
                    links.append((a, b))
                    n.update((a, b))
    comp = union_find(range(len(rows)), links)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[comp[i]] = min(low.get(comp[i], r[0]), r[0])
    want = Counter((r[0], n[i], low.get(comp[i]), r[0] == low.get(comp[i])) for i, r in enumerate(rows))
    assert len(links) > 40
    assert Counter(tuple(r) for r in got) == want
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def test_tile_bound_never_loses_a_pair():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 20))
    x[150:] = x[:150] + rng.normal(size=(150, 20)) * 0.25
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lead = 6
    tail = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    rest = np.sqrt(np.column_stack([tail[:, a] for a in range(0, 20, lead)] + [np.zeros(300)]))
    for cut in (0.3, 0.9):     # the first takes the whole product, the second stops early
        i, j, cos = vector_dedup._tile(x, x, rest, rest, lead, cut)
        want = x @ x.T >= cut
        got = np.zeros((300, 300), bool)
        got[i, j] = True
        assert (got == want).all() or np.abs((x @ x.T)[got != want] - cut).max() < 1e-12
        assert np.allclose(cos, (x @ x.T)[i, j])


@pytest.mark.parametrize("leaf,block", [(256, 4096), (4, 3)])
def test_top_k(spark, leaf, block, monkeypatch):
    monkeypatch.setattr(topk_search, "LEAF", leaf)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", block)
    rows = vector_rows(9) + vector_rows(10, dim=3)[:40]
    rows = [(None if r[0] is None else i, r[1]) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(*r, 2) for r in rows], VEC + ", shard int")
    got = topk_search.top_k(df, F.col("vec_id") % 5 == 0).collect()
    want = set()
    q = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(int)) for i, v in rows
         if i is not None and usable(v)]
    for i, v in q:
        if i % 5 == 0:
            best = sorted((-int(v @ w), j) for j, w in q if j != i and len(w) == len(v))[:5]
            want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    assert len(want) > 100 and {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk_search.top_k(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("leaf,size", [(1, 1), (3, 1.0), (8, 1e9), (5, 1e14)])
def test_tree_search_is_exact(leaf, size, monkeypatch):
    """Splits, boxes and the best-first walk in this process, where the leaf size is really set;
    products from small ones to ones beyond the integers that doubles hold and beyond a long."""
    monkeypatch.setattr(topk_search, "LEAF", leaf)
    rng = np.random.default_rng(int(size) % 7)
    x = np.floor(rng.normal(size=(700, 6)) * 40 * size)
    x[::9] = x[4]                               # repeated vectors: ties go to the smaller id
    ids = rng.permutation(700)
    tree = topk_search.KDTree(x)
    assert len(tree.span) > 700 // leaf // 3 and sorted(tree.order.tolist()) == list(range(700))
    for (a, b), low, high in zip(tree.span, tree.low, tree.high):
        assert (tree.x[a:b].min(0) == low).all() and (tree.x[a:b].max(0) == high).all()
    queries, qids = x[:40], ids[:40]
    whole = [[int(v) for v in row] for row in x.tolist()]
    most = (1 << 63) - 1
    floor = np.full(40, -np.inf)
    for k in (1, 5):
        got = defaultdict(list)
        for q, i, s in topk_search.search(tree, ids, queries, qids, k, floor):
            got[q].append((i, s))
        for n, q in enumerate(qids.tolist()):
            scores = [(-max(-most, min(most, sum(a * b for a, b in zip(whole[n], row)))), int(i))
                      for row, i in zip(whole, ids) if i != q]
            assert got[q] == [(i, -s) for s, i in sorted(scores)[:k]]
            floor[n] = -sorted(scores)[k - 1][0] if k == 1 else floor[n]
        floor[:] = -np.inf


def test_top_k_of_huge_vectors(spark):
    rows = [(i, [1e12 * (i % 7 - 3), float(i), 1.0]) for i in range(60)] + [(60, [1e300, -1e300, 0.0]), (61, [1e308, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_search.top_k(df, F.col("vec_id") % 5 == 0).collect()}
    most, big = (1 << 63) - 1, 2.0 ** 500
    q = {i: [int(max(-big, min(big, math.floor(256 * max(-big, min(big, x)))))) for x in v] for i, v in rows}
    for i in range(0, 60, 5):
        best = sorted((-max(-most, min(most, sum(a * b for a, b in zip(q[i], w)))), j) for j, w in q.items() if j != i)
        assert [got[i, r + 1] for r in range(5)] == [(j, -s) for s, j in best[:5]]


def test_tiles_and_blocks_of_any_size(monkeypatch):
    """Blocks in this process, where tile and leading dimensions are really set."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(30, 12))
    x = np.repeat(centre, 8, axis=0) + rng.normal(size=(240, 12)) * 0.25
    x[17] = x[3] * 2
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    link = (cos >= 0.9) & ~np.eye(240, dtype=bool)
    assert 200 < link.sum() < 240 * 60
    axes = {12: np.linalg.qr(rng.normal(size=(12, 12)))[0]}
    for tile, lead in ((512, 8), (7, 3), (33, 12)):
        monkeypatch.setattr(vector_dedup, "TILE", tile)
        monkeypatch.setattr(vector_dedup, "LEAD", lead)
        table = pa.table({"cls": np.arange(240), "copies": np.ones(240, np.int64), "dim": np.full(240, 12, np.int32),
                          "block": np.zeros(240, np.int32), "lo": np.zeros(240, np.int32), "hi": np.zeros(240, np.int32),
                          "vec": pa.array([v.tobytes() for v in x], pa.binary())})
        out = vector_dedup._compare(table, axes, 0.9)
        found = dict(zip(out["cls"].to_pylist(), out["links"].to_pylist()))
        assert found == {i: int(n) for i, n in enumerate(link.sum(1)) if n}


# ---------------------------------------------------------------- archives

def test_archives_round_trip(spark):
    big, other = "é<p>\r\n\r\nWARC/1.1\r\n" * 30_000, "x" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/2 b", big), (3, None, other), (4, "u", "short"), (5, "u", "short"),
            (6, "u", None), (7, "u", ""), (9, "http://a/9", big), (8, "u", other), (10, "u", "y" * 999),
            (11, "u", "y" * 999), (None, "u", big), (12, "u", "".join(map(str, range(4000))))]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, digest string")
    chunks = warc.read_archives(warc.write_archives(df.repartition(3)))
    largest = {big: 9, other: 8}
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = h in largest and i != largest[h]
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response",
             largest[h] if again else None] += 1
    assert Counter(tuple(r) for r in warc.records(chunks).collect()) == want
    # the chunk table holds the payloads, every chunk with the digest so far
    payload = defaultdict(bytes)
    for r in sorted(chunks.collect(), key=lambda r: (r["record_id"], r["chunk_no"])):
        assert len(r["chunk"]) <= warc.CHUNK
        payload[r["record_id"]] += r["chunk"]
        if r["record_type"] == "response":
            assert r["digest"] == hashlib.sha1(payload[r["record_id"]]).hexdigest()
    assert Counter(payload.values())[big.encode()] == 1 and chunks.filter("chunk_no > 1").count() >= 1
    assert warc.records(warc.read_archives(warc.write_archives(df.limit(0)))).count() == 0


def test_segments_are_read_by_tasks_of_their_own(spark):
    """Also with adaptive execution, which would put so few rows into one task."""
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(3)], "page_id bigint, url string, html string")
    one = warc.write_archives(pages.coalesce(1)).first()
    rows = []
    for i in range(37):
        path = one.archive.removeprefix("file://").replace("part-", f"copy{i}-")
        shutil.copy(one.archive.removeprefix("file://"), path)
        rows.append((path, one.start, one.length))
    segments = spark.createDataFrame(rows, "archive string, start bigint, length bigint")
    chunks = warc.read_archives(segments)
    assert chunks.rdd.getNumPartitions() == 37
    per = chunks.groupBy(F.spark_partition_id()).count().collect()
    assert len(per) >= 30 and sum(r["count"] for r in per) == 37 * 3


def test_small_chunks_and_segments(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 700)
    monkeypatch.setattr(warc, "SEGMENT", 500)
    rng = np.random.default_rng(2)
    data = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 699, 700, 701, 5000, 0, 1400)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(data)), pa.int64()), pa.array(["u"] * len(data)), pa.array(data, pa.binary()),
         pa.array([hashlib.sha1(d).hexdigest() for d in data]), pa.array([None] * len(data), pa.int64())],
        names=["page_id", "url", "payload", "digest", "refers_to"])
    segments = list(warc._write(iter([batch]), str(tmp_path), "2024-01-01T00:00:00Z"))
    assert sum(s.num_rows for s in segments) > 3
    rows = [r for b in warc._read(iter(segments)) for r in b.to_pylist()]
    for i, d in enumerate(data):
        own = [r for r in rows if r["page_id"] == i]
        assert [r["chunk_no"] for r in own] == list(range(max(1, -(-len(d) // 700))))
        assert b"".join(r["chunk"] for r in own) == d and [r["last"] for r in own][-1]
        assert own[-1]["digest"] == hashlib.sha1(d).hexdigest()


@pytest.mark.parametrize("segment", [1, 1000, 3000, warc.SEGMENT])
def test_records_behind_a_payload_of_many_chunks(tmp_path, monkeypatch, segment):
    """What follows a payload that is decompressed in several steps is read once and whole."""
    monkeypatch.setattr(warc, "SEGMENT", segment)
    rng = np.random.default_rng(5)
    noise = rng.integers(0, 256, 400_000, dtype=np.uint8).tobytes()
    data = [b"a", b"<p>text</p>" * 60_000, b"b" * 2000, noise[:3000], b"c" * 3 * warc.CHUNK, b"",
            noise + b"d" * 900_000, *(noise[i:i + 5000] for i in range(0, 395_000, 5000)), b"<b>" * 200_000, b"e"]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(data)), pa.int64()), pa.array(["u"] * len(data)), pa.array(data, pa.binary()),
         pa.array([hashlib.sha1(d).hexdigest() for d in data]), pa.array([None] * len(data), pa.int64())],
        names=["page_id", "url", "payload", "digest", "refers_to"])
    segments = list(warc._write(iter([batch]), str(tmp_path), "2024-01-01T00:00:00Z"))
    rows = [r for b in warc._read(iter(segments)) for r in b.to_pylist()]
    payload = defaultdict(bytes)
    for r in rows:
        payload[r["record_id"], r["page_id"]] += r["chunk"]
    assert sorted((i, p) for (_, i), p in payload.items()) == list(enumerate(data))
    assert sorted(r["page_id"] for r in rows if r["last"]) == list(range(len(data)))


def test_pages_are_read_a_few_at_a_time(spark, tmp_path, monkeypatch):
    """The Parquet reader's batches are small while pages are read, the session's are kept."""
    seen = []
    stored = warc.stored
    monkeypatch.setattr(warc, "stored", lambda df, name: seen.append(spark.conf.get(warc.ROWS_CONF)) or stored(df, name))
    spark.createDataFrame([(i, "u", f"page {i}" * 200) for i in range(300)], "page_id bigint, url string, html string") \
        .coalesce(1).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    before = spark.conf.get(warc.ROWS_CONF)
    assert before == warc.ROWS_DEFAULT
    assert warc.records(warc.read_archives(warc.write_archives(pages))).count() == 300
    assert seen == [str(warc.READ_ROWS)] * 2 and spark.conf.get(warc.ROWS_CONF) == before
    try:
        spark.conf.set(warc.ROWS_CONF, "100")
        warc.write_archives(pages)
        assert seen[2:] == ["100"] * 2 and spark.conf.get(warc.ROWS_CONF) == "100"
    finally:
        spark.conf.set(warc.ROWS_CONF, before)


# ---------------------------------------------------------------- shards

def test_longest_first_is_lpt():
    rng = np.random.default_rng(1)
    sizes = [(int(x), i) for i, x in enumerate(rng.integers(1, 1000, 500))]
    got = sharding.longest_first(sizes, 7)
    load, heap = [0] * 7, [(0, s) for s in range(7)]
    for size, item in sorted(sizes, key=lambda x: (-x[0], str(x[1]))):
        t, s = heapq.heappop(heap)
        assert got[item] == s
        load[s] += size
        heapq.heappush(heap, (t + size, s))
    assert max(load) - min(load) <= 1000


@pytest.mark.parametrize("buckets,large", [(512, 256), (2, 1)])
def test_shard_by_size(docs, doc_rows, no_docs, buckets, large, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKETS", buckets)
    monkeypatch.setattr(sharding, "LARGE", large)
    monkeypatch.setattr(sharding, "RUN", 3)
    got = sharding.shard_by_size(docs, shards=5).collect()
    text = {r[0]: r[1] or "" for r in doc_rows}
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in doc_rows)
    of, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        b = text[r["doc_id"]].encode()
        assert r["size"] == len(b) + 8 and r["text_crc32"] == zlib.crc32(b)
        of[b].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if buckets == 512:
        group = Counter()
        for r in got:
            group[text[r["doc_id"]]] += r["size"]
        assert max(load.values()) <= max(sum(load.values()) / 5, max(group.values())) * 4 / 3
    assert sharding.shard_by_size(no_docs).count() == 0


# ---------------------------------------------------------------- mixing

def test_poisson_table(spark):
    for rate in (0.01, 1.0, 3.7, 80.0, 499.0):
        c = spark.range(1).select(mixing.poisson_table(F.lit(rate))).first()[0]
        p = [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(len(c))]
        assert np.allclose(c, np.cumsum(p), atol=1e-9) and c[-1] > 1 - 1e-9


def test_poisson_mix(docs, doc_rows, no_docs):
    got = mixing.poisson_mix(docs, copy_col="copy")
    assert got.columns == [*docs.columns, "copy", "mix_key"]
    size = Counter()
    for r in doc_rows:
        size[r[3]] += len((r[1] or "").encode())
    root = {s: math.sqrt(x) for s, x in size.items()}
    want = Counter()
    for r in doc_rows:
        s = r[3]
        rate = sum(size.values()) * root[s] / sum(root.values()) / size[s] if size[s] else 1.0
        u = int(hashlib.md5(f"42:{r[0]}".encode()).hexdigest()[:13], 16) / 2 ** 52
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        for i in range(k):
            want[r[0], i, hashlib.md5(f"42:{r[0]}:{i}".encode()).hexdigest()] += 1
    rows = got.select("doc_id", "copy", "mix_key").collect()
    assert Counter(tuple(r) for r in rows) == want and None in size
    assert mixing.poisson_mix(no_docs).count() == 0


def test_poisson_mix_weights(spark):
    rows = [(i, "a" if i % 10 else "b", "x" * 100) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    n = Counter(r["source"] for r in mixing.poisson_mix(df, weights={"a": 1, "b": 1}).collect())
    assert abs(n["a"] / 2000 - 1) < 0.1 and abs(n["b"] / 2000 - 1) < 0.1
    large = mixing.poisson_mix(df.limit(20), weights={"a": 1, "b": 1}, budget_bytes=4_000_000).count()
    assert abs(large / 40_000 - 1) < 0.05            # means above 500 are sums of parts


def test_mix_oracle(spark):
    from seqlake.llm.queries import op7_mixing
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    rel = con.sql(mixing.mix_oracle_sql())
    got = op7_mixing(spark, SF_SMALL)
    assert got.columns == rel.columns
    assert Counter(tuple(r) for r in got.collect()) == Counter(rel.fetchall())


# ---------------------------------------------------------------- pipeline

@pytest.mark.parametrize("label", [0, 1])
def test_quality_keeps_documents_without_a_word(spark, tmp_path, label):
    """Whatever the sign of the bias, which is all that such documents have."""
    import corpus_pipeline as cp
    texts = [None, "", " \n\t\x0b\r ", "some words", "é", "\xa0"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spark.createDataFrame([(i, label) for i in range(18)], "doc_id bigint, quality int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in cp.quality(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i in range(18) if label or i % 6 < 3}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    names, before = docs.columns, docs
    for name, stage in cp.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, before, SF_SMALL).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == names
        a = {r["doc_id"]: r for r in before.collect()}
        b = after.collect()
        if name == "quality":
            label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
            kept = {r["doc_id"] for r in b}
            good = [i for i in a if label.get(i) == 1]
            bad = [i for i in a if label.get(i) == 0]
            assert np.mean([i in kept for i in good]) > 0.97 and np.mean([i in kept for i in bad]) < 0.3
        if name == "line_dedup":
            from .test_text_ops import brute_lines
            want = brute_lines(sorted(tuple(r) for r in a.values()), lambda r: r[0])
            assert {r["doc_id"]: r["text"] for r in b} == {
                i: t for i, (n, gone, t) in want.items() if not n or gone < n}
        if name == "near_dedup":
            from .test_text_ops import shingle_set, similar
            sets = {i: shingle_set(r["text"], 5) for i, r in a.items()}
            ids = sorted(sets)
            comp = union_find(ids, [(x, y) for k, x in enumerate(ids) for y in ids[k + 1:]
                                    if similar(sets[x], sets[y])])
            assert sorted(r["doc_id"] for r in b) == [i for i in ids if comp[i] == i]
        if name in ("near_dedup", "mixing"):
            assert all(tuple(a[r["doc_id"]]) == tuple(r) for r in b)
        before = after
    packed = cp.STAGES[-1][1](spark, before, SF_SMALL).collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r["doc_id"] for r in before.collect())
    total = cp.run(spark, SF_SMALL).agg(F.sum("length")).first()[0]
    assert total == sum(r["length"] for r in packed)


def test_stages_take_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF_SMALL).count() == 0


def test_queries_are_registered(spark):
    import __spark_entry__ as e
    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert "op7_mixing" in e.oracle_sql()
