"""Components, MinHash, vectors, archives and the pipeline against brute force."""

import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from tests.conftest import DATA

from chromalake.llm import minhash, pivots, warc
from chromalake.llm.components import connected_components


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(2)
    path = [(i, i + 1) for i in range(100, 140)]
    edges = path + [(500, i) for i in range(501, 560)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(80)] + [(7, 7), (100, 101)]
    got = {x["node"]: x["component"] for x in connected_components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    links = [e for e in edges if e[0] != e[1]]
    want = roots({n for e in links for n in e}, links)
    assert got == want
    assert connected_components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


def shingles(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", low)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute(rows, width):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, width))
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])]
    return roots(ids, links)


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(12):
        t = [r.choice(words) for _ in range(60)]
        for _ in range(r.randrange(1, 6)):
            u = list(t)
            for _ in range(r.randrange(0, 7)):
                u[r.randrange(60)] = r.choice(words)
            i += 1
            rows.append((i, " ".join(u)))
    return [*rows, (900, None), (901, ""), (902, "Solo"), (903, "solo"), (904, " \n"), (905, "two words"), (906, "TWO\twords"), (907, rows[0][1]), (1, rows[0][1])]


@pytest.mark.parametrize(("width", "chunk"), [(2, 256), (5, 256), (2, 4)])
def test_near_duplicates(spark, monkeypatch, width, chunk):
    monkeypatch.setattr(minhash, "CHUNK", chunk)  # small chunks send families through the split path
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "'s' AS sig")
    got = minhash.near_duplicates(spark, d, width).collect()
    want = brute(rows, width)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    n = {r["doc_id"]: r["n_shingles"] for r in got}
    assert all(n[i] == len(shingles(t, width)) for i, t in rows)


def crowd(width, passages=40, seed=5, n=1500, pairs=80):
    """Unlike texts of a few common passages, and pairs at about 0.83 among them with high ids."""
    r = random.Random(seed)
    pool = [" ".join(f"p{k}w{j}" for j in range(12)) for k in range(passages)]
    rows = [(i, " ".join([*r.sample(pool, 12), *(f"u{i}x{j}" for j in range(60))])) for i in range(n)]
    for k in range(pairs):
        common = [*r.sample(pool, 12), " ".join(f"v{k}x{j}" for j in range(60 - width))]
        rows += [(n + 2 * k + side, " ".join([*common, *(f"s{side}k{k}x{j}" for j in range(20))])) for side in (0, 1)]
    return rows


def met_pairs(d, rows, width, bands, n=1500):
    """(second copy -> first) of the linked pairs that share a bucket, and those of them that only meet beside an unlike smaller text."""
    sets = {i: shingles(t, width) for i, t in rows}
    sig = {r["doc_id"]: tuple(r["sig"]) for r in d.select("doc_id", "text").mapInArrow(minhash._sign_batches(width), "doc_id long, n_shingles long, d0 long, d1 long, sig array<int>").collect()}
    row = [{i: x[k * 5 : k * 5 + 5] for i, x in sig.items()} for k in range(bands)]
    first = [{x[i] for i in range(n)} for x in row]
    want = {b: b - 1 for b in range(n + 1, len(rows), 2) if 100 * len(sets[b] & sets[b - 1]) >= 80 * len(sets[b] | sets[b - 1]) and any(x[b] == x[b - 1] for x in row)}
    return want, [b for b in want if all(x[b] != x[b - 1] or x[b] in f for x, f in zip(row, first, strict=True))]


@pytest.mark.parametrize("block", [512, 8])
def test_unlike_documents_hide_no_pair(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block, raising=False)  # small blocks send buckets through the leaders
    monkeypatch.setattr(minhash, "BANDS", 2)  # so that a pair often has one common bucket only
    rows = crowd(2)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want, hidden = met_pairs(d, rows, 2, 2)
    assert hidden
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark, d, 2).collect()}
    assert {i: c for i, c in got.items() if i != c} == want


def test_near_duplicate_edges(spark):
    none = minhash.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (5, "g h i j k l"), (3, "g h i j k l"), (9, "a b c d e f")]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got.count((None, None, True)) == 2
    assert {g[1] for g in got if g[0] is not None} == {3}  # id 5 ties both texts together
    left = minhash.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] for r in left), key=str) == [3, None, None]
    own = [(1, "b b b", 1), (1, "a a a", 2), (1, "a a a", 2), (2, "c c c", 3)]
    d = spark.createDataFrame(own, "doc_id long, text string, _id int")
    assert sorted(tuple(r) for r in minhash.keep_one(spark, d).collect()) == [(1, "a a a", 2), (2, "c c c", 3)]
    long = " ".join(f"w{i}" for i in range(300_000))
    far = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark, spark.createDataFrame([(4, long), (6, long + " x"), (8, "x")], "doc_id long, text string")).collect()}
    assert far == {4: 4, 6: 4, 8: 8}


def test_confirmed_pairs_equal_sets():
    r = np.random.default_rng(4)
    sets = [np.sort(r.choice(50, r.integers(1, 30), replace=False)).astype(np.uint64) for _ in range(25)]
    got = {tuple(p) for p in minhash.linked_pairs(sets, 40).tolist()}
    py = [set(x.tolist()) for x in sets]
    assert got == {(i, j) for i in range(25) for j in range(i + 1, 25) if 100 * len(py[i] & py[j]) >= 40 * len(py[i] | py[j])}


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 40)
    r = np.random.default_rng(6)
    base = r.normal(size=(150, 16))
    near = [base[k] + 0.15 * r.normal(size=16) for k in range(12) for _ in range(10)]
    x = [v.tolist() for v in [*base, *near, base[0], base[0], *(3 * base[5:7])]]
    rows = [(i, v) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [None] + [1.0] * 15), (1004, [float("nan")] + [1.0] * 15), (1005, [float("inf")] * 16), (1006, [1.0, 2.0]), (None, x[0])]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS node", "'p' AS prefix")
    got = {q["vec_id"]: q for q in pivots.near_vectors(spark, d).collect()}
    assert len(got) == len(rows) + len(odd)
    a = np.array(x)
    a /= np.linalg.norm(a, axis=1)[:, None]
    c = a @ a.T
    np.fill_diagonal(c, -1)
    deg = (c >= 0.9).sum(1)
    mine = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (mine <= deg).all() and mine.sum() >= 0.97 * deg.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i, _ in odd)
    links = np.argwhere(c >= 0.9).tolist()
    want = roots(range(len(rows)), links)
    assert np.mean([got[i]["component_id"] == want[i] for i in want]) > 0.97
    assert pivots.near_vectors(spark, d.limit(0)).count() == 0


@pytest.mark.parametrize(("count", "least"), [(640, 0.97), (4096, 0.95)])
def test_recall_at_the_border(count, least):
    """Pairs at a cosine of 0.9 among random vectors, where recall is lowest."""
    r = np.random.default_rng(3)
    a = pivots.unit(r.normal(size=(600, 64)))
    b = r.normal(size=a.shape)
    b = pivots.unit(b - (b * a).sum(1)[:, None] * a)
    b = 0.9000001 * a + np.sqrt(1 - 0.9000001**2) * b
    ref = pivots.unit(r.normal(size=(count, 64)))
    p, q = pivots.describe(a, ref), pivots.describe(b, ref)
    met = (pivots.list_keys(p)[:, :, None] == pivots.list_keys(q)[:, None, :]).any((1, 2))
    met &= (p[:, :, None] == q[:, None, :]).any(2).sum(1) >= pivots.SHARED
    assert met.mean() >= least


@pytest.mark.parametrize("cross", [False, True])
def test_lists_count_every_pair_once(cross):
    r = np.random.default_rng(5)
    ref = pivots.unit(r.normal(size=(64, 8)))
    vec = np.concatenate([r.normal(size=8) + 0.1 * r.normal(size=(12, 8)) for _ in range(10)])
    prefix, block = pivots.describe(vec, ref), r.integers(0, 2, len(vec))
    keys = pivots.list_keys(prefix)
    got = {True: [], False: []}
    for key in np.unique(keys):
        at = np.flatnonzero((keys == key).any(1))
        where = np.tile([key, 0, int(cross)], (len(at), 1))
        for kind in (True, False):
            if kind:
                i, j = pivots.long_links(vec[at], prefix[at], block[at], int(key), cross, 0.9)
            else:
                i, j = pivots.short_links(vec[at], prefix[at], block[at], where, np.full(len(at), len(at)), 0.9)
            got[kind] += list(zip(at[i].tolist(), at[j].tolist(), strict=True))
    u = pivots.unit(vec)
    want = {(i, j) for i, j in np.argwhere(np.triu(u @ u.T >= 0.9, 1)).tolist()
            if len(set(prefix[i]) & set(prefix[j])) >= pivots.SHARED and set(keys[i]) & set(keys[j]) and (not cross or block[i] != block[j])}
    assert want and sorted(got[True]) == sorted(want) == sorted(x for x in got[False])


def test_archives(spark, tmp_path):
    body = "<html>" + "x" * 200
    rows = [(4, "http://a", body), (2, "http://b", body), (9, "http://c\r\nX: 1", body), (5, None, None), (6, "http://d", ""), (7, "u", "short"), (8, "u", "short"), (10, "é", "é" * 60 + "\r\n\r\nWARC/1.1"), (11, "", "é" * 60 + "\r\n\r\nWARC/1.1"), (None, "n", body)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS payload", "1 AS head")
    path = f"file://{tmp_path}/w"
    warc.write_archives(d, path)
    got = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert bytes(r["payload"]) == data if r["record_type"] == "response" else r["payload"] is None
    assert {i: got[i]["refers_to"] for i in got if got[i]["record_type"] == "revisit"} == {4: 2, 9: 2, None: 2, 11: 10}
    q = warc.read_archives(spark, path).where("record_type = 'revisit' and page_id in (4, 2)")
    assert [r["page_id"] for r in q.collect()] == [4]
    assert warc.read_archives(spark, path, payload=False).where("payload is not null").count() == 0
    (tmp_path / "w" / "part-lost.warc.gz").write_bytes(b"an attempt that was never committed")
    assert warc.read_archives(spark, path).count() == len(rows)
    warc.write_archives(d.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0


def test_archives_append_overwrite_and_foreign(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    part = lambda a, b: spark.createDataFrame([(i, f"http://{i}", f"<p>{i}" + "y" * 300_000 * (i == 7)) for i in range(a, b)], "page_id long, url string, html string")
    warc.write_archives(part(0, 5), path)
    warc.write_archives(part(5, 10), path)
    got = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert sorted(got) == list(range(10)) and len(got[7]["payload"]) == 300_004  # a long payload among them
    warc.write_archives(part(20, 23), path, mode="overwrite")
    assert sorted(r["page_id"] for r in warc.read_archives(spark, path).collect()) == [20, 21, 22]
    assert len(list((tmp_path / "a").glob("*.warc.gz"))) <= 3
    # archives of others: plain and gzip, several records to a member, all record types
    rec = lambda kind, date, ctype, block: (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Date: {date}\r\nWARC-IP-Address: 10.0.0.{len(block)}\r\nContent-Type: {ctype}\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    one = rec("warcinfo", "2020-01-01T00:00:00Z", "application/warc-fields", b"software: x\r\n") + rec("response", "2021-01-01T00:00:00Z", "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody")
    two = rec("resource", "2022-01-01T00:00:00Z", "text/plain", b"plain\r\n\r\ntext") + rec("conversion", "2023-01-01T00:00:00Z", "text/plain", b"")
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.warc").write_bytes(one)
    (tmp_path / "f" / "y.warc.gz").write_bytes(gzip.compress(two))
    (tmp_path / "f" / "notes.txt").write_text("no archive")
    d = warc.read_archives(spark, f"file://{tmp_path}/f", headers="WARC-IP-Address")
    rows = {r["record_type"]: r for r in d.collect()}
    assert {k: bytes(r["payload"]) for k, r in rows.items()} == {"warcinfo": b"software: x\r\n", "response": b"body", "resource": b"plain\r\n\r\ntext", "conversion": b""}
    assert rows["response"]["payload_bytes"] == 4 and rows["response"]["page_id"] is None
    late = d.where("warc_date >= '2021-06-01' and warc_date < '2023' and warc_ip_address = '10.0.0.13'").select("record_type", "warc_date").collect()
    assert [tuple(r) for r in late] == [("resource", "2022-01-01T00:00:00Z")] and rows["resource"]["warc_ip_address"] == "10.0.0.13"
    assert warc.read_archives(spark, f"file://{tmp_path}/f/x.warc").count() == 2


def test_common_payloads_meet_no_single_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "hub_size", lambda rows: 3)
    rows = [(i, "u", "z" * 200 if i % 3 else "q" * 200 if i < 7 else f"own {i}" + "x" * 200) for i in range(30, 0, -1)]
    plan = warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["refers_to"] for r in plan.collect()} == {i: None if i % 3 == 0 and i >= 7 or i in (1, 3) else 1 if i % 3 else 3 for i in range(1, 31)}


def test_pushed_filters_skip_payloads():
    import io

    recs = [warc.encode_record(i, "u", "response", None, "d", 5, b"hello") for i in range(3)]
    heads = [(h["x-page-id"], b) for h, b in warc.records(io.BytesIO(b"".join(recs)), lambda h: h["x-page-id"] == "1")]
    assert heads == [("1", b"hello")]
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(gzip.compress(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc"))))


def test_pipeline_keeps_and_drops(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    cols, d = docs.columns, docs
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        d = cp.materialize(spark, stage(spark, d, DATA), "test")
        assert d.columns == cols
        seen[name] = {r["doc_id"] for r in d.select("doc_id").collect()}
    a, b, c = (seen[n] for n, _ in cp.STAGES[:-1])
    assert c < b <= a
    clean = cp.quality_rule_stage(spark, docs, DATA)
    rows = [(r["doc_id"], r["text"]) for r in clean.where(clean["doc_id"].isin(list(b))).collect()]
    want = brute(rows, 5)
    assert c == {i for i, k in want.items() if i == k}
    packed = cp.STAGES[-1][1](spark, d, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == c
    assert cp.run(spark, DATA).count() == packed.count()


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as cp

    good = "This line is long enough to stay here.\nHome | News | Shop | More\nAnd so is this other one, with its own words."
    rows = [(1, good, "en", "s", 7, "x"), (1, good, "en", "s", 7, "x"), (2, None, None, None, None, None), (3, "", "en", "s", 0, "x"), (None, good + " More.", "en", "s", 1, "x"), (4, good + " " + "word " * 60_000 + "end.", "en", "s", 1, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    kept = cp.quality_rule_stage(spark, d, DATA)
    assert kept.columns == d.columns
    got = kept.collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "None"]  # 4 repeats itself too much
    assert all("Home" not in r["text"] and r["n_chars"] == len(r["text"]) for r in got)
    for name, stage in cp.STAGES:
        out, none = stage(spark, d, DATA), stage(spark, d.limit(0), DATA)
        assert none.count() == 0
        if name != "packing":
            assert out.columns == d.columns
    near = cp.near_duplicate_stage(spark, d, DATA).collect()
    assert sorted(str(r["doc_id"]) for r in near) == ["1", "2", "3", "4", "None"]
    assert len({r["doc_id"] for r in cp.packing_stage(spark, d, DATA).collect()}) == 5


def test_near_duplicate_stage_among_common_passages(spark, monkeypatch):
    import corpus_pipeline as cp

    monkeypatch.setattr(minhash, "BANDS", 2)
    rows = crowd(5, passages=16)
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    want, hidden = met_pairs(d, rows, 5, 2)
    assert hidden
    left = cp.near_duplicate_stage(spark, d, "")
    assert left.columns == d.columns
    assert {i for i, _ in rows} - {r["doc_id"] for r in left.select("doc_id").collect()} == set(want)
