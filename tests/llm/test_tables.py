"""Operators on pages and vectors, and the pipeline, against brute force."""

import hashlib
import math
import random

import pytest

from cellweave.llm import common, topk, url_filter, warc

# ---- op 4


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    rest = rest[at:]
    return host, rest[: next((i for i, c in enumerate(rest) if c in "?#"), len(rest))]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "x", "://", "http://A.com/en/1", "http://a.example.com/en/71?x#y", "http://example.com/en/7", "http://xexample.com/en/7", "http://b.example.net/de/8", "http://b.example.net/de/7", "http://c.org/es", "http://c.org/es/", "http://com?/en/", "http://É.com/en/#", "ftp://a.net/de/://b", "http://lone.io/x", "http://h.lone.io/x"]


def test_url_filter(spark):
    pages = [(i, u, '<a href="http://A.com/x"> <a href=//lone.io:80/y>' if i % 2 else None) for i, u in enumerate(URLS)] + [(3, URLS[3], None), (None, URLS[4], "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as w", "3 as verdict")
    got = url_filter.url_filter(df).collect()
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule) for r in got))) == sorted(map(str, ((i, *parsed(u), rule(*parsed(u))[0]) for i, u, _ in pages)))
    for r in got:
        known = rule(r.host, r.path)[1]
        bad = r.distrust > url_filter.THRESHOLD * (r.trust + r.distrust) and r.distrust >= url_filter.LEAST
        assert r.verdict == (known or ("block" if bad else "allow"))
    assert url_filter.url_filter(df.limit(0)).count() == 0


def test_propagation(spark):
    links = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 2.0)]
    seeds = [("a", 1.0, 0.0), ("c", 0.0, 0.5), ("lone", 0.2, 0.2)]
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagated(spark.createDataFrame(links, "src string, dst string, w double"), spark.createDataFrame(seeds, "host string, trust double, distrust double")).collect()}
    for k, edges in ((0, links), (1, [(b, a, w) for a, b, w in links])):
        out = {}
        for a, _, w in edges:
            out[a] = out.get(a, 0) + w
        seed = {h: (t, d)[k] for h, t, d in seeds if (t, d)[k]}
        rank = dict(seed)
        for _ in range(url_filter.STEPS):
            new = {h: 0.15 * v for h, v in seed.items()}
            for a, b, w in edges:
                new[b] = new.get(b, 0) + 0.85 * rank.get(a, 0) * w / out[a]
            rank = new
        for h, v in rank.items():
            assert got[h][k] == pytest.approx(v, abs=1e-12)


def test_links_by_name_and_up_the_chain_of_domains(spark):
    html = '<A HREF="HTTP://User@Other.Net:8080/x"> <a Href=\'//10.0.0.7/y\'> <a href=/relative> <base href="https://c.d.e.f.org/">'
    pages = [(1, "http://a.b.c.com:8080/p", html), (2, "http://a.b.c.com/p", html.lower()), (3, "http://10.0.0.7:81/q", None), (4, "http://[::1]:80/", None), (5, "http://b.c.com./", None)]
    got = {(r.src, r.dst): r.w for r in url_filter.host_links(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    chain = [("a.b.c.com", "b.c.com"), ("b.c.com", "c.com"), ("c.d.e.f.org", "d.e.f.org"), ("d.e.f.org", "e.f.org"), ("e.f.org", "f.org"), ("b.c.com.", "c.com."), ("c.com.", "com.")]
    want = {("a.b.c.com", h): 2.0 for h in ("other.net", "10.0.0.7", "c.d.e.f.org")} | {p: 1.0 for a, b in chain for p in ((a, b), (b, a))}
    assert got == want


def test_a_seed_far_off_reaches_a_host(spark):
    """A port is no other host to the graph, and distrust travels up and down the chain of domains."""
    pages = [(k, f"http://bad.example.net/de/8{k}", None) for k in range(6)] + [(10, "http://x.y.example.net:8080/", None), (11, "http://example.net/", None)]
    got = {r.page_id: r for r in url_filter.url_filter(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[10].host == "x.y.example.net:8080" and got[10].distrust > 0 and got[11].distrust > got[10].distrust and got[0].rule == "example.net/de/8"


# ---- op 8


def test_archives_keep_urls_and_long_pages(spark):
    rnd = random.Random(9)
    pages = [(1, "http://a.com/x\r\ny", "p"), (2, "  http://a.com/ %0D\n", "q"), (3, "http://a.com/" + "z" * 5000, "é" * 3_000_000), (4, None, "r"), (5, "", "s"), (6, "\x00?", "t")] + [(10 + i, "http://hot.com/", f"capture {rnd.random()}" * 40) for i in range(3000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r for r in warc.warc(df).collect()}
    assert len(got) == len(pages) and all(got[i].url == (u or "") and got[i].payload_bytes == len(h.encode()) for i, u, h in pages)


def test_lookup_of_other_urls(spark):
    pages = [(i, f"http://h{i % 9}.example.com/{i % 300}", f"page {i}") for i in range(900)]
    root = common.shared_dir(spark)
    manifest = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), root)
    asked = ["http://h3.example.com/3", "http://h3.example.com/3", "HTTP://H0.example.com/0", "http://none.example.com/", None, "http://h8.example.com/299"]
    got = warc.lookup(manifest, root, spark.createDataFrame([(u,) for u in asked], "url string"))
    assert sorted(r.page_id for r in got.collect()) == sorted(i for i, u, _ in pages if u.lower() in {a.lower() for a in asked if a})
    assert warc.lookup(manifest.limit(0), root, spark.createDataFrame([("x",)], "url string")).count() == 0


def test_warc(spark, tmp_path):
    big, other = "é" * 600, "x" * 1000
    pages = [(1, "http://b.com/1", big), (2, "http://a.com/1?q=1#f", big), (3, None, big), (4, "http://a.com/2", other), (5, "http://a.com/2", "x" * 999), (6, "http://c.org", "x" * 999), (7, "bad url\r\n", None), (8, "http://a.com/2", ""), (9, "http://a.com/2", "\x00\r\n\r\n"), (None, "http://a.com/2", other), (4, "http://a.com/2", other)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as digest", "'x' as marker")
    got = sorted(map(str, (tuple(r)[:5] for r in warc.warc(df).collect())))
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        top = max((j for j, _, h in pages if (h or "").encode() == data and j is not None), default=None)
        again = len(data) >= 1000 and top is not None and i != top
        want.append(str((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None)))
    assert got == sorted(want)
    assert warc.warc(df.limit(0)).count() == 0


def test_index_lookup(spark):
    """A key is found through directory and block, whatever block it starts in."""
    pages = [(i, f"http://h{i % 40}.example.com/{i % 700}", f"page {i}") for i in range(2500)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    root = common.shared_dir(spark)
    manifest = warc.write_archives(df, root).orderBy("shard").collect()
    assert sum(m.n for m in manifest) == 2500 and all(a.last_key <= b.first_key for a, b in zip(manifest, manifest[1:]))
    for url in ("http://h3.example.com/3", "http://h0.example.com/0", "http://h39.example.com/39", "http://none.example.com/"):
        host, path = parsed(url)
        key = ",".join(reversed(host.split("."))) + ")" + path
        found = []
        for m in manifest:
            if m.first_key <= key <= m.last_key:
                shard = warc.Shard(common.Files(root), m.shard)
                found += [r["payload"].decode() for r in shard.find(key)]
                shard.close()
        assert sorted(found) == sorted(h for _, u, h in pages if u == url)


# ---- op 9


def test_top_k(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(16)]) for i in range(400)]
    rows += [(400, None), (401, [math.nan] * 16), (402, [1.0, None] + [0.0] * 14), (403, []), (404, rows[5][1]), (405, rows[5][1]), (None, rows[5][1]), (420, [1.0] * 3), (421, [2.0] * 3), (440, rows[20][1]), (404, rows[6][1]), (460, [1e30] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as query", "2 as block", "3 as dims", "4 as kind")
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want, most = [], 2**63 - 2
    for q, v in ok:
        if q % 20 == 0:
            scores = sorted((-max(-most, min(most, sum(a * b for a, b in zip(v, w)))), i) for i, w in ok if i != q and len(w) == len(v))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:20])]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_segment_bounds_hold_and_prune():
    import numpy as np

    rnd = np.random.default_rng(1)
    x = np.floor(rnd.normal(size=(3000, 64)) * np.linspace(40, 4, 64))
    ids, q = np.arange(3000), x[:20]
    turn = topk.rotation(x[::3])
    assert np.allclose(turn @ turn.T, np.eye(64))
    searcher = topk.Searcher(ids[:20], q, None, turn)
    # every pair that a bound rules out scores below the query's k-th best
    for at in range(0, 3000, 500):
        reached = set(searcher.reached(topk.summary(x[at : at + 500] @ turn)).tolist())
        floor = searcher.floor.copy()
        scores = topk.exact_products(q, x[at : at + 500])
        assert all(scores[i].max() < floor[i] for i in range(20) if i not in reached)
        searcher.add(ids[at : at + 500], x[at : at + 500])
    assert searcher.exact < 0.25 * 20 * 3000  # most pairs never meet exactly
    found = sorted(zip(*(c.tolist() for c in searcher.rows())))
    want = [(i, j, s) for i in range(20) for s, j in sorted(((int(q[i] @ x[j]), j) for j in range(3000) if j != i), key=lambda p: (-p[0], p[1]))[:20]]
    assert found == sorted(want)


@pytest.mark.parametrize("n", [1, 5, 300])
def test_blocks_of_any_size_give_the_same(spark, monkeypatch, n):
    rnd = random.Random(n)
    rows = [(i, [float(rnd.randrange(-3, 4)) for _ in range(rnd.choice([2, 8]))]) for i in range(n)] + [(20, [1.0] * 8)] * 60  # one very common vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = sorted(map(tuple, topk.top_k(df).collect()))
    brute = []
    for q, v in rows:
        if q % 20 == 0:
            brute += [(q, -sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v)]
    best = []
    for q in {b[0] for b in brute}:
        best += [(q, k + 1, i, -s) for k, (_, s, i) in enumerate(sorted(b for b in brute if b[0] == q)[:20])]
    assert want == sorted(best)


# ---- registered queries


@pytest.mark.parametrize("name", ["op1_quality_rules", "op4_url_filter", "op8_warc", "op9_top_k"])
def test_query_and_its_sql(spark, name):
    import glob
    import os

    import duckdb

    from cellweave.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for path in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df, want = QUERIES[name](spark, "/root/testdata/sf0.001"), con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, want.fetchall()))


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master, applicationId = "spark://host:7077", "none"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


# ---- pipeline


def test_pipeline_stages_on_odd_tables(spark):
    """Empty tables, null texts and ids, and columns with names that the stages use."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(20).selectExpr("doc_id", "if(doc_id % 3 = 0, null, text) as text", "if(doc_id % 4 = 0, null, lang) as lang", "if(doc_id % 5 = 0, null, source) as source", "n_chars")
    odd = odd.union(odd.selectExpr("cast(null as bigint)", "''", "lang", "source", "n_chars")).union(odd.limit(3)).selectExpr("*", "1 as key", "2 as doc", "3 as size", "4 as node", "5 as stratum", "6 as rk1", "7 as draw", "8 as kept")
    for table in (odd, odd.limit(0)):
        now = table
        for k, (name, stage) in enumerate(p.STAGES):
            now = common.written(stage(spark, now, sf))
            if k < len(p.STAGES) - 1:
                assert now.columns == odd.columns, name
    assert now.count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(p.STAGES):
        before, docs = docs, common.written(stage(spark, docs, sf))
        if k < len(p.STAGES) - 1:
            assert docs.columns == columns, name
        if k < 3:
            assert docs.subtract(before).count() == 0 and docs.count() <= before.count(), name
    assert docs.count() == before.count() and sorted(map(str, docs.collect())) == sorted(map(str, p.run(spark, sf).collect()))
