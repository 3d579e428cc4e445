"""Core operators against plain loops, and their edge cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioscope.functions import urls
from folioscope.functions.text import collapsed, cosine, longest_ticks, markdown_escaped, normalized, quoted, tokens, unit_vector, valid_symbol
from folioscope.operators import chunking, context, crawling, fusion, graph, history, lexical, vectors
from folioscope.operators.snapshots import record_url, snapshot_changes
from folioscope.plans import validate

T0 = datetime(2025, 1, 1)
SNAP = "snapshot_no int, source_id string, document_url string, normalized_sha256 string, availability string, stored_at timestamp, value string, state int, present boolean"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def brute_changes(rows):
    states = {}
    for no, src, url, sha, avail, at, *_ in rows:
        if no is None:
            continue
        u = None
        if url is not None:
            u = url.split("#")[0]
            if "://" in u:
                scheme, rest = u.split("://", 1)
                host, slash, path = rest.partition("/")
                u = f"{scheme.lower()}://{host.lower()}{slash}{path}"
        key = (at or datetime.min, (sha or "").lower() if sha else "", avail or "")
        if (no, src, u) not in states or key > states[(no, src, u)][0]:
            states[(no, src, u)] = (key, sha.lower() if sha else None, (avail or "active") != "removed")
    numbers = sorted({n for n, _, _ in states})
    out = set()
    for a, b in zip(numbers, numbers[1:]):
        was = {(s, u): v[1] for (n, s, u), v in states.items() if n == a and v[2]}
        now = {(s, u): v[1] for (n, s, u), v in states.items() if n == b and v[2]}
        out |= {(b, *k, "added") for k in now if k not in was} | {(b, *k, "removed") for k in was if k not in now}
        out |= {(b, *k, "changed") for k in now if k in was and now[k] != was[k]}
    return out


def test_snapshot_changes_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for no in (1, 2, 4, 7):
        for i in range(60):
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                url = rng.choice([f"https://a.test/p{i}", f"HTTPS://A.test/p{i}#x", f"https://a.test/p{i}#y"])
                rows.append((no, rng.choice(["s", "s", None]), url, rng.choice([None, "ab", "AB", "cd"]), rng.choice([None, "active", "removed"]), T0 + timedelta(seconds=rng.randrange(10**6)), "v", 1, True))
    rows += [rows[3], (None, "s", "https://a.test/p1", "x", None, T0, "v", 1, True), (2, "s", None, "q", None, T0, "v", 1, True)]
    got = {tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SNAP)).collect()}
    assert got == brute_changes(rows)
    assert snapshot_changes(spark.createDataFrame([], SNAP)).count() == 0


def test_snapshot_plan_has_one_exchange_of_the_rows(spark, data):
    df = snapshot_changes(spark.read.parquet(f"{data}/document_snapshot.parquet"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1


def test_record_url(spark):
    cases = {"HTTP://A.B/C?D#e": "http://a.b/C?D", "x": "x", "": "", "a#b#c": "a", "https://H.I": "https://h.i"}
    for given, want in cases.items():
        assert one(spark, record_url(F.lit(given)))[0] == want


def test_text_functions(spark):
    r = one(
        spark, tokens(F.lit("Proxy::custom() – ÄB")), normalized(F.lit("  a \n b c ")), collapsed(F.lit(" a\n\nb ")), markdown_escaped(F.lit("a*b[c]")), longest_ticks(F.lit("a`b```c")), quoted(F.lit("a\nb")),
        valid_symbol(F.lit("A::b")), valid_symbol(F.lit("A:b")), unit_vector(F.array(F.lit(3.0), F.lit(4.0))), unit_vector(F.array(F.lit(0.0))), F.round(cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), 6),
    )
    assert list(r) == [["proxy", ":", ":", "custom", "(", ")", "–", "äb"], "a b c", " a b ", r"a\*b\[c\]", 3, "> a\n> b", True, False, [0.6, 0.8], None, 0.707107]


def test_urls(spark):
    assert urls.join_url("https://a.test/x/y", " ../z?q ") == "https://a.test/z?q"
    assert urls.join_url("https://a.test/", "mailto:x@y") is None and urls.join_url("https://a.test/", "https://u:p@b.test") is None
    public = {"8.8.8.8": True, "10.0.0.1": False, "127.0.0.1": False, "100.64.0.1": False, "192.0.2.1": False, "198.18.0.1": False, "::1": False, "::ffff:10.0.0.1": False, "2001:4860:4860::8888": True, "x": False}
    assert {k: urls.is_public(k) for k in public} == public
    scoped = {"https://a.test/docs": True, "https://a.test/docs/x": True, "https://a.test/docsx": False, "https://b.test/docs/x": False, "https://a.test/docs/%41": False, "https://A.test/docs/?q": True, None: False}
    df = spark.createDataFrame([(k,) for k in scoped], "u string")
    assert {r.u: r.s for r in df.select("u", urls.in_scope(F.col("u"), "https://a.test/docs").alias("s")).collect()} == scoped
    r = one(spark, urls.html_candidate(F.lit("https://a/x.html?q")), urls.html_candidate(F.lit("https://a/x.pdf")), urls.html_candidate(F.lit("https://a/x/")), urls.path_depth(F.lit("https://a/b//c?d")))
    assert list(r) == [True, False, True, 2]


def pack(blocks, target):
    units = []
    for kind, n in blocks:
        if units and kind == "code" and units[-1][-1][0] in ("paragraph", "code"):
            units[-1].append((kind, n))
        else:
            units.append([(kind, n)])
    out, at, size = [], 0, 0
    for u in units:
        own = sum(n for _, n in u) + 2 * (len(u) - 1)
        if out and size + 2 + own <= target:
            out[-1][1] += len(u)
            size += 2 + own
        else:
            out.append([at, at + len(u)])
            size = own
        at += len(u)
    return [tuple(x) for x in out]


def test_packing_equals_a_loop(spark):
    rng = random.Random(3)
    cases = [([(rng.choice(["paragraph", "code", "list"]), rng.randint(0, 60)) for _ in range(rng.randint(0, 12))], rng.choice([1, 40, 80, 200])) for _ in range(200)]
    df = spark.createDataFrame([(i, [k for k, _ in b], [n for _, n in b], t) for i, (b, t) in enumerate(cases)], "i int, k array<string>, n array<int>, t int")
    got = {r.i: [(x.start, x.stop) for x in r.p] for r in df.select("i", chunking.packed_ranges(F.col("k"), F.col("n"), F.col("t")).alias("p")).collect()}
    assert got == {i: pack(b, t) for i, (b, t) in enumerate(cases)}


SEC = "source_id string, document_url string, section_id int, parent_id int, heading string, heading_level int, anchor string, blocks array<struct<kind:string,text:string,links:int>>"


def test_chunks_cover_blocks_and_keep_their_ids(spark):
    def doc(extra):
        return [("s", "u", 0, None, None, 0, None, []), ("s", "u", 1, 0, "A", 1, "a", [("paragraph", "x" * 50, 0), ("code", "y" * 50, 0), ("paragraph", "z" * 30, 0)]), ("s", "u", 2, 1, "B", 2, None, []), ("s", "u", 3, 1, "B", 2, None, [("paragraph", "same", 0)]), ("s", "u", 4, 1, "B", 2, None, [("paragraph", "same", 0)])] + extra

    a = chunking.chunked(spark.createDataFrame(doc([]), SEC), 90).orderBy("sequence").collect()
    assert [(r.section_id, r.block_start, r.block_end) for r in a] == [(1, 0, 2), (1, 2, 3), (2, 0, 0), (3, 0, 1), (4, 0, 1)]
    assert a[0].oversized == "ExampleGroup" and a[1].oversized is None and a[3].heading_path == ["A", "B"]
    assert len({r.chunk_id for r in a}) == 5 and a[3].content_sha256 == a[4].content_sha256
    b = chunking.chunked(spark.createDataFrame(doc([("s", "u", 5, 0, "C", 1, None, [("paragraph", "new", 0)])]), SEC), 90)
    assert {r.chunk_id for r in a} < {r.chunk_id for r in b.collect()}
    with pytest.raises(ValueError):
        chunking.chunked(spark.createDataFrame(doc([]), SEC), 0)


def lexical_corpus(spark):
    rows = [("1", "Use Proxy::custom() here"), ("2", "custom things of a Proxy"), ("3", "Proxy::customized is longer"), ("4", "noise"), ("5", "noise again"), ("6", "more noise")]
    return spark.createDataFrame([(i, "s", f"https://a.test/{i}", "Title", ["H"], 0, t, T0) for i, t in rows], "chunk_id string, source_id string, document_url string, title string, heading_path array<string>, sequence long, text string, crawled_at timestamp")


def test_lexical_modes_and_filters(spark):
    rows = lexical_corpus(spark)
    ids = lambda df: [r.chunk_id for r in df.collect()]
    assert ids(lexical.search(rows, "Proxy::custom")) == ["1"]
    assert sorted(ids(lexical.search(rows, "proxy custom", mode="keywords"))) == ["1", "2"]
    assert ids(lexical.search(rows, "Proxy custom", mode="exact")) == []
    assert ids(lexical.search(rows, "title", where=lexical.Filter(source_id="none"))) == []
    everywhere = lexical.search(rows, "title").orderBy("document_url").collect()
    assert [r.score for r in everywhere] == [0.0] * 6
    assert ids(lexical.search(rows, "noise", where=lexical.Filter(url_prefix="https://a.test/5", heading=" h ", crawled_after=int(T0.timestamp())))) == ["5"]
    assert lexical.search(rows, "noise", where=lexical.Filter(crawled_after=2**40)).count() == 0


def test_rrf_and_ranks(spark):
    rows = spark.createDataFrame([(0, "a", "s", "u", 1, 2, None), (0, "b", "s", "u", 2, 1, None), (0, "c", "s", "u", None, None, 7)], "query_id int, chunk_id string, source_id string, document_url string, lexical_rank int, vector_rank int, graph_rank int")
    got = {r.chunk_id: (r.rrf_score, r.place) for r in fusion.hybrid(rows).collect()}
    assert abs(got["a"][0] - (1 / 61 + 1 / 62)) < 1e-11 and got["a"][1] == 1 and got["b"][1] == 2 and got["c"][1] == 3


def test_context_budget_equals_a_loop(spark):
    rng = random.Random(4)
    rows = [(h, f"c{i}", "s", "u", i, "x" * rng.randint(0, 40), abs(i - h)) for h in (3, 5, 9) for i in range(h - 1, h + 2)]
    df = spark.createDataFrame(rows, "hit_no int, chunk_id string, source_id string, document_url string, sequence long, text string, distance long")
    got = {r.chunk_id: r.takes for r in context.budgeted(df, 100, 5, 30).collect()}
    best = {}
    for r in sorted(rows, key=lambda r: (r[6] > 0, r[6], r[0], r[4])):
        best.setdefault(r[1], r)
    left, want = 100, {}
    for r in sorted(best.values(), key=lambda r: (r[6] > 0, r[6] if r[6] else 0, r[0], r[4], r[1]))[:5]:
        if left <= 0:
            break
        take = min(len(r[5]), 30, left)
        want[r[1]] = take
        left -= take
    assert got == want


def test_symbols_and_links(spark):
    found = one(spark, graph.symbols(F.lit("use a::b::C, x::y. not:this ::z Q::r: ünder::s")))[0]
    assert found == ["a::b::C", "x::y"]
    links = spark.createDataFrame([("s", "https://a.test/p", i, h, "t" * 300) for i, h in enumerate(["q#x", "q#x", "q#y", "mailto:a@b", "/p"])], "source_id string, src_url string, position int, href string, text string")
    e = graph.link_edges(links)
    assert {(r.url, r.dst_url) for r in e.collect()} == {("https://a.test/q#x", "https://a.test/q"), ("https://a.test/q#y", "https://a.test/q"), ("https://a.test/p", "https://a.test/p")}
    assert all(len(r.text) == 200 and r.text_truncated for r in e.collect())


def test_one_hop_keeps_filters_before_limits(spark):
    seeds = spark.createDataFrame([(1, "c0", "s", "u0")], "seed_no int, chunk_id string, source_id string, document_url string")
    chunks = spark.createDataFrame([(f"c{i}", "s", f"u{i}", 0, None, i) for i in range(8)], "chunk_id string, source_id string, document_url string, sequence long, anchor string, no int")
    edges = spark.createDataFrame([("s", "u0", f"u{i}", f"u{i}") for i in (0, 1, 2, 3, 4, 5, 99)] + [("s", "u7", "u0", "u0")], "source_id string, src_url string, dst_url string, url string")
    mentions = spark.createDataFrame([("s", "u0", "c0", 0, "A::b"), ("s", "u6", "c6", 0, "A::b")], "source_id string, document_url string, chunk_id string, sequence long, symbol string")
    got = graph.expand(seeds, edges, mentions, chunks, graph.Hop(edges=2))
    assert {(r.chunk_id, r.relation, r.edge_overflow) for r in got.collect()} == {("c1", "outgoing_link", True), ("c2", "outgoing_link", True), ("c6", "shared_entity", False)}
    only = graph.expand(seeds, edges, mentions, chunks, graph.Hop(edges=2), keep=F.col("no") >= 5)
    assert {r.chunk_id for r in only.collect()} == {"c5", "c7", "c6"}
    assert [r.graph_rank for r in graph.interleaved(got).orderBy("graph_rank").collect()] == [1, 2, 3]


def test_change_kinds(spark):
    cols = "status int, state string, requested_url string, final_url string, raw_sha256 string, normalized_sha256 string, old_raw_sha256 string, old_normalized_sha256 string, old_availability string, compatible boolean"
    cases = [
        ((200, "Fetched", "u", "u", "r", "n", None, None, None, True), "added"), ((200, "Fetched", "u", "u", "r", "n", "r", "n", None, True), "raw_unchanged"),
        ((200, "Fetched", "u", "u", "r2", "n", "r", "n", None, True), "normalized_unchanged"), ((200, "Fetched", "u", "u", "r2", "n2", "r", "n", None, True), "changed"),
        ((200, "Fetched", "u", "u", "r", "n", "r", "n", None, False), "reprocessed"), ((304, "NotModified", "u", "u", None, None, "r", "n", None, True), "not_modified"),
        ((410, "HttpFailure", "u", "u", None, None, "r", "n", None, True), "removed"), ((410, "HttpFailure", "u", "v", None, None, "r", "n", None, True), "rejected"),
        ((503, "HttpFailure", "u", "u", None, None, "r", "n", None, True), "rejected"), ((200, "Fetched", "u", "u", "r", "n", "r", "n", "removed", True), "reprocessed"),
    ]
    df = spark.createDataFrame([c for c, _ in cases], cols)
    assert [r.k for r in df.select(history.change_kind().alias("k")).collect()] == [k for _, k in cases]


def test_revisions_come_back(spark):
    rows = [("s", "u", x, T0 + timedelta(days=i)) for i, x in enumerate(["A", "B", "A"])]
    got = history.revisions(spark.createDataFrame(rows, "source_id string, document_url string, normalized_sha256 string, stored_at timestamp")).orderBy("sequence").collect()
    assert [(r.normalized_sha256, r.sequence, r.is_current) for r in got] == [("A", 1, True), ("B", 2, False)]


def test_manifest_scans(spark):
    xml = "<urlset><url><loc> https://a.test/1?a=1&amp;b=2 </loc></url><sitemap><loc>https://a.test/m.xml</loc></sitemap></urlset>"
    r = one(spark, crawling.sitemap_links(F.lit(xml)), crawling.sitemap_links(F.lit("<!DOCTYPE x>" + xml)), crawling.markdown_links(F.lit("[a](b) and [c](d 'e')")))
    assert r[0].pages == ["https://a.test/1?a=1&b=2"] and r[0].maps == ["https://a.test/m.xml"] and r[1].pages == [] and r[2] == ["b", "d"]


def test_embedding_states(spark):
    chunks = spark.createDataFrame([("a", "s", "u", "good", "h1"), ("b", "s", "u", "bad", "h2"), ("c", "s", "u", "zero", "h3")], "chunk_id string, source_id string, document_url string, text string, content_sha256 string")
    known = spark.createDataFrame([(1, "sp", "a", [1.0], "h1", "ready", 1, T0)], "embedding_id long, space_id string, chunk_id string, vector array<double>, content_sha256 string, status string, attempts int, updated_at timestamp")
    todo = vectors.to_embed(chunks, known, "sp")
    assert {r.chunk_id for r in todo.collect()} == {"b", "c"}

    def provider(texts):
        if "bad" in texts:
            raise RuntimeError("outage")
        return [[0.0, 0.0] if t == "zero" else [3.0, 4.0] for t in texts]

    got = {r.chunk_id: (r.status, r.error) for r in vectors.completed(vectors.embed(vectors.to_embed(chunks, known.where("false"), "sp"), provider, "sp"), chunks).collect()}
    assert got == {"a": ("ready", None), "b": ("failed", "outage"), "c": ("failed", "no direction")}


def test_validators():
    validate.crawl("s", "c", "https://a.test/docs", ["https://a.test/docs/x"])
    for bad in (dict(seeds=["https://b.test/"]), dict(seeds=[], max_pages=0), dict(seeds=[], timeout_s=121)):
        with pytest.raises(validate.Invalid):
            validate.crawl("s", "c", "https://a.test/docs", **bad)
    for f, a in ((validate.context, (4,)), (validate.graph, (9,)), (validate.metadata, ("https://a.test/?q",)), (validate.rank_lists, ([["a", "a"]],)), (validate.embedding_space, ("p", "m", 0))):
        with pytest.raises(validate.Invalid):
            f(*a)


def test_staged_tables_are_released(spark):
    import os

    from folioscope.sources import staging

    df = staging.stage(spark.range(10), "test")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 10 and os.path.exists(path)
    assert staging.small_or_shuffled(df, 5).join(df, "id").count() == staging.small_or_shuffled(df).join(df, "id").count() == 10
    assert staging.release(spark) >= 1 and not os.path.exists(path)


def test_kept_snapshots_give_the_newest_changes(spark, data, tmp_path):
    from folioscope.operators import snapshots

    rows = spark.read.parquet(f"{data}/document_snapshot.parquet")
    path = str(tmp_path / "kept")
    snapshots.keep_snapshot(rows.where("snapshot_no <= 4"), path)
    snapshots.keep_snapshot(rows.where("snapshot_no = 5"), path)
    cols = ["snapshot_no", "source_id", "document_url", "change_kind"]
    want = sorted(map(tuple, snapshots.snapshot_changes(rows).where("snapshot_no = 5").select(*cols).collect()))
    assert sorted(map(tuple, snapshots.newest_changes(spark, path).select(*cols).collect())) == want and want


def test_manifests_and_identifiers(spark):
    from folioscope.operators.lexical import is_identifier
    from folioscope.sources.readers import manifest_urls

    rows = [("s", "llms.txt", "[a](guide/a) [b](https://y.test/b)", "https://x.test/docs/llms.txt"), ("s", "sitemap.xml", "<url><loc>https://x.test/c?a=1&amp;b=2</loc></url>", "https://x.test/sitemap.xml")]
    got = {r.url for r in manifest_urls(spark.createDataFrame(rows, "source_id string, name string, text string, base_url string")).collect()}
    assert got == {"https://x.test/docs/guide/a", "https://y.test/b", "https://x.test/c?a=1&b=2"}
    assert is_identifier("Größe::maß") and is_identifier("a::b()") and not is_identifier("1a::b") and not is_identifier("plain")
