"""Vectors, rankings, packing, mixing and pages against brute force, and their edge cases."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import main_body, mixing, packing, pages, rank_fusion, residue, suffix_array
from folioscope.llm import vector_neighbours as vn

EMB = "embedding_id long, space_id string, chunk_id string, vector array<double>, status string, updated_at timestamp, dim int, unit string, did int"
T0, T1 = datetime(2025, 1, 1), datetime(2025, 1, 2)


def emb(i, v, space="s", chunk=None, status="ready", at=T0):
    return (i, space, chunk or f"c{i}", v, status, at, 9, "z", 1)


def brute_neighbours(rows, k):
    out = set()
    by = {}
    for i, space, _, v, *_ in rows:
        by.setdefault((space, len(v)), []).append((i, v))
    for members in by.values():
        ids = [i for i, _ in members]
        x = np.array([v for _, v in members])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        c = np.round(x @ x.T, 9)
        for a in range(len(ids)):
            order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-c[a, b], ids[b]))[:k]
            out |= {(min(ids[a], ids[b]), max(ids[a], ids[b])) for b in order}
    return out


def test_neighbours_with_copies_ties_and_spaces(spark):
    rng = np.random.default_rng(1)
    rows = [emb(i, (rng.normal(size=8) * rng.uniform(0.1, 5)).tolist(), "s" if i % 3 else "t") for i in range(300)]
    rows += [emb(1000 + i, rows[5][3]) for i in range(12)]
    good = list(rows)
    rows += [emb(2000, None), emb(2001, [0.0] * 8), emb(2002, [float("nan")] * 8), emb(2003, rows[1][3], status="failed"), emb(2004, [1.0, 2.0]), emb(2005, [])]
    rows += [emb(7000, [9.0] + [0.0] * 7, chunk="c7", at=datetime(2024, 1, 1)), emb(8000, None, space=None)]
    got = {(r.embedding_a, r.embedding_b) for r in vn.neighbour_pairs(spark.createDataFrame(rows, EMB)).collect()}
    want = brute_neighbours(good, 5)
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97
    full = vn.Index(probes=10_000, most_probes=10_000, rerank=10_000, member_block=64, asker_block=50)
    got = {(r.embedding_a, r.embedding_b) for r in vn.neighbour_pairs(spark.createDataFrame(rows, EMB), index=full).collect()}
    assert got == want
    assert vn.neighbour_pairs(spark.createDataFrame([], EMB)).count() == 0


def neighbour_recall(spark, x, index):
    n = len(x)
    rows = spark.createDataFrame([emb(i, v) for i, v in enumerate(x.tolist())], EMB)
    found = vn.nearest_vectors(rows, 5, index).select("embedding_id", "neighbour_id").toArrow()
    got = set(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    right = 0
    for start in range(0, n, 1000):
        c = np.round(u[start : start + 1000] @ u.T, 9)
        c[np.arange(len(c)), start + np.arange(len(c))] = -2
        near = np.argpartition(-c, 5, axis=1)[:, :5]
        right += sum((start + i, int(j)) in got for i in range(len(c)) for j in near[i])
    return right / (5 * n)


def test_recall_of_many_vectors(spark):
    rng = np.random.default_rng(12)
    centers = rng.normal(size=(400, 24))
    x = centers[rng.integers(0, 400, 20_000)] + 0.4 * rng.normal(size=(20_000, 24))
    assert neighbour_recall(spark, x, vn.Index()) >= 0.999
    # The same with top cells of a small sample, cut further on the cluster.
    assert neighbour_recall(spark, x, vn.Index(sample=2_000, top_cells=40, fit_rows=1_000)) >= 0.99
    # A third of all in one dense cluster without any structure inside.
    x[:6_000] = centers[0] + 0.05 * rng.normal(size=(6_000, 24))
    assert neighbour_recall(spark, x, vn.Index()) >= 0.97


CAND = "query_id long, chunk_id string, lexical_score double, vector_score double, graph_rank int, scored_at timestamp, significance double, position int"


def test_fusion_ranks_and_hot_queries_alike(spark):
    rng = random.Random(2)
    rows = [(q, f"c{i}", rng.choice([None, 1e300, rng.random() * 10**q]), rng.choice([None, round(rng.random(), 1)]), rng.choice([None, rng.randrange(30)]), T0, 0.0, 0) for q in range(5) for i in range(25)]
    rows += [rows[0], (0, "c1", None, None, None, datetime(2020, 1, 1), 0.0, 0), (None, "c", 1.0, 1.0, 1, T0, 0.0, 0), (0, None, 1.0, 1.0, 1, T0, 0.0, 0), (0, "nan", float("nan"), 0.1, 3, None, 0.0, 0)]
    cand = spark.createDataFrame(rows, CAND)
    queries = spark.createDataFrame([(0, 4), (1, 3), (2, None), (9, 5), (3, 100), (4, 0)], "query_id long, wanted int")
    a = rank_fusion.fused_ranking(cand, queries).collect()
    b = rank_fusion.fused_ranking(cand, queries, hot_query=1).collect()
    assert sorted(a) == sorted(b)
    assert {(q, sum(r.query_id == q for r in a)) for q in range(5)} == {(0, 4), (1, 3), (2, 0), (3, 25), (4, 0)}
    assert rank_fusion.fused_ranking(spark.createDataFrame([], CAND), queries).count() == 0


def test_beta_tails(spark):
    rng = np.random.default_rng(3)
    draws = np.sort(rng.random((200_000, 3)), axis=1)
    for k in (1, 2, 3):
        got = spark.range(1).select(rank_fusion.beta_tail(k, 3, F.lit(0.3))).first()[0]
        assert abs(got - (draws[:, k - 1] <= 0.3).mean()) < 0.005


def optimum(sizes, capacity):
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for j in sorted(set(rooms)):
            if j >= sizes[i]:
                rest = list(rooms)
                rest.remove(j)
                go(i + 1, rest + [j - sizes[i]])
        go(i + 1, rooms + [capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([10, 17, 30])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = {s: sizes.count(s) for s in sizes}
        fixed, left = packing.reduce_by_dominance(counts, capacity)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (optimum(rest, capacity) if rest else 0) == optimum(sizes, capacity)
        packed = packing.packed_patterns(counts, capacity)
        used = {}
        for pattern, n in packed:
            assert sum(s * k for s, k in pattern) <= capacity
            for s, k in pattern:
                used[s] = used.get(s, 0) + k * n
        assert used == counts


def test_packing_whole_documents(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["word"] * rng.randint(1, 90)), "x") for i in range(300)] + [(900, "word " * 1000, "x"), (901, None, "x"), (902, "", "x"), (None, "a b", "x"), (1, "word", "x")]
    rows += [(2000 + i, "same size here", "x") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin_no string")
    kinds = spark.createDataFrame([(1, 64), (2, 256), (3, None), (4, 0)], "container_id int, capacity_tokens long")
    got = packing.packed(docs, kinds).collect()
    for cid, capacity in ((1, 64), (2, 256)):
        mine = [r for r in got if r.container_id == cid]
        held, whole = {}, {}
        for r in mine:
            held[r.bin_no] = held.get(r.bin_no, 0) + r.n_tokens
            whole.setdefault(r.doc_id, []).append((r.token_start, r.n_tokens))
        assert max(held.values()) <= capacity and len(whole) == 1001
        assert all(len(v) == 1 or sum(n for _, n in v) > capacity for v in whole.values())
        assert sum(held.values()) / (len(held) * capacity) > 0.97
        assert sorted(held) == list(range(len(held)))
    assert {r.container_id for r in got} == {1, 2}
    assert packing.packed(docs.where("false"), kinds).count() == 0


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(6)
    tokens = rng.integers(1, 500, 400).astype(float)
    p = np.full(400, 0.37)
    seen = np.zeros(400)
    for i in range(300):
        q = mixing.flight(p, tokens, np.random.default_rng(i))
        assert ((q > 0) & (q < 1)).sum() <= 2
        assert abs(q @ tokens - p @ tokens) < 1e-3 and abs(q.sum() - p.sum()) < 1e-6
        seen += q
    assert abs(seen / 300 - 0.37).max() < 0.15


def test_mixing_reaches_the_shares(spark):
    rng = random.Random(7)
    rows = [(i, "word " * rng.randint(5, 80), rng.choice(["a", " A ", "b", "c", None])) for i in range(900)] + [(5000, None, "a"), (5001, "", "a"), (None, "x", "a"), (3, "word", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    goal = spark.createDataFrame([("a", 0.5, 2), ("B", 0.3, 3), ("c", 0.15, 1), ("none", 0.05, 1), (None, 0.1, 1), ("d", None, 1)], "mix_source string, target_weight double, max_repeats int")
    chosen = mixing.mixed(docs, goal)
    shares = {r.mix_source: r for r in mixing.mix_report(chosen, goal).collect()}
    assert all(abs(shares[s].share - w / 0.95) < 0.002 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.15)))
    assert all(r.most_uses <= r.max_repeats for r in shares.values()) and shares["none"].tokens == 0
    assert chosen.groupBy("doc_id").count().where("count > 1").count() == 0
    assert mixing.mixed(docs.where("false"), goal).count() == 0
    assert mixing.mix_report(mixing.mixed(docs.where("false"), goal), goal).count() == 4


def site(body, title="Title"):
    return f'<html><head><title>{title}</title></head><body><div id="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">Blog</a></li></ul></div><div id="content">{body}</div><div id="bottom"><p>© {{{{ year }}}} Site</p></div></body></html>'


def test_containers_and_slots():
    found = pages.containers(site("<h1>T</h1><p>One &amp; two<br>three</p><pre>a\n b</pre><ul><li>x <a href='/'>y z</a></li><li>y</li></ul><div class='note'>N</div><table><tr><td>1</td><td>2</td></table>"))
    main = [c for c in found if c.slot.startswith('/div id="content"')]
    blocks = [b for c in main for b in c.blocks]
    assert [b.kind for b in blocks] == ["heading", "paragraph", "code", "list", "note", "table"]
    assert blocks[1].text == "One & two three" and blocks[3].text == "x y z\ny" and blocks[3].loose == 2 and blocks[5].text == "1\t2"
    assert main[0].inside == main[2].inside and main[1].inside[:-1] == main[0].inside and main[1].slot == main[0].slot + '/div class="note"'
    assert pages.containers("") == [] and pages.title_of("<title>A &amp; b</title>") == "A & b"


PAGE = "page_id long, source_id string, raw_body binary, state string, status int, kind string, shards int, h long"


def residue_rows():
    ok = "<h1>Cache</h1><p>The cache {n} keeps entries until the lease ends and then drops all of them at once.</p>"
    name = lambda i: "".join("kbdfgjlmnp"[int(d)] + "aeiou"[int(d) % 5] for d in str(1000 + i))
    lorem = "Lorem ipsum dolor sit amet.", "TODO: write this section.", "Coming soon.", "Text to follow."
    marks = "{{ user.name }}", "%%SITE_NAME%%", "[[INSERT TEXT]]"
    rows = [(i, f"s{i % 7}", site(ok.replace("{n}", name(i)) + f"<p>Another sentence about item {name(5000 + i)} and its many parts.</p>").encode(), "Fetched", 200, "", 1, 1) for i in range(120)]
    rows += [(200 + i, f"s{i % 7}", site(ok.replace("{n}", name(i)) + f"<p>{lorem[i % 4]}</p>").encode(), "Fetched", 200, "", 1, 1) for i in range(40)]
    rows += [(300 + i, f"s{i % 7}", site(f"<h1>T{name(i)}</h1><p>Welcome to {marks[i % 3]}.</p>").encode(), "Fetched", 200, "", 1, 1) for i in range(30)]
    rows += [(400 + i, f"s{i % 7}", site(ok.replace("{n}", name(i)) + f"<p>The mark {marks[i % 3]} is replaced by the engine {name(i)}.</p>").encode(), "Fetched", 200, "", 1, 1) for i in range(40)]
    rows += [(1000 + i, f"s{i % 7}", site("<h2>404 - Page not found</h2><p>The page you asked for does not exist or has been moved.</p>").encode(), "HttpFailure", 404, "", 1, 1) for i in range(30)]
    rows += [(1100 + i, f"s{i % 7}", site('<div id="app"></div><noscript>Please enable JavaScript to view this page.</noscript>').encode(), "Fetched", 200, "", 1, 1) for i in range(12)]
    cases = {
        500: site("<h1>[[INSERT TEXT]]</h1><p>Welcome to {{ user.name }}.</p>"),
        501: site(ok.replace("{n}", name(901)) + "<p>Lorem ipsum dolor sit amet.</p>"),
        502: site("<h2>Oops</h2><p>The page you asked for does not exist or has been moved.</p>"),
        503: site('<div id="app"></div><noscript>Please enable JavaScript to view this page.</noscript>'),
    }
    others = {
        600: site(ok.replace("{n}", name(902)) + "<p>The mark {{ user.name }} is replaced by the engine.</p>"),
        601: site(ok.replace("{n}", name(903)) + "<pre>{{ user.name }} {% if %}</pre>"),
        602: site(ok.replace("{n}", name(903)) + "<noscript>Please enable JavaScript to view this page.</noscript>"),
        603: site(""),
        604: "",
    }
    rows += [(k, "s1", v.encode(), "Fetched", 200, "", 1, 1) for k, v in (cases | others).items()]
    rows += [(700, None, None, "Fetched", 200, "", 1, 1), (701, "s", cases[500].encode(), "Blocked", 403, "", 1, 1), (None, "s", cases[500].encode(), "Fetched", 200, "", 1, 1), rows[-9]]
    return rows, set(cases) | set(range(200, 240)) | set(range(300, 330)) | set(range(1100, 1112))


def residue_frame(spark, rows):
    df = spark.createDataFrame(rows, PAGE)
    return df.withColumn("final_url", F.concat(F.lit("u"), "page_id")).withColumn("rendering", F.struct(F.lit("rendered").alias("outcome"), F.lit(1).alias("fresh")))


#: A small host's template is on few pages.
SMALL = residue.Fit(furniture=main_body.Furniture(min_pages=20, all_pages=120, all_share=0.5, host_share=0.5))


def test_residue_kinds(spark):
    rows, cases = residue_rows()
    got = {r.page_id for r in residue.residue_pages(residue_frame(spark, rows), SMALL).collect()}
    assert got == cases
    assert residue.residue_pages(residue_frame(spark, []), SMALL).count() == 0


def test_the_classifier_decides(spark):
    rows, _ = residue_rows()
    bodies = residue.read_bodies(residue_frame(spark, rows), SMALL)
    model = residue.trained(bodies, SMALL)
    assert model.validated > 20 and model.held_out > 0.95
    found = [(r.words, r.hidden, r.said, r.rest, r.sides) for r in bodies.collect()]
    none = residue.Linear(np.zeros_like(model.weights), np.zeros_like(model.side), np.full(2, -0.1, np.float32))
    assert any(residue.judged(found, model)) and not any(residue.judged(found, none))


def test_filler_without_a_phrase_is_labelled_by_its_words_and_found():
    latin = "velora quandor sepina tremor cundor mentum simet noctes arvana gravor".split()
    plain = "the cache keeps every entry until its lease ends and then drops them all".split()
    rng = np.random.default_rng(5)
    filler = ["Lorem ipsum " + " ".join(rng.choice(latin, 12)) for _ in range(40)] + [" ".join(rng.choice(latin, 12)) for _ in range(20)]
    proper = [" ".join(rng.choice(plain, 12)) for _ in range(200)]
    texts = filler + proper
    labels = residue.spoken_for(texts, np.array([residue.weak_label(t) for t in texts]))
    assert (labels[:60] == residue.RESIDUE).all() and not labels[60:].any()
    side = residue.side_features("x" * 70, False, frozenset(), False, 40, 0)
    model = residue.fit(texts, residue._sides([side] * 260), labels, np.arange(260))
    fresh, other = " ".join(rng.permutation(latin)), " ".join(rng.permutation(plain))
    assert residue.judged([(30, "", [other, fresh], [10, 10], [side, side]), (30, "", [other], [10], [side])], model) == ["residue", None]


def test_a_mark_in_a_long_sentence_fills_a_piece():
    _, starts, ends = residue._hashed(["short", "y" * 200])
    text, first, last = residue.pieces(starts, ends)
    assert list(text) == [0] + [1] * 6 and last[-1] == ends[1] and (last - first <= residue.PIECE).all()
    assert residue.marked("Für {{ a.b }} x") == (5, 14)


SECTION = "page_id long, source_id string, document_url string, section_id int, blocks array<struct<kind:string,text:string,links:int,extra:int>>, shard int, marks int"


def main_tables(spark):
    words = "alpha bravo carol delta echo forum gamma hotel india juliet kappa lemon".split()
    pages_, sections = [], []
    for i in range(60):
        own = " ".join(words[(i * k + k) % 12] + "abcdefghijklmnopqrst"[(i + k) % 20] for k in range(1, 15))
        body = f'<h1>T{i}</h1><p>{own}</p><p>Was this page of any help to you?</p><div class="promo">Buy now {i}</div><ul><li><a href="/n">Next: page {i + 1}</a></li></ul>'
        side = f'<div id="side"><h3>Related</h3><ul><li><a href="/r">Read {own[:9]} as well</a></li></ul></div>'
        pages_.append((i, "s" if i % 2 else None, site(body, f"T{i}").replace('<div id="bottom">', side + '<div id="bottom">').encode(), "Fetched", 200, "", 1, 1))
        flat = [("list", "Home\nBlog", 2)], [("paragraph", own, 0), ("paragraph", "Was this page of any help to you?", 0), ("paragraph", f"Buy now {i}", 0), ("list", f"Next: page {i + 1}", 1)], [("list", f"Read {own[:9]} as well", 1), ("paragraph", "© {{ year }} Site", 0)]
        sections += [(i, "s" if i % 2 else None, f"u{i}", n, [(*b, 0) for b in bs], 0, 0) for n, bs in enumerate(flat)]
    sections += [(900, "z", "u900", 0, [("paragraph", "before", 0, 0)], 0, 0), (900, "z", "u900", 1, [("paragraph", "article text", 0, 0), ("paragraph", None, None, 0)], 0, 0), (901, "z", None, 1, None, 0, 0), sections[1]]
    p = spark.createDataFrame(pages_, PAGE).withColumn("final_url", F.concat(F.lit("u"), "page_id"))
    return p, spark.createDataFrame(sections, SECTION)


def test_main_blocks(spark):
    p, sections = main_tables(spark)
    wanted = {(i, 1, 0) for i in range(60)} | {(900, 1, 0)}
    assert {tuple(r) for r in main_body.main_blocks(p, sections).collect()} == wanted
    # Cut into shards, the same strings are found, for their counts are summed.
    assert {tuple(r) for r in main_body.main_blocks(p, sections, main_body.Furniture(shard_pages=8)).collect()} == wanted
    none = spark.createDataFrame([], PAGE).withColumn("final_url", F.lit("u"))
    assert main_body.main_blocks(none, spark.createDataFrame([], SECTION)).count() == 0


def test_without_repeats_the_furniture_stays(spark):
    """What the suffix array counts decides: nothing else knows the prompt and the promotion."""
    p, sections = main_tables(spark)
    off = main_body.Furniture(min_pages=10**9, all_pages=10**9)
    got = {tuple(r) for r in main_body.main_blocks(p, sections, off).collect()}
    assert {(i, 1, b) for i in range(60) for b in (0, 1, 2)} <= got


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(8)
    for n, kinds in ((0, 2), (1, 1), (60, 1), (300, 2), (400, 5)):
        t = rng.integers(0, kinds, n)
        sa, lcp = suffix_array.suffix_array(t)
        said = [tuple(t[i:]) for i in sa]
        assert said == sorted(said)
        for a, b, k in zip(said, said[1:], lcp[1:]):
            assert a[:k] == b[:k] and (len(a) == k or a[k] != b[k])


def test_repeats_against_brute_force():
    rng = np.random.default_rng(9)
    t, owner = rng.integers(0, 2, 240), np.repeat(np.arange(12), 20)
    t[19::20] = 100 + np.arange(12)
    sa, lcp = suffix_array.suffix_array(t)
    got = suffix_array.covered(sa, lcp, owner, 5, 3)
    want = np.zeros(240, bool)
    grams = [tuple(t[i : i + 5]) for i in range(236)]
    for i, g in enumerate(grams):
        if len({owner[j] for j, h in enumerate(grams) if h == g}) >= 3:
            want[i : i + 5] = True
    assert (got == want).all() and want.any() and not want.all()
    t = np.array([7, 8, 1, 7, 8, 1, 7, 9, 1, 7, 8, 1])
    sa, lcp = suffix_array.suffix_array(t)
    assert list(suffix_array.whole_supports(sa, lcp, np.array([0, 3, 6, 9]), np.full(4, 3), np.array([0, 0, 1, 2]))) == [2, 2, 1, 2]


def test_the_core_does_not_need_this_package():
    import pathlib
    import re

    root = pathlib.Path(main_body.__file__).parent.parent
    for f in root.rglob("*.py"):
        if f.parent.name != "llm":
            assert not re.search(r"folioscope\.llm|from \.+llm", f.read_text()), f
