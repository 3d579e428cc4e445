"""Repeated lines, near-duplicates and wrong encodings against brute force, and their edge cases."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import near_duplicates as nd
from folioscope.llm import repeated_lines as rl
from folioscope.llm import wrong_encoding as we

CHUNK = "chunk_id string, source_id string, document_url string, title string, text string, crawled_at timestamp, h1 int, cid string, line string, n_docs int"
T0 = datetime(2025, 1, 1)


def chunk(i, text, source="s", url=None, title="T", at=T0):
    return (i, source, url or f"u{i}", title, text, at, 1, "x", "y", 2)


def frame(spark, rows, schema=CHUNK):
    return spark.createDataFrame(rows, schema)


def test_repeated_lines_and_rebuilt_text(spark):
    rows = [chunk(f"c{i}", f"Own words number {'abcdefgh'[i]} here\nAll rights reserved by us {i}\n\nshort one", url=f"u{i}") for i in range(6)]
    rows += [chunk("c0", rows[0][4], url="u0"), chunk("n1", None), chunk("n2", ""), chunk("n3", "Doc Title says three words", title="doc title"), chunk(None, "All rights reserved by us")]
    rows += [chunk("other", "all RIGHTS reserved, by us!", source=None, url=None)]
    found = {(r.chunk_id, r.line_no) for r in rl.repeated_lines(frame(spark, rows)).collect()}
    assert found == {(f"c{i}", 1) for i in range(6)} | {(None, 0)}
    clean = {r.chunk_id: r for r in rl.without_repeated_lines(frame(spark, rows)).collect()}
    assert clean["c1"].text == "Own words number b here\n\nshort one" and clean["c1"].lines_removed == 1
    assert clean["n1"].text is None and clean["n2"].text == "" and clean["other"].lines_removed == 0
    assert rl.repeated_lines(frame(spark, [])).count() == 0


def test_a_line_needs_a_share_of_a_large_source(spark):
    rows = [chunk(f"c{i}", "see the big notice" if i < 3 else f"text {chr(97 + i % 26) * 5} {chr(97 + i // 26) * 4} end") for i in range(101)]
    assert rl.repeated_lines(frame(spark, rows)).count() == 0
    assert rl.repeated_lines(frame(spark, rows[:100])).count() == 3


def test_lines_of_a_third_of_all_rows_by_shuffle(spark, monkeypatch):
    rows = [chunk(f"c{i}", f"Own words {chr(97 + i % 26) * 4} {chr(97 + i // 26) * 4} here\nThe same notice on every page", source=f"s{i % 3}", url=f"u{i}") for i in range(90)]
    small = {tuple(r) for r in rl.repeated_lines(frame(spark, rows)).collect()}
    monkeypatch.setattr(rl, "small_or_shuffled", lambda df: df.hint("merge"))
    assert {tuple(r) for r in rl.repeated_lines(frame(spark, rows)).collect()} == small == {(f"c{i}", 1) for i in range(90)}


def brute_pairs(texts, n, threshold, least):
    import re

    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\W_]+", t.lower())
        if len(w) >= least:
            sets[k] = set(zip(*(w[i:] for i in range(n))))
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def families(rng, n, size, words=120):
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {}
    for f in range(n):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for v in range(size):
            w = list(base)
            for _ in range(v * 3):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts[f"{f:03d}-{v}"] = " ".join(w)
    return texts


def test_pairs_equal_brute_force(spark):
    texts = families(random.Random(1), 30, 4)
    texts["copy-1"] = texts["000-0"]
    texts["copy-2"] = texts["000-0"]
    rows = [chunk(k, t) for k, t in texts.items()] + [chunk("000-1", texts["000-1"]), chunk("none", None), chunk("short", "a b c"), chunk(None, texts["000-0"])]
    got = {(r.chunk_a, r.chunk_b) for r in nd.near_duplicate_pairs(frame(spark, rows)).collect()}
    assert got == brute_pairs(texts, 3, 0.5, 40)
    groups = {r.chunk_id: r for r in nd.near_duplicate_groups(frame(spark, rows)).collect()}
    assert groups["copy-1"].group_id == groups["000-0"].group_id == groups["000-3"].group_id != groups["001-0"].group_id
    assert "none" not in groups and "short" not in groups


def test_shingle_sets_are_never_shuffled_to_meet_links(spark):
    texts = families(random.Random(3), 20, 3)
    rows = frame(spark, [chunk(k, t) for k, t in texts.items()])
    members, classes = nd.text_classes(rows, nd.CHUNK_COPIES)
    key = {r.cid: r.key for r in members.collect()}
    links = classes.select(F.col("cid").alias("a")).join(classes.select(F.col("cid").alias("b")), F.expr("a < b"))
    links = nd.stage(links, "links").hint("merge")
    ends = links.select(F.col("a").alias("cid")).hint("merge")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (nd.verified(links, classes, 0.5), classes.join(ends, "cid", "left_semi"))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The links, and these with the sets of one end; the ends alone.
    assert [p.count("Exchange hashpartitioning") for p in plans] == [2, 1]
    got = {tuple(sorted((key[r.a], key[r.b]))) for r in nd.verified(links, classes, 0.5).collect()}
    assert got == brute_pairs(texts, 3, 0.5, 40)
    assert classes.count() == len(texts) and not [t for t in spark.catalog.listTables() if t.name.startswith("stage_")]


def test_hot_buckets_in_two_levels_give_the_same_groups(spark):
    rng = random.Random(2)
    texts = families(rng, 1, 1)
    base = texts["000-0"].split()
    for i in range(60):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        texts[f"hot-{i:02d}"] = " ".join(w)
    rows = [chunk(k, t) for k, t in texts.items()]
    plain = nd.near_duplicate_groups(frame(spark, rows))
    from dataclasses import replace

    salted = nd.near_duplicate_groups(frame(spark, rows), replace(nd.CHUNK_COPIES, hot_rows=1, hot_sample=1, hot_share=0.01, salts=4))
    assert plain.select("group_id").distinct().count() == salted.select("group_id").distinct().count() == 1
    assert nd.near_duplicate_pairs(frame(spark, [])).count() == 0


def test_pairs_in_a_third_of_all_rows_that_share_a_boilerplate(spark):
    rng = random.Random(7)
    shared = [f"b{i}" for i in range(130)]
    texts = {}
    for i in range(0, 400, 2):
        part = [f"p{i}x{k}" for k in range(16)]
        for j in (i, i + 1):
            texts[f"g{j:03d}"] = " ".join(shared + part + [f"o{j}x{k}" for k in range(54)])
    texts |= {f"f{i:03d}": " ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for i in range(800)}
    wanted = brute_pairs(texts, 3, 0.5, 40)
    assert wanted == {(f"g{i:03d}", f"g{i + 1:03d}") for i in range(0, 400, 2)}
    rows = frame(spark, [chunk(k, t) for k, t in texts.items()])
    got = {(r.chunk_a, r.chunk_b) for r in nd.near_duplicate_pairs(rows).collect()}
    assert got <= wanted and len(got) >= 0.99 * len(wanted)
    from dataclasses import replace

    salted = replace(nd.CHUNK_COPIES, hot_rows=1, hot_sample=1, hot_share=0.1, salts=4)
    assert {(r.chunk_a, r.chunk_b) for r in nd.near_duplicate_pairs(rows, salted).collect()} == wanted
    assert nd.near_duplicate_groups(rows).where("n_links = 1").count() >= 0.99 * 400


def test_rarest_shingles_miss_no_pair(spark):
    rng = random.Random(8)
    texts = {}
    for i in range(120):
        common = [f"b{k}" for k in range(rng.randrange(20, 90))]
        texts[f"t{i:03d}"] = " ".join(common + [f"r{rng.randrange(60)}" for _ in range(rng.randrange(20, 60))])
    _, classes = nd.text_classes(frame(spark, [chunk(k, t) for k, t in texts.items()]), nd.CHUNK_COPIES)
    sets = {r.cid: set(r.grams) for r in classes.collect()}
    keys = sorted(sets)
    near = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert len(near) > 100 and near <= {(r.a, r.b) for r in nd.prefix_links(classes, nd.CHUNK_COPIES).collect()}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**31, 400)
    b = np.concatenate([a[:300], rng.integers(0, 2**31, 100)])
    sig = nd.signatures(np.concatenate([a, b]), np.array([0, 400, 800]), 512)
    assert abs((sig[0] == sig[1]).mean() - 300 / 500) < 0.08
    few = nd.signatures(np.array([5, 9, 5, 9]), np.array([0, 2, 4]), 64)
    assert (few[0] == few[1]).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in nd.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


@pytest.mark.parametrize("chain", we.CHAINS, ids=lambda c: "+".join(f"{a}-{b}" for a, b in c))
def test_every_chain_is_inverted(chain):
    samples = ["Für größere Übung", "où l’été élève ça", "Książka żółć", "Привет, мир ещё", "ação — não “sim”"]
    done = 0
    for s in samples:
        g = we.garble(s, chain)
        if g is not None and g != s:
            assert we.ungarble(g, chain) == s
            done += 1
    assert done


def corpus(rng, n=600):
    de = "für über größe prüfung schlüssel übertragung öffnen gültige rückgabe verfügbar".split()
    fr = "été règle clé générée dépassé vérifie préalable côté à où".split()
    ru = "очередь задач запись поиск граница пакета строка данных после сбоя".split()
    en = "the queue isn’t full – see “notes” about naïve cafés and it’s state".split()
    return [" ".join(rng.choice(v) for _ in range(12)) for v in (de, fr, ru, en) for _ in range(n // 4)]


def test_held_out_accuracy_and_restoration():
    rng = random.Random(4)
    model = we.train(corpus(rng))
    fresh = corpus(rng, 200)
    assert sum(x is not None for x in we.judge(fresh, model)) <= 2
    right = total = 0
    for chain in we.CHAINS[:13]:
        made = [(x, we.garble(x, chain)) for x in fresh]
        made = [(x, g) for x, g in made if g is not None and g != x]
        for (x, _), v in zip(made, we.judge([g for _, g in made], model)):
            total += 1
            right += v is not None and v[1] == x
    assert right / total > 0.97


def test_quotations_are_no_cases():
    model = we.train(corpus(random.Random(5)))
    quoted = ["Older exports show Ã© for é; the index copies them.", "The pair â€™ in a log is a sign that X compares an apostrophe twice.", "The replacement character � marks bytes that were lost."]
    assert we.judge(quoted, model) == [None] * 3
    wrong = ["Older exports show ÃƒÂ© for Ã©; the index copies them.", "The lease isn�t permanent: it ends.", "die Pr&#195;&#188;fung f&#195;&#188;r alle"]
    assert all(v is not None for v in we.judge(wrong, model))


def test_documents_with_nulls_and_extra_columns(spark):
    texts = corpus(random.Random(6), 200)
    rows = [(i, t + "\nplain", "a", "b") for i, t in enumerate(texts)]
    rows += [(1000, we.garble(texts[0], we.CHAINS[0]) + "\n" + texts[1], "a", "b"), (1001, None, None, None), (1002, "", None, None), (None, "Ã¼Ã¼ Ã¼ber", None, None)]
    docs = spark.createDataFrame(rows + rows[-4:-3], "doc_id long, text string, line string, chain string")
    assert [r.doc_id for r in we.garbled_documents(docs).collect()] == [1000]
    back = we.restored_documents(docs).collect()
    assert len(back) == 1 and back[0].text == texts[0] + "\n" + texts[1] and back[0].lines_restored == 1
    assert we.garbled_documents(docs.where(F.lit(False))).count() == 0
