"""Retrieval quality, embeddings, recrawls, reads and runs through the engine."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioscope.engine import Engine
from folioscope.operators import fusion, history, vectors
from folioscope.operators.lexical import Filter
from folioscope.plans.deadline import TimedOut, collected
from folioscope.plans.validate import Invalid
from folioscope.streaming.jobs import JobManager

SCHEMA = (
    "page_id bigint, source_id string, crawl_id string, requested_url string, final_url string, fetched_at timestamp, status int, "
    "headers array<struct<name string, value binary>>, raw_body binary, content_truncated boolean, state string, state_message string"
)


def page(i, source, path, body, crawl="c1", status=200, state="Fetched", headers=(), requested=None):
    url = f"https://x.test/{source}/{path}"
    return (i, source, crawl, requested or url, url, datetime(2025, 1, 1), status, list(headers), body.encode() if body is not None else None, False, state, None)


def doc(title, body, anchor=""):
    return f"<title>{title}</title><main><h1{f' id={anchor}' if anchor else ''}>{title}</h1>{body}</main>"


def keyed(rules, default):
    """A provider that gives the vector of the first word of rules that a text holds."""

    def provider(texts):
        return [next((list(v) for w, v in rules if w in t), list(default)) for t in texts]

    return provider


@pytest.fixture(scope="module")
def net(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("net") / "lake"))
    pages = [
        page(1, "net", "proxy", doc("Proxy setup", "<p><code>Proxy::custom</code> sets up relays of any kind.</p>", "custom")),
        page(2, "net", "paths/a", doc("Path selection", "<p>Path selection ties the sockets of a client.</p>")),
        page(3, "net", "paths/b", doc("Remote dispatch", "<p>Remote dispatch sends calls outward along a line of choice.</p>")),
        page(4, "net", "other/noise", doc("Jars", "<p>Jars hold what a session has to remember.</p>")),
        page(5, "db", "indexes", doc("Schema", "<p>MAKE INDEX builds the index of a table.</p>")),
    ]
    e.ingest(spark.createDataFrame(pages, SCHEMA))
    space = e.embedding_space("test", "rules", "1", 3)
    rules = [("Proxy::custom", (0.0, 0.0, 1.0)), ("Path selection", (0.0, 1.0, 0.0)), ("Remote dispatch", (1.0, 0.0, 0.0)), ("MAKE INDEX", (0.0, 0.0, 1.0))]
    report = e.index_embeddings(keyed(rules, (0.7, 0.7, 0.0)), space)
    assert report == {"scanned": 5, "reused": 0, "generated": 5, "failed": 0, "superseded": 0}
    return e, space


def test_recall_at_two_of_four_modes(net):
    e, space = net
    cases = [
        ("Proxy::custom", (0.7, 0.7, 0.0), "net", {"proxy"}), ("send traffic through something between", (0.0, 0.0, 1.0), "net", {"proxy"}),
        ("path selection", (1.0, 0.0, 0.0), "net", {"paths/a", "paths/b"}), ("MAKE INDEX", (0.7, 0.7, 0.0), "db", {"indexes"}),
    ]
    totals = [0.0] * 4
    for text, vector, source, relevant in cases:
        where = Filter(source_id=source)
        lists = [
            e.search(text, 2, where=where), e.vector_search(list(vector), space, 2, where), e.hybrid_search(text, list(vector), space, 2, where),
            e.graph_search(text, 2, vector=list(vector), space_id=space, where=where)[0],
        ]
        for i, hits in enumerate(lists):
            found = {r.document_url.split(f"/{source}/")[1] for r in hits.collect()}
            totals[i] += len(found & relevant) / len(relevant)
    assert [t / 4 for t in totals] == [0.625, 0.625, 1.0, 1.0]


def test_evidence_and_rankers(spark, net):
    e, space = net
    top = e.hybrid_search("Proxy::custom", [0.7, 0.7, 0.0], space, 2, Filter(source_id="net")).first()
    assert top.lexical_rank == 1 and top.vector_rank > 1 and top.lexical_score is not None and top.vector_score is not None
    hit = "chunk_id string, source_id string, document_url string, sequence long, content_sha256 string, score double, rank int"
    a = spark.createDataFrame([("x", "s", "u", 0, "h", 2.0, 1), ("y", "s", "u", 1, "h", 1.0, 2)], hit)
    b = spark.createDataFrame([("y", "s", "u", 1, "h", 0.9, 1), ("x", "s", "u", 0, "h", 0.1, 2)], hit)
    got = fusion.with_evidence(8, a=a, b=b).collect()
    assert [r.chunk_id for r in got] == ["x", "y"] and all(abs(r.score - (1 / 61 + 1 / 62)) < 1e-12 for r in got)
    for bad in (
        lambda c: c.select(F.concat("chunk_id", F.lit("?")).alias("chunk_id"), F.lit(1.0).alias("fused")),
        lambda c: c.select("chunk_id", F.lit(1.0).alias("fused")).unionByName(c.select("chunk_id", F.lit(1.0).alias("fused"))),
        lambda c: c.select("chunk_id", F.lit(float("nan")).alias("fused")),
    ):
        with pytest.raises(Exception, match="unknown or repeated|not finite"):
            fusion.with_evidence(8, bad, a=a, b=b).collect()
    with pytest.raises(Exception, match="changed during"):
        fusion.with_evidence(8, a=a, b=b.withColumn("content_sha256", F.lit("other"))).collect()


def test_relations_raise_recall_at_two(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "lake"))
    noise = doc("Noise", "<p>Noise about settings that have nothing to do with it.</p>")
    sets = {
        "links": [("start", doc("Entry", "<p>EntrySign sets what goes out.</p><a href='target#deep%20part'>the part</a><a href='gone'>gone</a><a href='https://else.test/x'>else</a>")),
                  ("target", doc("Opening", "<p>Nothing of note.</p><h2 id='deep part'>Essentials</h2><p>Use these TLS settings and limits.</p>", "intro"))],
        "names": [("start", doc("Ways", "<p>NamesSign uses <code>Client::route</code>. Prose::only is no name.</p>")),
                  ("target", doc("Limits", "<p>Set the limits.</p><pre><code>Client::route();</code></pre>", "details"))],
        "back": [("target", doc("Goal", "<p>GoalSign is where it ends.</p>")), ("start", doc("Guide", "<p>What to do before.</p><a href='target'>the goal</a>"))],
    }
    rows = [page(100 * i + j, s, p, b) for i, (s, ps) in enumerate(sets.items()) for j, (p, b) in enumerate([*ps, *((f"n{k}", noise) for k in range(3))])]
    e.ingest(spark.createDataFrame(rows, SCHEMA))
    assert {r.symbol for r in e.table("mentions").collect()} == {"Client::route"}
    space = e.embedding_space("test", "signs", "1", 3)
    e.index_embeddings(keyed([("Sign", (1.0, 0.0, 0.0)), ("Noise", (0.9, 0.1, 0.0))], (0.0, 0.0, 1.0)), space)
    totals = [0.0] * 4
    for source, text, relation in (("links", "EntrySign", "outgoing_link"), ("names", "NamesSign", "shared_entity"), ("back", "GoalSign", "incoming_link")):
        where = Filter(source_id=source)
        q = [1.0, 0.0, 0.0]
        hits, report = e.graph_search(text, 2, seeds=1, vector=q, space_id=space, where=where)
        hits = hits.collect()
        told = report.first()
        assert told.seeds == 1 and told.candidates > 0 and not told.skipped_stale_seeds
        near = next(r for r in hits if r.paths)
        assert near.paths[0].relation == relation and near.graph_rank == 1
        if source == "links":
            assert e.table("chunk").where(F.col("chunk_id") == near.chunk_id).first().anchor == "deep part"
        lists = [e.search(text, 2, where=where).collect(), e.vector_search(q, space, 2, where).collect(), e.hybrid_search(text, q, space, 2, where).collect(), hits]
        for i, found in enumerate(lists):
            totals[i] += len({r.document_url.split("/")[-1] for r in found} & {"start", "target"}) / 2
    assert [t / 3 for t in totals] == [0.5, 0.5, 0.5, 1.0]
    # Without anything to reach, keywords keep their own order and scores.
    alone, told = e.graph_search("noise", 2, where=Filter(source_id="links"))
    plain = e.search("noise", 2, where=Filter(source_id="links")).orderBy(F.desc("score"), "document_url").collect()
    assert told.first().candidates == 0 and [(r.chunk_id, r.score) for r in alone.collect()] == [(r.chunk_id, r.score) for r in plain]
    cover = e.graph_coverage().first()
    assert cover.documents == cover.indexed == 15 and cover.truncated == 0


def test_embeddings_of_changed_chunks_are_not_found(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "lake"))
    e.ingest(spark.createDataFrame([page(1, "s", "a", doc("A", "<p>First words of a.</p>")), page(2, "s", "b", doc("B", "<p>bad words of b.</p>"))], SCHEMA))
    space = e.embedding_space("test", "m", "1", 2)
    assert e.embedding_space("test", "m", "1", 2) == space and e.table("embedding_space").count() == 1

    def provider(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no service")
        return [[1.0, 0.0] for _ in texts]

    assert e.index_embeddings(provider, space) | {} == {"scanned": 2, "reused": 0, "generated": 1, "failed": 1, "superseded": 0}
    assert e.index_embeddings(lambda ts: [[0.0, 1.0, 2.0] for _ in ts], space)["failed"] == 1
    again = e.index_embeddings(lambda ts: [[0.0, 1.0] for _ in ts], space)
    assert again["reused"] == 1 and again["generated"] == 1
    assert e.vector_search([1.0, 0.0], space, 5).count() == 2
    e.ingest(spark.createDataFrame([page(1, "s", "a", doc("A", "<p>Other words of a.</p>"), "c2")], SCHEMA))
    assert {r.document_url[-1] for r in e.vector_search([1.0, 0.0], space, 5).collect()} == {"b"}
    with pytest.raises(Invalid):
        e.vector_search([1.0], space)
    with pytest.raises(Invalid):
        e.vector_search([1.0, 0.0], "unknown")
    # A state that was made for content that has changed is stale, and a ready vector stays as it is.
    state = e.table("embedding").where("status = 'ready'").drop("updated_at")
    assert vectors.completed(state, e.table("chunk"), e.table("embedding")).count() == 0


def test_recrawl_reuses_what_has_not_changed(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "lake"))
    a, b = doc("A", "<p>All about a, at length.</p>"), doc("B", "<p>All about b, at length.</p>")
    tag = [("ETag", b'"one"'), ("Last-Modified", b"Wed, 21 Oct 2015 07:28:00 GMT")]
    e.ingest(spark.createDataFrame([page(1, "s", "a", a, headers=tag), page(2, "s", "b", b, headers=[("ETag", b'"two"'), ("Vary", b"Cookie")])], SCHEMA))
    ask = {r.url[-1]: [h.name for h in r.ask_with] for r in e.known_pages("s", "https://x.test/s/").collect()}
    assert ask == {"a": ["If-None-Match", "If-Modified-Since"], "b": []}
    same = spark.createDataFrame([page(3, "s", "a", None, "c2", 304, "NotModified", [("ETag", b'"new"')])], SCHEMA)
    assert [r.change_kind for r in e.ingest(same).collect()] == ["not_modified"]
    ids = {r.chunk_id for r in e.table("chunk").collect()}
    # With other rules the stored bytes are used, though the page has not changed.
    assert [r.change_kind for r in e.ingest(same, 40).collect()] == ["reprocessed"]
    assert {r.chunk_id for r in e.table("chunk").collect()} != ids
    kinds = {r.change_kind for r in e.reprocess("s", "https://x.test/s/").collect()}
    assert kinds == {"reprocessed"} and {r.chunk_id for r in e.table("chunk").collect()} == ids
    with pytest.raises(Invalid, match="different contents"):
        e.ingest(spark.createDataFrame([page(4, "s", "a", a), page(5, "s", "a", b, requested="https://x.test/s/alias")], SCHEMA))
    gap = history.unvisited_known(e.table("document"), same)
    assert [r.document_url[-1] for r in gap.collect()] == ["b"]


def test_a_page_writes_its_own_buckets_only(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "lake"))
    e.ingest(spark.createDataFrame([page(i, "s", f"p{i}", doc(f"P{i}", f"<p>Words of page {i}.</p>")) for i in range(30)], SCHEMA))
    before = e.lake.manifest()["tables"]["chunk"]
    e.ingest(spark.createDataFrame([page(50, "s", "p3", doc("P3", "<p>Quite other words.</p>"), "c2")], SCHEMA))
    after = e.lake.manifest()["tables"]["chunk"]
    assert sum(before[b] != after.get(b) for b in before) == 1 and e.table("chunk").count() == 30
    assert len(e.lake.read("chunk", source_id="s", key="https://x.test/s/p3").inputFiles()) == 1
    got = e.document("s", "https://x.test/s/p3").first()
    assert got.title == "P3" and len(got.sections) == 2
    rows = e.chunks("s", "https://x.test/s/p3", max_chars=5).collect()
    assert rows[0].text == "Quite" and rows[0].text_truncated and not rows[0].more
    old = e.table("document_revision").where("document_url like '%/p3' and sequence = 1").first().revision_id
    assert "Words of page 3" in e.revision(old).first().text
    assert {r.chunks for r in e.document_status().collect()} == {1}


def test_context_skips_stale_hits_and_tells(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "lake"))
    body = doc("T", "<p>one two three</p><h2>Second</h2><p>four five six</p><h2>Third</h2><p>seven eight nine</p>")
    e.ingest(spark.createDataFrame([page(1, "s", "a", body)], SCHEMA))
    rows = sorted(e.table("chunk").collect(), key=lambda r: r.sequence)
    hits = spark.createDataFrame([(1, rows[0].chunk_id, rows[0].content_sha256), (2, rows[1].chunk_id, rows[1].content_sha256), (3, rows[2].chunk_id, "old")], "hit_no int, chunk_id string, content_sha256 string")
    passages, report = e.context(hits, neighbours=1, max_chars=20)
    told = report.first()
    assert told.skipped_stale_hits == 1 and told.deduplicated_chunks == 2 and told.total_text_chars == 20 and told.budget_exhausted and told.omitted_chunks == 1
    assert [m.text_omitted for m in passages.first().matches] == [False, False]


def test_runs_jobs_and_deadlines(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "lake"))
    e.jobs.register_source("s", "S", "https://x.test/s/")
    manager = JobManager(e.jobs, most=1, deadline_s=600)
    pages = spark.createDataFrame([page(1, "s", "a", doc("A", "<p>All about a, at length.</p>"))], SCHEMA)
    job = manager.start("s", "c1", "recrawl", lambda j: e.recrawl(j, "s", "c1", pages))
    assert manager.wait(job, 300) == "completed"
    row = e.jobs.status(job)
    assert row["status"] == "completed" and row["run_status"] == "completed" and row["stage"] == "complete" and '"added": 1' in row["summary"]
    status = {r.source_id: r for r in e.source_status().collect()}
    assert status["s"].documents == 1 and status["s"].active_job is None
    part = e.jobs.new_id()
    e.jobs.reserve(part, "s", "c2", "recrawl")
    other = spark.createDataFrame([page(2, "s", "b", doc("B", "<p>All about b, at length.</p>"), "c2")], SCHEMA)
    assert e.recrawl(part, "s", "c2", other) == "partial"
    manager.shutdown()
    assert history.run_outcome(0, 0, 0, True) == "failed" and history.run_outcome(3, 0, 0, False) == "partial"
    with pytest.raises(TimedOut):
        slow = spark.range(4).repartition(4).mapInPandas(lambda it: (__import__("time").sleep(30) or p for p in it), "id long")
        collected(slow, 1.0)
    assert collected(spark.range(3), 60)[2].id == 2


def test_a_lake_below_a_file_address(spark, tmp_path):
    from folioscope.sources.store import Lake

    lake = Lake(spark, f"file://{tmp_path}/lake")
    row = spark.createDataFrame([("s", "c", "u", "pending", None)], "source_id string, crawl_id string, url string, status string, reason string")
    assert lake.commit(append={"crawl_url": row}, batch="f-1") == 1 and lake.commit(append={"crawl_url": row}, batch="f-0") == 1
    assert lake.read("crawl_url").count() == 1 and os.path.isdir(tmp_path / "lake" / "manifests")
