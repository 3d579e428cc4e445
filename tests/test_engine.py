from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioscope.engine import Engine
from folioscope.functions.html_extract import extract, needs_browser
from folioscope.plans.validate import Invalid
from folioscope.sources.store import Conflict, Lake

SCHEMA = (
    "page_id bigint, source_id string, crawl_id string, requested_url string, final_url string, fetched_at timestamp, status int, "
    "headers array<struct<name string, value binary>>, raw_body binary, content_truncated boolean, state string, state_message string"
)


def page(i, url, body, status=200, state="Fetched", crawl="c1"):
    return (i, "docs", crawl, url, url, datetime(2025, 1, 1), status, [("Content-Type", b"text/html")], body.encode(), False, state, None)


def html(title, body):
    return f"<html><head><title>{title}</title></head><body><nav>menu noise</nav><main><h1>{title}</h1>{body}</main></body></html>"


A, B = "https://x.test/docs/a", "https://x.test/docs/b"
BODY_A = html("Alpha", "<p>The proxy answers <code>Proxy::custom()</code> at once, see <a href='b#two'>beta</a>.</p><h2>More</h2><p>Second part of the alpha page.</p>")
BODY_B = html("Beta", "<h2 id='two'>Two</h2><p>Beta also holds <code>Proxy::custom</code> for good.</p>")


def test_ingest_search_and_recrawl(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "lake"))
    first = e.ingest(spark.createDataFrame([page(1, A, BODY_A), page(2, B, BODY_B), page(3, A + "/bad", "", 200)], SCHEMA))
    assert {(r.page_id, r.change_kind) for r in first.collect()} == {(1, "added"), (2, "added"), (3, "rejected")}
    hits = e.search("Proxy::custom").collect()
    assert {h.match_kind for h in hits} == {"exact"} and {h.document_url for h in hits} == {A, B}
    assert "menu noise" not in "".join(h.text for h in hits)
    assert [r.target_known for r in e.links("docs", A).collect()] == [True]
    assert e.entity("docs", "Proxy::custom").count() == 2
    near, report = e.graph_search("second part")
    assert report.first().seeds == 1
    near = near.collect()
    assert {r.document_url for r in near} >= {A}
    hit = e.search("beta").withColumn("hit_no", F.lit(1)).limit(1)
    passages, told = e.context(hit)
    assert passages.count() == 1 and passages.first().matches[0].text_omitted is False
    assert told.first().asDict() | {"total_text_chars": 0} == {"skipped_stale_hits": 0, "deduplicated_chunks": 0, "omitted_chunks": 0, "total_text_chars": 0, "budget_exhausted": False}
    ids = {r.chunk_id for r in e.table("chunk").collect()}
    again = e.ingest(spark.createDataFrame([page(1, A, BODY_A, crawl="c2"), page(2, B, BODY_B.replace("for good", "no more"), crawl="c2")], SCHEMA))
    assert {(r.page_id, r.change_kind) for r in again.collect()} == {(1, "raw_unchanged"), (2, "changed")}
    after = {r.chunk_id for r in e.table("chunk").collect()}
    assert len(ids & after) == len(ids) - 1
    assert e.revisions("docs", B).count() == 2 and e.revisions("docs", A).count() == 1
    gone = e.ingest(spark.createDataFrame([page(2, B, "", 410, "HttpFailure", "c3")], SCHEMA))
    assert gone.collect()[0].change_kind == "removed"
    assert {r.document_url for r in e.table("chunk").collect()} == {A}
    assert {r.availability for r in e.table("document").where(F.col("document_url") == B).collect()} == {"removed"}
    old = e.table("document_revision").where((F.col("document_url") == B) & (F.col("sequence") == 1)).collect()[0].revision_id
    assert e.search_revision(old, "good").count() == 1


def test_invalid_requests_are_refused_before_any_job(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "lake"))
    for bad in ("", "  ", "::", "a\x00b", "x" * 1025):
        with pytest.raises(Invalid):
            e.search(bad)
    with pytest.raises(Invalid):
        e.search("a", limit=51)


def test_jobs_have_one_active_each_and_recover(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "lake"))
    e.jobs.register_source("docs", "Docs", "https://x.test/")
    e.jobs.register_source("docs", "Docs", "https://x.test/")
    with pytest.raises(Invalid):
        e.jobs.register_source("docs", "Docs", "https://y.test/")
    e.jobs.reserve("j1", "docs", "c1", "crawl")
    with pytest.raises(Invalid):
        e.jobs.reserve("j2", "docs", "c2", "crawl")
    e.jobs.move("j1", "running")
    assert Engine(spark, str(tmp_path / "lake")).jobs.status("j1")["status"] == "interrupted"
    with pytest.raises(Invalid):
        e.jobs.move("j1", "completed")
    e.jobs.reserve("j2", "docs", "c2", "crawl")


def test_commits_are_whole_and_conflicts_seen(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    base = lake.manifest()
    row = spark.createDataFrame([("s", "c", "u", "pending", None)], "source_id string, crawl_id string, url string, status string, reason string")
    lake.commit(append={"crawl_url": row}, base=base, batch="b1")
    with pytest.raises(Conflict):
        lake.commit(append={"crawl_url": row}, base=base)
    assert lake.commit(append={"crawl_url": row}, batch="b1") == 1
    assert lake.read("crawl_url").count() == 1
    with lake.exclusive():
        with pytest.raises(Conflict), lake.exclusive():
            pass


def test_extraction_structure():
    got = extract(BODY_A.encode(), A)
    assert [(s["section_id"], s["parent_id"], s["heading_level"]) for s in got["sections"]] == [(0, None, 0), (1, 0, 1), (2, 1, 2)]
    assert got["links"][0]["url"] == "https://x.test/docs/b#two"
    assert extract(b"\xff", A)["reject_reason"] == "InvalidUtf8"
    assert extract(b"<nav>x</nav>", A)["reject_reason"] == "EmptyContent"
    assert extract(b"<div>" * 200 + b"x", A)["reject_reason"] == "StructureTooDeep"
    code = extract(b"<pre><code class='language-rust'>let a;\n  ```\n</code></pre>", A)["sections"][0]["blocks"][0]
    assert code["language"] == "rust" and code["markdown"].startswith("````rust\n")
    table = extract(b"<table><tr><th>a<th>b<tr><td>x|y<td>z</table>", A)["sections"][0]["blocks"][0]
    assert "x\\|y" in table["markdown"] and table["text"] == "a\tb\nx|y\tz"
    assert needs_browser(b"<div id=root></div><script>1</script>")
