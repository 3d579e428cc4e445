"""The engine in one place: ingest captured pages into a lake and ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.html_extract import document_links, document_sections, extracted, normalized_sha256
from folioscope.operators import chunking, context, fusion, graph, history, lexical, reads, vectors
from folioscope.plans import validate
from folioscope.schema import DEFAULT_TARGET_CHARS, INPUT_VERSION
from folioscope.sources.staging import stage
from folioscope.sources.store import Lake
from folioscope.streaming.jobs import Jobs, Runs

KEYS = ["source_id", "document_url"]


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.lake = spark, Lake(spark, root)
        self.jobs, self.runs = Jobs(self.lake), Runs(self.lake)
        self.jobs.recover()

    def table(self, name: str) -> DataFrame:
        return self.lake.read(name)

    # Writing

    def ingest(self, pages: DataFrame, target_chars: int = DEFAULT_TARGET_CHARS, batch: str | None = None, force: bool = False) -> DataFrame:
        """Extract, chunk and link captured pages and commit everything at once; what became of each page.

        A page whose bytes or meaning are as stored keeps its chunks, unless they were made by other rules or force is
        given; one that is gone loses them; a page that isn't among those given stays as it is. A page that answers
        that it has not changed, but was made by other rules, is made anew from its stored bytes. A batch with one
        address in two versions is refused. Only the buckets of the addresses that change are written.
        """
        clash = history.conflicting(pages).head()
        if clash is not None:
            raise validate.Invalid(f"{clash['final_url']} came with different contents")
        base = self.lake.manifest()
        old = self.lake.read("document", base).select(
            *KEYS, *[F.col(c).alias(f"old_{c}") for c in ("raw_sha256", "normalized_sha256", "availability", "representation", "graph_version", "headers")]
        )
        pages = stage(self._revived(history.canonical(pages), old, base, target_chars, force), "pages")
        found = stage(extracted(pages).withColumn("normalized_sha256", F.when(F.col("reject_reason").isNull(), normalized_sha256())), "extracted")
        facts = pages.select(
            "page_id", "status", "requested_url", "final_url", "crawl_id", "fetched_at", "headers", F.when(F.col("state") == "Fetched", F.sha2("raw_body", 256)).alias("raw_sha256"), "state"
        )
        joined = found.join(facts, "page_id").join(old, KEYS, "left").withColumn("compatible", history.compatible(target_chars))
        state = F.when(F.col("reject_reason").isNotNull() & (F.col("state") == "Fetched"), "Rejected").otherwise(F.col("state"))
        outcome = stage(joined.withColumn("state", state).withColumn("change_kind", history.change_kind(force)), "outcome")
        fresh = outcome.where(F.col("change_kind").isin("added", "changed", "reprocessed"))
        touched = outcome.where(F.col("change_kind").isin("added", "changed", "reprocessed", "removed")).select(*KEYS)
        chunks = chunking.chunked(document_sections(fresh), target_chars).join(fresh.select(*KEYS, "title", "crawl_id", F.col("fetched_at").alias("crawled_at")), KEYS)
        chunks = stage(chunks.withColumn("source_url", F.concat_ws("#", "document_url", "anchor")), "chunks")
        raw_links = document_links(fresh)
        links = graph.link_edges(raw_links).join(fresh.select("source_id", F.col("document_url").alias("src_url"), "crawl_id", F.col("fetched_at").alias("crawled_at")), ["source_id", "src_url"])
        mentions = stage(graph.mention_edges(chunks), "mentions")
        states = graph.graph_states(raw_links, mentions, fresh)
        counts = chunking.index_counts(chunks).select(*KEYS, F.col("chunks").alias("chunk_count"))
        docs = fresh.join(counts, KEYS, "left").join(states, KEYS).select(
            *KEYS, "title", "raw_sha256", "normalized_sha256", F.lit("active").alias("availability"), history.revision_id(target_chars).alias("current_revision"), "chunk_count",
            F.lit(target_chars).alias("target_chars"), F.lit(history.representation(target_chars)).alias("representation"), "graph_version", "graph_truncated", "headers",
            F.col("fetched_at").alias("checked_at"),
        )
        docs = stage(docs, "docs")
        kept = self.lake.read("document", base)
        # A page that was found unchanged is stamped; its validators are the latest ones.
        same = outcome.where(F.col("change_kind").isin("not_modified", "raw_unchanged", "normalized_unchanged")).select(*KEYS, F.col("headers").alias("new_headers"), F.col("fetched_at").alias("seen"))
        stamped = kept.join(same, KEYS).withColumn("headers", history.merged_headers(F.coalesce("headers", F.array().cast(kept.schema["headers"].dataType)), F.col("new_headers"))).withColumn("checked_at", F.col("seen"))
        gone = kept.join(outcome.where("change_kind = 'removed'").select(*KEYS), KEYS, "left_semi").withColumn("availability", F.lit("removed"))
        written = stage(docs.unionByName(gone, allowMissingColumns=True).unionByName(stamped.drop("new_headers", "seen"), allowMissingColumns=True), "documents")
        known = self.lake.read("document_revision", base)
        last = known.groupBy(*KEYS).agg(F.max("sequence").alias("last"))
        born = docs.select(*KEYS, "title", "chunk_count", F.col("current_revision").alias("revision_id")).join(known.select("revision_id"), "revision_id", "left_anti").join(last, KEYS, "left")
        born = born.withColumn("sequence", F.coalesce("last", F.lit(0)) + 1).withColumn("stored_at", F.current_timestamp())
        sections = document_sections(fresh).drop("title")
        born = stage(born.join(sections.groupBy(*KEYS).agg(F.count("*").alias("section_count")), KEYS, "left"), "born")
        rev_chunks = chunks.join(born.select(*KEYS, "revision_id"), KEYS).select("revision_id", "chunk_id", "section_id", "sequence", "title", "text")
        at_src = touched.withColumnRenamed("document_url", "src_url")
        self.lake.commit(
            merge={
                "document": (written, written.select(*KEYS), KEYS), "section": (sections, touched, KEYS), "chunk": (chunks, touched, KEYS),
                "links_to": (links, at_src, ["source_id", "src_url"]), "mentions": (mentions.drop("sequence"), touched, KEYS),
            },
            append={"page_outcome": pages, "document_revision": born, "revision_chunk": rev_chunks},
            base=base, batch=batch,
        )
        return outcome.select(*KEYS, "page_id", "change_kind", "reject_reason")

    def _revived(self, pages: DataFrame, old: DataFrame, base: dict, target_chars: int, force: bool) -> DataFrame:
        """The pages, with stored bytes and merged headers for those that have not changed but must be made anew."""
        stored = self.lake.read("page_outcome", base).where("state = 'Fetched'").withColumn("sha", F.sha2("raw_body", 256))
        live = old.where(F.coalesce("old_availability", F.lit("active")) != "removed").where(~history.compatible(target_chars) | F.lit(force))
        keys = [F.col("source_id"), F.col("document_url").alias("final_url")]
        bodies = stored.join(live.select(*keys, F.col("old_raw_sha256").alias("sha"), "old_headers"), ["source_id", "final_url", "sha"])
        bodies = bodies.groupBy("source_id", "final_url").agg(F.first("raw_body").alias("old_body"), F.first("old_headers").alias("old_headers"))
        joined = pages.join(bodies, ["source_id", "final_url"], "left")
        again = (F.col("state") == "NotModified") & F.col("old_body").isNotNull()
        none = F.array().cast(pages.schema["headers"].dataType)
        joined = joined.withColumn("raw_body", F.when(again, F.col("old_body")).otherwise(F.col("raw_body")))
        joined = joined.withColumn("headers", F.when(again, history.merged_headers(F.coalesce("old_headers", none), F.coalesce("headers", none))).otherwise(F.col("headers")))
        joined = joined.withColumn("status", F.when(again, 200).otherwise(F.col("status"))).withColumn("state", F.when(again, "Fetched").otherwise(F.col("state")))
        return joined.drop("old_body", "old_headers")

    def reprocess(self, source_id: str, root: str, target_chars: int = DEFAULT_TARGET_CHARS, max_pages: int = 10_000) -> DataFrame:
        """Make a source's documents anew from their stored bytes, without fetching anything."""
        return self.ingest(history.retained(self.table("page_outcome"), self.table("document"), source_id, root, max_pages), target_chars, force=True)

    def recrawl(self, job_id: str, source_id: str, crawl_id: str, pages: DataFrame, target_chars: int = DEFAULT_TARGET_CHARS, delivered: bool = True) -> str:
        """One run of a reserved job: its stages and outcome are kept; how it ended."""
        self.jobs.move(job_id, "running")
        self.runs.start(source_id, crawl_id, f'{{"target_chars": {target_chars}}}')
        try:
            before = history.unvisited_known(self.table("document"), pages).where(F.col("source_id") == source_id).count()
            self.runs.progress(source_id, crawl_id, "persist")
            counts = history.recrawl_report(self.ingest(pages, target_chars, batch=f"{source_id}/{crawl_id}")).first().asDict()
            held = self.table("document").where((F.col("source_id") == source_id) & (F.coalesce("availability", F.lit("active")) != "removed")).count()
            status = history.run_outcome(held, counts["rejected"], before, delivered)
            self.runs.finish(source_id, crawl_id, "failed" if status == "failed" else "completed", counts | {"unvisited_known": before, "outcome": status})
        except Exception as e:
            self.runs.finish(source_id, crawl_id, "failed", {}, str(e)[:500])
            self.jobs.move(job_id, "failed", str(e)[:500])
            raise
        self.jobs.move(job_id, status)
        return status

    # Embeddings

    def embedding_space(self, provider: str, model: str, revision: str, dimensions: int) -> str:
        """The id of a space, which is registered with what makes its identity."""
        validate.embedding_space(provider, model, dimensions)
        space = vectors.space_id(provider, model, revision, dimensions, INPUT_VERSION)
        row = self.spark.createDataFrame(
            [(space, provider, model, revision, dimensions, INPUT_VERSION)], "space_id string, provider string, model string, revision string, dimensions int, input_version string"
        )
        self.lake.transact(lambda base: {} if self.lake.read("embedding_space", base).where(F.col("space_id") == space).head() else {"append": {"embedding_space": row}})
        return space

    def _space(self, space_id: str):
        row = self.table("embedding_space").where(F.col("space_id") == space_id).head()
        if row is None:
            raise validate.Invalid(f"{space_id} is not registered")
        if vectors.space_id(row["provider"], row["model"], row["revision"], row["dimensions"], row["input_version"]) != space_id:
            raise validate.Invalid(f"{space_id} is not what its description says")
        return row

    def index_embeddings(self, provider: Callable[[list[str]], list], space_id: str, source_id: str | None = None) -> dict:
        """Embed the chunks that have no ready vector of their content and store what came of it; the run's counts."""
        space = self._space(space_id)
        chunks = self.table("chunk")
        chunks = chunks if source_id is None else chunks.where(F.col("source_id") == source_id)
        todo = stage(vectors.to_embed(chunks, self.table("embedding").withColumn("embedding_id", F.lit(0)), space_id), "todo")
        states = stage(vectors.embed(todo, provider, space_id, dimensions=space["dimensions"]), "states")
        stored = {}

        def change(base):
            fresh = vectors.completed(states, self.lake.read("chunk", base), self.lake.read("embedding", base))
            stored["rows"] = stage(fresh.where("status <> 'stale'").withColumn("updated_at", F.current_timestamp()).withColumn("created_at", F.current_timestamp()), "embedded")
            return {"merge": {"embedding": (stored["rows"], stored["rows"].select("space_id", "source_id", "chunk_id"), ["space_id", "source_id", "chunk_id"])}}

        self.lake.transact(change)
        return vectors.run_report(chunks, todo, stored["rows"]).first().asDict()

    def embedding_coverage(self, space_id: str) -> DataFrame:
        return vectors.coverage(self.table("chunk"), self.table("embedding").withColumn("embedding_id", F.lit(0)), space_id)

    # Searching

    def search(self, query: str, limit: int = 8, mode: str = "auto", where: lexical.Filter = lexical.Filter(), max_text: int = 4_000) -> DataFrame:
        validate.search(query, limit, max_text, mode)
        validate.metadata(where.url_prefix, where.heading, where.crawled_after)
        hits = lexical.search(self.table("chunk"), query, limit, where, mode, max_text)
        return reads.named(hits, self.table("source"))

    def search_revision(self, revision_id: str, query: str, limit: int = 8) -> DataFrame:
        """The same search within one stored revision, with the archive's own statistics."""
        validate.search(query, limit)
        rows = self.table("revision_chunk").select("chunk_id", F.col("revision_id").alias("source_id"), F.lit("").alias("document_url"), "sequence", "title", "text", F.array().cast("array<string>").alias("heading_path"), F.lit(None).cast("timestamp").alias("crawled_at"))
        return lexical.search(rows, query, limit, lexical.Filter(source_id=revision_id))

    def vector_search(self, query: list[float], space_id: str, limit: int = 8, where: lexical.Filter = lexical.Filter()) -> DataFrame:
        """The chunks whose present content is nearest to a vector of a registered space that has vectors at all."""
        validate.within("limit", limit, 1, 50)
        space = self._space(space_id)
        if len(query) != space["dimensions"]:
            raise validate.Invalid(f"the query has {len(query)} dimensions, the space {space['dimensions']}")
        chunks = self.table("chunk")
        kept = chunks.where(where.column()) if where != lexical.Filter() else chunks
        rows = self.table("embedding").withColumn("embedding_id", F.col("chunk_id"))
        return vectors.vector_search(rows, query, space_id, limit, chunks=kept)

    def _list(self, hits: DataFrame) -> DataFrame:
        known = self.table("chunk").select("chunk_id", "content_sha256")
        with_hash = hits if "content_sha256" in hits.columns else hits.join(known, "chunk_id")
        return fusion.numbered(with_hash.select("chunk_id", "source_id", "document_url", "sequence", "content_sha256", "score"))

    def hybrid_search(
        self, query: str, vector: list[float], space_id: str, limit: int = 8, where: lexical.Filter = lexical.Filter(), ranker: fusion.Ranker = fusion.reciprocal_ranker
    ) -> DataFrame:
        """Keyword and vector hits in one ranking, with the rank and score of each as evidence."""
        depth = max(20, min(50, limit * 4))
        lists = {"lexical": self._list(self.search(query, depth, where=where)), "vector": self._list(self.vector_search(vector, space_id, depth, where))}
        return fusion.with_evidence(limit, ranker, **lists)

    def graph_search(
        self, query: str | None, limit: int = 8, hop: graph.Hop = graph.Hop(), seeds: int = 4, vector: list[float] | None = None, space_id: str | None = None,
        where: lexical.Filter = lexical.Filter(),
    ) -> tuple[DataFrame, DataFrame]:
        """Hits of keywords, a vector or both, what one hop from the best of them reaches, fused; and the hop's report.

        Where the hop reaches nothing, a search by keywords or by vector alone keeps its own scores and order.
        """
        validate.graph(seeds, hop.edges, hop.chunks, hop.candidates)
        depth = max(20, min(50, limit * 4))
        lists = {}
        if query is not None:
            lists["lexical"] = stage(self._list(self.search(query, depth, where=where)), "lexical")
        if vector is not None:
            lists["vector"] = stage(self._list(self.vector_search(vector, space_id, depth, where)), "vector")
        chunks, documents = self.table("chunk"), self.table("document")
        first = fusion.numbered(fusion.with_evidence(seeds, **lists)).select(F.col("rank").alias("seed_no"), "chunk_id", "content_sha256", "source_id", "document_url")
        states = stage(graph.seed_states(first, chunks, documents), "seeds")
        ready = states.where("state = 'ready'").select("seed_no", "chunk_id", "source_id", "document_url")
        mentions = self.table("mentions").join(chunks.select("chunk_id", "sequence"), "chunk_id")
        edges = graph.present_edges(self.table("links_to"), documents)
        expanded = stage(graph.expand(ready, edges, mentions, chunks, hop, where.column() if where != lexical.Filter() else None), "expanded")
        reached = stage(graph.interleaved(expanded, hop), "reached")
        stale = states.where("state = 'stale'").select("chunk_id")
        lists = {n: df.join(stale, "chunk_id", "left_anti") for n, df in lists.items()}
        asked = next(iter(lists.values()))
        for other in list(lists.values())[1:]:
            asked = asked.unionByName(other)
        distinct = asked.select("chunk_id").distinct().count()
        report = graph.expansion_report(states, expanded, hop).withColumn("seeds_truncated", F.lit(distinct) > F.col("seeds"))
        if not reached.limit(1).count():
            if len(lists) == 1:
                (name, only), = lists.items()
                return only.orderBy("rank").limit(limit).withColumn(f"{name}_rank", F.col("rank")), report
            return fusion.with_evidence(limit, **lists), report
        near = reached.join(chunks.select("chunk_id", *KEYS, "sequence", "content_sha256"), "chunk_id").withColumn("rank", F.col("graph_rank")).withColumn("score", F.lit(None).cast("double"))
        hits = fusion.with_evidence(limit, **lists, graph=near)
        return hits.join(reached.select("chunk_id", "paths", "paths_truncated"), "chunk_id", "left").orderBy(F.desc("score"), *KEYS, "sequence", "chunk_id"), report

    def context(self, hits: DataFrame, neighbours: int = 1, max_chunks: int = 50, max_chars: int = 12_000, max_chunk_chars: int = 4_000) -> tuple[DataFrame, DataFrame]:
        """Passages around hits (chunk_id, hit_no, content_sha256) with the hits they hold, and a report of what was left out.

        Hits whose chunk has changed or gone are skipped and counted.
        """
        validate.context(neighbours, max_chunks, max_chars, max_chunk_chars)
        chunks = self.table("chunk").select("chunk_id", *KEYS, "sequence", "text", "content_sha256")
        if "content_sha256" not in hits.columns:
            hits = hits.join(chunks.select("chunk_id", "content_sha256"), "chunk_id", "left")
        valid = stage(context.verified(hits, chunks), "hits")
        around = stage(context.neighbours(valid.select("hit_no", *KEYS, "sequence"), chunks, neighbours), "around")
        taken = stage(context.budgeted(around, max_chars, max_chunks, max_chunk_chars), "taken")
        return context.with_matches(context.passages(taken), valid, taken), context.report(hits, valid, around, taken)

    # Reading

    def document(self, source_id: str, document_url: str) -> DataFrame:
        """A document with its sections."""
        read = lambda name: self.lake.read(name, source_id=source_id, key=document_url)
        return reads.whole_document(read("document"), read("section"), source_id, document_url)

    def chunks(self, source_id: str, document_url: str, section_id: int | None = None, max_chars: int = 12_000) -> DataFrame:
        return reads.document_chunks(self.lake.read("chunk", source_id=source_id, key=document_url), source_id, document_url, section_id, max_chars)

    def revision(self, revision_id: str, section_id: int | None = None, max_chars: int = 12_000) -> DataFrame:
        return reads.revision_chunks(self.table("revision_chunk"), revision_id, section_id, max_chars)

    def document_status(self) -> DataFrame:
        return reads.document_status(self.table("document"), self.table("chunk"))

    def source_status(self) -> DataFrame:
        return reads.source_status(self.table("source"), self.table("document"), self.table("crawl_job"))

    def page_outcomes(self, source_id: str, crawl_id: str) -> DataFrame:
        return self.table("page_outcome").where((F.col("source_id") == source_id) & (F.col("crawl_id") == crawl_id)).drop("raw_body").orderBy("fetched_at", "requested_url")

    def known_pages(self, source_id: str, root: str) -> DataFrame:
        """Addresses of a source with the headers to ask whether they have changed."""
        return history.cached_requests(self.table("document"), source_id, root)

    def graph_coverage(self) -> DataFrame:
        return graph.graph_coverage(self.table("document"))

    def revisions(self, source_id: str, document_url: str, after: str | None = None, limit: int = 20) -> DataFrame:
        rows = self.table("document_revision").where((F.col("source_id") == source_id) & (F.col("document_url") == document_url))
        return history.page_after(rows.withColumn("cursor", F.lpad(F.col("sequence").cast("string"), 12, "0")), "cursor", after, limit)

    def links(self, source_id: str, document_url: str, incoming: bool = False, limit: int = 100) -> DataFrame:
        return graph.document_links(self.table("links_to"), self.table("document"), source_id, document_url, incoming, limit)

    def entity(self, source_id: str, symbol: str, limit: int = 100) -> DataFrame:
        rows = self.table("mentions").join(self.table("chunk").select("chunk_id", "sequence"), "chunk_id")
        return graph.entity_mentions(rows, source_id, symbol, limit)
