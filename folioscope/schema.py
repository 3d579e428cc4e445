"""Table schemas and the constants that identities depend on."""

from __future__ import annotations

#: Versions that take part in hashes: raising one makes everything derived by it new.
EXTRACTION_VERSION = "folio-pages-1"
NORMALIZATION_VERSION = "folio-meaning-1"
CHUNKING_VERSION = "folio-chunks-1"
GRAPH_VERSION = "folio-graph-1"
REVISION_TAG = "folio-revision-1"
INPUT_VERSION = "folio-embedding-input-1"

DEFAULT_TARGET_CHARS = 2_400
MAX_INPUT_BYTES = 16 * 1024 * 1024
MAX_DEPTH = 128
MAX_LINKS, MAX_MENTIONS = 4_096, 8_192
MAX_SYMBOL_BYTES, MAX_LINK_TEXT, MAX_URL_BYTES = 256, 200, 4_096
RRF_K = 60

PAGE_STATES = ("Fetched", "NotModified", "Blocked", "TransportFailure", "Truncated", "BodyTooLarge", "HttpFailure", "RenderFailure")
FRONTIER_STATES = ("pending", "done", "failed", "blocked", "skipped")
JOB_STATES = ("queued", "running", "completed", "partial", "failed", "cancelled", "interrupted")
RUN_STATES = ("running", "completed", "failed", "interrupted", "cancelled")

HEADER = "struct<name: string, value: binary>"
BLOCK = "struct<kind: string, text: string, markdown: string, language: string, links: int, code: array<string>>"
TABLES: dict[str, str] = {
    "source": "source_id string, name string, root_url string, created_at timestamp, admission_revision bigint",
    "crawl_run": "source_id string, crawl_id string, status string, started_at timestamp, finished_at timestamp, stage string, configuration string, summary string, error string",
    "page_outcome": f"page_id bigint, source_id string, crawl_id string, position bigint, requested_url string, final_url string, fetched_at timestamp, status int, headers array<{HEADER}>, raw_body binary, content_truncated boolean, state string, state_message string",
    "document": f"source_id string, document_url string, title string, raw_sha256 string, normalized_sha256 string, availability string, current_revision string, revision_sequence bigint, chunk_count bigint, target_chars int, representation string, graph_version string, graph_truncated boolean, headers array<{HEADER}>, checked_at timestamp",
    "section": f"source_id string, document_url string, section_id int, parent_id int, heading string, heading_level int, anchor string, blocks array<{BLOCK}>",
    "chunk": "chunk_id string, source_id string, document_url string, title string, section_id int, heading_path array<string>, anchor string, source_url string, crawl_id string, crawled_at timestamp, sequence bigint, block_start int, block_end int, text string, markdown string, content_sha256 string, char_count bigint, oversized string",
    "embedding_space": "space_id string, provider string, model string, revision string, dimensions int, input_version string",
    "embedding": "space_id string, chunk_id string, source_id string, document_url string, vector array<double>, content_sha256 string, status string, attempts int, created_at timestamp, updated_at timestamp, error string",
    "crawl_job": "job_id string, source_id string, crawl_id string, operation string, status string, created_at timestamp, finished_at timestamp, elapsed_ms bigint, configuration string, error string",
    "links_to": "source_id string, src_url string, dst_url string, url string, text string, text_truncated boolean, crawl_id string, crawled_at timestamp, version string",
    "mentions": "source_id string, document_url string, chunk_id string, symbol string, section_id int, heading_path array<string>, url string, content_sha256 string, version string",
    "document_revision": "source_id string, document_url string, revision_id string, sequence bigint, stored_at timestamp, title string, chunk_count bigint, section_count bigint",
    "revision_chunk": "revision_id string, chunk_id string, section_id int, sequence bigint, title string, text string",
    "crawl_url": "source_id string, crawl_id string, url string, status string, reason string",
}
