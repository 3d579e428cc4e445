"""The blocks of each page's own article, without the furniture around and inside it.

The token streams of a host's pages (their words and the marks of their blocks) are put together and a suffix
array with its longest common prefixes is built over them. Long substrings that enough distinct pages share
are the host's template; what they cover is furniture, what is unique stays. Three things follow from it:

* A page's main element is the one that holds the most unique words outside of links, less a part
  (furniture_words) of the words that are furniture, together with what the
  elements in the same slot (see pages.py) of its host's pages hold on average (slot_weight times); the page's
  own title as a heading counts as title_words. Blocks outside of it are left out. The attributes of elements are compared, never read.
* A block in the main element is left out if the substrings cover all of it, or if its whole token string is on
  enough pages of the host or of all hosts.
* A list in the main element is left out if all it says is in links: there is no text of its own in it.

If nothing would be left of the main element's text, its rarest paragraphs without links stay: a message that
stands in place of the article.

A host's pages are split into shards of bounded size, so a host with a third of all pages is many tasks. Each
shard's array counts the distinct pages of every block's string and of every slot; the counts are summed over
the shards of a host and over all hosts before anything is decided, so how a host is cut doesn't matter to
them. The substrings that cross blocks must be on a share of a shard's pages, and shards are cut by hash.
Copies of a page under other ids count as the one address they have. Numbers are alike, and so are the name
of the host and the page's own title wherever they stand.

Null texts and sections without blocks give no rows. Pages without a body in page_outcome are judged by
their sections alone: what comes before the first heading is left out, and so are lists all in links.
Repeated section rows give each block once. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.pages import Block, Container, containers, decoded, elements_of, title_of
from folioscope.llm.suffix_array import covered, distinct_owners, suffix_array, whole_supports
from folioscope.sources.staging import small_or_shuffled, stage

DIGITS = re.compile(r"[0-9]+")
#: Tokens that no text has: the end of a block, the host's name and the page's title.
END, HOST, TITLE = 1, "\x01", "\x02"


@dataclass(frozen=True)
class Furniture:
    """run: tokens of the shortest substring that crosses blocks and counts. min_pages and a share of the distinct
    pages of a shard or host (host_share) or of all hosts (all_share, on `hosts` of them) make it furniture."""

    run: int = 8
    min_pages: int = 6
    all_pages: int = 4
    host_share: float = 0.01
    all_share: float = 0.007
    often_share: float = 0.0005
    hosts: int = 3
    slot_weight: float = 3.0
    title_words: int = 60
    furniture_words: float = 0.25
    shard_pages: int = 2_000


class _Words(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = crc32(word.encode("utf-8", "replace")) | 2
        return h


def text_print(text: Column) -> Column:
    """A hash of a block's text without its white space; equal to that of _print."""
    return F.xxhash64(F.regexp_replace(text, r"(?U)\s+", ""))


def _print(text: str) -> int:
    return xxhash.xxh64_intdigest("".join(text.split()).encode("utf-8", "replace"), 42) - (1 << 63) ^ -(1 << 63)


def stream(found: list[Container], host: str | None, title: str, words: _Words) -> tuple[list[int], list[int]]:
    """A page's tokens, headings included, and how many each block has."""
    out: list[int] = []
    sizes: list[int] = []
    name = re.compile(re.escape(host), re.I) if host else None
    for c in found:
        for b in c.blocks:
            text = b.text.replace(title, TITLE) if title and title in b.text else b.text
            text = DIGITS.sub("0", name.sub(HOST, text) if name else text)
            said = text.split()
            out.append(words[f"<{b.kind}>"])
            out.extend([words[w] for w in said])
            out.append(END)
            sizes.append(len(said) + 2)
    return out, sizes


def _titled(blocks: list[tuple[int, Block]], n: int, title: str) -> list[bool]:
    """For each of n elements whether the page's title stands in it as a heading."""
    held = {e for e, b in blocks if b.kind == "heading" and b.text == title}
    return [e in held for e in range(n)]


STREAMS = (
    "page_id long, host string, url long, tokens array<int>, sizes array<int>, prints array<long>, place array<int>, slots array<string>, around array<array<int>>, titled array<boolean>, loose array<int>, links array<int>"
)


def page_streams(pages: DataFrame) -> DataFrame:
    """Of every fetched page with a body: its tokens, and for each block (headings too) the number of its tokens, its
    text's hash (null for headings), the number of its slot, the words outside of links, kind and links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for host, body in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                page = decoded(body)
                found = containers(page)
                title = title_of(page)
                tokens, sizes = stream(found, host, title, words)
                blocks, slots, around = elements_of(found)
                row = (
                    np.array(tokens, np.uint32).view(np.int32), sizes, [None if b.kind == "heading" else _print(b.text) for _, b in blocks], [s for s, _ in blocks],
                    slots, around, _titled(blocks, len(slots), title), [b.loose for _, b in blocks], [b.links for _, b in blocks],
                )
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.bool_(), pa.int32(), pa.int32())
            made = [pa.array(c, pa.list_(k)) for c, k in zip(cols, kinds)]
            names = ["page_id", "host", "url", "tokens", "sizes", "prints", "place", "slots", "around", "titled", "loose", "links"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=names)

    url = F.xxhash64(F.coalesce(F.regexp_replace("final_url", r"(?s)#.*$", ""), F.col("page_id").cast("string")))
    rows = pages.where("state = 'Fetched' and page_id is not null and length(raw_body) > 0")
    return rows.select("page_id", F.col("source_id").alias("host"), url.alias("url"), "raw_body").mapInArrow(run, STREAMS)


WEIGHED = "page_id long, host string, runs array<long>, held array<int>, inside array<boolean>, prints array<long>, place array<int>, slots array<string>, around array<array<int>>, titled array<boolean>, fresh array<int>, net array<double>, loose array<int>, first boolean"


def _weigh(rule: Furniture):
    """For the pages of one shard, what its suffix array says of each block and slot."""

    def weigh(table: pa.Table) -> pa.Table:
        lists = {n: table.column(n).combine_chunks() for n in ("tokens", "sizes", "place")}
        n_tokens = lists["tokens"].value_lengths().to_numpy()
        tokens = lists["tokens"].flatten().to_numpy().view(np.uint32).astype(np.int64)
        page_of = np.repeat(np.arange(table.num_rows), n_tokens)
        owner_of = np.unique(table.column("url").to_numpy(), return_inverse=True)[1]
        # A page's stream ends in a token of its own, so no substring reaches into the next page.
        ends = np.cumsum(n_tokens)
        marks = (1 << 33) + np.arange(table.num_rows)
        tokens = np.insert(tokens, ends, marks)
        page_of = np.insert(page_of, ends, np.arange(table.num_rows))
        codes = np.unique(tokens, return_inverse=True)[1].astype(np.int32)
        sa, lcp = suffix_array(codes)
        owner = owner_of[page_of]
        n_urls = int(owner_of.max()) + 1 if len(owner_of) else 0
        least = max(rule.min_pages, int(np.ceil(rule.host_share * n_urls)))
        hidden = covered(sa, lcp, owner, rule.run, least)
        sizes = lists["sizes"].flatten().to_numpy().astype(np.int64)
        n_blocks = lists["sizes"].value_lengths().to_numpy()
        block_page = np.repeat(np.arange(table.num_rows), n_blocks)
        starts = np.cumsum(sizes) - sizes + block_page
        held = whole_supports(sa, lcp, starts, sizes, owner_of[block_page])
        within_block = np.add.reduceat(np.append(hidden, False).astype(np.int64), np.ravel(np.column_stack([starts, starts + sizes])))[::2] if len(starts) else sizes
        # A block's string as a number that is the same in every shard: two hashes of its tokens by place.
        raw = tokens.astype(np.uint64)
        at = np.arange(len(tokens)) - np.repeat(np.append(starts, len(tokens)), np.append(np.diff(np.append(starts, len(tokens))), 0)) if len(starts) else np.zeros(len(tokens), np.int64)
        mixed = (raw * np.uint64(0x9E3779B97F4A7C15)) ^ ((at.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        runs = np.add.reduceat(np.append(mixed, np.uint64(0)), np.ravel(np.column_stack([starts, starts + sizes])))[::2] if len(starts) else np.empty(0, np.uint64)
        # Words of each element that no substring covers and that are in no link, nor beside several of them.
        loose, links = (table.column(n).combine_chunks().flatten().to_numpy() for n in ("loose", "links"))
        free = np.where((held >= least) | (links > 1), 0, np.maximum(0, np.minimum(loose, sizes - within_block - 2)))
        place = lists["place"].flatten().to_numpy()
        n_slots = table.column("slots").combine_chunks().value_lengths().to_numpy()
        slot_at = (np.cumsum(n_slots) - n_slots)[block_page] + place
        fresh = np.bincount(slot_at, weights=free, minlength=int(n_slots.sum())).astype(np.int32)
        # The same with all that stands in elements within, less a part of the words that are furniture.
        worth = np.where(held >= least, -rule.furniture_words * (sizes - 2), free)
        outer = table.column("around").combine_chunks().flatten()
        depth = outer.value_lengths().to_numpy()
        inner_at, first_outer = outer.flatten().to_numpy(), np.cumsum(depth) - depth
        n_outer = depth[slot_at]
        which = np.repeat(first_outer[slot_at] - (np.cumsum(n_outer) - n_outer), n_outer) + np.arange(int(n_outer.sum()))
        base = np.repeat((np.cumsum(n_slots) - n_slots)[block_page], n_outer)
        net = np.bincount(base + inner_at[which], weights=np.repeat(worth, n_outer), minlength=int(n_slots.sum()))
        # One block of each string stands for its shard's count.
        _, one = np.unique(runs, return_index=True)
        count = np.zeros(len(runs), np.int32)
        count[one] = held[one]
        cut = lambda values, lengths, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind))
        seen = np.zeros(table.num_rows, bool)
        seen[np.unique(owner_of, return_index=True)[1]] = True
        return pa.table(
            [
                table.column("page_id"), table.column("host"), cut(runs.view(np.int64), n_blocks, pa.int64()), cut(count, n_blocks, pa.int32()),
                cut(within_block >= sizes, n_blocks, pa.bool_()), table.column("prints"), table.column("place"), table.column("slots"), table.column("around"), table.column("titled"),
                cut(fresh, n_slots, pa.int32()), cut(net, n_slots, pa.float64()), table.column("loose"), pa.array(seen),
            ],
            names=["page_id", "host", "runs", "held", "inside", "prints", "place", "slots", "around", "titled", "fresh", "net", "loose", "first"],
        )

    return weigh


def weighed_pages(pages: DataFrame, rule: Furniture = Furniture()) -> DataFrame:
    """Staged: one row for each page that page_streams gives, with what the suffix array of its shard found."""
    streams = stage(page_streams(pages), "streams")
    # One row for each host.
    sizes = streams.groupBy(F.col("host").alias("of")).agg(F.ceil(F.approx_count_distinct("url") / rule.shard_pages).alias("shards"))
    joined = streams.join(small_or_shuffled(stage(sizes, "hosts")), F.col("host").eqNullSafe(F.col("of")), "left").drop("of")
    sharded = joined.withColumn("shard", F.pmod(F.xxhash64("url", F.lit(3)), F.coalesce("shards", F.lit(1)))).drop("shards")
    return stage(sharded.groupBy("host", "shard").applyInArrow(_weigh(rule), WEIGHED), "weighed")


def frequent_runs(by_host: DataFrame, pages: DataFrame, rule: Furniture = Furniture()) -> tuple[DataFrame, DataFrame]:
    """(of, of_run), the block strings on enough pages of that host, and (run, common, often), those of at least
    rule.hosts hosts and whether they are on all_share or often_share of all pages; from staged (host, run, n) and (of, pages).

    n counts distinct pages, and no page is in two shards, so their sums do too.
    """
    pages = small_or_shuffled(pages)
    total = pages.agg(F.sum("pages")).first()[0] or 0
    own = by_host.join(pages, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") >= F.greatest(F.lit(rule.min_pages), rule.host_share * F.col("pages")))
    shared = by_host.groupBy("run").agg(F.sum("n").alias("n"), F.count("*").alias("hosts")).where(F.col("hosts") >= rule.hosts)
    common, often = F.col("n") >= max(rule.all_pages, rule.all_share * total), F.col("n") >= rule.often_share * total
    return own.select("of", F.col("run").alias("of_run")), shared.select("run", common.alias("common"), often.alias("often"))


def slot_weights(weighed: DataFrame) -> DataFrame:
    """host, slot, weight: the unique words of the elements in a slot, on average."""
    each = weighed.where("first").select("host", F.explode(F.arrays_zip("slots", "fresh")).alias("s"))
    return each.groupBy("host", F.col("s.slots").alias("slot")).agg(F.avg("s.fresh").alias("weight"))


def furniture_flags(weighed: DataFrame, rule: Furniture = Furniture()) -> DataFrame:
    """weighed with main (the number of the page's main element) and common (for each block, whether it is furniture)."""
    each = weighed.select("host", F.explode(F.arrays_zip("runs", "held")).alias("r")).where("r.held > 0")
    by_host = stage(each.groupBy("host", F.col("r.runs").alias("run")).agg(F.sum("r.held").alias("n")), "runs")
    pages = stage(weighed.where("first").groupBy(F.col("host").alias("of")).agg(F.count("*").alias("pages")), "host-pages")
    own, shared = frequent_runs(by_host, pages, rule)
    own = small_or_shuffled(stage(own, "own")).withColumn("mine", F.lit(True))
    # At most (blocks of a page) / all_share rows, whatever the input.
    theirs = small_or_shuffled(stage(shared.where("common").select(F.col("run").alias("any_run"), F.lit(True).alias("theirs")), "theirs"))
    blocks = weighed.select("page_id", "host", F.posexplode("runs").alias("i", "run"))
    hit = blocks.join(own, F.col("host").eqNullSafe(F.col("of")) & (F.col("run") == F.col("of_run")), "left")
    hit = hit.join(theirs, F.col("run") == F.col("any_run"), "left")
    hit = hit.where("mine or theirs").groupBy("page_id").agg(F.collect_set("i").alias("hits"))
    elements = weighed.select("page_id", "host", F.posexplode(F.arrays_zip("slots", "net", "titled")).alias("e", "s"))
    known = small_or_shuffled(stage(slot_weights(weighed), "slots").select(F.col("host").alias("of"), F.col("slot").alias("of_slot"), "weight"))
    scored = elements.join(known, F.col("host").eqNullSafe(F.col("of")) & (F.col("s.slots") == F.col("of_slot")))
    score = F.col("s.net") + rule.slot_weight * F.col("weight") + F.when(F.col("s.titled"), rule.title_words).otherwise(0)
    chosen = scored.groupBy("page_id").agg(F.max(F.struct(score.alias("score"), (-F.col("e")).alias("e"))).alias("best"))
    flagged = weighed.join(hit, "page_id", "left").join(chosen, "page_id", "left").withColumn("main", -F.col("best.e"))
    common = F.transform("runs", lambda r, i: F.coalesce(F.array_contains("hits", i), F.lit(False)) | F.get("inside", i))
    return flagged.withColumn("common", common).drop("hits", "best", "first")


def _aligned(prints: list[int | None], own: list[int | None]) -> list[int | None]:
    """For each of the own blocks the number of the page's block with its print, at or after the last one's place;
    the last one's where there is none."""
    out: list[int | None] = []
    at = 0
    for p in own:
        try:
            at = prints.index(p, at) + 1
            out.append(at - 1)
        except ValueError:
            out.append(out[-1] if out else None)
    return out


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept: list[tuple[int, int, int]] = []
        for page, cut, prints, common, place, around, loose, main in zip(*(c.to_pylist() for c in batch.columns)):
            mine = [(s["section_id"], i, b) for s in cut for i, b in enumerate(s["blocks"] or ()) if b and b["print"] is not None]
            if prints is None:
                kept += [(page, s, i) for s, i, b in mine if s > 0 and not (b["kind"] == "list" and b["links"] >= b["lines"])]
                continue
            inner = [main in x for x in around]
            own, spare = [], []
            for (s, i, b), at in zip(mine, _aligned(prints, [b["print"] for _, _, b in mine])):
                if at is None or not inner[place[at]] or (b["kind"] == "list" and loose[at] == 0):
                    continue
                if not common[at]:
                    own.append((page, s, i))
                elif b["kind"] == "paragraph" and not b["links"]:
                    spare.append((page, s, i))
            kept += own or spare[:1]
        cols = list(zip(*kept)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["page_id", "section_id", "block_idx"]
        )


def main_blocks(pages: DataFrame, sections: DataFrame, rule: Furniture = Furniture()) -> DataFrame:
    """page_id, section_id, block_idx of the blocks of each page's main body."""
    flagged = furniture_flags(weighed_pages(pages, rule), rule)
    facts = F.transform(
        "blocks",
        lambda b: F.struct(
            F.when(F.length(b["text"]) > 0, text_print(b["text"])).alias("print"), b["kind"].alias("kind"), F.coalesce(b["links"], F.lit(0)).alias("links"),
            F.size(F.split(b["text"], "\n")).alias("lines"),
        ),
    )
    cut = sections.where("page_id is not null and section_id is not null").select("page_id", "section_id", facts.alias("blocks"))
    # A page's own sections, as many as its body has headings.
    cut = cut.dropDuplicates(["page_id", "section_id"]).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("section_id", "blocks"))).alias("cut"))
    judged = cut.join(flagged.dropDuplicates(["page_id"]), "page_id", "left").select("page_id", "cut", "prints", "common", "place", "around", "loose", "main")
    return judged.mapInArrow(_judged, "page_id long, section_id int, block_idx int")
