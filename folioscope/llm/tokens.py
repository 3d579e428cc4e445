"""Sizes of texts in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.sources.staging import stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How this tokenizer's vocabulary expects a text to be cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose sizes a worker remembers before it starts afresh.
REMEMBERED = 500_000

_counters: dict[str, Callable[[str], int]] = {}


def counter(path: str = TOKENIZER) -> Callable[[str], int]:
    """The number of tokens of a text. Pieces are merged one by one, so each piece's size is worked out once."""
    if path not in _counters:
        import regex
        import tiktoken
        from pyspark import SparkFiles

        # Where the machine lacks the file, the one that came with the job.
        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        find = regex.compile(PATTERN).findall
        sizes: dict[str, int] = {}

        def count(text: str) -> int:
            total = 0
            for piece in find(text):
                n = sizes.get(piece)
                if n is None:
                    if len(sizes) > REMEMBERED:
                        sizes.clear()
                    n = sizes[piece] = len(encode(piece))
                total += n
            return total

        _counters[path] = count
    return _counters[path]


def token_sizes(documents: DataFrame, *keep: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Staged doc_id, n_tokens and the columns to keep; null texts and empty ones have 0, null ids are left out.

    Rows that repeat a doc_id count once, with the largest size.
    """
    context = documents.sparkSession.sparkContext
    if not context.master.startswith("local"):
        context.addFile(tokenizer)
    rows = documents.where("doc_id is not null").select("doc_id", "text", *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            sizes = pa.array([count(t) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())
            others = [batch.column(i) for i in range(batch.num_columns) if i != 1]
            names = [n for i, n in enumerate(batch.schema.names) if i != 1]
            yield pa.RecordBatch.from_arrays([*others, sizes], names=[*names, "n_tokens"])

    sized = rows.mapInArrow(run, f"{kinds}, n_tokens long")
    last = F.max(F.struct("n_tokens", *keep)).alias("r")
    return stage(sized.groupBy("doc_id").agg(last).select("doc_id", "r.n_tokens", *[f"r.{k}" for k in keep]), "sizes")
