"""Mixing sources to target shares of all tokens by balanced sampling.

The total is the largest at which no source would be used more than its max_repeats times (or the one
asked for, if smaller). A source's documents are all used the same whole number of times, and once more
with the same fraction as probability. Which ones get the extra use is drawn by the cube method: inclusion
probabilities move along directions in which neither the tokens nor the number of documents of a source
change, until they are 0 or 1. The flight runs in blocks of bounded size; each block leaves at most two
undecided documents, which fly again together with those of other blocks. The last ones of a source land
where the tokens come closest to the target, and a few single documents make up for the rest.

A document's source and a target's mix_source are compared without outer spaces and letter case; documents
without a source, of a source without a target, or without tokens are not used. Targets without documents
get no tokens and their weight is not shared out; of repeated targets the largest weight counts; null or
non-positive weights or repeats are no targets. Repeated rows of one doc_id count once. Extra columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.tokens import TOKENIZER, token_sizes
from folioscope.sources.staging import stage

#: Documents that fly together.
BLOCK = 8_192
EPS = 1e-9


def source_key(source: Column) -> Column:
    return F.lower(F.trim(source))


def flight(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after moving within the null space of (tokens, 1); at most two stay between 0 and 1."""
    p, t = p.tolist(), tokens.astype(float).tolist()
    draws = iter(rng.random(3 * len(p) + 8).tolist())
    active: list[int] = []
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = float(round(p[i]))
            continue
        active.append(i)
        while len(active) == 3:
            a, b, c = active
            u = (t[b] - t[c], t[c] - t[a], t[a] - t[b])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for x, k in zip(u, active):
                if x > 0:
                    up, down = min(up, (1 - p[k]) / x), min(down, p[k] / x)
                elif x < 0:
                    up, down = min(up, p[k] / -x), min(down, (1 - p[k]) / -x)
            step = up if next(draws) * (up + down) < down else -down
            for x, k in zip(u, active):
                p[k] += step * x
                if p[k] <= EPS:
                    p[k] = 0.0
                elif p[k] >= 1 - EPS:
                    p[k] = 1.0
            active = [k for k in active if 0.0 < p[k] < 1.0]
    return np.array(p)


def landing(p: np.ndarray, tokens: np.ndarray, want: float, free: np.ndarray) -> np.ndarray:
    """The last undecided documents, rounded to come closest to the tokens wanted; what is still missing or too
    much is made up by single documents among the free ones, each time the one of the fittest length, until none
    brings the tokens closer."""
    open_ = np.nonzero((p > 0) & (p < 1))[0]
    out = p.copy()
    if len(open_):
        rest = want - float(np.delete(p, open_) @ np.delete(tokens, open_))
        ends = sorted(itertools.product((0.0, 1.0), repeat=len(open_)), key=lambda e: (abs(np.dot(e, tokens[open_]) - rest), e))
        out[open_] = ends[0]
    while True:
        over = float(out @ tokens) - want
        at = np.nonzero(free & (out == (1.0 if over > 0 else 0.0)))[0]
        if not len(at):
            break
        best = at[np.argmin(np.abs(abs(over) - tokens[at]))]
        if abs(abs(over) - tokens[best]) >= abs(over):
            break
        out[best] = 1.0 - out[best]
    return out


def _fly(rows: DataFrame, seed: int, last: bool) -> DataFrame:
    """One round of flights, a task for each (mix_source, block); the last round lands as well."""

    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table
        # The longest first, so that the documents left for the landing are the shortest.
        order = np.lexsort((table.column("doc_id").to_numpy(), table.column("turn").to_numpy(), -table.column("n_tokens").to_numpy()))
        table = table.take(pa.array(order))
        source, block = table.column("mix_source")[0].as_py(), table.column("block")[0].as_py()
        rng = np.random.default_rng([seed, zlib.crc32(source.encode()), block])
        tokens, p = table.column("n_tokens").to_numpy().astype(float), table.column("p").to_numpy().astype(float)
        want, free = float(p @ tokens), (p > EPS) & (p < 1 - EPS)
        p = flight(p, tokens, rng)
        if last:
            p = landing(p, tokens, want, free)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))

    return rows.groupBy("mix_source", "block").applyInArrow(run, rows.schema)


def mixed(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER, seed: int = 7) -> DataFrame:
    """doc_id, mix_source, n_tokens, uses of every document that is used."""
    goal = _targets(targets)
    keyed = token_sizes(documents, "source", tokenizer=tokenizer).withColumn("mix_source", source_key(F.col("source"))).where("n_tokens > 0")
    # The targets are a short list that the user wrote; their sums are as many rows.
    keyed = keyed.join(F.broadcast(goal), "mix_source")
    sums = keyed.groupBy("mix_source", "target_weight", "max_repeats").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()
    if not sums:
        return keyed.select("doc_id", "mix_source", "n_tokens", F.lit(0).alias("uses"))
    total = min(r["max_repeats"] * r["tokens"] / r["target_weight"] for r in sums)
    total = total if total_tokens is None else min(total, total_tokens)
    mean = {r["mix_source"]: min(float(r["max_repeats"]), r["target_weight"] * total / r["tokens"]) for r in sums}
    blocks = {r["mix_source"]: -(-r["n"] // BLOCK) for r in sums}
    plan = F.broadcast(documents.sparkSession.createDataFrame([(s, mean[s], blocks[s]) for s in mean], "mix_source string, mean double, blocks int"))
    rows = keyed.join(plan, "mix_source").select(
        "doc_id", "mix_source", "n_tokens", F.floor(F.col("mean") + EPS).cast("int").alias("base"), F.xxhash64("doc_id", F.lit(seed)).alias("turn"),
        F.greatest(F.lit(0.0), F.col("mean") - F.floor(F.col("mean") + EPS)).alias("p"),
        F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"),
    )
    decided = None
    most = max(blocks.values())
    while True:
        last = most <= 1
        flown = stage(_fly(rows, seed, last), "flight")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done = flown if last else flown.where(~open_)
        decided = done if decided is None else decided.unionByName(done)
        if last:
            break
        most = -(-2 * most // BLOCK)
        rows = flown.where(open_).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(most)).cast("int"))
    uses = F.col("base") + F.round("p").cast("int")
    return decided.select("doc_id", "mix_source", "n_tokens", uses.alias("uses")).where("uses > 0")


def _targets(targets: DataFrame) -> DataFrame:
    good = targets.where("mix_source is not null and target_weight > 0 and max_repeats > 0")
    best = good.groupBy(source_key(F.col("mix_source")).alias("mix_source")).agg(F.max(F.struct("target_weight", "max_repeats")).alias("t"))
    return best.select("mix_source", "t.target_weight", "t.max_repeats")


def mix_report(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_source, target_weight, max_repeats, documents, uses, tokens, share, most_uses: one row for each target."""
    used = selection.groupBy("mix_source").agg(
        F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.max("uses").alias("most_uses")
    )
    rows = _targets(targets).join(used, "mix_source", "left").na.fill(0, ["documents", "uses", "tokens", "most_uses"])
    # One row for each target.
    share = F.coalesce(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy())), F.lit(0.0))
    return rows.withColumn("share", share)
