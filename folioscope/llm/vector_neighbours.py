"""The k most similar vectors of every vector: an inverted file with product-quantised residuals.

Coarse centroids and codebooks are fitted on a bounded sample (see Index); every vector is indexed. A vector is compared with the members of its nearest cells by asymmetric
distance tables on their codes; the Index.rerank best of each cell and block are compared exactly, and the
best k over all cells stay. Cells are cut into blocks of bounded size on the side of the members and of
the vectors asking, so a cell that holds a third of all rows is worked on by many tasks.

Only rows with status `ready` and a vector count, of those with one space_id and chunk_id the latest
updated_at (null is the oldest; of ties the largest embedding_id). Vectors of different length in one
space are never compared. Vectors of zero or not finite length have no direction and take no part. Equal
directions are indexed once and keep their k+1 smallest ids, which are all that can be in a result. Ties
of the similarity, rounded to 9 decimals, go to the smaller embedding_id. Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.sources.staging import small_or_shuffled, stage


@dataclass(frozen=True)
class Index:
    """sample: unit vectors of a space that the top cells (at most top_cells) and codebooks are fitted on; fit_rows: how
    many of a cell's own vectors one task cuts it by, where there shall be more cells. All vectors are indexed. A vector
    probes its nearest cells: probes at least (more where they hold fewer than least_members), most_probes at most, and those whose centroid is farther than the first by
    at most slack mean square distances."""

    sample: int = 20_000
    rounds: int = 8
    cells_per_root: float = 4.0
    top_cells: int = 4_096
    fit_rows: int = 8_192
    parts: int = 16
    codes: int = 256
    probes: int = 6
    least_members: int = 128
    most_probes: int = 48
    slack: float = 0.5
    rerank: int = 24
    member_block: int = 4_096
    asker_block: int = 4_096
    seed: int = 11


def ready_vectors(rows: DataFrame) -> DataFrame:
    """space_id, dim, embedding_id, vector of the rows that count."""
    rows = rows.where("status = 'ready' and vector is not null and embedding_id is not null and size(vector) > 0")
    rows = rows.select("space_id", "chunk_id", "embedding_id", "updated_at", "vector")
    newest = rows.groupBy("space_id", "chunk_id").agg(F.max(F.struct("updated_at", "embedding_id", "vector")).alias("r"))
    return newest.select("space_id", F.size("r.vector").alias("dim"), "r.embedding_id", "r.vector")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes of 64-bit numbers; rows without a direction are left out."""
    for batch in batches:
        space, dim, ids, vectors = (batch.column(i) for i in range(4))
        dims = dim.to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(dims)])
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        for d in np.unique(dims):
            at = np.nonzero(dims == d)[0]
            m = np.nan_to_num(flat[starts[at][:, None] + np.arange(d)], nan=np.inf).astype(float)
            scale = np.max(np.abs(m), axis=1, keepdims=True)
            ok = np.isfinite(scale[:, 0]) & (scale[:, 0] > 0)
            at, m = at[ok], m[ok] / scale[ok]
            unit = np.round(m / np.linalg.norm(m, axis=1, keepdims=True), 13) + 0.0
            take = pa.array(at)
            packed = pa.array([u.tobytes() for u in unit], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [space.take(take), dim.take(take), ids.take(take), packed], names=["space_id", "dim", "embedding_id", "unit"]
            )


def directions(vectors: DataFrame, k: int) -> DataFrame:
    """One row for each direction of a space: did (its smallest id), ids (its k+1 smallest ids) and unit."""
    packed = vectors.mapInArrow(_pack, "space_id string, dim int, embedding_id long, unit binary")
    # Two rounds, so that a direction shared by a third of all rows is first reduced in 64 parts.
    salted = packed.withColumn("salt", F.pmod("embedding_id", F.lit(64)))
    keys = ["space_id", "dim", "unit"]
    order = Window.partitionBy(*keys, "salt").orderBy("embedding_id")
    few = salted.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    order = Window.partitionBy(*keys).orderBy("embedding_id")
    few = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    return few.groupBy(*keys).agg(F.min("embedding_id").alias("did"), F.array_sort(F.collect_list("embedding_id")).alias("ids"))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def fit(units: DataFrame, index: Index) -> dict[tuple[str | None, int], tuple]:
    """Of each space and dimension: centroids, codebooks, the bounds of the parts, the mean square distance from a
    vector to its centroid and the mean number of members of a cell, from a bounded sample.

    The number of cells grows with the root of the number of vectors. Where that is more than the sample can tell
    apart, every cell of the sample is cut further by vectors of its own, on the cluster.
    """
    sizes = units.groupBy("space_id", "dim").agg(F.count("*").alias("n")).collect()
    models = {}
    rng = np.random.default_rng(index.seed)
    for row in sizes:
        share = 4.0 * index.sample / row["n"]
        here = units.where(F.col("space_id").eqNullSafe(F.lit(row["space_id"])) & (F.col("dim") == row["dim"]))
        part = here.where(F.pmod(F.xxhash64("did"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)) if share < 1 else here
        taken = part.orderBy(F.xxhash64("did", F.lit(index.seed))).select("unit").limit(index.sample).toArrow().column(0).to_pylist()
        x = np.frombuffer(b"".join(taken)).reshape(len(taken), row["dim"]).astype(np.float32)
        wanted = max(1, int(index.cells_per_root * row["n"] ** 0.5))
        c = _kmeans(x, min(wanted, max(1, len(x) // 4), index.top_cells), index.rounds, rng)
        if wanted > len(c) and row["n"] > len(x):
            c = _cut_further(here, c, wanted, row["n"], row["dim"], index)
        rest = x - c[np.argmax(x @ c.T - (c * c).sum(1) / 2, axis=1)]
        parts = min(index.parts, row["dim"])
        bounds = np.linspace(0, row["dim"], parts + 1).astype(int)
        books = [_kmeans(rest[:, a:b], index.codes, index.rounds, rng) for a, b in zip(bounds, bounds[1:])]
        models[(row["space_id"], row["dim"])] = (c, books, bounds, float((rest * rest).sum(1).mean()) if len(rest) else 0.0, row["n"] / len(c))
    return models


def _cut_further(here: DataFrame, top: np.ndarray, wanted: int, n: int, dim: int, index: Index) -> np.ndarray:
    """About `wanted` centroids: those of each top cell, as many as its share of vectors asks for, fitted on some 16 of
    its own vectors for each. Only the centroids come to the driver."""
    shared = here.sparkSession.sparkContext.broadcast(top)
    share = min(1.0, 16.0 * wanted / n)
    own = here.where(F.pmod(F.xxhash64("did", F.lit(7)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)).select("unit", "did")

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), np.arange(batch.num_rows), dim).astype(np.float32)
                cell = _nearest(x, shared.value, 1)[:, 0].astype(np.int32)
                # A cell with many vectors is fitted in several parts; each gives its share of centroids.
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(1), batch.column(0)], names=["cell", "did", "unit"])

    placed = stage(own.mapInArrow(place, "cell int, did long, unit binary"), "placed")
    counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    most = index.fit_rows
    parts = F.create_map(*[F.lit(v) for cell, held in counts.items() for v in (cell, -(-held // most))])
    split = placed.withColumn("part", F.pmod(F.xxhash64("did", F.lit(8)), F.coalesce(F.try_element_at(parts, "cell"), F.lit(1))).cast("int"))

    def cut(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        x = _matrix(table.column("unit").combine_chunks(), np.arange(table.num_rows), dim).astype(np.float32)
        k = max(1, round(wanted * table.num_rows / total))
        c = _kmeans(x, min(k, max(1, len(x) // 4)), index.rounds, np.random.default_rng([index.seed, cell]))
        return pa.table([pa.array([r.tobytes() for r in c], pa.binary())], names=["center"])

    found = split.groupBy("cell", "part").applyInArrow(cut, "center binary").toArrow().column(0).to_pylist()
    return np.frombuffer(b"".join(found), np.float32).reshape(len(found), dim)


def _nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    score = x @ c.T - (c * c).sum(1) / 2
    n = min(n, score.shape[1])
    return np.argpartition(-score, n - 1, axis=1)[:, :n] if n < score.shape[1] else np.argsort(-score, axis=1)


def _probes(x: np.ndarray, c: np.ndarray, spread: float, least: int, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Which row probes which cell: its nearest ones, as many as are hardly farther than the first; more where
    centroids lie close together, as in a dense cluster, than where they lie apart."""
    rows, cells = [], []
    for start in range(0, len(x), 1024):
        part = x[start : start + 1024]
        near = _nearest(part, c, max(least, index.most_probes))
        far = (c * c).sum(1)[near] - 2 * np.einsum("qd,qnd->qn", part, c[near])
        order = np.argsort(far, axis=1)
        near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
        keep = (far <= far[:, :1] + index.slack * spread) | (np.arange(far.shape[1]) < least)
        r, k = np.nonzero(keep)
        rows.append(r + start)
        cells.append(near[r, k])
    return np.concatenate(rows), np.concatenate(cells)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
    names = batch.column(0).to_pylist()
    dims = batch.column(1).to_pylist()
    by: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(names, dims)):
        by.setdefault(key, []).append(i)
    for key, at in by.items():
        yield key, np.array(at)


def _matrix(column: pa.Array, at: np.ndarray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist())).reshape(len(at), dim)


def assigned(units: DataFrame, models, index: Index) -> tuple[DataFrame, DataFrame]:
    """members (cell and codes of every direction) and askers (every direction in each cell it probes)."""
    shared = units.sparkSession.sparkContext.broadcast(models)

    def encode(batches):
        for batch in batches:
            for key, at in _groups(batch):
                c, books, bounds, *_ = shared.value[key]
                x = _matrix(batch.column(2), at, key[1])
                cell = _nearest(x.astype(np.float32), c, 1)[:, 0]
                rest = x.astype(np.float32) - c[cell]
                codes = np.stack([_nearest(rest[:, a:b], w, 1)[:, 0] for w, a, b in zip(books, bounds, bounds[1:])], axis=1)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(cell.astype(np.int32)), batch.column(3).take(take),
                     batch.column(2).take(take), pa.array([r.tobytes() for r in codes.astype(np.uint8)], pa.binary())],
                    names=["space_id", "dim", "cell", "did", "unit", "codes"],
                )

    def probe(batches):
        for batch in batches:
            for key, at in _groups(batch):
                c, _, _, spread, held = shared.value[key]
                least = max(index.probes, int(np.ceil(index.least_members / held)))
                row, cells = _probes(_matrix(batch.column(2), at, key[1]).astype(np.float32), c, spread, least, index)
                take = pa.array(at[row])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(cells.astype(np.int32)),
                     batch.column(3).take(take), batch.column(2).take(take)],
                    names=["space_id", "dim", "cell", "did", "unit"],
                )

    rows = units.select("space_id", "dim", "unit", "did")
    members = rows.mapInArrow(encode, "space_id string, dim int, cell int, did long, unit binary, codes binary")
    askers = rows.mapInArrow(probe, "space_id string, dim int, cell int, did long, unit binary")
    return members, askers


def _blocked(rows: DataFrame, counts: DataFrame, mine: str, others: str, at: str, other_at: str, salt: int) -> DataFrame:
    """Rows with their own block of the cell, repeated for each block of the other side."""
    joined = rows.join(counts, ["space_id", "dim", "cell"])
    own = F.pmod(F.xxhash64("did", F.lit(salt)), F.col(mine)).cast("int")
    return joined.withColumn(at, own).withColumn(other_at, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop(mine, others)


def _search_block(models, index: Index, keep: int):
    def search(key, asking: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([("did", pa.int64()), ("other", pa.int64()), ("likeness", pa.float64())])
        if not asking.num_rows or not held.num_rows:
            return schema.empty_table()
        space, dim, cell = key[0].as_py(), key[1].as_py(), key[2].as_py()
        c, books, bounds, *_ = models.value[(space, dim)]
        read = lambda t, n, kind=np.float64: np.frombuffer(b"".join(t.column(n).to_pylist()), kind).reshape(t.num_rows, -1)
        q, m, codes = read(asking, "unit"), read(held, "unit"), read(held, "codes", np.uint8)
        q_id, m_id = asking.column("did").to_numpy(), held.column("did").to_numpy()
        center, top = c[cell], min(index.rerank, len(m))
        found_q, found_m, found_s = [], [], []
        short = len(m) < index.codes
        # Of each part, the codewords whose distances are tabulated: all, or in a small block only the members' own.
        words = [w[codes[:, part]] if short else w for part, w in enumerate(books)]
        for start in range(0, len(q), 256):
            x = q[start : start + 256]
            rest = x.astype(np.float32) - center
            far = np.zeros((len(x), len(m)), np.float32)
            for part, (w, a, b) in enumerate(zip(words, bounds, bounds[1:])):
                table = (w * w).sum(1) - 2 * rest[:, a:b] @ w.T
                far += table if short else table[:, codes[:, part]]
            near = np.argpartition(far, top - 1, axis=1)[:, :top] if top < len(m) else np.broadcast_to(np.arange(len(m)), far.shape)
            if len(m) <= 8 * top:
                exact = np.take_along_axis(x @ m.T, near, 1)
            else:
                exact = np.einsum("qd,qnd->qn", x, m[near])
            exact = np.round(exact, 9)
            ids = m_id[near]
            order = np.lexsort((ids, -exact), axis=1)[:, :keep]
            found_q.append(np.repeat(q_id[start : start + 256], order.shape[1]))
            found_m.append(np.take_along_axis(ids, order, 1).reshape(-1))
            found_s.append(np.take_along_axis(exact, order, 1).reshape(-1))
        return pa.table([np.concatenate(found_q), np.concatenate(found_m), np.concatenate(found_s)], schema=schema)

    return search


def nearest_vectors(rows: DataFrame, k: int = 5, index: Index = Index()) -> DataFrame:
    """embedding_id, neighbour_id, likeness, place: the k most similar of every vector that counts."""
    vectors = ready_vectors(rows)
    vectors = stage(vectors, "vectors")
    units = stage(directions(vectors, k), "directions")
    models = fit(units, index)
    members, askers = assigned(units, models, index)
    members = stage(members, "cells")
    askers = stage(askers, "askers")
    cells = ["space_id", "dim", "cell"]
    # One row for each cell.
    asked = askers.groupBy(*cells).agg(F.ceil(F.count("*") / index.asker_block).cast("int").alias("asker_blocks"))
    counts = members.groupBy(*cells).agg(F.ceil(F.count("*") / index.member_block).cast("int").alias("member_blocks")).join(asked, cells)
    counts = small_or_shuffled(stage(counts, "blocks"))
    left = _blocked(askers, counts, "asker_blocks", "member_blocks", "a_block", "m_block", 1)
    right = _blocked(members, counts, "member_blocks", "asker_blocks", "m_block", "a_block", 2)
    by = [*cells, "a_block", "m_block"]
    shared = units.sparkSession.sparkContext.broadcast(models)
    hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_search_block(shared, index, k + 1), "did long, other long, likeness double")
    order = Window.partitionBy("did").orderBy(F.desc("likeness"), "other")
    best = hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    return _expanded(best, units, vectors, k)


def _expanded(best: DataFrame, units: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """From directions back to rows: each candidate direction stands for its smallest ids."""
    ids = units.select(F.col("did").alias("other"), F.explode("ids").alias("neighbour_id"))
    order = Window.partitionBy("did").orderBy(F.desc("likeness"), "neighbour_id")
    ranked = best.join(ids, "other").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    near = ranked.groupBy("did").agg(F.array_sort(F.collect_list(F.struct("n", "neighbour_id", "likeness"))).alias("near"))
    packed = vectors.mapInArrow(_pack, "space_id string, dim int, embedding_id long, unit binary")
    owners = packed.join(units.select(F.col("space_id").alias("s"), F.col("dim").alias("d"), F.col("unit").alias("u"), "did"),
                         F.col("space_id").eqNullSafe(F.col("s")) & (F.col("dim") == F.col("d")) & (F.col("unit") == F.col("u")))
    others = F.slice(F.filter("near", lambda x: x["neighbour_id"] != F.col("embedding_id")), 1, k)
    found = owners.select("embedding_id", "did").join(near, "did").select("embedding_id", F.posexplode(others).alias("at", "x"))
    return found.select("embedding_id", "x.neighbour_id", "x.likeness", (F.col("at") + 1).alias("place"))


def neighbour_pairs(rows: DataFrame, k: int = 5, index: Index = Index()) -> DataFrame:
    """embedding_a < embedding_b where at least one is among the other's k most similar."""
    found = nearest_vectors(rows, k, index)
    return found.select(
        F.least("embedding_id", "neighbour_id").alias("embedding_a"), F.greatest("embedding_id", "neighbour_id").alias("embedding_b")
    ).distinct()
