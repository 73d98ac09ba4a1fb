"""Exact top-k search by inner product as a Voronoi kNN join.

Components become floor(256 x), so scores are whole numbers. Rows are grouped by their nearest pivot,
queries alike. A query's k-th best score among the pivots (rows themselves, its own left out) is a
floor for its result; a query group keeps its radius, its longest query and its least floor as a
summary. A data row x can only matter to the group at pivot h if one of two bounds reaches the floor:

    q.x <= h.x + R |x|          R: radius of the query group
    q.x <= h.g + R |g| + N d    g, d: pivot of x and its distance; N: longest query of the group

and is replicated only to blocks of groups that need it. A block and a slice of the rows meet in one
task, which holds the block's queries and streams the rows, with each query's running k-th score in
place of the floor. Lists of the slices are merged by rank. Hot groups are cut: queries of a large
group are dealt into several blocks, rows into slices by a hash of their number.

Pivots come from a bounded sample of about ``SAMPLE`` times as many rows by a hash of the row; they steer
the work only, results are exact with any. Their number grows with the root of the table to
``MAX_PIVOTS``, so the summaries that the driver holds are bounded.

Defined results
* Vectors null or with a null or non-finite component take no part; vectors of different lengths never meet.
* Ties go to the smaller id, null ids last, then in no set order; a null id is no query but a candidate.
* Rows that repeat an id are queries of their own and candidates of each other; only the row itself is left out.
* Fewer rows than k give all. Empty tables give an empty result; other columns are ignored.
* Scores beyond 64 bits count as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from haptrace.session import cut_lineage

K = 5
SCALE = 256.0
MIN_PIVOTS, MAX_PIVOTS = 16, 512
SAMPLE = 4
# Queries of a block, and rows of a slice beyond the session's parallelism.
BLOCK_QUERIES = 4096
SLICE_ROWS = 1_000_000
# Scores that a task holds at once.
CELLS = 1 << 20
EXACT = float(1 << 53)
SMALL = float(1 << 24)


def sound(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in four bytes each where that is exact, else in eight."""
    small = not len(values) or np.abs(values).max() <= SMALL
    return values.astype(np.float32 if small else np.float64).tobytes()


def unpacked(raw: list[bytes], size: int) -> np.ndarray:
    out = np.empty((len(raw), size))
    for n, b in enumerate(raw):
        out[n] = np.frombuffer(b, np.float32 if len(b) == 4 * size else np.float64)
    return out


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in double precision where no partial sum can pass 2^53."""
    if not len(queries) or not len(rows):
        return np.zeros((len(queries), len(rows)))
    reach = np.linalg.norm(queries, axis=1).max() * np.linalg.norm(rows, axis=1).max()
    if reach < EXACT:
        return queries @ rows.T
    whole = np.array([[int(x) for x in v] for v in queries], dtype=object) @ np.array([[int(x) for x in v] for v in rows], dtype=object).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Pivots:
    """Pivot vectors by dimension; a dimension without any has the origin."""

    def __init__(self, found: dict[int, np.ndarray]):
        self.found = found

    def of(self, size: int) -> np.ndarray:
        return self.found.get(size, np.zeros((1, size)))


def choose_pivots(rows: DataFrame, n: int, count: int) -> Pivots:
    share = min(1.0, SAMPLE * count / max(1, n))
    chance = F.pmod(F.xxhash64("row", F.lit("pivot")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.filter(chance < share).select("size", "vector", chance.alias("c")).orderBy("c").limit(2 * SAMPLE * count).collect()
    found: dict[int, list[bytes]] = {}
    for r in drawn:
        if len(found.setdefault(r["size"], [])) < count:
            found[r["size"]].append(bytes(r["vector"]))
    return Pivots({size: unpacked(raw, size) for size, raw in found.items()})


def _by_size(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        sizes = np.array(batch.column("size"))
        for size in np.unique(sizes):
            part = batch.filter(pa.array(sizes == size))
            yield part, int(size), unpacked(part.column("vector").to_pylist(), int(size))


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, size, vector): floor(256 x) of every sound vector, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.floor(SCALE * np.asarray(v, dtype=np.float64)) + 0.0 for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) for v in values], pa.int32()), pa.array([packed(v) for v in values], pa.binary())],
                                             names=["id", "size", "vector"])

    picked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter(sound(F.col("vector")))
    return picked.mapInArrow(run, "id bigint, size int, vector binary")


def assign(rows: DataFrame, pivots: Pivots, k: int) -> DataFrame:
    """Adds the nearest pivot (cell), its distance, the vector's length and the floor of its k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, size, x in _by_size(batches):
            p = pivots.of(size)
            for at in range(0, len(x), max(1, CELLS // len(p))):
                some = slice(at, at + max(1, CELLS // len(p)))
                dots = x[some] @ p.T
                far = (x[some] ** 2).sum(axis=1)[:, None] - 2 * dots + (p ** 2).sum(axis=1)[None, :]
                cell = far.argmin(axis=1)
                gap = np.linalg.norm(x[some] - p[cell], axis=1)
                # The query itself may be one of the pivots, so one more is asked for.
                known = size in pivots.found and len(p) > k
                floor = np.partition(dots, -k - 1, axis=1)[:, -k - 1] if known else np.full(len(dots), -np.inf)
                norm = np.linalg.norm(x[some], axis=1)
                # Below any rounding, and not beyond what a long can hold.
                floor = np.minimum(floor - 1e-9 * norm * np.linalg.norm(p, axis=1).max(), 9.2e18)
                piece = part.slice(at, len(dots))
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(cell.astype(np.int32)), pa.array(gap), pa.array(norm), pa.array(floor)],
                    names=[*piece.schema.names, "cell", "gap", "norm", "floor"])

    return rows.mapInArrow(run, "row bigint, id bigint, size int, vector binary, cell int, gap double, norm double, floor double")


class Groups:
    """Summaries of the query groups, and the block of queries that each belongs to."""

    def __init__(self, summaries: list, block_queries: int):
        self.first: dict[tuple[int, int], int] = {}
        self.parts: dict[tuple[int, int], int] = {}
        self.of_size: dict[int, list] = {}
        block, room = -1, 0
        for s in sorted(summaries, key=lambda r: (r["size"], r["cell"])):
            key = (s["size"], s["cell"])
            if s["n"] > block_queries:
                self.parts[key] = -(-s["n"] // block_queries)
                self.first[key], block, room = block + 1, block + self.parts[key], 0
            else:
                if s["n"] > room:
                    block, room = block + 1, block_queries
                self.parts[key], self.first[key], room = 1, block, room - s["n"]
            self.of_size.setdefault(s["size"], []).append(s)
        self.blocks = block + 1


def loosened(bound: np.ndarray, scale: np.ndarray | float) -> np.ndarray:
    """An upper bound that rounding can't push below the exact value."""
    return bound + 1e-9 * scale + 1e-6


def replicate(rows: DataFrame, pivots: Pivots, groups: Groups, slices: int) -> DataFrame:
    """(block, slice, kind, row, id, size, vector, gap, cell, floor): queries (kind 0) in every slice of their block, rows (kind 1) where they may matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, size, x in _by_size(batches):
            found = groups.of_size.get(size)
            if found is None:
                continue
            p = pivots.of(size)
            cells = np.array([s["cell"] for s in found])
            radius, longest, floor = (np.array([s[c] for s in found]) for c in ("radius", "longest", "floor"))
            first = np.array([groups.first[size, c] for c in cells.tolist()])
            copies = np.array([groups.parts[size, c] for c in cells.tolist()])
            norm, gap = np.array(part.column("norm")), np.array(part.column("gap"))
            own = np.array(part.column("cell"))
            length = np.linalg.norm(p, axis=1)
            around = p[cells] @ p.T + radius[:, None] * length[None, :]
            for at in range(0, len(x), max(1, CELLS // len(cells))):
                some = slice(at, at + max(1, CELLS // len(cells)))
                through_query = x[some] @ p[cells].T + norm[some][:, None] * radius[None, :]
                through_row = around.T[own[some]] + gap[some][:, None] * longest[None, :]
                reach = norm[some][:, None] * (radius + length[cells])[None, :] + gap[some][:, None] * longest[None, :]
                need = loosened(np.minimum(through_query, through_row), reach) >= floor[None, :]
                r, g = np.nonzero(need)
                times = copies[g]
                r, inner = np.repeat(r, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                pairs = np.unique(np.stack([np.repeat(first[g], times) + inner, r]), axis=1)
                piece = part.slice(at, len(need))
                numbers = np.array(piece.column("row"))
                yield laid(piece.take(pa.array(pairs[1])), pairs[0], _mixed(numbers[pairs[1]]) % slices, 1)
            asks = np.array(part.column("query"))
            if asks.any():
                piece = part.filter(pa.array(asks))
                keys = [(size, c) for c in np.array(piece.column("cell")).tolist()]
                numbers = _mixed(np.array(piece.column("row")))
                block = np.array([groups.first[key] + n % groups.parts[key] for key, n in zip(keys, numbers.tolist())])
                for n in range(slices):
                    yield laid(piece, block, np.full(len(block), n), 0)

    def laid(piece: pa.RecordBatch, block: np.ndarray, at: np.ndarray, kind: int) -> pa.RecordBatch:
        names = ["row", "id", "size", "vector", "cell", "gap", "floor"]
        return pa.RecordBatch.from_arrays(
            [pa.array(block, pa.int32()), pa.array(at, pa.int32()), pa.array(np.full(len(block), kind), pa.int32()), *[piece.column(c) for c in names]],
            names=["block", "slice", "kind", *names])

    schema = "block int, slice int, kind int, row bigint, id bigint, size int, vector binary, cell int, gap double, floor double"
    return rows.mapInArrow(run, schema)


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """Row numbers scattered, so that neighbours fall into different slices."""
    mixed = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(33)).astype(np.int64)


NULL_LAST = (1 << 63) - 1


class Best:
    """The k best rows so far of a block's queries of one length."""

    def __init__(self, part: pa.RecordBatch, queries: np.ndarray, k: int):
        self.k, self.queries = k, queries
        self.rows, self.ids = np.array(part.column("row")), part.column("id").to_pylist()
        self.floor = np.array(part.column("floor"))
        self.norm = np.linalg.norm(queries, axis=1)
        none = np.zeros(0, np.int64)
        # Query number, score, id, null mark and row of the best found, ordered by query and place.
        self.held = (none, none, none, np.zeros(0, bool), none)

    def offer(self, part: pa.RecordBatch, x: np.ndarray, pivot: np.ndarray, far: float) -> None:
        bound = loosened(self.queries @ pivot + self.norm * far, self.norm * (np.linalg.norm(pivot) + far))
        able = np.flatnonzero(bound >= self.floor)
        rows = np.array(part.column("row"))
        ids = part.column("id")
        empty = np.array(ids.is_null())
        ids = np.array(ids.fill_null(NULL_LAST))
        step = max(1, CELLS // max(1, len(able)))
        for at in range(0, len(x), step):
            s = scores(self.queries[able], x[at:at + step])
            floor = self.floor[able]
            if s.shape[1] > self.k:
                own = self.rows[able][:, None] == rows[None, at:at + step]
                floor = np.maximum(floor, np.partition(np.where(own, s.min(axis=1)[:, None], s), -self.k, axis=1)[:, -self.k])
            q, r = np.nonzero(s >= floor[:, None])
            value, r = s[q, r].astype(np.int64), r + at
            q = able[q]
            other = self.rows[q] != rows[r]
            self._merge(q[other], value[other], ids[r[other]], empty[r[other]], rows[r[other]])

    def _merge(self, *new: np.ndarray) -> None:
        if not len(new[0]):
            return
        q, value, ids, empty, rows = (np.concatenate(pair) for pair in zip(self.held, new))
        # ~value turns the order around without overflow at the smallest long.
        order = np.lexsort((rows, ids, empty, ~value, q))
        q = q[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        kept = order[place < self.k]
        self.held = tuple(c[kept] for c in (np.concatenate(pair) for pair in zip(self.held, new)))
        full = place == self.k - 1
        self.floor[q[full]] = np.maximum(self.floor[q[full]], value[order[full]])


def solve(laid: DataFrame, pivots: Pivots, k: int) -> DataFrame:
    """(q_row, query_id, vec_id, row, score): per query and slice its k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, {}
        for batch in batches:
            keys = np.stack([np.array(batch.column(c)) for c in ("block", "slice", "kind", "size", "cell")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                block, part_of, kind, size, cell = keys[:, start].tolist() if batch.num_rows else [None] * 5
                if block is None:
                    continue
                if (block, part_of) != at:
                    yield from given(best)
                    at, best = (block, part_of), {}
                part = batch.slice(start, end - start)
                x = unpacked(part.column("vector").to_pylist(), size)
                if kind == 0:
                    best.setdefault(size, []).append((part, x))
                elif size in best:
                    if isinstance(best[size], list):
                        best[size] = Best(pa.Table.from_batches([p for p, _ in best[size]]).combine_chunks().to_batches()[0], np.concatenate([v for _, v in best[size]]), k)
                    best[size].offer(part, x, pivots.of(size)[cell], float(np.array(part.column("gap")).max()))
        yield from given(best)

    def given(best: dict) -> Iterator[pa.RecordBatch]:
        for b in best.values():
            if isinstance(b, Best):
                q, value, ids, empty, rows = b.held
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.rows[q]), pa.array([b.ids[n] for n in q], pa.int64()), pa.array(ids, mask=empty), pa.array(rows), pa.array(value)],
                    names=["q_row", "query_id", "vec_id", "row", "score"])

    dealt = laid.repartition("block", "slice").sortWithinPartitions("block", "slice", "kind", "size", "cell")
    return dealt.mapInArrow(run, "q_row bigint, query_id bigint, vec_id bigint, row bigint, score bigint")


def top_k(vectors: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
          block_queries: int = BLOCK_QUERIES, slice_rows: int = SLICE_ROWS, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of every row for which ``asks``, a condition on ``id``, holds."""
    spark = vectors.sparkSession
    rows = cut_lineage(quantised(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()).select("row", "id", "size", "vector"))
    n = rows.count()
    count = pivots or int(np.clip(n ** 0.5 / 2, MIN_PIVOTS, MAX_PIVOTS))
    chosen = choose_pivots(rows, n, count)
    placed = cut_lineage(assign(rows, chosen, k)).withColumn("query", F.coalesce(asks, F.lit(False)))
    found = placed.filter("query").groupBy("size", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"), F.max("norm").alias("longest"), F.min("floor").alias("floor")).collect()
    groups = Groups(found, block_queries)
    if not groups.blocks:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    slices = max(1, spark.sparkContext.defaultParallelism // groups.blocks, -(-n // slice_rows))
    lists = solve(replicate(placed, chosen, groups, slices), chosen, k)
    order = W.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("row"))
    ranked = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
