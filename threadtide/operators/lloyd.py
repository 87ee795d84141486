"""K-means with all restarts in one scan.

The centres of all restarts are stacked, so a step over the table serves every restart: a task measures its rows against
all centres, keeps sums, counts and costs per (restart, cluster) and hands on those alone. Seeding is
k-means|| for all restarts at once: a few scans that draw far rows by a hash of their values, and a weighted choice among the
drawn rows. Only centres and drawn rows (restarts times a few times k) pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED_ROUNDS, OVERSAMPLING = 4, 2  # k-means||: scans, and rows drawn in each as a multiple of k
ROWS = 2048  # that are measured at once
MIX = np.uint64(0x9E3779B97F4A7C15)
Batches = Iterator[pa.RecordBatch]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _draws(x: np.ndarray, restarts: int, turn: int) -> np.ndarray:
    """Numbers in [0, 1) per row and restart, from the row's values alone, so that a repeated task repeats them."""
    h = np.zeros(len(x), np.uint64)
    for j in range(x.shape[1]):
        h = (h ^ x[:, j].view(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
    h = (h[:, None] ^ np.uint64(turn * 1_000_003 + 1) ^ (np.arange(restarts, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[None, :]) * MIX
    h = (h ^ h >> np.uint64(32)) * MIX
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres."""
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :]
    return np.maximum(d, 0)


def _scan(vectors: DataFrame, run: Callable[[Batches], Batches]) -> DataFrame:
    return vectors.mapInArrow(run, "r int, c int, n double, cost double, v array<double>")


def _rows(r, c, n, cost, v: np.ndarray) -> pa.RecordBatch:
    at = pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1])
    return pa.RecordBatch.from_arrays(
        [pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(n, pa.float64()), pa.array(cost, pa.float64()),
         pa.ListArray.from_arrays(at, pa.array(v.ravel()))], names=["r", "c", "n", "cost", "v"])


def _pieces(batches: Batches) -> Iterator[np.ndarray]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            yield _matrix(batch.column(0).slice(low, ROWS))


def step(vectors: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and counts of each centre's rows and the cost of each restart, for centres (restart, cluster, dimension)."""
    restarts, k, dims = centres.shape
    flat = centres.reshape(-1, dims)

    def run(batches: Batches) -> Batches:
        sums, n, cost = np.zeros((restarts * k, dims)), np.zeros(restarts * k), np.zeros(restarts * k)
        for x in _pieces(batches):
            d = _distances(x, flat).reshape(len(x), restarts, k)
            best = d.argmin(axis=2) + np.arange(restarts) * k
            low = d.min(axis=2)
            for r in range(restarts):
                hit = np.zeros((restarts * k, len(x)))
                hit[best[:, r], np.arange(len(x))] = 1
                own = slice(r * k, r * k + k)
                sums[own] += hit[own] @ x
                n[own] += hit[own].sum(axis=1)
                cost[own] += hit[own] @ low[:, r]
        place = np.arange(restarts * k)
        yield _rows(place // k, place % k, n, cost, sums)

    parts = _scan(vectors, run)
    whole = parts.groupBy("r", "c").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"))
    cells = parts.select("r", "c", F.posexplode("v")).groupBy("r", "c", "pos").agg(F.sum("col").alias("s")).groupBy("r", "c").agg(
        F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("s"))  # one value per dimension
    sums, n, cost = np.zeros((restarts, k, dims)), np.zeros((restarts, k)), np.zeros(restarts)
    for row in whole.join(cells, ["r", "c"]).collect():
        n[row["r"], row["c"]] = row["n"]
        cost[row["r"]] += row["cost"]
        sums[row["r"], row["c"]] = [x["s"] for x in row["s"]]
    return sums, n, cost


def seeds(vectors: DataFrame, k: int, restarts: int, seed: int) -> np.ndarray:
    """First centres by k-means||."""
    first = [np.array(r[0], float) for r in vectors.select("v").orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(restarts).collect()]
    if not first:
        raise ValueError("no rows to cluster")
    drawn = [[first[r % len(first)]] for r in range(restarts)]
    for turn in range(SEED_ROUNDS):
        stacks = [np.array(d) for d in drawn]

        def totals(batches: Batches, stacks=stacks) -> Batches:
            cost = np.zeros(restarts)
            for x in _pieces(batches):
                cost += [_distances(x, s).min(axis=1).sum() for s in stacks]
            place = np.arange(restarts)
            yield _rows(place, place * 0, cost * 0, cost, np.zeros((restarts, 1)))

        whole = {r["r"]: r["t"] for r in _scan(vectors, totals).groupBy("r").agg(F.sum("cost").alias("t")).collect()}

        def far(batches: Batches, stacks=stacks, whole=whole, turn=turn) -> Batches:
            for x in _pieces(batches):
                low = np.stack([_distances(x, s).min(axis=1) for s in stacks], axis=1)
                share = OVERSAMPLING * k * low / np.maximum([whole[r] for r in range(restarts)], 1e-300)
                i, r = np.nonzero(_draws(x, restarts, seed + turn) < share)
                if len(i):
                    yield _rows(r, r * 0, r * 0.0, r * 0.0, x[i])

        # about OVERSAMPLING * k rows of each restart; equal rows are drawn together and count once
        for row in _scan(vectors, far).select("r", "v").distinct().orderBy("r", "v").collect():
            drawn[row["r"]].append(np.array(row["v"]))

    stacks = [np.unique(np.array(d), axis=0) for d in drawn]
    most = max(len(s) for s in stacks)
    padded = np.stack([np.concatenate([s, np.repeat(s[:1], most - len(s), axis=0)]) for s in stacks])
    _, n, _ = step(vectors, padded)
    return np.stack([_chosen(s, w[: len(s)], k, np.random.default_rng([seed, r])) for r, (s, w) in enumerate(zip(stacks, n))])


def _chosen(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of a few weighted points by k-means++; a point stands twice where there are fewer."""
    picked = [points[rng.choice(len(points), p=weights / weights.sum())]]
    while len(picked) < k:
        far = weights * _distances(points, np.array(picked)).min(axis=1)
        picked.append(points[rng.choice(len(points), p=far / far.sum())] if far.sum() > 0 else points[0])
    return np.array(picked)


def fit(df: DataFrame, vector: str, k: int = 2, restarts: int = 10, seed: int = 42, steps: int = 20,
        tolerance: float = 1e-4) -> tuple[np.ndarray, float, np.ndarray]:
    """The centres of the restart with the lowest cost, in order of their coordinates, that cost, and the costs of all restarts."""
    vectors = df.select(F.transform(vector, lambda x: x.cast("double")).alias("v")).where("v IS NOT NULL").persist()
    try:
        centres = seeds(vectors, k, restarts, seed)
        for _ in range(steps):
            sums, n, _ = step(vectors, centres)
            moved = np.where(n[:, :, None] > 0, sums / np.maximum(n, 1)[:, :, None], centres)
            far = ((moved - centres) ** 2).sum(axis=2).max()
            centres = moved
            if far <= tolerance**2:
                break
        _, _, cost = step(vectors, centres)
    finally:
        vectors.unpersist()
    best = int(np.flatnonzero(cost <= cost.min() * (1 + 1e-9))[0])  # sums differ a little with the partitioning
    return centres[best][np.lexsort(centres[best].T[::-1])], float(cost[best]), cost
