"""Exact top-k search by three-phase uniform threshold.

A score is an inner product of integer vectors. The components are dealt into `lists`
slices; a slice gives each pair of query and candidate a local score, and the score is the
sum of the local scores. Candidates lie in blocks of vectors that are near each other, so a
block's centre and radius bound the local scores that a query has in it. For each query:

1. Gather: a few probe blocks near the query report, for each list, its k best entries, whose
   scores are then worked out. The k-th best of them, tau, is a lower bound on the k-th best
   of all.
2. Broadcast a safe cutoff: list l passes local scores of at least
   c_l = mean_l + (tau - sum of means) / lists, and no less than what tau leaves when the other
   lists give as much as they can in the block. The cutoffs c_l add up to tau, so a candidate
   under the cutoff in every list scores less than tau and can't be among the k best. A list
   in which a block can't reach the cutoff is not looked at there.
3. Resolve: candidates at or over a cutoff are the sufficient entries; only their remaining
   lists are worked out, exactly, and the k best of a block go into the final merge.

Blocks of candidates and of queries meet once, by an equi-join on the cells of a grid whose
sides are chosen so that the copies of both together are few. No pair becomes a row unless it
may be a result.

Centres come from a sample of SAMPLE vectors; they change how much is skipped, not the result.

Defined results: vectors that are null, or hold a null or a non-finite component, or haven't
`dims` components, take no part; nor do rows with a null id. Components and scores beyond a
long are held at its limits, where they are ties. Rows with a
query's own id are never its candidates. Rows that repeat an id and a vector can fill
several ranks. Ties go to the smaller id. Fewer candidates than k: all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table

BLOCK = 4096
QUERY_BLOCK = 1024
LISTS = 2
#: Vectors from which the centres of CELLS cells are worked out on the driver.
SAMPLE, CELLS = 4096, 64
#: Each query gathers in the first PROBE_ROWS vectors of so many cells near it.
PROBES, PROBE_ROWS = 2, 1024
#: Cells of the grid of query and candidate blocks for each shuffle partition.
GRID_A_PARTITION = 4
LONG = 2**63
ENTRY = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("products", pa.int64())])
ENTRIES = "query_id long, vec_id long, score long, products long"


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, dims: int, scale: int = 256) -> DataFrame:
    """(id, vector array<long>): floor(scale * x) of each component; rows without a whole finite vector of dims go."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dims) & ~F.coalesce(bad, F.lit(True)))
    return whole.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("vector"))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("vector").flatten().to_numpy().reshape(b.num_rows, -1)


def centres(sample: np.ndarray, cells: int = CELLS, rounds: int = 8) -> np.ndarray:
    """Of at most `cells` clusters."""
    points = sample.astype(np.float64)
    middle = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)]
    for _ in range(rounds):
        of = _nearest(points, middle)
        sums = np.zeros_like(middle)
        np.add.at(sums, of, points)
        n = np.bincount(of, minlength=len(middle))
        middle = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], middle)
    return middle


def bounded_sample(rows: DataFrame, size: int) -> list:
    """At most `size` of the rows, spread over all of them; all, if there are no more.

    A part of each partition that is `size` rows of all together, with some to spare, is all that tasks send: however
    many they are, the driver gets no more.
    """
    n = rows.count()
    some = rows.sample(min(1.0, 1.25 * size / n), seed=1) if n > size else rows
    return some.orderBy(F.xxhash64("id", "vector"), "id").limit(size).collect()


def _nearest(points: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return ((middle**2).sum(axis=1) - 2 * points.astype(np.float64) @ middle.T).argmin(axis=1)


def _slices(dims: int, lists: int) -> list[slice]:
    edges = np.linspace(0, dims, min(lists, dims) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _assign(middle: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.append_column("cell", pa.array(_nearest(_matrix(b), middle).astype(np.int32)))

    return run


def _pack(size: int) -> Callable:
    """Packs rows (id, vector, cell, perhaps tau), sorted by cell, into blocks of one cell and at most `size` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cell = b.column("cell").to_numpy()
            edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), b.num_rows]
            for low, high in zip(edges[:-1], edges[1:]):
                for at in range(low, high, size):
                    part = b.slice(at, min(size, high - at))
                    v = _matrix(part)
                    most = max(-int(v.min()), int(v.max()))
                    kind = next(k for k in ("<i2", "<i4", "<i8") if k == "<i8" or most < 1 << 8 * int(k[2]) - 1)
                    tau = part.column("tau").to_numpy(zero_copy_only=False).astype(np.float64).tobytes() if "tau" in part.schema.names else b""
                    yield pa.RecordBatch.from_pydict(
                        {"cell": [int(cell[low])], "n": [part.num_rows], "ids": [part.column("id").to_numpy().astype(np.int64).tobytes()], "vectors": [v.astype(kind).tobytes()], "kind": [kind], "tau": [tau]},
                        schema=pa.schema([("cell", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("kind", pa.string()), ("tau", pa.binary())]),
                    )

    return run


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Stored blocks of rows, with a number. A cell is dealt over so many groups that one of average size fills a block."""
    salt = F.pmod(F.xxhash64("id"), F.lit(max(1, rows.count() // (CELLS * size))))
    dealt = rows.repartition("cell", salt).sortWithinPartitions("cell", "id")
    packed = dealt.mapInArrow(_pack(size), "cell int, n int, ids binary, vectors binary, kind string, tau binary")
    return materialise(packed.select("*", F.monotonically_increasing_id().alias("block")), "topk-blocks")


class Vectors:
    """A block as arrays."""

    def __init__(self, row: dict, prefix: str, dims: int):
        self.ids = np.frombuffer(row[f"{prefix}_ids"], np.int64)
        self.ints = np.frombuffer(row[f"{prefix}_vectors"], row[f"{prefix}_kind"]).reshape(-1, dims)
        self.floats = self.ints.astype(np.float64)
        self.tau = np.frombuffer(row[f"{prefix}_tau"], np.float64)

    def exact(self, i: int, other: Vectors, entries: np.ndarray) -> list[int]:
        """Inner products of vector i with entries of other, however large, held at the limits of a long."""
        return [max(-LONG, min(LONG - 1, x)) for x in (other.ints[entries].astype(object) @ self.ints[i].astype(object)).tolist()]


def _beyond_doubles(q: Vectors, c: Vectors, dims: int) -> bool:
    """Whether sums of products may pass 2**53, up to which doubles hold integers exactly."""
    return np.abs(q.floats).max(initial=0) * np.abs(c.floats).max(initial=0) * dims >= 2.0**53


def _best(scores, ids: np.ndarray, k: int) -> np.ndarray:
    """Of one query's candidates, the positions of the k best: larger score, then smaller id."""
    scores = np.asarray(scores, object if isinstance(scores, list) else None)
    if len(scores) <= k:
        keep = np.arange(len(scores))
    elif scores.dtype == object:
        keep = np.flatnonzero(scores >= sorted(scores)[-k])
    else:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    order = sorted(keep, key=lambda x: (-scores[x], ids[x]))
    return np.array(order[:k], np.int64)


def _entries(found: list[tuple[int, np.ndarray, list]], products: int) -> pa.RecordBatch:
    """Rows (query_id, vec_id, score), and one that counts the products that were worked out."""
    out = {"query_id": [None], "vec_id": [None], "score": [None], "products": [products]}
    for q_id, ids, scores in found:
        out["query_id"] += [q_id] * len(ids)
        out["vec_id"] += ids.tolist()
        out["score"] += [int(s) for s in scores]
        out["products"] += [None] * len(ids)
    return pa.RecordBatch.from_pydict(out, schema=ENTRY)


def gather(q: Vectors, c: Vectors, dims: int, lists: int, k: int) -> tuple[list, int]:
    """Phase 1 in a probe block: each query's k best of the entries that lead a list."""
    n = min(k + 1, len(c.ids))  # one more, as the query's own row may be among them
    leading = [np.argpartition(-(q.floats[:, s] @ c.floats[:, s].T), n - 1, axis=1)[:, :n] for s in _slices(dims, lists)]
    found = []
    for i, q_id in enumerate(q.ids.tolist()):
        seen = np.unique(np.concatenate([t[i] for t in leading]))
        seen = seen[c.ids[seen] != q_id]
        scores = q.exact(i, c, seen) if _beyond_doubles(q, c, dims) else c.floats[seen] @ q.floats[i]
        best = _best(scores, c.ids[seen], k)
        found.append((q_id, c.ids[seen[best]], [scores[x] for x in best]))
    return found, len(q.ids) * len(c.ids) * dims + sum(len(t[0]) for t in leading) * len(q.ids) * dims


def resolve(q: Vectors, c: Vectors, mean: np.ndarray, dims: int, lists: int, k: int) -> tuple[list, int]:
    """Phases 2 and 3 for a pair of blocks: each query's k best of the sufficient entries; and the products it took.

    q.tau is nan where fewer than k entries were gathered; everything passes then, and if tau is held at a long's limit.
    """
    slices = _slices(dims, lists)
    large = _beyond_doubles(q, c, dims)
    tau = np.where(np.isnan(q.tau) | (q.tau <= -(2.0**63)), -np.inf, q.tau)
    norms = np.column_stack([np.linalg.norm(q.floats[:, s], axis=1) for s in slices])
    middle = c.floats.mean(axis=0)
    radius = [np.linalg.norm(c.floats[:, s] - middle[s], axis=1).max() for s in slices]
    reach = [np.linalg.norm(c.floats[:, s], axis=1).max() for s in slices]
    # What doubles may be off by: in the bounds, and in products that they don't hold exactly.
    slack = 1e-12 * dims * norms * (np.array(reach) + np.array(radius)) + 1e-9
    slack += 1e-15 * np.abs(np.where(np.isinf(tau), 0, tau))[:, None]
    upper = np.column_stack([q.floats[:, s] @ middle[s] + norms[:, j] * radius[j] for j, s in enumerate(slices)]) + slack
    means = np.column_stack([q.floats[:, s] @ mean[s] for s in slices])
    cut = means + ((tau - means.sum(axis=1)) / len(slices))[:, None]
    cut = np.maximum(cut, tau[:, None] - (upper.sum(axis=1, keepdims=True) - upper)) - 2 * slack
    local: list = []
    products = 2 * len(q.ids) * dims
    passed = np.zeros((len(q.ids), len(c.ids)), bool)
    for j, s in enumerate(slices):
        rows = np.flatnonzero(upper[:, j] >= cut[:, j])
        scores = q.floats[rows, s] @ c.floats[:, s].T
        products += len(rows) * len(c.ids) * (s.stop - s.start)
        passed[rows] |= scores >= cut[rows, j : j + 1]
        local.append((dict(zip(rows.tolist(), range(len(rows)))), scores))
    found = []
    for i in np.flatnonzero(passed.any(axis=1)).tolist():
        entries = np.flatnonzero(passed[i] & (c.ids != q.ids[i]))
        if large:
            scores = q.exact(i, c, entries)
            products += len(entries) * dims
        else:
            scores = np.zeros(len(entries))
            for (place, known), s in zip(local, slices):
                if i in place:
                    scores += known[place[i], entries]
                else:
                    scores += c.floats[entries, s] @ q.floats[i, s]
                    products += len(entries) * (s.stop - s.start)
        best = _best(scores, c.ids[entries], k)
        found.append((int(q.ids[i]), c.ids[entries[best]], [scores[x] for x in best]))
    return found, products


def _each_pair(pairs: DataFrame, work: Callable, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                row = b.slice(at, 1).to_pylist()[0]
                yield _entries(*work(Vectors(row, "q", dims), Vectors(row, "c", dims)))

    return pairs.mapInArrow(run, ENTRIES)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """Spark keeps k rows a query in each task before the shuffle (WindowGroupLimit)."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _named(blocks: DataFrame, prefix: str) -> DataFrame:
    return blocks.select("block", "cell", *[F.col(x).alias(f"{prefix}_{x}") for x in ("ids", "vectors", "kind", "tau")])


def _grid(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each pair of blocks once. queries are copied to `tall` rows of the grid, candidates to `wide` columns."""
    size = lambda b: b.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    (q_blocks, q_rows), (c_blocks, c_rows) = size(queries), size(candidates)
    cells = GRID_A_PARTITION * int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tall = min(max(1, round((cells * c_rows / max(1, q_rows)) ** 0.5)), cells, max(1, c_blocks))
    wide = min(max(1, -(-cells // tall)), max(1, q_blocks))
    number = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = _named(candidates, "c").select("*", number(tall).alias("a"), all_of(wide).alias("b")).drop("block", "cell")
    left = _named(queries, "q").select("*", number(wide).alias("b"), all_of(tall).alias("a")).drop("block", "cell")
    # Whatever the blocks' files weigh, the copies are many: neither side may be broadcast.
    return right.join(left.hint("merge"), ["a", "b"])


def top_k(queries: DataFrame, candidates: DataFrame, dims: int, k: int, lists: int = LISTS, report: dict | None = None) -> DataFrame:
    """query_id, rank int, vec_id, score long. Both inputs: (id long, vector array<long>), as integer_vectors gives.

    report, if given, gets `share`: the products of components that were worked out, of those of all pairs.
    """
    spark = candidates.sparkSession
    sample = bounded_sample(candidates, SAMPLE)
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    points = np.array([r["vector"] for r in sample], np.float64)
    middle, mean = centres(points), points.mean(axis=0)
    celled = lambda rows: rows.mapInArrow(_assign(middle), "id long, vector array<long>, cell int")
    candidate_blocks = _blocks(materialise(celled(candidates), "topk-candidates"), BLOCK)
    asked = materialise(celled(queries.dropDuplicates(["id", "vector"])), "topk-queries")

    # Phase 1. The first rows of each cell's fullest block: at most CELLS * PROBE_ROWS vectors.
    fullest = W.partitionBy("cell").orderBy(F.desc("n"), "block")
    probes = candidate_blocks.withColumn("r", F.row_number().over(fullest)).where("r = 1")
    width = F.octet_length("vectors") / F.col("n")
    some = F.least("n", F.lit(PROBE_ROWS))
    probes = probes.select("block", "cell", F.substring("ids", F.lit(1), (some * 8).cast("int")).alias("ids"), F.substring("vectors", F.lit(1), (some * width).cast("int")).alias("vectors"), "kind", "tau")
    near = np.argsort(((middle[:, None] - middle) ** 2).sum(axis=2), axis=1, kind="stable")[:, :PROBES]
    near = spark.createDataFrame([(i, int(j)) for i, js in enumerate(near) for j in js], "own int, cell int")
    left = _named(_blocks(asked, QUERY_BLOCK), "q").withColumnRenamed("cell", "own").drop("block").join(F.broadcast(near), "own")
    gathered = _each_pair(left.join(F.broadcast(_named(probes, "c").drop("block")), "cell"), lambda q, c: gather(q, c, dims, lists, k), dims)
    gathered = materialise(gathered, "topk-gathered")
    # A repeated query row reports an entry again; each counts once towards tau.
    entries = gathered.where("vec_id is not null").select("query_id", "vec_id", "score").distinct()
    tau = _ranked(entries, k).groupBy("query_id").agg(F.min("score").alias("tau"), F.count(F.lit(1)).alias("found"))
    tau = tau.select(F.col("query_id").alias("id"), F.when(F.col("found") >= k, F.col("tau").cast("double")).alias("tau"))

    # Phases 2 and 3.
    bounded = asked.join(tau, "id", "left").withColumn("tau", F.coalesce("tau", F.lit(float("nan"))))
    query_blocks = _blocks(materialise(bounded, "topk-bounded"), QUERY_BLOCK)
    found = _each_pair(_grid(query_blocks, candidate_blocks), lambda q, c: resolve(q, c, mean, dims, lists, k), dims)
    if report is not None:
        found = materialise(found, "topk-found")
        done = sum(t.agg(F.coalesce(F.sum("products"), F.lit(0))).first()[0] for t in (gathered, found))
        report["share"] = done / max(1, asked.count() * candidates.count() * dims)
    return _ranked(found.where("vec_id is not null"), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_uniform_threshold_topk(spark, sf_dir):
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return top_k(vectors.where(F.col("id") % 50 == 0), vectors, 64, 5)


def oracle() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS score
  FROM v AS q JOIN v AS c ON q.vec_id != c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5"""
