"""A vector index as tables: an inverted file of trained cells with product-quantised codes.

``build`` learns cell centres and code books from a bounded sample, then writes every row once: its code (one byte for
each group of dimensions) and its vector, both partitioned by cell. ``search`` reads the codes of the cells nearest to
the queries only (partition pruning), scores them by table look-ups, keeps one running best of each query per task, and
fetches the vectors of those few rows for the exact score. So a query costs the codes of its cells and ``refine``
vectors, whatever the table holds. With ``refine`` not below the table every vector of the cells is to be fetched, so they
are scored where they lie, with one running best of each query per task, and no codes are read: in all cells, the exact search.

How many cells a query needs depends on the data: well-parted vectors need a few, vectors without any structure nearly
all (no pruning of cells helps there, and the codes, a sixteenth of the vectors, carry the search). ``build`` measures
that on its sample and keeps the number with the index. So it does with the dimensions that a byte of a code
stands for: the most of GROUPS with which a query's true neighbours are among the first FOUND by code.

Rows without a vector of the index's length, or with numbers that aren't finite, are not in the index; a zero vector has
similarity 0 to all. Ties go by id. An empty table gives an index without rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import ship
from .retrieval import _Best, _unit, blocks_of, check_limit, ranked

#: Vectors that the index learns from, at most; the share of their true neighbours that the default number of cells must hold.
SAMPLE, COVERED = 32_768, 0.98
#: Dimensions that one byte of a code may stand for, and rows by code that must hold a query's ten nearest.
GROUPS, FOUND = (4, 2, 1), 40
#: Most cells, rows that share a file of a hot cell, queries of one pass, rows that are compared with all centres at once.
MOST_CELLS, FILE_ROWS, BLOCK, CHUNK = 4096, 4_000_000, 512, 2048


@dataclass(frozen=True)
class VectorIndex:
    """Where the index's tables are, and what it has learned."""

    path: str
    centres: np.ndarray  # cells x dimensions, of length 1
    books: np.ndarray  # groups x 256 x dimensions of a group
    probes: int
    rows: int | None = None  # of the table; None where the index was written without it

    @property
    def cells(self) -> int:
        return len(self.centres)

    def codes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id bigint, code binary, cell int").parquet(f"{self.path}/codes")

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id bigint, embedding array<double>, cell int").parquet(f"{self.path}/vectors")


def _nearest(x: np.ndarray, centres: np.ndarray, spherical: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each row's centre and how near it is, CHUNK rows at a time: the driver holds no table of rows by centres."""
    half = 0 if spherical else 0.5 * np.einsum("ij,ij->i", centres, centres)
    own, best = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    for lo in range(0, len(x), CHUNK):
        near = x[lo : lo + CHUNK] @ centres.T - half
        own[lo : lo + CHUNK] = at = near.argmax(axis=1)
        best[lo : lo + CHUNK] = near[np.arange(len(near)), at]
    return own, best


def _grouped(x: np.ndarray, group: int) -> np.ndarray:
    """Rows x groups x dimensions of a group, filled up with zeros."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % group))).reshape(len(x), -1, group)


def _coded(rest: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The nearest entry of each group's book."""
    half = 0.5 * np.einsum("gkd,gkd->gk", books, books)
    return np.stack([(rest[:, g] @ books[g].T - half[g]).argmax(axis=1) for g in range(len(books))], axis=1).astype(np.uint8)


def _clusters(x: np.ndarray, k: int, rng: np.random.Generator, spherical: bool, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from distinct rows of ``x``; a centre that loses all its rows takes the row that lies worst."""
    centres = x[np.sort(rng.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        own, best = _nearest(x, centres, spherical)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        worst = iter(np.argsort(best, kind="stable").tolist())
        for empty in np.flatnonzero(count == 0).tolist():
            total[empty], count[empty] = x[next(worst)], 1
        centres = _unit(total) if spherical else total / count[:, None]
    return centres


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold ``dim`` finite numbers, and those rows."""
    fits = pc.equal(pc.fill_null(pc.list_value_length(column), 0), dim)
    m = column.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(m).all(axis=1)
    mask = fits.to_numpy(zero_copy_only=False).astype(bool)
    mask[np.flatnonzero(mask)[~good]] = False
    return mask, m[good]


def _learn(x: np.ndarray, cells: int, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Cell centres, code books of what vectors differ from their centre in, and the number of cells that hold COVERED of true neighbours."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    centres = _clusters(x, min(cells, len(x)), rng, spherical=True)
    own, _ = _nearest(x, centres, True)
    asked = x[rng.permutation(len(x))[:256]]
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, 1:11]  # the first is the row itself
    for group in GROUPS:
        rest = _grouped(x - centres[own], group)
        books = np.zeros((rest.shape[1], 256, group))
        for g in range(rest.shape[1]):
            found = _clusters(rest[:, g], min(256, len(x)), rng, spherical=False)
            books[g, : len(found)] = found
            books[g, len(found) :] = found[:1]
        if group == GROUPS[-1] or _covered(x, centres, own, rest, books, asked, near) >= COVERED:
            break
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell, for each
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(COVERED * len(needed)))]) + 1 if len(needed) else 1
    return centres, books, probes


def _covered(x: np.ndarray, centres: np.ndarray, own: np.ndarray, rest: np.ndarray, books: np.ndarray, asked: np.ndarray, near: np.ndarray) -> float:
    """The share of true neighbours that are among the first FOUND by code (beside the row itself)."""
    close = np.empty((len(x), centres.shape[1]))  # the vectors that the codes stand for
    for lo in range(0, len(x), CHUNK):
        code = _coded(rest[lo : lo + CHUNK], books)
        close[lo : lo + CHUNK] = centres[own[lo : lo + CHUNK]] + books[np.arange(len(books)), code].reshape(len(code), -1)[:, : centres.shape[1]]
    if not near.size or len(x) <= FOUND + 1:
        return 1.0
    score = asked @ close.T
    least = np.partition(score, len(x) - FOUND - 1, axis=1)[:, len(x) - FOUND - 1]
    return float((np.take_along_axis(score, near, axis=1) >= least[:, None]).mean())


def build(memories: DataFrame, path: str, cells: int | None = None, seed: int = 5) -> VectorIndex:
    """Indexes every row of ``memories`` (id, embedding) below ``path``, which the cluster shares.

    The sample is the SAMPLE rows of the least hash of their id, the same at every run; its length of vector is the index's.
    """
    spark = memories.sparkSession
    ship(spark)
    rows = memories.select(F.col("id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("id").isNotNull() & V.is_finite(F.col("embedding")))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()  # as numbers, not as objects
    dim = pc.max(pc.list_value_length(drawn)).as_py() or 0
    x = _unit(_matrix(drawn, dim)[1]) if dim else np.empty((0, 1))
    del drawn
    count = rows.count()
    cells = min(MOST_CELLS, max(1, cells or int(2 * np.sqrt(count))))
    centres, books, probes = _learn(x, cells, seed) if len(x) and dim else (np.zeros((1, 1)), np.zeros((1, 256, GROUPS[0])), 1)
    learned = spark.sparkContext.broadcast((centres, books))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = learned.value
        for batch in batches:
            mask, m = _matrix(batch.column(1), centres.shape[1])
            kept = batch.filter(pa.array(mask))
            for lo in range(0, len(m), 8192):
                u = _unit(m[lo : lo + 8192])
                own, _ = _nearest(u, centres, True)
                code = _coded(_grouped(u - centres[own], books.shape[2]), books)
                part = kept.slice(lo, len(u))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(own.astype(np.int32))], names=["id", "embedding", "code", "cell"])

    coded = rows.mapInArrow(encode, "id bigint, embedding array<double>, code binary, cell int")
    # a cell's rows are dealt over several writers where it may hold more than a file's worth, so none takes a hot cell alone
    files = max(1, -(-count // FILE_ROWS))
    dealt = coded.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(files)))
    dealt.select("id", "embedding", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    dealt.select("id", "code", "cell").write.partitionBy("cell").parquet(f"{path}/codes")
    model = [("centres", list(centres.shape), centres.ravel().tolist()), ("books", list(books.shape), books.ravel().tolist()), ("probes", [1], [float(probes)]), ("rows", [1], [float(count)])]
    spark.createDataFrame(model, "name string, shape array<int>, data array<double>").coalesce(1).write.parquet(f"{path}/model")
    return VectorIndex(path, centres, books, probes, count)


def opened(spark: SparkSession, path: str) -> VectorIndex:
    """The index that ``build`` wrote below ``path``."""
    model = {r.name: np.array(r.data).reshape(r.shape) for r in spark.read.parquet(f"{path}/model").collect()}
    return VectorIndex(path, model["centres"], model["books"], int(model["probes"][0]), int(model["rows"][0]) if "rows" in model else None)


def _asked(index: VectorIndex, block: DataFrame, probes: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Names of the block's queries, their vectors of length 1, how near each cell is, and which cells they look into."""
    dim = index.centres.shape[1]
    asked = [r for r in block.select("query_id", "embedding").collect() if len(r[1] or ()) == dim]
    q = _unit(np.array([r[1] for r in asked], dtype=np.float64).reshape(-1, dim))
    to_cell = q @ index.centres.T
    probed = np.zeros(to_cell.shape, dtype=bool)
    np.put_along_axis(probed, np.argsort(-to_cell, axis=1, kind="stable")[:, :probes], True, axis=1)
    return [r[0] for r in asked], q, to_cell, probed


def _of_cells(rows: DataFrame, probed: np.ndarray) -> DataFrame:
    cells = np.flatnonzero(probed.any(axis=0)).tolist()
    return rows.where(F.col("cell").isin(cells) if cells else F.lit(False))


def candidates(index: VectorIndex, queries: DataFrame, refine: int, probes: int | None = None) -> DataFrame:
    """query_id, id, cell, score, rank: each query's ``refine`` best rows by code among its ``probes`` nearest cells. queries: query_id, embedding."""
    spark = queries.sparkSession
    ship(spark)
    probes, out = min(index.cells, max(1, probes or index.probes)), None
    for block in blocks_of(queries, BLOCK):
        own, q, to_cell, probed = _asked(index, block, probes)
        handle = spark.sparkContext.broadcast((own, to_cell, probed, _grouped(q, index.books.shape[2]), index.books))

        def scan(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            names, to_cell, probed, grouped, books = handle.value
            table = np.einsum("qgd,gkd->gkq", grouped, books)  # what each byte adds to each query's score
            best = _Best(len(names), refine)
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                ids, cells = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                for lo in range(0, len(ids), 4096):
                    cell = cells[lo : lo + 4096]
                    score = to_cell.T[cell]
                    for g in range(len(books)):
                        score += table[g, codes[lo : lo + 4096, g]]
                    score[~probed.T[cell]] = -np.inf
                    best.add(ids[lo : lo + 4096] * index_cells + cell, score)
            if len(best.q):
                yield pa.RecordBatch.from_arrays([pa.array(np.array(names, dtype=np.int64)[best.q]), pa.array(best.ids // index_cells), pa.array((best.ids % index_cells).astype(np.int32)), pa.array(best.scores)], names=["query_id", "id", "cell", "score"])

        index_cells = index.cells
        codes = _of_cells(index.codes(spark), probed).select("id", "code", "cell")
        part = codes.mapInArrow(scan, "query_id bigint, id bigint, cell int, score double")
        out = part if out is None else out.unionByName(part)
    return ranked(out, refine)


def _whole(index: VectorIndex, queries: DataFrame, k: int, probes: int, places: int) -> DataFrame:
    """``search`` with every vector of the cells fetched: they are scored as they are read."""
    spark, out = queries.sparkSession, None
    ship(spark)
    for block in blocks_of(queries, BLOCK):
        own, q, _, probed = _asked(index, block, probes)
        handle = spark.sparkContext.broadcast((own, q, probed))

        def scan(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            names, q, probed = handle.value
            best = _Best(len(names), k)
            for batch in batches:
                mask, m = _matrix(batch.column(1), q.shape[1])
                ids, cells = batch.column(0).to_numpy()[mask], batch.column(2).to_numpy()[mask]
                for lo in range(0, len(ids), 4096):
                    score = np.round(_unit(m[lo : lo + 4096]) @ q.T, places) + 0.0
                    score[~probed.T[cells[lo : lo + 4096]]] = -np.inf
                    best.add(ids[lo : lo + 4096], score)
            if len(best.q):
                yield pa.RecordBatch.from_arrays([pa.array(np.array(names, dtype=np.int64)[best.q]), pa.array(best.ids), pa.array(best.scores)], names=["query_id", "id", "score"])

        part = _of_cells(index.vectors(spark), probed).select("id", "embedding", "cell").mapInArrow(scan, "query_id bigint, id bigint, score double")
        out = part if out is None else out.unionByName(part)
    return ranked(out, k)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, refine: int | None = None, places: int = 6) -> DataFrame:
    """query_id, id, score, rank: the k nearest by cosine among the rows that the codes rank first."""
    check_limit(k)
    spark, refine = queries.sparkSession, refine or max(64, 8 * k)
    if k and index.rows is not None and refine >= index.rows:
        return _whole(index, queries, k, min(index.cells, max(1, probes or index.probes)), places)
    near = candidates(index, queries, refine, probes).select("query_id", "id", "cell")
    # stated queries times ``refine`` rows: by cell and id, so that other cells' files aren't opened
    held = near.join(index.vectors(spark), ["cell", "id"])
    asked = queries.select("query_id", V.unit(F.col("embedding")).alias("q"))
    scored = held.join(asked, "query_id").select("query_id", "id", (F.round(V.dot(V.unit(F.col("embedding")), F.col("q")), places) + 0.0).alias("score"))
    return ranked(scored, k)
