"""Exact cosine range join of vectors: pivots, boundary copies by the triangle inequality, independent cells.

On the unit sphere, angles are a metric. Every distinct vector belongs to its nearest pivot, there
to the ball of those within half the reach or to the shell around it: a cell. Vectors of one ball
all link with each other, so a dense group is counted, never compared. A vector is copied to
another cell only if the triangle inequality on its angle to that cell's pivot and the bisector
of the two pivots leave room for a partner there; of two cells one copies to the other. Cells are
cut into parts of bounded size, and each part meets its copies in a task of its own, one block of
them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import connected_components, written

COSINE = 0.9
#: Distinct vectors per pivot, pivots at most (beyond that cells get more parts), vectors of one part.
CELL_ROWS, MAX_PIVOTS, PART_ROWS = 4096, 1024, 8192
#: The bounded sample that pivots are chosen from: vectors and bytes at most. Only the speed depends on it.
SAMPLE_ROWS, SAMPLE_BYTES = 4096, 32 << 20
#: Copied vectors that are packed into one row and compared at once.
TILE = 1024
#: Angles and single-precision cosines are trusted up to these; in between double precision decides.
_ANGLE_SLACK, _COSINE_SLACK = 1e-6, 2e-5
_PACKED = "cell int, part int, copied boolean, nodes binary, weights binary, vectors binary"
_FOUND = "a long, b long, n long"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, usable): v in double precision; unusable if null, zero, or holding null or non-finite components."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(v.isNotNull() & fine, F.lit(False)).alias("usable"))


def _units(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors of a list column, shorter ones filled with zeros; scaled first, so that no square overflows."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        full = flat.reshape(-1, dims).copy()
    else:
        full = np.zeros((len(sizes), dims))
        full[np.arange(dims) < sizes[:, None]] = flat
    full /= np.abs(full).max(axis=1, keepdims=True)
    return full / np.sqrt((full * full).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, count: int, reach: float) -> np.ndarray:
    """Centres of dense groups of the sample first, then vectors far from all chosen ones."""
    near = sample.astype(np.float32) @ sample.astype(np.float32).T >= np.cos(reach)
    left = np.ones(len(sample), bool)
    chosen: list[np.ndarray] = []
    while len(chosen) < count:
        crowd = (near & left).sum(axis=1) * left
        best = int(crowd.argmax())
        if crowd[best] < max(3, len(sample) // 256):
            break
        members = near[best] & left
        centre = sample[members].mean(axis=0)
        chosen.append(centre / np.linalg.norm(centre))
        left &= ~members
    if not chosen:
        chosen.append(sample[0])
    closest = (sample @ np.array(chosen).T).max(axis=1)
    while len(chosen) < min(count, len(sample)):
        far = int(closest.argmin())
        if closest[far] > 1 - 1e-9:
            break
        chosen.append(sample[far])
        closest = np.maximum(closest, sample @ sample[far])
    return np.array(chosen)


def _assigned(nodes: DataFrame, pivots: np.ndarray, reach: float) -> DataFrame:
    """(node, w, v, cell, angle): the cell is twice the nearest pivot, plus one outside half the reach."""
    dims = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(batch.column(2), dims)
            cosines = units @ pivots.T
            nearest = cosines.argmax(axis=1)
            angle = np.arccos(np.clip(cosines[np.arange(len(units)), nearest], -1, 1))
            cell = 2 * nearest + (angle > reach / 2 - _ANGLE_SLACK)
            yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=["node", "w", "v", "cell", "angle"])

    return written(nodes.mapInArrow(run, "node long, w long, v array<double>, cell int, angle double"), "range-cells")


class Cells:
    """What every task knows of the cells: pivots, rings of angles, and numbers of parts."""

    def __init__(self, pivots: np.ndarray, stats: list, reach: float) -> None:
        n = 2 * len(pivots)
        self.pivots, self.reach = pivots, reach
        self.low, self.high, self.parts = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, np.int64)
        for r in stats:
            self.low[r.cell], self.high[r.cell], self.parts[r.cell] = r.low, r.high, -(-r.members // PART_ROWS)
        between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-300))
        self.between = between

    def targets(self, units: np.ndarray, cell: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Other cells, each with the vectors that may have a partner there and are copied."""
        cosines = units @ self.pivots.T
        angles = np.arccos(np.clip(cosines, -1, 1))
        own = cell // 2
        mine = cosines[np.arange(len(units)), own]
        for target in np.flatnonzero(self.parts):
            pivot = target // 2
            sends = ((cell + target) % 2 == 0) == (cell < target)
            ring = (angles[:, pivot] <= self.high[target] + self.reach + _ANGLE_SLACK) & (angles[:, pivot] >= self.low[target] - self.reach - _ANGLE_SLACK)
            side = (own == pivot) | (mine - cosines[:, pivot] <= np.sin(self.reach) * self.between[own, pivot] + _ANGLE_SLACK)
            chosen = np.flatnonzero((cell != target) & sends & ring & side)
            if len(chosen):
                yield int(target), chosen


def _dealt(assigned: DataFrame, cells: Cells) -> DataFrame:
    """Parts of cells and the copies that each part must meet, as packed rows."""
    dims = cells.pivots.shape[1]
    names = [x.split()[0] for x in _PACKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, weights, cell = (batch.column(k).to_numpy().astype(np.int64) for k in (0, 1, 3))
            units = _units(batch.column(2), dims)
            mixed = (nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            part = (mixed % cells.parts[cell].astype(np.uint64)).astype(np.int64)
            made: list[tuple[int, int, bool, np.ndarray]] = []
            for key in np.unique(cell * (1 << 32) + part).tolist():
                c, p = key >> 32, key & 0xFFFFFFFF
                own = np.flatnonzero((cell == c) & (part == p))
                made.append((c, p, False, own))
                if c % 2:  # the parts of a shell meet each other; a ball needs no comparison
                    made += [(c, q, True, own) for q in range(p)]
            for target, chosen in cells.targets(units, cell):
                made += [(target, q, True, chosen) for q in range(int(cells.parts[target]))]
            rows = [(c, p, copied, at[k : k + TILE]) for c, p, copied, at in made for k in range(0, len(at), TILE)]
            for k in range(0, len(rows), 16):
                some = rows[k : k + 16]
                yield pa.record_batch(
                    [pa.array([r[0] for r in some], pa.int32()), pa.array([r[1] for r in some], pa.int32()), pa.array([r[2] for r in some], pa.bool_())]
                    + [pa.array([x[r[3]].tobytes() for r in some], pa.binary()) for x in (nodes, weights, units)],
                    names=names,
                )

    return assigned.mapInArrow(run, _PACKED)


class Part:
    """One part of a cell: its vectors, link counts so far, and which of them are known to be connected."""

    def __init__(self, packed: list[tuple[np.ndarray, np.ndarray, np.ndarray]], cosine: float) -> None:
        self.nodes, self.weights, self.units = (np.concatenate(x) for x in zip(*packed, strict=True))
        self.narrow = self.units.astype(np.float32)
        self.counts = np.zeros(len(self.nodes), np.int64)
        self.label = np.arange(len(self.nodes))
        self.cosine = cosine

    def _links(self, units: np.ndarray, narrow: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which of `rows` of the part link with which units: a matrix, exact in double precision."""
        rough = narrow @ self.narrow[rows].T
        linked = rough >= self.cosine + _COSINE_SLACK
        open_ = (rough >= self.cosine - _COSINE_SLACK) & ~linked
        at, to = np.nonzero(open_)
        for k in range(0, len(at), 65536):
            a, b = at[k : k + 65536], to[k : k + 65536]
            linked[a, b] = np.einsum("ij,ij->i", units[a], self.units[rows[b]]) >= self.cosine
        return linked

    def _join(self, ends: np.ndarray) -> list[tuple[int, int, int]]:
        """Edges that connect the part's vectors in `ends`, where they were not yet."""
        labels = np.unique(self.label[ends])
        if len(labels) == 1:
            return []
        self.label[np.isin(self.label, labels[1:])] = labels[0]
        return [(int(self.nodes[labels[0]]), int(self.nodes[x]), 0) for x in labels[1:]]

    def meet(self, nodes: np.ndarray, weights: np.ndarray, units: np.ndarray) -> list[tuple]:
        """Counts and edges between the part and copied vectors."""
        every = np.arange(len(self.nodes))
        linked = self._links(units, units.astype(np.float32), every)
        hit = np.flatnonzero(linked.any(axis=1))
        if not len(hit):
            return []
        linked = linked[hit]
        self.counts += linked.T.astype(np.int64) @ weights[hit]
        out: list[tuple] = [(int(x), None, int(n)) for x, n in zip(nodes[hit], linked.astype(np.int64) @ self.weights, strict=True)]
        for x, row in zip(nodes[hit], linked, strict=True):
            ends = np.flatnonzero(row)
            out += self._join(ends)
            out.append((int(x), int(self.nodes[ends[0]]), 0))
        return out

    def meet_itself(self) -> list[tuple]:
        """Edges among the part's own vectors; their counts are added."""
        out: list[tuple] = []
        for k in range(0, len(self.nodes), TILE):
            rows = np.arange(k, len(self.nodes))
            some = slice(k, k + TILE)
            linked = self._links(self.units[some], self.narrow[some], rows)
            linked &= rows[None, :] > np.arange(k, k + len(linked))[:, None]
            hit = np.flatnonzero(linked.any(axis=1))
            if len(hit):
                wide = linked[hit].astype(np.int64)
                self.counts[k + hit] += wide @ self.weights[rows]
                self.counts[rows] += wide.T @ self.weights[k + hit]
                for x in hit:
                    out += self._join(np.concatenate(([k + x], rows[linked[x]])))
        return out


def _compared(dealt: DataFrame, cosine: float, dims: int) -> DataFrame:
    """(a, null, n): link counts; (a, b, 0): edges that connect whatever links."""
    ordered = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "copied")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        return pa.record_batch([pa.array(x, pa.int64()) for x in columns], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, part = None, [], None

        def start() -> list[tuple]:
            nonlocal part
            part = Part(own, cosine)
            return part.meet_itself() if key[0] % 2 else []

        def counted() -> list[tuple]:
            at = np.flatnonzero(part.counts)
            return [(int(a), None, int(n)) for a, n in zip(part.nodes[at], part.counts[at], strict=True)]

        for batch in batches:
            for k in range(batch.num_rows):
                cell, number, copied, *packed = (batch.column(c)[k].as_py() for c in range(6))
                nodes, weights = (np.frombuffer(x, np.int64) for x in packed[:2])
                block = nodes, weights, np.frombuffer(packed[2], np.float64).reshape(-1, dims)
                if (cell, number) != key:
                    if own and part is None:
                        yield batch_of(start())
                    if part is not None:
                        yield batch_of(counted())
                    key, own, part = (cell, number), [], None
                if not copied:
                    own.append(block)
                    continue
                if not own:
                    continue  # a part that no vector fell into
                if part is None:
                    yield batch_of(start())
                found = part.meet(*block)
                if found:
                    yield batch_of(found)
        if own and part is None:
            yield batch_of(start())
        if part is not None:
            yield batch_of(counted())

    return ordered.mapInArrow(run, _FOUND)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Null and zero vectors and those with null or non-finite components link with nothing and stay
    their own component. Shorter vectors count as filled with zeros. Rows with one id but
    different vectors are vectors of their own; exact copies link with each other. A null id is
    never a component's id unless it has no other, and such a row is not kept. Other columns are
    ignored. An empty table gives no rows.
    """
    reach = float(np.arccos(cosine))
    spark = vectors.sparkSession
    key = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit("vector"), "v").alias("k2")]
    rows = usable(vectors, id_col, vector_col)
    copies = rows.where("usable").select("id", "v", *key).groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("w"), F.first("v").alias("v"))
    nodes = written(copies.withColumn("node", F.monotonically_increasing_id()), "range-nodes")
    many, dims = nodes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not many:
        alone = rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        return alone.withColumn("kept", F.col("vec_id").isNotNull())
    size = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)))
    sample = nodes.orderBy(F.xxhash64("k1"), "node").limit(size).select("v").toArrow().column(0).combine_chunks()
    sample = sample if isinstance(sample, pa.Array) else pa.concat_arrays(sample.chunks)
    pivots = choose_pivots(_units(sample, dims), max(1, min(MAX_PIVOTS, -(-many // CELL_ROWS))), reach)
    assigned = _assigned(nodes.select("node", "w", "v"), pivots, reach)
    rings = assigned.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("members"), F.sum("w").alias("total"), F.min("node").alias("rep"))
    stats = rings.collect()
    found = written(_compared(_dealt(assigned, Cells(pivots, stats, reach)), cosine, dims), "range-links")
    balls = spark.createDataFrame([(r.cell, r.total, r.rep) for r in stats if r.cell % 2 == 0] or [(-1, 0, 0)], "cell int, total long, rep long")
    inside = assigned.join(F.broadcast(balls), "cell").select("node", "w", "total", "rep")
    edges = found.where("b IS NOT NULL").select("a", "b").unionByName(inside.select(F.col("node").alias("a"), F.col("rep").alias("b")))
    counts = found.where("b IS NULL").select(F.col("a").alias("node"), "n").unionByName(inside.select("node", (F.col("total") - F.col("w")).alias("n")))
    counts = counts.groupBy("node").agg(F.sum("n").alias("n"))
    roots = connected_components(edges, "range-components")
    placed = nodes.select("node", "k1", "k2", "first", "w").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = placed.join(smallest, "root").join(counts, "node", "left")
    classes = classes.select("k1", "k2", "component_id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    keyed = rows.select("id", *[F.when(F.col("usable"), k).alias(n) for k, n in zip(key, ("k1", "k2"), strict=True)])
    out = keyed.join(classes, ["k1", "k2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )


def op11_metric_join(spark, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.9 or more."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = f"""
WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v,
    embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings),
links AS (
  SELECT a.r AS a, b.r AS b FROM vectors a JOIN vectors b ON a.r <> b.r AND a.usable AND b.usable
  WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}),
reached AS (SELECT r AS a, r AS b FROM vectors UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b),
roots AS (SELECT reached.a AS r, min(v.vec_id) AS component_id FROM reached JOIN vectors v ON v.r = reached.b GROUP BY 1),
counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY 1)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(v.vec_id = component_id, false) AS kept
FROM vectors v JOIN roots USING (r) LEFT JOIN counts USING (r)
"""
