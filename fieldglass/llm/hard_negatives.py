"""Hard negatives by inner product: cover trees over norm-augmented rows, searched best first.

Every row x of norm |x| gets one more component, sqrt(M^2 - |x|^2), where M is
the largest norm: all rows then lie on one sphere and the inner product with an
anchor falls with the angle between them.  A node of the tree has a centre and a
covering angle, which bound the products of all rows below it from both sides.
Nodes are taken by their upper bound; those outside all windows that are still
open are skipped with everything below.  Rows of a node that is reached are
verified with exact integer products.

Rows are dealt by id to shelves of bounded size, anchors to slices; every slice
meets every shelf in a task of its own, which builds the trees and then streams
the anchors past them.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldglass.llm.common import landed

SCALE = 256
POSITIVES = NEGATIVES = 5
#: A negative scores at least 80 % and at most 100 % of the positive.
LEAST_PERCENT, MOST_PERCENT = 80, 100
#: Components of a larger size would not give exact 64-bit scores.
MOST_COMPONENT = 1 << 26
#: Rows of one shelf, anchors of one slice, rows of one tree, rows of a node that is not split.
SHELF_ROWS = SLICE_ANCHORS = 8192
TREE_ROWS, LEAF_ROWS = 2048, 192
#: The net of a node is this much finer than its own covering radius.
FINER = 0.7
#: What bounds are widened by, as a share of |anchor| x M: far above what floating point loses.
WIDENED = 1e-6
MOST_PARTITIONS = 20_000


@dataclass
class Node:
    """A centre, its covering angle, the rows verified when it is reached, and finer nodes."""

    centre: int
    angle: float
    block: np.ndarray
    labels: tuple[int, int]
    children: list[int] = field(default_factory=list)


class CoverTrees:
    """Cover trees over rows of one shelf; each holds at most TREE_ROWS rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.floats = vectors.astype(np.float64)
        norms = np.sqrt((self.floats**2).sum(1))
        self.most = float(norms.max()) or 1.0
        lift = np.sqrt(np.maximum(self.most**2 - norms**2, 0.0))
        self.sphere = np.column_stack([self.floats, lift]) / self.most
        self.nodes: list[Node] = []
        self.roots: list[int] = []
        order = self._near_together()
        for start in range(0, len(order), TREE_ROWS):
            self._tree(order[start:start + TREE_ROWS])
        self.centres = self.floats[[n.centre for n in self.nodes]]
        self.angles = np.array([n.angle for n in self.nodes])

    def _near_together(self) -> np.ndarray:
        """Rows by their nearest pivot, so that one tree holds rows that lie together."""
        trees = -(-len(self.ids) // TREE_ROWS)
        pivots = self.sphere[np.linspace(0, len(self.ids) - 1, 2 * trees).astype(int)]
        nearest = (self.sphere @ pivots.T).argmax(1)
        return np.lexsort((self.labels, nearest))

    def _tree(self, members: np.ndarray) -> None:
        around = self.sphere[members]
        cosines = (around @ around.T).astype(np.float32)
        self.roots.append(len(self.nodes))
        todo = [(None, np.arange(len(members)))]
        while todo:
            parent, own = todo.pop()
            # float32 is widened, so that no row lies outside.
            angle = float(np.arccos(np.clip(cosines[own[0], own].min() - 1e-6, -1, 1)))
            rows = members[own]
            kinds = self.labels[rows]
            node = Node(int(rows[0]), angle, rows, (int(kinds.min()), int(kinds.max())))
            if parent is not None:
                self.nodes[parent].children.append(len(self.nodes))
            number = len(self.nodes)
            self.nodes.append(node)
            parts = list(self._net(cosines, own, angle)) if len(own) > LEAF_ROWS else []
            # One part only: the rows lie (nearly) in one place, and a finer net tells nothing.
            if len(parts) > 1:
                small = []
                for part in parts:
                    if len(part) > LEAF_ROWS // 4:
                        todo.append((number, part))
                    else:
                        small.append(part)
                node.block = members[np.concatenate(small)] if small else members[:0]

    @staticmethod
    def _net(cosines: np.ndarray, own: np.ndarray, angle: float) -> Iterator[np.ndarray]:
        """Parts of a node: each centre covers what is left within the finer radius."""
        chord = 2 * np.sin(angle / 2) * FINER
        least = 1 - chord**2 / 2
        left = own
        while len(left):
            near = cosines[left[0], left] >= least
            near[0] = True
            yield left[near]
            left = left[~near]

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most product of every anchor with the rows below every node."""
        size = np.sqrt((anchors**2).sum(1))[:, None] * self.most
        angles = np.arccos(np.clip(anchors @ self.centres.T / np.maximum(size, 1e-300), -1, 1))
        slack = size * WIDENED + 1e-6
        most = np.cos(np.maximum(angles - self.angles, 0)) * size + slack
        least = np.cos(np.minimum(angles + self.angles, np.pi)) * size - slack
        return least, most

    def products(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact integer products."""
        if self.most * float(np.sqrt((anchor.astype(np.float64)**2).sum())) < 2**52:
            return (self.floats[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.vectors[rows].astype(np.int64) @ anchor.astype(np.int64)

    def search(
        self, anchor: np.ndarray, anchor_id: int, same: int | None, other: int | None,
        windows: list[tuple[int, int]], wanted: int, least: np.ndarray, most: np.ndarray,
    ) -> list[list[tuple[int, int]]]:
        """The first ``wanted`` rows (-score, id) of every window of scores, both ends included.

        ``same`` or ``other`` names the label that rows must or must not have.
        """
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        floors = [low for low, _ in windows]
        heap = [(-most[root], root) for root in self.roots]
        heapq.heapify(heap)
        while heap:
            bound, number = heapq.heappop(heap)
            if -bound < min(floors):
                break
            node = self.nodes[number]
            if same is not None and not node.labels[0] <= same <= node.labels[1]:
                continue
            if other is not None and node.labels == (other, other):
                continue
            if not any(-bound >= floor and least[number] <= high for floor, (_, high) in zip(floors, windows)):
                continue
            for child in node.children:
                heapq.heappush(heap, (-most[child], child))
            if len(node.block):
                scores = self.products(node.block, anchor)
                fits = self.labels[node.block] == same if same is not None else self.labels[node.block] != other
                fits &= (scores >= min(floors)) & (self.ids[node.block] != anchor_id)
                at = np.flatnonzero(fits)
                if len(at):
                    self._take(scores[at], self.ids[node.block[at]], windows, floors, found, wanted)
        return found

    @staticmethod
    def _take(scores, ids, windows, floors, found, wanted) -> None:
        for w, (_, high) in enumerate(windows):
            fits = np.flatnonzero((scores >= floors[w]) & (scores <= high))
            if len(fits) > 4 * wanted:
                least = np.partition(scores[fits], len(fits) - wanted)[len(fits) - wanted]
                fits = fits[scores[fits] >= least]
            if len(fits):
                best = sorted(found[w] + list(zip((-scores[fits]).tolist(), ids[fits].tolist(), strict=True)))[:wanted]
                found[w] = best
                if len(best) == wanted:
                    floors[w] = max(floors[w], -best[-1][0])


def vector_rows(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; shorter vectors end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    wide = int(sizes.max()) if len(sizes) else 0
    if (sizes == wide).all():
        return values.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), values.dtype)
    out[np.arange(wide) < sizes[:, None]] = values
    return out


def _widened(matrix: np.ndarray, wide: int) -> np.ndarray:
    return matrix if matrix.shape[1] == wide else np.pad(matrix, ((0, 0), (0, wide - matrix.shape[1])))


def distinct_rows(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by id; of several with one id the one with the smallest label, then vector."""
    order = np.argsort(ids, kind="stable")
    if len(ids) > 1 and (np.diff(ids[order]) == 0).any():
        order = np.lexsort((*vectors.T[::-1], labels, ids))
    new = np.concatenate([[True], np.diff(ids[order]) != 0]) if len(ids) else np.empty(0, bool)
    return ids[order[new]], labels[order[new]], vectors[order[new]]


def prepared(
    rows: DataFrame, is_anchor: Column, id_column: str, label: Column, vector_column: str, scale: int,
) -> DataFrame:
    """Rows that take part: vec_id, label, vector (whole numbers), anchor."""
    limit = F.lit(float(MOST_COMPONENT) / scale)
    vector = F.col(vector_column)
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    rows = rows.where(F.col(id_column).isNotNull() & vector.isNotNull() & label.isNotNull() & usable)
    return rows.select(
        F.col(id_column).cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("vector"),
        is_anchor.alias("anchor"),
    )


def _met(rows: DataFrame, anchors: DataFrame, shelves: int, slices: int) -> DataFrame:
    """Every slice of anchors beside every shelf of rows: sorted by shelf, slice and kind (rows first)."""
    def place(column: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(F.col(column), F.lit(parts)), F.lit(parts)).cast("int")

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    left = rows.select(
        place("vec_id", shelves).alias("shelf"), every(slices).alias("slice"), F.lit(0).alias("kind"), "vec_id", "label",
        "vector", F.array().cast("array<bigint>").alias("partners"), F.array().cast("array<bigint>").alias("scores"),
    )
    right = anchors.select(
        every(shelves).alias("shelf"), place("vec_id", slices).alias("slice"), F.lit(1).alias("kind"), "vec_id", "label",
        "vector", "partners", "scores",
    )
    dealt = left.unionByName(right).repartition(min(MOST_PARTITIONS, 2 * shelves * slices), "shelf", "slice")
    return dealt.sortWithinPartitions("shelf", "slice", "kind")


def _streamed(look: Callable[[CoverTrees, pa.RecordBatch], list[tuple]]):
    """Build the trees of each shelf, then pass its anchors by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, trees = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("shelf", "slice", "kind")])
            edges = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                here = tuple(keys[start, :2])
                if here != at:
                    at, parts, trees = here, [], None
                if keys[start, 2] == 0:
                    parts.append((
                        part.column("vec_id").to_numpy(zero_copy_only=False),
                        part.column("label").to_numpy(zero_copy_only=False), vector_rows(part.column("vector")),
                    ))
                    continue
                if parts:
                    wide = max(p[2].shape[1] for p in parts)
                    ids, labels, vectors = (
                        np.concatenate([_widened(p[i], wide) if i == 2 else p[i] for p in parts]) for i in range(3)
                    )
                    trees, parts = CoverTrees(*distinct_rows(ids, labels, vectors)), []
                if trees is not None:
                    found = look(trees, part)
                    columns = list(zip(*found, strict=True)) or [()] * 4
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "positive_id", "other_id", "score"]
                    )

    return run


def _anchors(trees: CoverTrees, part: pa.RecordBatch):
    """Anchors of a batch with their bounds; vectors are cut or filled up to the width of the rows."""
    vectors = vector_rows(part.column("vector")).astype(np.int64)
    wide = trees.vectors.shape[1]
    vectors = _widened(vectors[:, :wide], wide)
    names, labels = (part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
    least, most = trees.bounds(vectors.astype(np.float64))
    return zip(range(len(names)), names.tolist(), labels.tolist(), vectors, least, most, strict=True)


def _positives(wanted: int):
    everything = [(-(1 << 63), (1 << 63) - 1)]

    def look(trees: CoverTrees, part: pa.RecordBatch) -> list[tuple]:
        out = []
        for _, name, label, vector, least, most in _anchors(trees, part):
            best = trees.search(vector, name, label, None, everything, wanted, least, most)[0]
            out += [(name, row, None, -score) for score, row in best]
        return out

    return look


def _negatives(wanted: int, least_percent: int, most_percent: int):
    def look(trees: CoverTrees, part: pa.RecordBatch) -> list[tuple]:
        out = []
        partners, scores = (part.column(c).to_pylist() for c in ("partners", "scores"))
        for i, name, label, vector, least, most in _anchors(trees, part):
            # Whole scores n with least_percent * p <= 100 n <= most_percent * p.
            ends = [(-(-least_percent * p // 100), most_percent * p // 100) for p in scores[i]]
            open_ = [w for w, (low, high) in enumerate(ends) if low <= high]
            if open_:
                found = trees.search(vector, name, None, label, [ends[w] for w in open_], wanted, least, most)
                out += [(name, partners[i][w], row, -s) for w, best in zip(open_, found, strict=True) for s, row in best]
        return out

    return look


def _first(found: DataFrame, keys: list[str], other: str, wanted: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc(other))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= wanted)


def mine_hard_negatives(
    rows: DataFrame, is_anchor: Column, id_column: str = "vec_id", label: Column | None = None,
    vector_column: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT, most_percent: int = MOST_PERCENT, scale: int = SCALE,
    shelf_rows: int = SHELF_ROWS, slice_anchors: int = SLICE_ANCHORS,
) -> DataFrame:
    """Negatives of each anchor that score almost as high as one of its positives.

    Columns: anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score.  Components become ``floor(scale * x)``, scores are inner
    products; higher ones come first, ties by smaller id.  Positives are the
    first ``positives`` other rows of the anchor's label; for each, the first
    ``negatives`` rows of other labels that score ``least_percent`` to
    ``most_percent`` of it are returned.  ``is_anchor`` is a condition on the id
    column.

    Rows without id or label, without vector, with a null, non-finite or larger
    component than MOST_COMPONENT take no part.  Rows of one id are one row, the
    one with the smallest label, then vector.  Shorter vectors end in zeros.
    Anchors without positives, and positives without negatives in their window,
    give no rows; nor does an empty table.  Other columns are left out.
    """
    label = F.col("label") if label is None else label
    base = landed(prepared(rows, is_anchor, id_column, label, vector_column, scale), "vectors")
    chosen = landed(
        base.where("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector"),
        "anchors",
    )
    shelves, slices = max(1, -(-base.count() // shelf_rows)), max(1, -(-chosen.count() // slice_anchors))
    schema = "anchor_id bigint, positive_id bigint, other_id bigint, score bigint"
    none = F.array().cast("array<bigint>")
    met = _met(base, chosen.select("*", none.alias("partners"), none.alias("scores")), shelves, slices)
    near = _first(met.mapInArrow(_streamed(_positives(positives)), schema), ["anchor_id"], "positive_id", positives)
    near = landed(near.select("anchor_id", "positive_id", "score"), "positives")

    # At most ``positives`` rows an anchor.
    windows = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_list(F.struct("positive_id", "score"))).alias("w")
    )
    asked = chosen.join(windows, "vec_id").select(
        "vec_id", "label", "vector", F.col("w.positive_id").alias("partners"), F.col("w.score").alias("scores")
    )
    met = _met(base, asked, shelves, slices)
    hard = met.mapInArrow(_streamed(_negatives(negatives, least_percent, most_percent)), schema)
    hard = _first(hard, ["anchor_id", "positive_id"], "other_id", negatives)
    hard = hard.withColumnRenamed("score", "negative_score").withColumnRenamed("other_id", "negative_id")
    scored = near.withColumnRenamed("score", "positive_score")
    return hard.join(scored, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
