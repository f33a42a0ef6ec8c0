"""Exact k-nearest-neighbour vote without a cross join.

Space is cut into regions of about as many training rows each, along the main axes of a sample. A query searches its own region,
which bounds its k-th distance, and then visits only regions whose box is no farther than that. Inside a task, training rows
lie in small boxes and queries in small groups, and a group is measured only against boxes that its bounds cannot rule out.
Large regions are cut into chunks on both sides, so a task sees a bounded number of rows, and the k best of all parts are merged.

``visited_cells`` tells how the same search goes with cells around pivots and the triangle inequality.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.session import materialize

#: Numbers in the largest array of differences.
CUBE = 4_000_000
#: Training rows of a cell on average, and pivots at most.
CELL, PIVOTS = 1024, 1 << 16
#: Relative slack of distances by norms and products; candidates within it are measured again by differences.
SLACK = 1e-9


def _rough(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by norms and a matrix product: fast, and exact but for rounding."""
    return np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T))


def _pivots(train: DataFrame, key: str, vec: str, n: int) -> np.ndarray:
    rows = train.select(vec, F.md5(F.col(key).cast("string")).alias("_h")).orderBy("_h").limit(n).collect()
    return np.array([r[vec] for r in rows], dtype=float)


#: Pivots of a leaf of the tree.
LEAF = 8


class PivotTree:
    """Metric tree over pivots: nodes with a centre and the radius around everything below them."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.nodes = pivots, []
        self.radius, self.count = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
        self._build(np.arange(len(pivots)))

    def _build(self, at: np.ndarray) -> int:
        x = self.pivots[at]
        centre = x.mean(axis=0)
        far = np.sqrt(((x - centre) ** 2).sum(1))
        place = len(self.nodes)
        self.nodes.append([centre, float(far.max(initial=0)), 0, at, None])
        if len(at) > LEAF:
            one = x[far.argmax()]
            two = x[((x - one) ** 2).sum(1).argmax()]
            along = x @ (two - one)
            order = np.argsort(along, kind="stable")
            half = len(at) // 2
            self.nodes[place][4] = (self._build(at[order[:half]]), self._build(at[order[half:]]))
        return place

    def filled(self, radius: dict[int, tuple[float, int]]) -> PivotTree:
        """Radii and row counts of the cells, carried up the tree; the widened radii cover rounding."""
        for cell, (r, n) in radius.items():
            self.radius[cell], self.count[cell] = r * (1 + SLACK), n
        for node in reversed(self.nodes):
            centre, _, _, at, parts = node
            d = np.sqrt(((self.pivots[at] - centre) ** 2).sum(1))
            has = self.count[at] > 0
            node[1], node[2] = float((d + self.radius[at])[has].max(initial=0)) * (1 + SLACK), int(self.count[at].sum())
        return self

    def _far(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sqrt(((x - y) ** 2).sum(-1))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each row and the distance to it."""
        best, cell = np.full(len(x), np.inf), np.zeros(len(x), np.int64)

        def visit(place: int, rows: np.ndarray) -> None:
            at, parts = self.nodes[place][3:]
            if parts is None:
                for p in at:
                    d = self._far(x[rows], self.pivots[p])
                    closer = d < best[rows]
                    best[rows[closer]], cell[rows[closer]] = d[closer], p
                return
            for mine, d, side in self._nearer_first(x, rows, parts):
                mine = mine[d - self.nodes[side][1] <= best[mine] * (1 + SLACK)]
                if len(mine):
                    visit(side, mine)

        if len(x):
            visit(0, np.arange(len(x)))
        return cell, best

    def _nearer_first(self, x: np.ndarray, rows: np.ndarray, parts: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(rows, distances to the centre, node): each row goes down its nearer side first, so its best distance rules out more."""
        to = [self._far(x[rows], self.nodes[c][0]) for c in parts]
        left = to[0] <= to[1]
        for first in (True, False):
            for side in (0, 1):
                pick = (left if side == 0 else ~left) == first
                yield rows[pick], to[side][pick], parts[side]

    def reach(self, x: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell) for every cell that may hold one of a row's k nearest, and how many nodes and pivots each row was measured against.

        ``bound`` is the distance of a row's k-th best so far, or infinite; a node with k rows bounds it as well.
        """
        bound, looked, out = bound.copy(), np.zeros(len(x), np.int64), []

        def visit(place: int, rows: np.ndarray) -> None:
            at, parts = self.nodes[place][3:]
            if parts is None:
                for p in at[self.count[at] > 0]:
                    d = self._far(x[rows], self.pivots[p])
                    looked[rows] += 1
                    if self.count[p] >= k:
                        bound[rows] = np.minimum(bound[rows], d + self.radius[p])
                    out.append(np.stack([rows, np.full(len(rows), p)])[:, d - self.radius[p] <= bound[rows] * (1 + SLACK)])
                return
            looked[rows] += 2
            for mine, d, side in self._nearer_first(x, rows, parts):
                _, radius, count, _, _ = self.nodes[side]
                if count >= k:
                    bound[mine] = np.minimum(bound[mine], d + radius)
                mine = mine[(d - radius <= bound[mine] * (1 + SLACK)) & (count > 0)]
                if len(mine):
                    visit(side, mine)

        if len(x):
            visit(0, np.arange(len(x)))
        pairs = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        return pairs[0], pairs[1], looked


def _assign(df: DataFrame, vec: str, sent) -> DataFrame:
    """Every row with its nearest pivot and the distance to it."""
    schema = T.StructType([df.schema[c] for c in df.columns] + [T.StructField("_cell", T.IntegerType()), T.StructField("_pd", T.DoubleType())])

    def run(batches):
        for b in batches:
            x = np.stack(b[vec].to_numpy()).astype(float) if len(b) else np.zeros((0, sent.value.pivots.shape[1]))
            cell, d = sent.value.nearest(x)
            yield b.assign(_cell=cell.astype("int32"), _pd=d)

    return df.mapInPandas(run, schema)


def _visits(queries: DataFrame, key: str, vec: str, sent, k: int) -> DataFrame:
    """(key, vec, _cell, _looked): the cells beside its own that a query must visit; a NULL cell says that there are none."""
    schema = T.StructType([queries.schema[key], queries.schema[vec], T.StructField("_cell", T.IntegerType()), T.StructField("_looked", T.LongType())])

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b[vec].to_numpy()).astype(float)
            row, cell, looked = sent.value.reach(x, b["_bound"].fillna(np.inf).to_numpy(float), k)
            away = cell != b["_home"].to_numpy()[row]
            row, cell = row[away], cell[away]
            alone = np.setdiff1d(np.arange(len(x)), row)
            at = np.concatenate([row, alone])
            cells = pd.array(np.concatenate([cell, np.zeros(len(alone), np.int64)]), dtype="Int32")
            cells[len(row):] = pd.NA
            yield pd.DataFrame({key: b[key].to_numpy()[at], vec: b[vec].to_numpy()[at], "_cell": cells, "_looked": looked[at]})

    return queries.mapInPandas(run, schema)


def _search(test: DataFrame, train: DataFrame, key: str, vec: str, label: str, k: int) -> DataFrame:
    """k best training rows per query and chunk pair; both sides carry (_cell, _tc, _qc)."""
    kt = next(f.dataType for f in train.schema if f.name == key)
    qt = next(f.dataType for f in test.schema if f.name == key)
    lt = next(f.dataType for f in train.schema if f.name == label)
    schema = T.StructType([T.StructField(key, qt), T.StructField("_nid", kt), T.StructField("_nlabel", lt), T.StructField("_d", T.DoubleType())])

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        t = t.sort_values(key, kind="stable")
        tx, ids, labels = np.stack(t[vec].to_numpy()).astype(float), t[key].to_numpy(), t[label].to_numpy()
        keys, out, m = q[key].to_numpy(), [], min(k, len(tx))
        qx = np.stack(q[vec].to_numpy()).astype(float)
        size = (tx * tx).sum(1).max()
        step = max(1, min(512, CUBE // tx.size))  # all rows of a chunk may be equally near
        for start in range(0, len(q), step):
            x = qx[start:start + step]
            rough = _rough(x, tx)
            limit = np.partition(rough, m - 1, axis=1)[:, m - 1] + SLACK * ((x * x).sum(1) + size)
            row, near = np.nonzero(rough <= limit[:, None])
            d = np.sqrt(((tx[near] - x[row]) ** 2).sum(1))
            order = np.lexsort((near, d, row))  # ties stay in the order of the ids
            row, near, d = row[order], near[order], d[order]
            first = np.searchsorted(row, np.arange(len(x)))
            best = np.arange(len(row)) - first[row] < m
            out.append((keys[start + row[best]], ids[near[best]], labels[near[best]], d[best]))
        return pd.DataFrame(dict(zip(schema.names, map(np.concatenate, zip(*out)))))

    g = ["_cell", "_tc", "_qc"]
    return test.groupBy(*g).cogroup(train.groupBy(*g)).applyInPandas(run, schema)


def _chunk_of(key: str, n: str, chunk: int):
    return F.pmod(F.xxhash64(key), F.greatest(F.ceil(F.col(n) / chunk), F.lit(1))).cast("int")


def _paired(test: DataFrame, train: DataFrame, key: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Give both sides chunk numbers and copy each side to the chunks of the other."""
    tn = train.groupBy("_cell").agg(F.count(F.lit(1)).alias("_tn"))
    qn = test.groupBy("_cell").agg(F.count(F.lit(1)).alias("_qn"))
    size = F.broadcast(tn.join(qn, "_cell"))  # one row per cell, as many as pivots
    other = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(n) / chunk), F.lit(1)).cast("int") - 1))
    q = test.join(size, "_cell").withColumn("_qc", _chunk_of(key, "_qn", chunk)).withColumn("_tc", other("_tn")).drop("_tn", "_qn")
    t = train.join(size, "_cell").withColumn("_tc", _chunk_of(key, "_tn", chunk)).withColumn("_qc", other("_qn")).drop("_tn", "_qn")
    return q, t


def _best(found: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy("_d", "_nid")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)


def pivots_for(n: int) -> int:
    """Number of pivots for n training rows."""
    return max(1, min(PIVOTS, max(math.isqrt(n), -(-n // CELL))))


#: Training rows of a region and of a small box in it, queries of a group, rows of the sample that cuts space, rows of a region on small tables.
REGION, BOX, TOGETHER, SAMPLE, LEAST = 65_536, 32, 64, 20_000, 4096
#: Boxes that a query is measured against first; numbers of an array of distances between queries and rows of single boxes.
AHEAD, PAIRS = 6, 200_000


class Regions:
    """Space cut by planes across the main axes of a sample, each time in halves of the sample; a region holds rows of the sample."""

    def __init__(self, sample: np.ndarray, n: int):
        self.axes, self.cuts, self.count = np.eye(sample.shape[1]), [], 1
        if len(sample) > 1:
            self.axes = np.linalg.eigh(np.cov(sample, rowvar=False).reshape(sample.shape[1], -1))[1]
        y = self.turned(sample)
        sizes = {0: np.arange(len(y))}
        whole = set()
        while len(sizes) < n and len(whole) < len(sizes):
            place = max(sizes.keys() - whole, key=lambda r: (len(sizes[r]), -r))
            at = sizes[place]
            part = y[at]
            axis = int(np.ptp(part, axis=0).argmax())
            values = np.sort(part[:, axis])
            # The step next to the middle; steps that are rounding noise are none.
            steps = np.flatnonzero(np.diff(values) > SLACK * np.abs(values).max(initial=0))
            if not len(steps):
                whole.add(place)  # equal rows: they are dealt in chunks
                continue
            step = steps[np.abs(steps - len(at) // 2 + 1).argmin()]
            value, new = float(values[step] + values[step + 1]) / 2, self.count
            self.cuts.append((place, axis, value, new))
            self.count += 1
            right = part[:, axis] > value
            sizes[place], sizes[new] = at[~right], at[right]

    def turned(self, x: np.ndarray) -> np.ndarray:
        """Rows in the main axes: distances stay."""
        return x @ self.axes

    def places(self, y: np.ndarray) -> np.ndarray:
        """The region of every turned row; cuts are gone through in the order in which they were made."""
        place, held = np.zeros(len(y), np.int32), {0: np.arange(len(y))}
        for region, axis, value, new in self.cuts:
            at = held[region]
            right = y[at, axis] > value
            held[region], held[new] = at[~right], at[right]
        for region, at in held.items():
            place[at] = region
        return place


def _packed(y: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of small boxes of at most ``size`` rows that lie near each other."""
    out, todo = [], [np.arange(len(y))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        part = y[at]
        half = len(at) // 2
        order = np.argpartition(part[:, int(np.ptp(part, axis=0).argmax())], half)
        todo += [at[order[:half]], at[order[half:]]]
    return out


def _gaps(low: np.ndarray, high: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of boxes (from_, to) from boxes (low, high), one row for each of the former."""
    out = np.zeros((len(from_), len(low)))
    for j in range(low.shape[1]):
        gap = np.maximum(low[:, j] - to[:, j, None], from_[:, j, None] - high[:, j])
        np.maximum(gap, 0, out=gap)
        gap *= gap
        out += gap
    return out


def _near_rows(qx: np.ndarray, tx: np.ndarray, axes: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, training row, distance) of the k nearest training rows of every query, nearest first, ties in the order of the rows.

    Rows farther than a query's ``bound`` may be left out. A query is measured against its nearest boxes, and then against all others
    within the distance that is known from them.
    """
    qy, ty, width = qx @ axes, tx @ axes, tx.shape[1]
    m = min(k, len(tx))
    boxes = _packed(ty, BOX)
    held = np.full((len(boxes), max(map(len, boxes))), -1)
    for i, at in enumerate(boxes):
        held[i, : len(at)] = at
    lanes = [np.where(held >= 0, ty[held, j], np.inf) for j in range(width)]
    low, high = (np.stack([f(x, axis=1) for x in lanes], axis=1) for f in (np.min, lambda x, axis: np.where(np.isinf(x), -np.inf, x).max(axis=axis)))
    slack = SLACK * ((qy * qy).sum(1) + (ty * ty).sum(1).max())
    known = (np.minimum(bound, 1e150) * (1 + SLACK)) ** 2 + 2 * slack
    ahead = min(len(boxes), max(AHEAD, -(-4 * m // BOX)))
    found = []

    def apart(query: np.ndarray, box: np.ndarray) -> np.ndarray:
        """Squared distances of the queries from the rows of one box each."""
        out = np.zeros((len(query), held.shape[1]))
        for j, lane in enumerate(lanes):
            gap = lane[box]
            gap -= qy[query, j][:, None]
            gap *= gap
            out += gap
        return out

    def bounded(query: np.ndarray, boxes_: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Squared distances of each query from the rows of its boxes; their k-th lowers its limit."""
        near = apart(np.repeat(query, boxes_.shape[1]), boxes_.reshape(-1)).reshape(len(query), -1)
        if near.shape[1] >= m:
            limit[query] = np.minimum(limit[query], np.partition(near, m - 1, axis=1)[:, m - 1] + 2 * slack[query])
        return near

    def pairs(query: np.ndarray, box: np.ndarray, limit: np.ndarray) -> None:
        """Keep the rows of the boxes within the limit."""
        for i in range(0, len(query), max(1, PAIRS // held.shape[1])):
            q, b = query[i:i + max(1, PAIRS // held.shape[1])], box[i:i + max(1, PAIRS // held.shape[1])]
            at, place = np.nonzero(apart(q, b) <= limit[q, None])
            found.append((q[at], held[b[at], place]))

    def together(query: np.ndarray, boxes_: np.ndarray, limit: np.ndarray) -> None:
        """The same for all of the queries next to all of the boxes."""
        rows = held[boxes_].reshape(-1)
        rows = rows[rows >= 0]
        for i in range(0, len(query), max(1, CUBE // len(rows))):
            mine = query[i:i + max(1, CUBE // len(rows))]
            at, place = np.nonzero(_rough(qy[mine], ty[rows]) <= limit[mine, None])
            found.append((mine[at], rows[place]))

    done, limit = [], np.zeros(len(qy))
    for group in _packed(qy, TOGETHER):
        y, found = qy[group], []
        around = y.min(axis=0)[None], y.max(axis=0)[None]
        middle = (around[0] + around[1]) / 2
        # A first bound from boxes near the group, a close one from those nearest to each query.
        limit[group] = known[group]
        first = np.argpartition(_gaps(low, high, middle, middle)[0], ahead - 1)[:ahead]
        bounded(group, first[None].repeat(len(group), axis=0), limit)
        may = np.flatnonzero(_gaps(low, high, *around)[0] <= limit[group].max())
        may = np.union1d(may, first)
        gaps = _gaps(low[may], high[may], y, y)
        first = np.argpartition(gaps, ahead - 1, axis=1)[:, :ahead]
        near = bounded(group, may[first], limit)
        within = gaps <= limit[group, None]
        np.put_along_axis(within, first, True, axis=1)
        some = may[within.any(axis=0)]
        if within.sum() * width < 2 * len(group) * len(some):
            at, place = np.nonzero(near <= limit[group, None])
            found.append((group[at], held[may[first]].reshape(len(group), -1)[at, place]))
            np.put_along_axis(within, first, False, axis=1)
            at, box = np.nonzero(within)
            pairs(group[at], may[box], limit)
        else:
            together(group, some, limit)
        query, row = (np.concatenate(x) for x in zip(*found))
        query, row = query[row >= 0], row[row >= 0]
        d = np.sqrt(((tx[row] - qx[query]) ** 2).sum(1))
        order = np.lexsort((row, d, query))
        query, row, d = query[order], row[order], d[order]
        best = np.arange(len(query)) - np.searchsorted(query, query) < m
        done.append((query[best], row[best], d[best]))
    query, row, d = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(query, kind="stable")
    return query[order], row[order], d[order]


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _placed(df: DataFrame, vec: str, sent) -> DataFrame:
    """Every row with ``_cell``, its region. Rows without a vector of finite numbers are near to none and left out."""
    schema = T.StructType([*df.schema.fields, T.StructField("_cell", T.IntegerType())])
    at, names = df.columns.index(vec), [*df.columns, "_cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(at).is_valid())
            if b.num_rows:
                x = _vectors(b.column(at))
                fine = np.isfinite(x).all(axis=1)
                b = b.filter(pa.array(fine))
                if not b.num_rows:
                    continue
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.places(sent.value.turned(x[fine])))], names=names)

    return df.mapInArrow(run, schema)


def _boxes(train: DataFrame, vec: str, sent) -> DataFrame:
    """Rows of every region in each batch, and the box around them in the main axes."""
    at, cell_at = train.columns.index(vec), train.columns.index("_cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y, cell = sent.value.turned(_vectors(b.column(at))), np.asarray(b.column(cell_at))
            order = np.argsort(cell, kind="stable")
            cells, first = np.unique(cell[order], return_index=True)
            y = y[order]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(np.diff(np.r_[first, len(y)]), pa.int64()), *(pa.array(f.reduceat(y, first, axis=0).tolist(), pa.list_(pa.float64())) for f in (np.minimum, np.maximum))],
                                             names=["_cell", "n", "low", "high"])

    return train.mapInArrow(run, "_cell int, n long, low array<double>, high array<double>")


def _searched(asked: DataFrame, given: DataFrame, key: str, vec: str, label: str, k: int, sent, boxes, units: int) -> DataFrame:
    """``asked`` with ``_near``, the k nearest rows in a chunk of its region, ``_bound``, the distance that it has k rows within, and on
    the way home (``boxes`` given) ``_to``, the other regions that are in reach."""
    kt, lt = (next(f.dataType for f in given.schema if f.name == c) for c in (key, label))
    near = T.ArrayType(T.StructType([T.StructField("_d", T.DoubleType()), T.StructField("_nid", kt), T.StructField("_nlabel", lt)]))
    names = [c for c in asked.columns if c not in ("_bound", "_qc")]
    schema = T.StructType([*(asked.schema[c] for c in names), T.StructField("_bound", T.DoubleType()), T.StructField("_near", near), T.StructField("_to", T.ArrayType(T.IntegerType()))])

    def run(q: pa.Table, t: pa.Table) -> pa.Table:
        if not q.num_rows or not t.num_rows:
            q, t = q.slice(0, 0), t.slice(0, 0)
        t = t.sort_by(key).combine_chunks()  # ties go by the key
        m = q.num_rows
        row, d, ends, to, to_ends = np.zeros(0, np.int64), np.zeros(0), np.zeros(m + 1, np.int64), np.zeros(0, np.int32), np.zeros(m + 1, np.int64)
        bound = np.zeros(0)
        if m:
            qx, bound = _vectors(q.column(vec)), np.asarray(q.column("_bound"), float)
            query, row, d = _near_rows(qx, _vectors(t.column(vec)), sent.value.axes, k, bound)
            ends = np.searchsorted(query, np.arange(m + 1))
            full = np.diff(ends) >= k
            bound = bound.copy()
            bound[full] = np.minimum(bound[full], d[ends[1:][full] - 1])
        if m and boxes is not None:
            cells, low, high = boxes.value
            y, away = sent.value.turned(qx), cells != q.column("_cell")[0].as_py()
            reach = (np.minimum(bound, 1e150) * (1 + SLACK)) ** 2 + SLACK * ((y * y).sum(1) + np.maximum(low * low, high * high).sum(1).max())
            out, step = [], max(1, CUBE // len(low))
            for i in range(0, m, step):
                out.append((_gaps(low, high, y[i:i + step], y[i:i + step]) <= reach[i:i + step, None]) & away)
            out = np.concatenate(out)
            to, to_ends = cells[np.nonzero(out)[1]], np.r_[0, np.cumsum(out.sum(axis=1))]
        pick = lambda c: t.column(c).combine_chunks().take(pa.array(row))
        found = pa.StructArray.from_arrays([pa.array(d), pick(key), pick(label)], names=["_d", "_nid", "_nlabel"])
        return pa.table([*(q.column(c) for c in names), pa.array(bound), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found), pa.ListArray.from_arrays(pa.array(to_ends, pa.int32()), pa.array(to, pa.int32()))], names=schema.names)

    g = ["_cell", "_tc", "_qc"]
    return asked.repartition(units, *g).groupBy(*g).cogroup(given.repartition(units, *g).groupBy(*g)).applyInArrow(run, schema)


def _chunked(asked: DataFrame, given: DataFrame, key: str, sizes: dict[int, int], chunk: int) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with chunk numbers, each copied to the chunks of the other, and the number of pairs of chunks. A chunk of queries is
    an eighth of one of training rows."""
    counts = {r["_cell"]: (-(-sizes[r["_cell"]] // chunk), -(-r["count"] // max(1, chunk // 8))) for r in asked.groupBy("_cell").count().collect()}  # one row for each region
    size = F.broadcast(asked.sparkSession.createDataFrame([(c, t, q) for c, (t, q) in counts.items()], "_cell int, _tn int, _qn int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    q = asked.join(size, "_cell").withColumn("_qc", part("_q", "_qn")).withColumn("_tc", every("_tn")).withColumnRenamed("_tn", "_parts").drop("_qn")
    t = given.join(size, "_cell").withColumn("_tc", part(key, "_tn")).withColumn("_qc", every("_qn")).drop("_tn", "_qn")
    return q, t, max(1, sum(t * q for t, q in counts.values()))


def _by_regions(train: DataFrame, test: DataFrame, key: str, vec: str, label: str, k: int, n_regions: int | None = None, chunk: int = 2 * REGION) -> DataFrame:
    """``test`` with ``_near``, the exact k nearest training rows of every row, as an array of (_d, _nid, _nlabel), nearest first."""
    sc, n = train.sparkSession.sparkContext, train.count()
    wanted = n_regions or max(1, -(-n // REGION), min(2 * sc.defaultParallelism, n // LEAST))
    sample = _pivots(train.where(F.col(vec).isNotNull()), key, vec, max(SAMPLE, 64 * wanted))
    sample = sample[np.isfinite(sample).all(axis=1)] if sample.ndim == 2 else sample
    regions = Regions(sample.reshape(len(sample), -1) if len(sample) else np.zeros((0, 1)), wanted)
    sent = sc.broadcast(regions)
    t = materialize(_placed(train.select(key, label, vec), vec, sent))
    width = len(regions.axes)
    side = lambda f, c: F.array(*[f(F.col(c)[j]) for j in range(width)]).alias(c)
    held = _boxes(t, vec, sent).groupBy("_cell").agg(F.sum("n").alias("n"), side(F.min, "low"), side(F.max, "high")).collect()  # one row for each region
    sizes = {r["_cell"]: r["n"] for r in held}
    q = test.select(F.monotonically_increasing_id().alias("_q"), "*")
    keys = [c for c in q.columns if c != vec]
    q = materialize(_placed(q, vec, sent) if held else _placed(q.limit(0), vec, sent))
    boxes = sc.broadcast((np.array([r["_cell"] for r in held], np.int32), *(np.array([r[c] for r in held], float) for c in ("low", "high"))))

    def search(asked: DataFrame, bounds) -> DataFrame:
        q, t_, units = _chunked(asked, t, key, sizes, chunk)
        return materialize(_searched(q, t_, key, vec, label, k, sent, bounds, units))

    home = search(q.withColumn("_bound", F.lit(float("inf"))), boxes)
    whole = home.where("_parts = 1")
    cut = home.where("_parts > 1").groupBy(*keys).agg(F.min_by(vec, "_bound").alias(vec), F.min_by("_to", "_bound").alias("_to"), F.min("_bound").alias("_bound"))
    more = whole.select(*keys, vec, "_to", "_bound").unionByName(cut).where("size(_to) > 0").select(*keys, vec, "_bound", F.explode("_to").alias("_cell"))
    alone = (F.col("_parts") == 1) & (F.size("_to") == 0)
    parts = home.where(~alone).select(*keys, "_near").unionByName(search(more, None).select(*keys, "_near"))
    merged = parts.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("_near"))), 1, k).alias("_near"))
    return home.where(alone).select(*keys, "_near").unionByName(merged).drop("_q")


def nearest(train: DataFrame, test: DataFrame, key: str, vec: str, label: str, k: int = 5, n_pivots: int | None = None, chunk: int = 2 * REGION) -> DataFrame:
    """(key, _nid, _nlabel, _d, _r): the exact k nearest training rows of every test row.

    Space is cut into ``n_pivots`` regions, or as many as regions of REGION training rows ask for.
    """
    found = _by_regions(train, test.select(key, vec), key, vec, label, k, n_pivots, chunk).select(key, F.inline("_near"))
    return _best(found.select(key, "_nid", "_nlabel", "_d"), key, k)


def visited_cells(train: DataFrame, test: DataFrame, key: str, vec: str, label: str, k: int = 5, n_pivots: int | None = None) -> DataFrame:
    """(key, visited, measured, cells): how many cells each query searches, how many nodes and pivots it is measured against on
    the way, and how many cells there are."""
    chunk = 4096
    sc = train.sparkSession.sparkContext
    tree = PivotTree(_pivots(train, key, vec, n_pivots or pivots_for(train.count())))
    bare = sc.broadcast(tree)
    t = materialize(_assign(train.select(key, label, vec), vec, bare))
    q = materialize(_assign(test.select(key, vec), vec, bare))  # both are read by several searches
    home = materialize(_best(_search(*_paired(q.select(key, vec, "_cell"), t.select(key, label, vec, "_cell"), key, chunk), key, vec, label, k), key, k))
    bound = home.groupBy(key).agg(F.when(F.count(F.lit(1)) >= k, F.max("_d")).alias("_bound"))
    cells = t.groupBy("_cell").agg(F.max("_pd").alias("r"), F.count(F.lit(1)).alias("n")).collect()  # one row for each pivot
    full = sc.broadcast(tree.filled({r["_cell"]: (r["r"], r["n"]) for r in cells}))
    queries = q.join(bound, key, "left").select(key, vec, "_bound", F.col("_cell").alias("_home"))
    visits = materialize(_visits(queries, key, vec, full, k))
    return visits.groupBy(key).agg((F.count("_cell") + 1).alias("visited"), F.first("_looked").alias("measured"), F.lit(len(cells)).alias("cells"))


def vote(neighbours: DataFrame, key: str) -> DataFrame:
    """Majority label; the smaller label wins a tie."""
    c = neighbours.groupBy(key, "_nlabel").agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy(key).orderBy(F.desc("votes"), "_nlabel")
    return c.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, F.col("_nlabel").alias("prediction"), "votes")


#: Training rows near without a feature that are measured for its variants first, about; rows of a block of training rows and of queries.
NEAR, BLOCK, ASKED = 512, 32_768, 1024
#: Of the training rows nearest without a feature, how many a sample tells them by.
SAMPLED = 32


def _variant_neighbours(q: np.ndarray, others: np.ndarray, tx: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(variant, training row, distance) of the k nearest rows of every variant of ``q``; variant r * features + j has feature j from row r of ``others``.

    A row is at least as far from a variant as it is without the feature. Rows near without it, about NEAR of them, are measured first;
    their k-th best bounds the variant's, and only rows that are no farther without the feature are measured for it.
    """
    repeats, width = others.shape
    m, step = min(k, len(tx)), max(1, NEAR // SAMPLED)
    squares = (tx.T - q[:, None]) ** 2
    whole = squares.sum(axis=0)
    slack = SLACK * ((q * q).sum() + 2 * (whole.max() + (q * q).sum()) + (others * others).max() + 1)
    rank = max(m, NEAR // step) - 1
    variant, row = [], []
    for j in range(width):
        without, at_j = whole - squares[j], tx[:, j]
        part = without[::step]
        edge = np.partition(part, rank)[rank] if rank < len(part) else np.inf
        near = np.flatnonzero(without <= edge)
        rough = without[near] + (others[:, j, None] - at_j[near]) ** 2
        limit = np.partition(rough, m - 1, axis=1)[:, m - 1] + slack
        proven = limit + slack < edge
        r, at = np.nonzero((rough <= limit[:, None]) & proven[:, None])
        variant.append(r * width + j)
        row.append(near[at])
        for r in np.flatnonzero(~proven):
            may = np.flatnonzero(without <= limit[r] + slack)
            rough_all = without[may] + (others[r, j] - at_j[may]) ** 2
            found = may[rough_all <= np.partition(rough_all, m - 1)[m - 1] + slack]
            variant.append(np.full(len(found), r * width + j))
            row.append(found)
    variant, row = np.concatenate(variant), np.concatenate(row)
    x = np.repeat(q[None], len(variant), axis=0)
    x[np.arange(len(variant)), variant % width] = others[variant // width, variant % width]
    d = np.sqrt(((tx[row] - x) ** 2).sum(1))
    order = np.lexsort((row, d, variant))  # ties stay in the order of the rows
    variant, row, d = variant[order], row[order], d[order]
    best = np.arange(len(variant)) - np.searchsorted(variant, variant) < m
    return variant[best], row[best], d[best]


def _blocks(nt: int, nq: int, cores: int) -> tuple[int, int]:
    """Blocks of ``nt`` training and ``nq`` test rows. Pairs of blocks fall on tasks by a hash, so there are many small ones, which even out."""
    tb = max(1, -(-nt // BLOCK))
    return tb, max(1, -(-nq // ASKED), min(nq, -(-8 * cores // tb)))


def nearest_of_variants(train: DataFrame, test: DataFrame, key: str, vec: str, others: str, label: str, k: int = 5) -> DataFrame:
    """(key, _rep, _j, _near): the exact k nearest training rows of every variant of every test row, as an array of (_d, _nid, _nlabel).

    ``others`` holds vectors; variant (_rep, _j) has component _j of the vector with index _rep. Next to a few training rows, a test
    row is measured in a task once for all of its variants; beyond LEAST of them the variants search by regions.
    """
    nt, nq = train.count(), test.count()
    tb, qb = _blocks(nt, nq, train.sparkSession.sparkContext.defaultParallelism)
    if nt > min(BLOCK, LEAST):
        changed = F.transform(vec, lambda x, i: F.when(i == F.col("_j"), F.col("_o")[i]).otherwise(x))
        every = test.select(key, vec, F.posexplode(others).alias("_rep", "_o")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.size(vec) - 1)))
        return _by_regions(train, every.select(key, "_rep", "_j", changed.alias(vec)), key, vec, label, k).select(key, "_rep", "_j", "_near")
    kt, qt, lt = (next(f.dataType for f in d.schema if f.name == c) for d, c in ((train, key), (test, key), (train, label)))
    schema = T.StructType([T.StructField(key, qt), T.StructField("_rep", T.IntegerType()), T.StructField("_j", T.IntegerType()), T.StructField("_d", T.ArrayType(T.DoubleType())),
                           T.StructField("_nid", T.ArrayType(kt)), T.StructField("_nlabel", T.ArrayType(lt))])

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(t):
            t = t.sort_values(key, kind="stable")
            tx, ids, labels = np.asfortranarray(np.stack(t[vec].to_numpy()).astype(float)), t[key].to_numpy(), t[label].to_numpy()
            for one, x, o in zip(q[key], q[vec], q[others]):
                x, o = np.asarray(x, float), np.stack(list(o)).astype(float)
                variant, row, d = _variant_neighbours(x, o, tx, k)
                m = min(k, len(tx))
                for v, r, far in zip(variant[::m].tolist(), row.reshape(-1, m), d.reshape(-1, m)):
                    out.append((one, v // len(x), v % len(x), far, ids[r], labels[r]))
        return pd.DataFrame(out, columns=schema.names)

    g = ["_qb"]
    asked = test.select(key, vec, others, F.pmod(F.xxhash64(key), F.lit(qb)).cast("int").alias("_qb")).repartition(qb, *g)
    given = train.select(key, vec, label, F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("_qb")).repartition(qb, *g)
    found = asked.groupBy(*g).cogroup(given.groupBy(*g)).applyInPandas(run, schema)
    return found.select(key, "_rep", "_j", F.arrays_zip("_d", "_nid", "_nlabel").alias("_near"))
