"""Gradient-boosted trees with Tweedie loss (log link): many models side by side, one aggregate per level of all trees.

With score F = log(mean), power p, and

    gradient  g = -y e^((1-p)F) + e^((2-p)F)
    hessian   h = -(1-p) y e^((1-p)F) + (2-p) e^((2-p)F)   (positive for 1 < p < 2)

a Newton step is a tree whose leaves are -sum(g)/sum(h) and whose splits gain G_l^2/H_l + G_r^2/H_r - G^2/H.  Everything
a level of a tree needs are the sums of g and h per (model, node, column, bin).  Columns are binned once per frame of
lags; rows are kept as blocks of bins, targets and scores of all models.  One job per step then sums gradients for the
open nodes of every model, whatever trial, window or level it is at: tasks send their sums, these are added and searched
for the best split by model, and the driver receives one line per open node.  Only the first ``GATHERED`` bytes of sums of
a fit are added on the driver, which spares small fits an exchange.  The number of jobs is that of the model with the most
levels to grow; more trials and windows make jobs larger, not more.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgrid.functions.core import DS, ID, Y, q
from demandgrid.operators.backtest import Windows
from demandgrid.operators.regression import LagSpec, MONTHS, Predictor, WEEKDAYS, forecast, lag_frame, recursive_backtest
from demandgrid.session import cut_lineage

BLOCK = 32_768         # rows of a block
FOLD_EVERY = 8         # steps after which finished trees are added to the kept scores
CUT_EVERY = 5          # foldings after which the lineage is cut
GATHERED = 48 << 20    # bytes of sums of all tasks that the driver adds itself over a whole fit; the rest is added by model in tasks
LOG_SCHEMA = "model string, ensemble string"

@dataclass
class Tree:
    """Node arrays of one fitted tree: split feature (-1 for a leaf), threshold, children, value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, model: DecisionTreeRegressionModel) -> Tree:
        feat, thr, left, right, val = [], [], [], [], []

        def add(node) -> int:
            at = len(feat)
            for store, v in ((feat, -1), (thr, 0.0), (left, -1), (right, -1), (val, node.prediction())):
                store.append(v)
            if node.subtreeDepth() > 0:
                split = node.split()
                feat[at], thr[at] = split.featureIndex(), split.threshold()
                left[at] = add(node.leftChild())
                right[at] = add(node.rightChild())
            return at

        add(model._java_obj.rootNode())
        return cls(np.array(feat), np.array(thr), np.array(left), np.array(right), np.array(val))

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=int)
        inner = self.feature[at] >= 0
        while inner.any():
            rows = np.nonzero(inner)[0]
            node = at[rows]
            go_left = x[rows, self.feature[node]] <= self.threshold[node]
            at[rows] = np.where(go_left, self.left[node], self.right[node])
            inner = self.feature[at] >= 0
        return self.value[at]


@dataclass
class TweedieEnsemble:
    start: float
    rate: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def _packed(self) -> tuple[np.ndarray, ...]:
        """Node arrays of all trees behind one another, and where each tree begins."""
        starts = np.cumsum([0, *(len(t.feature) for t in self.trees)])[:-1]
        inner = [t.feature >= 0 for t in self.trees]
        move = lambda name: np.concatenate([np.where(k, getattr(t, name) + a, a + np.arange(len(k)))
                                            for t, a, k in zip(self.trees, starts, inner)])
        whole = lambda name: np.concatenate([getattr(t, name) for t in self.trees])
        return starts, whole("feature"), whole("threshold"), move("left"), move("right"), whole("value")

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        if self.trees and len(x):
            starts, feature, threshold, left, right, value = self._packed()
            at = np.repeat(starts[:, None], len(x), axis=1)   # all trees walk at once; leaves point to themselves
            rows = np.arange(len(x))[None]
            while (feature[at] >= 0).any():
                at = np.where(x[rows, np.maximum(feature[at], 0)] <= threshold[at], left[at], right[at])
            score += self.rate * value[at].sum(axis=0)
        return np.exp(score)

    def split_counts(self, n_features: int) -> np.ndarray:
        counts = np.zeros(n_features)
        for t in self.trees:
            used = t.feature[t.feature >= 0]
            counts += np.bincount(used, minlength=n_features)
        return counts


# ---------------------------------------------------------------- frames of rows, binned once

@dataclass
class Frame:
    """Training rows (y, the features, and ``segment`` where windows differ).  ``groups``: indicator features of which
    at most one is set in a row, so that one column of levels stands for all of them."""

    rows: DataFrame
    features: list[str]
    groups: list[list[str]] = field(default_factory=list)


@dataclass
class Column:
    """One binned column: thresholds of a number, or the features of a group of indicators (level 0: none is set)."""

    features: list[int]
    thresholds: np.ndarray | None

    @property
    def bins(self) -> int:
        return len(self.features) + 1 if self.thresholds is None else len(self.thresholds) + 1

    def codes(self, x: np.ndarray) -> np.ndarray:
        if self.thresholds is not None:
            return np.searchsorted(self.thresholds, x[:, self.features[0]]).astype(np.uint8)
        return (x[:, self.features] @ np.arange(1, len(self.features) + 1)).astype(np.uint8)


def binned_columns(frame: Frame, max_bins: int) -> list[Column]:
    """Thresholds from quantiles over all rows; equal ones count once."""
    if not 2 <= max_bins <= 256:
        raise ValueError("a bin is one byte: 2 to 256 bins")
    at = {f: i for i, f in enumerate(frame.features)}
    groups = [[at[f] for f in g] for g in frame.groups if len(g) > 1]
    numbers = [f for f in frame.features if not any(at[f] in g for g in groups)]
    cuts = frame.rows.approxQuantile(numbers, [i / max_bins for i in range(1, max_bins)], 1e-3) if numbers else []
    return [Column([at[f]], np.unique(np.array(c, float))) for f, c in zip(numbers, cuts)] + [Column(g, None) for g in groups]


def _blocks(number: int, frame: Frame, columns: list[Column], starts: np.ndarray) -> DataFrame:
    """Rows as blocks: frame, place, rows, bins (column by column), targets, segments and scores (model by model)."""
    features = frame.features
    seg = F.col("segment") if "segment" in frame.rows.columns else F.lit(0)
    src = frame.rows.select(seg.cast("int").alias("s"), F.col(Y).cast("double").alias("y"), *[q(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    # by content, so that a task run again deals the same rows
    src = src.repartition(max(1, src.sparkSession.sparkContext.defaultParallelism), *src.columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            s, y, *x = (table.column(i).to_numpy() for i in range(table.num_columns))
            x = np.column_stack(x) if x else np.empty((len(y), 0))
            codes = np.array([c.codes(x) for c in columns], np.uint8).reshape(len(columns), len(y))
            scores = np.repeat(starts[:, None], len(y), axis=1)
            values = ([number], [len(y)], [codes.tobytes()], [y.tobytes()], [s.astype(np.int32).tobytes()], [scores.tobytes()])
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, BLOCK_KINDS)], BLOCK_NAMES)

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(h.num_rows for h in held) >= BLOCK:
                yield block()
                held.clear()
        if held:
            yield block()

    return src.mapInArrow(pack, BLOCK_SCHEMA)


BLOCK_NAMES = ["frame", "n", "x", "y", "s", "f"]
BLOCK_KINDS = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
BLOCK_SCHEMA = "frame int, n int, x binary, y binary, s binary, f binary"


# ---------------------------------------------------------------- trees over bins

@dataclass
class Growing:
    """A tree over binned columns: column (-1: leaf), bin, whether the bin is a level, children, sums and value."""

    column: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    level: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    open: list[int] = field(default_factory=lambda: [0])
    depth: int = 0

    def arrays(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.column), np.array(self.bin), np.array(self.level), np.array(self.left), np.array(self.right), np.array(self.value))

    def split(self, found: np.ndarray, columns: list[Column], most: int) -> bool:
        """Take the best splits of the open nodes; false if the tree is complete."""
        after = []
        for node, (gain, column, at, gl, hl, g, h) in zip(self.open, found):
            self.value[node] = -g / h if h > 0 else 0.0
            if self.depth >= most or not gain > 0:
                continue
            self.column[node], self.bin[node] = int(column), int(at)
            self.level[node] = columns[int(column)].thresholds is None
            for side, a, b in ((self.left, gl, hl), (self.right, g - gl, h - hl)):
                side[node] = len(self.column)
                for store, v in ((self.column, -1), (self.bin, 0), (self.level, False), (self.left, -1), (self.right, -1), (self.value, -a / b)):
                    store.append(v)
                after.append(len(self.column) - 1)
        self.depth += 1
        self.open = after if self.depth < most else []
        return bool(self.open)

    def tree(self, columns: list[Column]) -> Tree:
        """The same over feature values: a level is its indicator above a half, on the right."""
        feature, threshold = [], []
        for c, b, lv in zip(self.column, self.bin, self.level):
            feature.append(-1 if c < 0 else columns[c].features[b - 1 if lv else 0])
            threshold.append(0.0 if c < 0 else 0.5 if lv else float(columns[c].thresholds[b]))
        return Tree(np.array(feature), np.array(threshold), np.array(self.left), np.array(self.right), np.array(self.value))


def _reached(tree: tuple[np.ndarray, ...], x: np.ndarray, width: int) -> np.ndarray:
    """Node of every row; ``x``: columns by rows of codes below ``width``."""
    column, at_bin, level, left, right, _ = tree
    n = x.shape[1]
    at = np.zeros(n, np.int64)
    if len(column) < 2 or not n:
        return at
    codes, leaf = np.arange(width), column[:, None] < 0
    go_left = np.where(level[:, None], codes != at_bin[:, None], codes <= at_bin[:, None])
    after = np.where(leaf, np.arange(len(column))[:, None], np.where(go_left, left[:, None], right[:, None])).ravel()
    flat, rows, starts = np.ascontiguousarray(x).ravel(), np.arange(n), np.maximum(column, 0) * n
    for _ in range(len(column) // 2):   # as deep as a tree of so many nodes can be
        then = after.take(at * width + flat.take(starts.take(at) + rows))
        if np.array_equal(then, at):
            break
        at = then
    return at


@dataclass(frozen=True)
class Setting:
    """One model: the frame and window it is trained on and its parameters."""

    frame: int = 0
    window: int = 0
    rate: float = 0.1
    n_rounds: int = 100
    depth: int = 5
    power: float = 1.5


@dataclass
class _Work:
    """A model being trained."""

    setting: Setting
    at: int                       # its row among the scores of its frame
    ensemble: TweedieEnsemble
    tree: Growing = field(default_factory=Growing)
    unfolded: list[tuple] = field(default_factory=list)


def _sums(batches: Iterator[pa.RecordBatch], jobs: dict[int, list[tuple]], columns: list[list[Column]],
          windows: Windows | None) -> Iterator[pa.RecordBatch]:
    """Per model the sums of g and h by (open node, column, bin), then those of loss and rows, over a task's blocks."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for frame, n, x, y, s, f in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            cols, width = columns[frame], max((c.bins for c in columns[frame]), default=1)
            x = np.frombuffer(x, np.uint8).reshape(len(cols), n)
            y, s = np.frombuffer(y), np.frombuffer(s, np.int32)
            scores = np.frombuffer(f).reshape(-1, n)
            rows_of: dict[int, np.ndarray] = {}
            for m, at, window, power, rate, done, tree, open_ in jobs.get(frame, []):
                if window not in rows_of:
                    rows_of[window] = _training(s, window, windows)
                rows = rows_of[window]
                xs, ys, score = x[:, rows], y[rows], scores[at, rows]
                for t in done:
                    score = score + rate * t[5].take(_reached(t, xs, width))
                a, b = np.exp((1 - power) * score), np.exp((2 - power) * score)
                g, h = b - ys * a, (power - 1) * ys * a + (2 - power) * b
                loss = b / (2 - power) - ys * a / (1 - power)
                place = np.full(len(tree[0]), -1)
                place[open_] = np.arange(len(open_))
                local = place.take(_reached(tree, xs, width))
                inside = np.flatnonzero(local >= 0)
                if len(inside) < len(local):
                    local, xs, g, h = local[inside], xs[:, inside], g[inside], h[inside]
                parts = []
                for w in (g, h):
                    parts += [np.bincount(local * c.bins + xs[i], weights=w, minlength=len(open_) * c.bins)[:len(open_) * c.bins]
                              for i, c in enumerate(cols)]
                    if not cols:
                        parts.append(np.bincount(local, weights=w, minlength=len(open_)))
                out = np.concatenate([*parts, [loss.sum(), len(ys)]])
                total[m] = total[m] + out if m in total else out
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["m", "v"])


def _training(segments: np.ndarray, window: int, windows: Windows | None) -> np.ndarray:
    if windows is None:
        return np.arange(len(segments))
    known = np.unique(segments)
    good = known[[windows.trains_on(window, int(v)) for v in known]] if len(known) else known
    return np.flatnonzero(np.isin(segments, good))


def best_splits(v: np.ndarray, n_open: int, cols: list[Column]) -> np.ndarray:
    """Per open node gain, column, bin, sums of g and h on the left, and of the node."""
    cells = sum(c.bins for c in cols) if cols else 1
    halves = v[:2 * n_open * cells].reshape(2, -1)
    out = np.zeros((n_open, 7))
    out[:, 0], at = -np.inf, 0
    if not cols:
        out[:, 5], out[:, 6] = halves
    for i, c in enumerate(cols):
        g, h = (halves[k, at:at + n_open * c.bins].reshape(n_open, c.bins) for k in range(2))
        at += n_open * c.bins
        whole_g, whole_h = g.sum(axis=1), h.sum(axis=1)
        out[:, 5], out[:, 6] = whole_g, whole_h
        if c.thresholds is None:   # the level is on the right
            gl, hl, first = whole_g[:, None] - g[:, 1:], whole_h[:, None] - h[:, 1:], 1
        else:
            gl, hl, first = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1], 0
        if not gl.shape[1]:
            continue
        gr, hr = whole_g[:, None] - gl, whole_h[:, None] - hl
        small = 1e-12 * whole_h[:, None]
        with np.errstate(all="ignore"):
            gain = gl * gl / hl + gr * gr / hr - (whole_g * whole_g / whole_h)[:, None]
        # nothing on one side, or no more gain than rounding makes
        floor = 1e-10 * np.abs(whole_g * whole_g / np.where(whole_h > 0, whole_h, 1))[:, None]
        gain = np.where((hl > small) & (hr > small) & (gain > floor), gain, -np.inf)
        b = gain.argmax(axis=1)
        rows = np.arange(n_open)
        better = gain[rows, b] > out[:, 0]
        found = np.column_stack([gain[rows, b], np.full(n_open, i), b + first, gl[rows, b], hl[rows, b]])
        out[better, :5] = found[better]
    return out


@contextmanager
def _plain_jobs(spark: SparkSession):
    """Without adaptive planning: the jobs of a fit are alike, and re-planning each costs more than it saves."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class _Trainer:
    def __init__(self, frames: Sequence[Frame], settings: Sequence[Setting], windows: Windows | None, every: int, max_bins: int, tolerance: float):
        self.every, self.tolerance, self.windows = every, tolerance, windows
        self.spark = frames[0].rows.sparkSession
        self.columns = [binned_columns(f, max_bins) for f in frames]
        seg = lambda f: F.col("segment") if "segment" in f.rows.columns else F.lit(0)
        sums = None
        for i, f in enumerate(frames):
            one = f.rows.groupBy(seg(f).cast("int").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(Y).cast("double")).alias("t")).select(F.lit(i).alias("frame"), "s", "n", "t")
            sums = one if sums is None else sums.unionByName(one)
        known = sums.collect()   # a row per frame and segment
        self.work: list[_Work] = []
        starts: list[list[float]] = [[] for _ in frames]
        for s in settings:
            if not 1 < s.power < 2:
                raise ValueError("power must lie strictly between 1 and 2")
            mine = [r for r in known if r["frame"] == s.frame and (windows is None or windows.trains_on(s.window, r["s"]))]
            n, t = sum(r["n"] for r in mine), sum(r["t"] or 0.0 for r in mine)
            if not n:
                raise ValueError(f"window {s.window} has no training rows")
            start = float(np.log(max(t / n, 1e-9)))
            self.work.append(_Work(s, len(starts[s.frame]), TweedieEnsemble(start, s.rate)))
            starts[s.frame].append(start)
        state = None
        for i, f in enumerate(frames):
            if starts[i]:
                one = _blocks(i, f, self.columns[i], np.array(starts[i])).withColumn("place", F.spark_partition_id())
                state = one if state is None else state.unionByName(one)
        # a share of every frame in each task, as frames whose models are finished drop out
        self.tasks, self.gathered = max(1, self.spark.sparkContext.defaultParallelism), 0
        state = state.repartitionById(self.tasks, "place").drop("place")
        self.state, self.held, self.folds = state.persist(), [], 0

    def run(self, save) -> list[TweedieEnsemble]:
        active, steps = list(range(len(self.work))), 0
        try:
            while active:
                steps += 1
                found, finished = self._step(active), []
                for m in active:
                    if self._grown(self.work[m], found[m]):
                        finished.append(m)
                if finished:
                    save(finished)
                    active = [m for m in active if m not in set(finished)]
                if active and steps % FOLD_EVERY == 0:
                    self._fold(active)
        finally:
            for s in (*self.held, self.state):
                s.unpersist()
        return [w.ensemble for w in self.work]

    def _step(self, active: list[int]) -> dict[int, tuple[np.ndarray, float]]:
        jobs: dict[int, list[tuple]] = {}
        opened = {}
        for m in active:
            w = self.work[m]
            opened[m] = len(w.tree.open)
            jobs.setdefault(w.setting.frame, []).append(
                (m, w.at, w.setting.window, w.setting.power, w.setting.rate, w.unfolded, w.tree.arrays(), np.array(w.tree.open)))
        columns, windows = self.columns, self.windows
        frame_of = {m: self.work[m].setting.frame for m in active}

        def added(batches) -> dict[int, np.ndarray]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for m, v in zip(batch.column("m").to_pylist(), batch.column("v").to_pylist()):
                    v = np.frombuffer(v)
                    total[m] = total[m] + v if m in total else v
            return total

        def searched(total: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
            return {m: np.concatenate([best_splits(v, opened[m], columns[frame_of[m]]).ravel(), v[-2:]]) for m, v in total.items()}

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = searched(added(batches))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], ["m", "v"])

        parts = self.state.where(F.col("frame").isin(list(jobs))).mapInArrow(lambda batches: _sums(batches, jobs, columns, windows), "m int, v binary")
        size = self.tasks * sum(16 * n * max(1, sum(c.bins for c in columns[frame_of[m]])) + 16 for m, n in opened.items())
        # added in the order of the tasks, so that a fit can be repeated
        if self.gathered + size <= GATHERED:
            self.gathered += size
            found = searched(added(parts.toArrow().to_batches()))
        else:
            dealt = parts.select("m", F.spark_partition_id().alias("task"), "v").repartition(min(len(active), self.tasks), "m")
            rows = dealt.sortWithinPartitions("m", "task").mapInArrow(search, "m int, v binary").collect()   # a line per open node
            found = {r["m"]: np.frombuffer(r["v"]) for r in rows}
        return {m: (v[:-2].reshape(-1, 7), v[-2] / v[-1]) for m, v in found.items()}

    def _grown(self, w: _Work, found: tuple[np.ndarray, float]) -> bool:
        """Take a step's splits; true if the model is finished."""
        splits, loss = found
        e, s = w.ensemble, w.setting
        if w.tree.depth == 0 and e.trees and (len(e.trees) % self.every == 0 or len(e.trees) == s.n_rounds):
            flat = bool(e.losses) and e.losses[-1] - loss <= self.tolerance * abs(loss)
            e.losses.append(float(loss))
            if flat or len(e.trees) == s.n_rounds:
                return True
        if not w.tree.split(splits, self.columns[s.frame], s.depth):
            e.trees.append(w.tree.tree(self.columns[s.frame]))
            w.unfolded.append(w.tree.arrays())
            w.tree = Growing()
        return False

    def _fold(self, active: list[int]) -> None:
        """Add finished trees to the kept scores; those of finished models go."""
        jobs: dict[int, list[tuple]] = {}
        for m in active:
            w = self.work[m]
            mine = jobs.setdefault(w.setting.frame, [])
            mine.append((w.at, w.setting.rate, w.unfolded))
            w.at, w.unfolded = len(mine) - 1, []
        columns = [len(c) for c in self.columns]
        widths = [max((c.bins for c in cols), default=1) for cols in self.columns]

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fresh = []
                for frame, n, x, f in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 5))):
                    x = np.frombuffer(x, np.uint8).reshape(columns[frame], n)
                    scores = np.frombuffer(f).reshape(-1, n)[[at for at, _, _ in jobs[frame]]]
                    for row, (_, rate, trees) in zip(scores, jobs[frame]):
                        for t in trees:
                            row += rate * t[5].take(_reached(t, x, widths[frame]))
                    fresh.append(scores.tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(fresh, pa.binary())], BLOCK_NAMES)

        self.folds += 1
        self.held.append(self.state)
        self.state = self.state.where(F.col("frame").isin(list(jobs))).mapInArrow(fold, BLOCK_SCHEMA).persist()
        if self.folds % CUT_EVERY == 0:
            before, self.state = self.state, cut_lineage(self.state)
            for old in (*self.held, before):
                old.unpersist()
            self.held = []
            self.state = self.state.persist()


def fit_many(frames: Sequence[Frame], settings: Sequence[Setting], windows: Windows | None = None, every: int = 5,
             max_bins: int = 32, tolerance: float = 1e-3, log: str | None = None,
             names: Sequence[str] | None = None) -> list[TweedieEnsemble]:
    """Train all models side by side.

    Every ``every`` rounds the loss is taken; a model ends early when it has fallen by no more than ``tolerance`` (a
    share of it) since the last time.  ``log``: a folder every finished model is appended to under its name; models it
    holds already aren't trained again, so that a job that was killed goes on where it was."""
    spark = frames[0].rows.sparkSession
    names = list(names or [json.dumps(asdict(s), sort_keys=True) for s in settings])
    done = read_log(spark, log) if log else {}
    missing = [i for i, n in enumerate(names) if n not in done]
    fresh: dict[int, TweedieEnsemble] = {}
    if missing:
        held = [Frame(f.rows.persist(), f.features, f.groups) for f in frames]
        with _plain_jobs(spark):
            trainer = _Trainer(held, [settings[i] for i in missing], windows, every, max_bins, tolerance)

            def save(finished: list[int]) -> None:
                if log:
                    rows = [(names[missing[m]], json.dumps(asdict(trainer.work[m].ensemble), default=np.ndarray.tolist)) for m in finished]
                    spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("append").json(log)

            try:
                fresh = dict(zip(missing, trainer.run(save)))
            finally:
                for f in held:
                    f.rows.unpersist()
    return [fresh[i] if i in fresh else done[n] for i, n in enumerate(names)]


def read_log(spark: SparkSession, path: str) -> dict[str, TweedieEnsemble]:
    """Finished models by name; none where there is no log yet."""
    try:
        rows = spark.read.schema(LOG_SCHEMA).json(path).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    out = {}
    for r in rows:
        m = json.loads(r["ensemble"])
        out[r["model"]] = TweedieEnsemble(**m | {"trees": [Tree(**{k: np.array(v) for k, v in t.items()}) for t in m["trees"]]})
    return out


def fit_tweedie(rows: DataFrame, power: float = 1.5, n_rounds: int = 100, rate: float = 0.1, depth: int = 5,
                max_bins: int = 32, checkpoint_every: int = 5, tolerance: float = 1e-3) -> TweedieEnsemble:
    """Boost on rows (features vector, y): one model."""
    size = rows.select(F.size(vector_to_array("features")).alias("n")).first()["n"]
    names = [f"f{i}" for i in range(size)]
    x = vector_to_array("features")
    frame = Frame(rows.select(Y, *[x[i].alias(n) for i, n in enumerate(names)]), names)
    return fit_many([frame], [Setting(rate=rate, n_rounds=n_rounds, depth=depth, power=power)], None, checkpoint_every, max_bins, tolerance)[0]


def ensemble_predictor(models: Mapping[int, TweedieEnsemble]) -> Predictor:
    return lambda window, x, on: models[window].predict(x)


def prepared_frame(panel: DataFrame, spec: LagSpec, windows: Windows | None = None) -> Frame:
    """Training rows of all windows, with the calendar indicators as groups."""
    weekdays = [f"weekday_{d}" for d in WEEKDAYS[1:]] if spec.weekday else []
    months = [f"month_{m}" for m in MONTHS[1:]] if spec.month else []
    return Frame(lag_frame(panel, spec, windows).drop(ID, DS), spec.features(), [g for g in (weekdays, months) if g])


def tweedie_backtest(panel: DataFrame, spec: LagSpec, windows: Windows, name: str = "TweedieGBT",
                     frame: Frame | None = None, checkpoint_every: int = 5, max_bins: int = 32, tolerance: float = 1e-3,
                     log: str | None = None, **params) -> tuple[DataFrame, dict[int, TweedieEnsemble]]:
    """Pooled boosted trees: predictions of every window and the ensemble per window, all trained side by side.

    ``frame``: what ``prepared_frame`` gives, kept by the caller for several calls of equal lags and windows."""
    frame = frame or prepared_frame(panel, spec, windows)
    settings = [Setting(0, i, **params) for i in range(windows.n_windows)]
    models = dict(enumerate(fit_many([frame], settings, windows, checkpoint_every, max_bins, tolerance, log)))
    return recursive_backtest(panel, spec, windows, {name: ensemble_predictor(models)}), models


def tweedie_forecast(panel: DataFrame, spec: LagSpec, h: int, future: DataFrame | None = None,
                     name: str = "TweedieGBT", **params) -> tuple[DataFrame, TweedieEnsemble]:
    """Pooled boosted trees on the whole panel: the next h days, and the ensemble."""
    model = fit_many([prepared_frame(panel, spec)], [Setting(**params)])[0]
    return forecast(panel, spec, h, {name: ensemble_predictor({0: model})}, future), model


def split_importance(panel: DataFrame, spec: LagSpec, models: Mapping[int, TweedieEnsemble],
                     folds: Mapping[int, str]) -> DataFrame:
    """Number of splits per feature and fold: (feature, fold, value)."""
    names = spec.features()
    rows = [(n, folds[i], float(v)) for i, m in models.items() for n, v in zip(names, m.split_counts(len(names)))]
    return panel.sparkSession.createDataFrame(rows, "feature string, fold string, value double")
