"""Trees, forests, boosted trees and logistic models of all folds of a table, fitted in passes that they share.

A fit of its own for each model and fold reads the rows several times and keeps them. Here one pass over the rows serves every tree that is
growing, in every fold, and no row is kept. Inputs are cut into ranges once (`cut_rows`): a row is then one byte an input. A pass sums weights and
targets by tree, open node, input and range in each task, the tasks' sums meet by tree, and the driver chooses the splits of a level from
numbers that trees, nodes and ranges bound. Logistic models take Newton steps, whose sums of products are added the same way.

The definitions are those of pyspark.ml's models, whose parameters are read: variance (for classes the same as Gini impurity), bootstrap weights
of a Poisson number a row, a random choice of inputs a node, boosting by the gradients of squared and logistic loss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from math import ceil, factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks of a pass for each core; rows of the sample that ranges are cut by, as in pyspark.ml.
TASKS, SAMPLE = 3, 10_000
_POISSON = np.cumsum([np.exp(-1) / factorial(i) for i in range(16)])


@dataclass
class Tree:
    """Nodes as in a heap, the root 1: the input compared (-1: a leaf), the last range that goes left, the mean target; those still to be split."""

    depth: int
    input: np.ndarray
    last: np.ndarray
    value: np.ndarray
    open: list[int] = field(default_factory=lambda: [1])

    @classmethod
    def root(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1)
        return cls(depth, np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            of = self.input[at]
            inner = of >= 0
            if not inner.any():
                break
            at = np.where(inner, 2 * at + (bins[rows, of] > self.last[at]), at)
        return at


@dataclass(frozen=True)
class Trees:
    """What pyspark.ml's parameters say: the target's column, trees, their depth, ranges, inputs a node, seed; boosted by a loss, or side by side."""

    label: str
    count: int
    depth: int
    bins: int
    seed: int
    share: str = "all"
    drawn: bool = False
    step: float = 0.0
    classes: bool = False

    def inputs(self, n: int) -> int:
        """How many of n inputs a node chooses from."""
        return {"all": n, "root": ceil(n**0.5), "third": ceil(n / 3)}[self.share]


@dataclass(frozen=True)
class Logistic:
    label: str
    steps: int
    tol: float


#: Parameters that say the same here as in pyspark.ml; any other must have its default.
_KNOWN = {"featuresCol", "labelCol", "predictionCol", "maxDepth", "maxBins", "maxIter", "numTrees", "seed", "stepSize", "tol"}


def described(model) -> Trees | Logistic | None:
    """The parameters of a model that is fitted here; None for any other, and where a parameter is set that is not known here."""
    if any(p.name not in _KNOWN and (not model.hasDefault(p) or v != model._defaultParamMap[p]) for p, v in model._paramMap.items()):
        return None
    if isinstance(model, LogisticRegression):
        return Logistic(model.getLabelCol(), model.getMaxIter(), model.getTol())
    if not isinstance(model, (DecisionTreeRegressor, RandomForestRegressor, RandomForestClassifier, GBTRegressor, GBTClassifier)):
        return None
    each = {"label": model.getLabelCol(), "depth": model.getMaxDepth(), "bins": model.getMaxBins(), "seed": model.getSeed()}
    if each["bins"] > 256 or each["depth"] > 10:
        return None
    if isinstance(model, DecisionTreeRegressor):
        return Trees(count=1, **each)
    if isinstance(model, (GBTRegressor, GBTClassifier)):
        return Trees(count=model.getMaxIter(), step=model.getStepSize(), classes=isinstance(model, GBTClassifier), **each)
    n = model.getNumTrees()
    share = "all" if n == 1 else "root" if isinstance(model, RandomForestClassifier) else "third"
    return Trees(count=n, share=share, drawn=n > 1, **each)


@dataclass(frozen=True)
class Ranges:
    """The bounds of each input's ranges, and mean and spread of the inputs in the sample that they were found in."""

    cuts: list[np.ndarray]
    mean: np.ndarray
    spread: np.ndarray


def cut_rows(x: DataFrame, bins: int) -> tuple[DataFrame, Ranges]:
    """x(x vector, any column) → its rows with x as an array, `bins`, a byte an input, and `row`, a number; and the ranges.

    A value goes to the first range whose bound is not below it. Where the sample has few values each is a range, otherwise ranges hold about equal shares of it.
    """
    n = x.count()
    t = x.withColumns({"x": vector_to_array("x"), "row": F.monotonically_increasing_id()})

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [v for v in (_numbers(batch.column("x"), batch.num_rows) for batch in batches) if len(v)]
        if not rows:
            return
        sample = np.concatenate(rows)
        cuts = []
        for column in sample.T:
            values, counts = np.unique(column, return_counts=True)
            between = values[:-1] + (values[1:] - values[:-1]) / 2
            if values.size > bins:
                at = np.searchsorted(np.cumsum(counts), np.arange(1, bins) * len(column) / bins)
                between = np.unique(between[np.minimum(at, between.size - 1)])
            cuts.append(between)
        whole = lambda v: pa.array([v.tolist()] * len(cuts), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(cuts)), pa.int64()), "cuts": pa.array(cuts, pa.list_(pa.float64())), "mean": whole(sample.mean(0)), "spread": whole(sample.std(0))})

    drawn = t.select("x") if n <= SAMPLE else t.select("x").sample(min(1.0, 1.5 * max(SAMPLE, bins * bins) / n), seed=7)
    got = sorted(drawn.repartition(1).mapInArrow(bounds, "at long, cuts array<double>, mean array<double>, spread array<double>").collect())  # a row an input
    cuts = [np.array(r["cuts"]) for r in got]
    mean, spread = (np.array(got[0][c]) if got else np.zeros(0) for c in ("mean", "spread"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _numbers(batch.column("x"), batch.num_rows)
            own = np.empty((batch.num_rows, len(cuts)), np.uint8)
            for i, c in enumerate(cuts):
                own[:, i] = np.searchsorted(c, values[:, i]) if c.size else 0
            starts = pa.py_buffer(np.arange(batch.num_rows + 1, dtype=np.int32) * len(cuts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, starts, pa.py_buffer(own)])], names=[*batch.schema.names, "bins"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema)
    return t.mapInArrow(cut, f"{kinds}, bins binary"), Ranges(cuts, mean, np.where(spread > 0, spread, 1.0))


def _numbers(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def _bytes(column: pa.Array) -> np.ndarray:
    _, starts, data = column.cast(pa.binary()).buffers()
    starts = np.frombuffer(starts, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]].reshape(len(column), -1)


def _draws(rows: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row stands in a tree's bootstrap sample: a Poisson number from the hashed row."""
    z = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + tree + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)) * 2.0**-53, "right").astype(float)


def _total(t: DataFrame, add: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """The sums over all tasks of the numbers that add gives for each key."""
    kind = "key long, sums binary"
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([v.tobytes() for _, v in rows], pa.binary())], names=["key", "sums"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in add(batches):
            yield table([one])

    def meet(parts: pa.Table) -> pa.Table:
        sums = None
        for v in parts.column("sums"):
            v = np.frombuffer(v.as_buffer())
            sums = v.copy() if sums is None else np.add(sums, v, out=sums)
        return pa.Table.from_batches([table([(parts.column("key")[0].as_py(), sums)])])

    few = t.coalesce(TASKS * t.sparkSession.sparkContext.defaultParallelism)
    return {r["key"]: np.frombuffer(r["sums"]) for r in few.mapInArrow(each, kind).groupBy("key").applyInArrow(meet, kind).collect()}  # a row a key


def _margin(trees: list[Tree], step: float, bins: np.ndarray) -> np.ndarray:
    """The sum of boosted trees: the first counts whole."""
    out = np.zeros(len(bins))
    for i, tree in enumerate(trees):
        out += (step if i else 1.0) * tree.value[tree.nodes(bins)]
    return out


def _gradient(spec: Trees, target: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """The negative gradient of the loss: 2 log(1 + exp(-2 t m)) for classes t of -1 and 1, else the squared error."""
    return 4 * target / (1 + np.exp(np.minimum(2 * target * margin, 700))) if spec.classes else 2 * (target - margin)


def _shifted(spec: Trees, target: np.ndarray, middle: float) -> np.ndarray:
    return 2 * target - 1 if spec.classes else target - middle


def grown_trees(t: DataFrame, specs: dict[str, Trees], folds: Iterable[int], cuts: list[np.ndarray]) -> dict[tuple[str, int], tuple[list[Tree], float]]:
    """t as cut_rows gives it, with `fold` and the targets → by model and fold left out its trees and the number to be added to their values.

    Targets are taken from their mean, so that sums of far more rows than their spread stay exact enough.
    """
    labels = sorted({s.label for s in specs.values()})
    means = t.agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in labels)).first()
    middle = {name: 0.0 if s.classes or means[s.label] is None else float(means[s.label]) for name, s in specs.items()}
    used = [i for i, c in enumerate(cuts) if c.size]
    width = max([len(c) for c in cuts], default=0) + 1
    done: dict[tuple[str, int], list[Tree]] = {(name, k): [] for name in specs for k in folds}
    growing: dict[tuple[str, int, int], Tree] = {}

    def start(name: str, k: int) -> None:
        """The next tree of a boosted model, or all trees of another."""
        s, n = specs[name], len(done[name, k])
        for i in range(n, min(n + 1, s.count) if s.step else s.count):
            growing[name, k, i] = Tree.root(s.depth)

    def choice(name: str, i: int, node: int) -> list[int]:
        s = specs[name]
        own = s.inputs(len(cuts))
        return used if own >= len(cuts) else sorted(set(used) & set(np.random.default_rng([s.seed, i, node]).choice(len(cuts), own, replace=False).tolist()))

    for name, k in done:
        start(name, k)
    while growing:
        jobs = []
        for (name, k, i), tree in growing.items():
            at = [choice(name, i, node) for node in tree.open]
            jobs.append((name, k, i, tree, at, sorted(set().union(*at))))
        known = t.sparkSession.sparkContext.broadcast((jobs, done))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
            jobs, done = known.value  # noqa: B023
            sums = [np.zeros((2, 1 + len(asked), len(tree.open), width)) for _, _, _, tree, _, asked in jobs]
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, fold, rows = _bytes(batch.column("bins")), batch.column("fold").to_numpy(), batch.column("row").to_numpy()
                columns = {f: bins[:, f].astype(np.int64) for f in used}
                targets = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in labels}
                here, drawn = {}, {}
                for (name, k, i, tree, _, asked), s in zip(jobs, sums, strict=True):
                    spec = specs[name]
                    if (name, k) not in here:
                        target = _shifted(spec, targets[spec.label], middle[name])
                        here[name, k] = _gradient(spec, target, _margin(done[name, k], spec.step, bins)) if done[name, k] and spec.step else target
                    if spec.drawn and (spec.seed, i) not in drawn:
                        drawn[spec.seed, i] = _draws(rows, spec.seed, i)
                    n = len(tree.open)
                    place = np.full(2 ** (tree.depth + 1), -1)
                    place[tree.open] = np.arange(n)
                    node = place[tree.nodes(bins)]
                    taken = (fold != k) & (node >= 0) & ~np.isnan(here[name, k])
                    w = drawn[spec.seed, i] if spec.drawn else np.ones(len(bins))
                    node, w, g = node[taken], w[taken], here[name, k][taken]
                    g = w * g
                    s[0, 0, :, 0] += np.bincount(node, w, n)
                    s[1, 0, :, 0] += np.bincount(node, g, n)
                    node = node * width
                    for j, f in enumerate(asked, 1):
                        at = node + columns[f][taken]
                        s[0, j] += np.bincount(at, w, n * width).reshape(n, width)
                        s[1, j] += np.bincount(at, g, n * width).reshape(n, width)
            yield from enumerate(s.ravel() for s in sums)

        told = _total(t.select("bins", "fold", "row", *(F.col(c).cast("double").alias(c) for c in labels)), add)
        for j, (name, k, i, tree, at, asked) in enumerate(jobs):
            sums = told[j].reshape(2, 1 + len(asked), len(tree.open), width) if j in told else np.zeros((2, 1 + len(asked), len(tree.open), width))
            _split(tree, at, asked, sums)
            if not tree.open:
                done[name, k].append(growing.pop((name, k, i)))
                if specs[name].step:
                    start(name, k)
        known.unpersist()
    return {key: (trees, middle[key[0]]) for key, trees in done.items()}


def _split(tree: Tree, at: list[list[int]], asked: list[int], sums: np.ndarray) -> None:
    """Splits the open nodes where that lessens the variance; their children are open unless they are at the greatest depth."""
    children = []
    for n, node in enumerate(tree.open):
        w, s = sums[0, 0, n, 0], sums[1, 0, n, 0]
        if not w:
            continue
        tree.value[node] = s / w
        own = [asked.index(f) + 1 for f in at[n]]
        if not own:
            continue
        left_w, left_s = np.cumsum(sums[0, own, n], 1)[:, :-1], np.cumsum(sums[1, own, n], 1)[:, :-1]
        right_w, right_s = w - left_w, s - left_s
        some = (left_w > 0.5) & (right_w > 0.5)  # weights are whole numbers
        gain = np.where(some, left_s**2 / np.where(some, left_w, 1) + right_s**2 / np.where(some, right_w, 1) - s * s / w, -np.inf)
        best = int(gain.argmax()) if gain.size else 0
        if not gain.size or not gain.flat[best] > 1e-12 * (1 + s * s / w):
            continue
        i, cut = np.unravel_index(best, gain.shape)
        tree.input[node], tree.last[node] = at[n][i], cut
        for child, cw, cs in ((2 * node, left_w, left_s), (2 * node + 1, right_w, right_s)):
            tree.value[child] = cs[i, cut] / cw[i, cut]
            children.append(child)
    tree.open = [c for c in children if c < 2**tree.depth]


def scores(spec: Trees, trees: list[Tree], middle: float, bins: np.ndarray) -> np.ndarray:
    """The prediction of a fitted model for cut rows, for classes the probability of 1."""
    if spec.step:
        margin = _margin(trees, spec.step, bins)
        return 1 / (1 + np.exp(-np.clip(2 * margin, -700, 700))) if spec.classes else margin + middle
    return middle + sum((tree.value[tree.nodes(bins)] for tree in trees), np.zeros(len(bins))) / max(1, len(trees))


def logistic_models(t: DataFrame, spec: Logistic, folds: Iterable[int], ranges: Ranges) -> dict[int, np.ndarray]:
    """By fold left out the coefficients of (1, scaled inputs) after at most spec.steps passes; a step that adds to the loss is halved.

    Dependent and constant inputs share their slope's least form.
    """
    n, mean, spread = len(ranges.mean) + 1, ranges.mean, ranges.spread
    now, last, best = ({k: v for k in folds} for v in (np.zeros(n), np.zeros(n), np.inf))
    open_ = list(now)
    for _ in range(spec.steps + 1):

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
            sums = {k: np.zeros(2 + n + n * n) for k in open_}  # noqa: B023
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.ones((batch.num_rows, n))
                x[:, 1:] = (_numbers(batch.column("x"), batch.num_rows) - mean) / spread
                fold, y = batch.column("fold").to_numpy(), batch.column("y").to_numpy(zero_copy_only=False)
                for k, s in sums.items():
                    taken = (fold != k) & ~np.isnan(y)
                    own, z = x[taken], y[taken]
                    m = own @ now[k]
                    p = 1 / (1 + np.exp(-np.clip(m, -700, 700)))
                    s[0] += len(own)
                    s[1] += (np.logaddexp(0, m) - z * m).sum()
                    s[2 : 2 + n] += own.T @ (z - p)
                    s[2 + n :] += ((own * (p * (1 - p))[:, None]).T @ own).ravel()
            yield from sums.items()

        told = _total(t.select("x", "fold", F.col(spec.label).cast("double").alias("y")), add)
        for k in list(open_):
            count, loss, slope, bend = told[k][0], told[k][1], told[k][2 : 2 + n], told[k][2 + n :].reshape(n, n)
            if not count:
                open_.remove(k)
            elif loss > best[k] * (1 + 1e-12):
                now[k] = (now[k] + last[k]) / 2
            else:
                if best[k] - loss <= spec.tol * abs(loss):
                    open_.remove(k)
                last[k], best[k] = now[k], loss
                now[k] = now[k] + np.linalg.lstsq(bend / count, slope / count, rcond=1e-10)[0]
        if not open_:
            break
    return last


def held_out(t: DataFrame, ranges: Ranges, models: dict[str, Trees | Logistic], folds: Iterable[int], keep: tuple[str, ...]) -> DataFrame:
    """t as cut_rows gives it, with `fold` and the targets → of the folds' rows the columns `keep` and, by each model's name, the score by the model of all other rows."""
    folds, trees = list(folds), {name: m for name, m in models.items() if isinstance(m, Trees)}
    grown = grown_trees(t, trees, folds, ranges.cuts) if trees else {}
    lines = {name: logistic_models(t, m, folds, ranges) for name, m in models.items() if isinstance(m, Logistic)}
    known = t.sparkSession.sparkContext.broadcast((grown, lines))
    read = [c for c in ("x", "fold") if c not in keep and (c != "x" or lines)]
    t = t.where(F.col("fold").isin(folds)).select(*keep, *read, "bins")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown, lines = known.value
        for batch in batches:
            told = {name: np.zeros(batch.num_rows) for name in models}
            fold = batch.column("fold").to_numpy()
            bins, x = _bytes(batch.column("bins")), (_numbers(batch.column("x"), batch.num_rows) - ranges.mean) / ranges.spread if lines else None
            for k in np.unique(fold):
                own = fold == k
                for name, m in trees.items():
                    told[name][own] = scores(m, *grown[name, int(k)], bins[own])
                for name, c in lines.items():
                    told[name][own] = 1 / (1 + np.exp(-np.clip(c[int(k)][0] + x[own] @ c[int(k)][1:], -700, 700)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(told[name]) for name in models)], names=[*keep, *models])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.select(*keep).schema)
    return t.mapInArrow(tell, ", ".join([kinds, *(f"{name} double" for name in models)]))
