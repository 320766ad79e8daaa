"""Spatial domains: repeated mixture fits, their agreement, and the chosen k.

Comparisons: for every k and each neighbouring k, the agreement of every pair of
runs. One extra k is fitted on both sides of the range, so each candidate has two
neighbours and ``2 * runs**2`` comparisons. k = 1 is a constant label.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.lineage import cut

ID = ["sample_id", "cell_id"]

#: Added to variances, in units of the whole spread, so that no component shrinks to a point.
RIDGE = 1e-6
#: Rows a task spreads out at a time, or as many as give so many numbers.
STEP, NUMBERS = 256, 2**14
#: Shares below the exponential of this are not told apart: they add nothing, and the smallest doubles are slow.
LEAST = -600.0
#: About so many cells, by hash, take fits further before all cells are scanned, if those are eight times as many.
MIDDLE = 2**18


def as_vectors(df: DataFrame, vec: str = "features", reduce_to: int | None = None) -> DataFrame:
    """Cells with an ML vector, optionally reduced before the mixture fits."""
    vectors = df.select(*ID, array_to_vector(F.col(vec)).alias("features"))
    if reduce_to is None:
        return vectors
    model = PCA(k=reduce_to, inputCol="features", outputCol="reduced").fit(vectors)
    return model.transform(vectors).select(*ID, F.col("reduced").alias("features"))


@dataclass
class Mixture:
    """One fitted mixture, in the units of the vectors it was fitted to."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float


class _Stack:
    """Open fits side by side: every component one column of weights over monomials.

    A cell's vector, standardised, is spread out as ``1, x, x xᵀ``. Log densities of all
    components of all fits are then one product with the columns, and the sums an update needs are
    one product of responsibilities with the monomials.
    """

    def __init__(self, centre: np.ndarray, scale: np.ndarray):
        self.centre, self.scale = centre, scale
        self.pairs = np.triu_indices(len(centre))

    def columns(self, weights, means, covariances) -> np.ndarray:
        """One row per component: its log density's coefficients, weight included."""
        d = len(self.centre)
        low = np.linalg.cholesky(covariances)
        inverse = np.linalg.inv(low)
        precision = np.swapaxes(inverse, 1, 2) @ inverse
        linear = np.einsum("kij,kj->ki", precision, means)
        log_det = 2 * np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1)
        constant = np.log(weights) - 0.5 * (d * np.log(2 * np.pi) + log_det + (linear * means).sum(1))
        twice = np.where(self.pairs[0] == self.pairs[1], 0.5, 1.0)
        return np.hstack([constant[:, None], linear, -precision[:, self.pairs[0], self.pairs[1]] * twice])

    def updated(self, sums: np.ndarray, old: tuple) -> tuple:
        """Weights, means and covariances from one fit's sums; an empty component stays as it was."""
        d = len(self.centre)
        n = sums[:, 0]
        held = np.maximum(n, 1e-8)[:, None]
        means = sums[:, 1 : d + 1] / held
        square = np.zeros((len(n), d, d))
        square[:, self.pairs[0], self.pairs[1]] = sums[:, d + 1 :] / held
        square[:, self.pairs[1], self.pairs[0]] = square[:, self.pairs[0], self.pairs[1]]
        covariances = square - means[:, :, None] * means[:, None, :] + RIDGE * np.eye(d)
        thin = (n < 1e-3) | (np.linalg.eigvalsh(covariances)[:, 0] < RIDGE / 2)
        means[thin], covariances[thin] = old[1][thin], old[2][thin]
        weights = np.maximum(n, 1e-8) / np.maximum(n, 1e-8).sum()
        return weights, means, covariances

    def task(self, columns: np.ndarray, sizes: list[int], labels: bool):
        """The function a task runs over batches of cells: labels of all fits, or sums and likelihoods."""
        centre, scale, (rows, cols) = self.centre, self.scale, self.pairs
        step, least = max(STEP, NUMBERS // columns.shape[1]), LEAST
        ends = np.cumsum(sizes)
        # One fit at a time, so that what is computed for a step of cells stays in the processor's cache.
        fits = [slice(high - k, high) for k, high in zip(sizes, ends)]

        def spread(values):
            for low in range(0, len(values), step * len(centre)):
                x = (values[low : low + step * len(centre)].reshape(-1, len(centre)) - centre) / scale
                yield np.hstack([np.ones((len(x), 1)), x, x[:, rows] * x[:, cols]])

        def sums(batches):
            total, likelihood = np.zeros(columns.shape), np.zeros(len(sizes))
            for block in (np.frombuffer(v.as_buffer()) for batch in batches for v in batch.column("v")):
                for monomials in spread(block):
                    across = np.ascontiguousarray(monomials.T)
                    for place, fit in enumerate(fits):
                        logs = columns[fit] @ across
                        top = logs.max(0)
                        logs -= top
                        np.maximum(logs, least, out=logs)
                        np.exp(logs, out=logs)
                        whole = logs.sum(0)
                        likelihood[place] += (top + np.log(whole)).sum()
                        logs /= whole
                        total[fit] += logs @ monomials
            blocks = [np.append(total[fit].ravel(), at) for fit, at in zip(fits, likelihood, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sizes)), pa.int32()), pa.array([b.tolist() for b in blocks])], names=["fit", "sums"])

        def best(batches):
            for batch in batches:
                found = []
                for monomials in spread(batch.column("v").flatten().to_numpy(zero_copy_only=False)):
                    across = np.ascontiguousarray(monomials.T)
                    found.append(np.stack([(columns[fit] @ across).argmax(0) for fit in fits], 1))
                flat = np.concatenate(found).ravel() if found else np.zeros(0, np.int64)
                bounds = np.arange(0, len(flat) + 1, len(sizes)) if found else np.zeros(1, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("sample_id"), batch.column("cell_id"), lists], names=["sample_id", "cell_id", "labels"])

        return best if labels else sums


def _arrays(vectors: DataFrame) -> DataFrame:
    return vectors.select(*ID, vector_to_array("features").alias("v"))


def _blocks(vectors: DataFrame) -> DataFrame:
    """Cells dealt out evenly, the vectors of a batch of them as the bytes of one row."""

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("v").flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary())], names=["v"])

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(_arrays(vectors).repartition(parts, *ID).select("v").mapInArrow(packed, "v binary"))


def _starting(vectors: DataFrame, rows: int = 4096) -> tuple[_Stack, np.ndarray, int]:
    """Units of the vectors, a bounded sample by hash from which fits start, and the number of vectors."""
    if vectors.isEmpty():
        raise ValueError("there are no vectors to fit to")
    facts = vectors.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("features")).alias("s")).first()["s"]
    scale = np.sqrt(np.asarray(facts["variance"].toArray()))
    stack = _Stack(facts["mean"].toArray(), np.where(scale > 0, scale, 1.0))
    drawn = _arrays(vectors).orderBy(F.xxhash64(*ID), *ID).limit(rows).collect()
    return stack, (np.array([row["v"] for row in drawn]) - stack.centre) / stack.scale, facts["count"]


def _seeded(sample: np.ndarray, k: int, seed: int) -> tuple:
    """Starting components: centres far apart, each the best of a few drawn by squared distance to those before."""
    rng = np.random.default_rng(seed)
    centres = [sample[rng.integers(len(sample))]]
    nearest = ((sample - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        total = nearest.sum()
        drawn = sample[rng.choice(len(sample), 2 + int(np.log(k)), p=nearest / total if total > 0 else None)]
        left = np.minimum(nearest, ((sample[None, :, :] - drawn[:, None, :]) ** 2).sum(2))
        best = left.sum(1).argmin()
        centres.append(drawn[best])
        nearest = left[best]
    means = np.array(centres)
    own = ((sample[:, None, :] - means[None, :, :]) ** 2).sum(2).min(1).mean() / sample.shape[1]
    covariances = np.repeat((max(own, RIDGE) * np.eye(sample.shape[1]))[None], k, 0)
    return np.full(k, 1 / k), means, covariances


def _climbed(stack: _Stack, state: dict, scan, max_iter: int, tol: float) -> tuple[dict, float]:
    """Advances the fits of ``state`` together until each gains no more than ``tol`` a cell.

    ``scan(columns, sizes)`` gives the place and the sums of every open fit. Returns log likelihoods
    and the number of cells.
    """
    before, done, n = dict.fromkeys(state, -np.inf), set(), 0
    for _ in range(max_iter):
        now = [fit for fit in state if fit not in done]
        if not now:
            break
        columns = np.vstack([stack.columns(*state[fit]) for fit in now])
        for place, sums in scan(columns, [k for k, _ in now]):
            fit = now[place]
            block, likelihood = sums[:-1].reshape(fit[0], -1), sums[-1]
            n = n or block[:, 0].sum()
            gain, before[fit] = (likelihood - before[fit]) / n, likelihood
            if gain <= tol:
                done.add(fit)
            else:
                state[fit] = stack.updated(block, state[fit])
    return before, n


def fit_many(vectors: DataFrame, fits: list[tuple[int, int]], seed: int = 0, max_iter: int = 100, tol: float = 1e-3) -> dict:
    """All mixtures ``(k, run)`` together: every scan of the cells advances all that are still open.

    Fits first go as far as the bounded sample they start from can take them, then as a larger part of
    many cells can, so that few scans of all cells are left. Cells are dealt out evenly, as scans are bound by arithmetic. A fit closes once
    its mean log likelihood over all cells gains no more than ``tol`` a cell. Sums of a scan are
    added up per fit by Spark; the driver holds the parameters and the sample, not cells.
    """
    stack, sample, cells = _starting(vectors)
    rows = _blocks(vectors)
    state = {fit: _seeded(sample, fit[0], seed + 1000 * fit[0] + fit[1]) for fit in fits}
    drawn = pa.RecordBatch.from_arrays([pa.array([(sample * stack.scale + stack.centre).tobytes()], pa.binary())], names=["v"])

    def of_sample(columns, sizes):
        found = next(stack.task(columns, sizes, False)(iter([drawn])))
        return enumerate(np.array(sums) for sums in found.column("sums").to_pylist())

    def of_rows(some):
        def scan(columns, sizes):
            parts = some.mapInArrow(stack.task(columns, sizes, False), "fit int, sums array<double>")
            found = parts.groupBy("fit").agg(Summarizer.sum(array_to_vector("sums")).alias("sums")).collect()
            return [(row["fit"], row["sums"].toArray()) for row in found]

        return scan

    _climbed(stack, state, of_sample, max_iter, tol)
    if cells >= 8 * MIDDLE:
        part = F.pmod(F.xxhash64(*ID, F.lit(1)), F.lit(cells // MIDDLE)) == 0
        _climbed(stack, state, of_rows(_blocks(vectors.where(part))), max_iter, tol)
    before, n = _climbed(stack, state, of_rows(rows), max_iter, tol)
    shift = np.log(stack.scale).sum() * n
    return {
        fit: Mixture(
            weights, means * stack.scale + stack.centre,
            covariances * stack.scale[:, None] * stack.scale[None, :], float(before[fit] - shift),
        )
        for fit, (weights, means, covariances) in state.items()
    }


def fit_one(vectors: DataFrame, k: int, run: int, seed: int = 0, max_iter: int = 100, tol: float = 1e-3) -> Mixture:
    """One fitted mixture; the start differs from run to run."""
    return fit_many(vectors, [(k, run)], seed, max_iter, tol)[k, run]


def stacked_labels(vectors: DataFrame, models: list[Mixture]) -> DataFrame:
    """``(sample_id, cell_id, labels)``: the label under each of the models, by one scan."""
    spread = np.sqrt(np.mean([np.diagonal(m.covariances, axis1=1, axis2=2).mean(0) for m in models], 0))
    centre = np.mean([m.weights @ m.means for m in models], 0)
    scale = np.maximum(np.sqrt(np.mean([m.weights @ (m.means - centre) ** 2 for m in models], 0) + spread**2), 1e-300)
    stack = _Stack(centre, scale)
    columns = np.vstack([
        stack.columns(m.weights, (m.means - centre) / scale, m.covariances / scale[:, None] / scale[None, :]) for m in models
    ])
    kind = {field.name: field.dataType.simpleString() for field in vectors.schema.fields}
    schema = f"sample_id {kind['sample_id']}, cell_id {kind['cell_id']}, labels array<int>"
    return _arrays(vectors).mapInArrow(stack.task(columns, [len(m.weights) for m in models], True), schema)


def stacked_agreements(stacked: DataFrame, fits: list[tuple[int, int]]) -> DataFrame:
    """Agreement of every run of k with every run of k + 1, from cells with an array of labels.

    ``fits`` names the places of the array. Tasks count how often two labels meet, so what is
    shuffled are counts; k = 1, a constant label, needs no place of its own.
    """
    places = {fit: k for k, fit in enumerate(fits)}
    runs = sorted({run for _, run in fits})
    pairs = [(k, a, b) for k in range(min(k for k, _ in fits) - 1, max(k for k, _ in fits)) for a in runs for b in runs if (k == 1 or (k, a) in places) and (k + 1, b) in places]
    widths = [k + 1 for k, _, _ in pairs]
    ends = [(places.get((k, a), -1), places[k + 1, b]) for k, a, b in pairs]

    def met(batches):
        counts = [np.zeros(w * w, np.int64) for w in widths]
        for batch in batches:
            whole = batch.column("labels").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for low in range(0, batch.num_rows, 2048):
                labels = np.ascontiguousarray(whole[low : low + 2048].T, np.int64)
                for (a, b), w, own in zip(ends, widths, counts, strict=True):
                    own += np.bincount(labels[a] * w + labels[b] if a >= 0 else labels[b], minlength=w * w)
        some = [np.flatnonzero(own) for own in counts]
        at = np.repeat(np.arange(len(pairs)), [len(s) for s in some])
        cell = np.concatenate(some) if some else np.zeros(0, np.int64)
        n = np.concatenate([own[s] for own, s in zip(counts, some, strict=True)]) if some else cell
        width = np.array(widths)[at] if len(at) else cell
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(v, pa.int32()) for v in (*(np.array(pairs)[at].T if len(at) else (cell, cell, cell)), cell // np.maximum(width, 1), cell % np.maximum(width, 1))), pa.array(n, pa.int64())],
            names=["k", "run_a", "run_b", "a", "b", "n"],
        )

    counted = stacked.select("labels").mapInArrow(met, "k int, run_a int, run_b int, a int, b int, n long")
    return agreement_of(counted, ["k", "run_a", "run_b"])


def labels_by_fit(stacked: DataFrame, fits: list[tuple[int, int]], also=tuple(ID)) -> DataFrame:
    """One row per cell and fit, ``(*also, k, run, label)``, labels as text; ``also`` are columns of the cells."""
    each = stacked.select(*also, F.posexplode("labels").alias("place", "label"))
    k, run = [F.array(*[F.lit(fit[of]) for fit in fits]) for of in (0, 1)]
    return each.select(
        *also, F.get(k, F.col("place")).alias("k"), F.get(run, F.col("place")).alias("run"), F.col("label").cast("string").alias("label")
    )


def range_labels(stacked: DataFrame, fits: list[tuple[int, int]], min_k: int = 2, also=tuple(ID)) -> DataFrame:
    """The same with a row for every run of k = 1, a constant label, if the range starts at 2."""
    labels = labels_by_fit(stacked, fits, also)
    if min_k > 2:
        return labels
    ones = F.explode(F.array(*[F.lit(run) for run in sorted({run for _, run in fits})])).alias("run")
    return labels.unionByName(stacked.select(*also, F.lit(1).alias("k"), ones, F.lit("0").alias("label")))


@dataclass
class Search:
    """Fits of a range of k, their labels, one array a cell, and how stable each k is."""

    models: dict
    fits: list
    stacked: DataFrame
    stability: DataFrame


def search(
    vectors: DataFrame,
    min_k: int = 2,
    max_k: int = 16,
    runs: int = 10,
    seed: int = 0,
    max_iter: int = 100,
    tol: float = 1e-3,
    convergence: float | None = 1e-3,
    at_once: int = 5,
) -> Search:
    """Mixtures of every k of the range and one more on both sides, run after run.

    ``vectors`` should be materialised. The search ends before ``runs`` once a further run changes
    the mean stability of the candidates by no more than ``convergence`` of itself; ``None``
    makes all runs, all by the same scans. Otherwise ``at_once`` runs of all k share their scans; those
    beyond the end are dropped, so the result does not depend on it.
    """
    if min_k < 2 or max_k < min_k or runs < 2:
        raise ValueError("needs min_k >= 2, max_k >= min_k and runs >= 2")
    models, waves, before = {}, None, None
    ks = range(max(min_k - 1, 2), max_k + 2)
    at_once = runs if convergence is None else at_once
    for first in range(0, runs, at_once):
        fits = [(k, run) for run in range(first, min(first + at_once, runs)) for k in ks]
        models |= fit_many(vectors, fits, seed, max_iter, tol)
        waves = cut(stacked_labels(vectors, list(models.values())))
        done = list(models)
        agreements = cut(stacked_agreements(waves, done))
        for last in range(first, min(first + at_once, runs)):
            if last == 0 or (convergence is None and last < runs - 1):
                continue
            seen = agreements.where((F.col("run_a") <= last) & (F.col("run_b") <= last))
            table = cut(stability(seen, min_k, max_k))
            now = {row["k"]: row["mean_stability"] for row in table.collect()}
            close = convergence is not None and before and all(abs(now[k] - before[k]) <= convergence * abs(now[k]) for k in now)
            if close or last == runs - 1:
                kept = [fit for fit in done if fit[1] <= last]
                # Runs are fitted in their order, so the kept fits are the first ones.
                chosen = waves.select(*ID, F.slice("labels", 1, len(kept)).alias("labels"))
                return Search({fit: models[fit] for fit in kept}, kept, chosen, table)
            before = now
    raise AssertionError("the last run ends the search")


def fit_range(vectors: DataFrame, min_k: int = 2, max_k: int = 16, runs: int = 10, **settings):
    """Labels of all fits as ``(sample_id, cell_id, k, run, label)``, k = 1 included, and the models."""
    found = search(vectors, min_k, max_k, runs, **settings)
    return range_labels(found.stacked, found.fits, min_k), found.models


def likeliest(models: dict, k: int):
    """Of the fits with ``k`` components the one under which the data are most likely."""
    return max((run for j, run in models if j == k), key=lambda run: (models[k, run].log_likelihood, -run))


def label_agreement(pairs: DataFrame, by=()) -> DataFrame:
    """Fowlkes-Mallows agreement of the label columns ``a`` and ``b``.

    Everything follows from the contingency table: pairs of cells together in
    both clusterings over the geometric mean of pairs together in each.
    """
    return agreement_of(pairs.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n")), by)


def agreement_of(counts: DataFrame, by=()) -> DataFrame:
    """The same from how often two labels meet, ``(*by, a, b, n)``, rows of equal labels added up."""
    by = list(by)
    table = counts.groupBy(*by, "a", "b").agg(F.sum("n").cast("double").alias("n"))

    def pairs_together(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*by).agg((F.sum(F.col("n") * F.col("n")) - F.sum("n")).alias(name))

    both = pairs_together(table, "both")
    sides = [
        pairs_together(table.groupBy(*by, side).agg(F.sum("n").alias("n")), f"in_{side}")
        for side in ("a", "b")
    ]
    if not by:
        one = F.lit(1).alias("whole")
        both, *sides = [df.withColumn("whole", one) for df in (both, *sides)]
    keys = by or ["whole"]
    joined = reduce(lambda p, q: p.join(q, keys), sides, both)
    score = F.try_divide(F.col("both"), F.sqrt(F.col("in_a") * F.col("in_b")))
    return joined.select(*by, F.coalesce(score, F.lit(0.0)).alias("agreement"))


def neighbour_agreements(labels: DataFrame) -> DataFrame:
    """Agreement of every run of k with every run of k + 1.

    A cell's labels come together once; pairs of runs are formed there and counted
    before they are shuffled.
    """
    fits = labels.groupBy(*ID).agg(F.collect_list(F.struct("k", "run", "label")).alias("fits"))

    def with_next(a):
        after = F.filter("fits", lambda b: b["k"] == a["k"] + 1)
        names = (a["k"].alias("k"), a["run"].alias("run_a"), a["label"].alias("a"))
        return F.transform(after, lambda b: F.struct(*names, b["run"].alias("run_b"), b["label"].alias("b")))

    pairs = fits.select(F.inline(F.flatten(F.transform("fits", with_next))))
    return label_agreement(pairs, ["k", "run_a", "run_b"])


def stability(agreements: DataFrame, min_k: int, max_k: int) -> DataFrame:
    """Mean and population deviation of agreement for every candidate k."""
    touches = F.explode(F.array(F.col("k"), F.col("k") + 1))
    return (
        agreements.select(touches.alias("k"), "agreement")
        .where(F.col("k").between(min_k, max_k))
        .groupBy("k")
        .agg(
            F.avg("agreement").alias("mean_stability"),
            F.stddev_pop("agreement").alias("sd_stability"),
            F.count(F.lit(1)).alias("n_comparisons"),
        )
    )


def best_k(table: DataFrame) -> DataFrame:
    """The most stable k; the lowest one if several are equally stable."""
    return table.select("k", "mean_stability").orderBy(F.desc("mean_stability"), "k").limit(1)


def stability_peaks(table: DataFrame) -> DataFrame:
    """Candidates strictly more stable than both of their neighbours.

    The table has one row per candidate k, so joining it to itself is enough.
    """
    here = table.select("k", "mean_stability")
    lower = table.select((F.col("k") + 1).alias("k"), F.col("mean_stability").alias("lower"))
    upper = table.select((F.col("k") - 1).alias("k"), F.col("mean_stability").alias("upper"))
    return (
        here.join(lower, "k")
        .join(upper, "k")
        .where("mean_stability > lower and mean_stability > upper")
        .select("k", "mean_stability")
    )


def assign_domains(vectors: DataFrame, model: Mixture) -> DataFrame:
    """Cells with the label of the chosen model, as text."""
    labelled = stacked_labels(vectors, [model])
    return labelled.select(*ID, F.col("labels")[0].cast("string").alias("compartment"))


def find_domains(vectors: DataFrame, **settings):
    """Fit the range, pick k, and label: ``(domains, stability table, best k)``."""
    vectors = cut(vectors)
    found = search(vectors, **settings)
    chosen = best_k(found.stability).first()["k"]
    place = found.fits.index((chosen, likeliest(found.models, chosen)))
    labels = found.stacked.select(*ID, F.col("labels")[place].cast("string").alias("compartment"))
    return labels, found.stability, chosen
