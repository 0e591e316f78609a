"""One-class detector with an RBF kernel, approximated so that it can be trained by Spark aggregations.

Random Fourier features (Rahimi and Recht 2007) turn the kernel into a D-vector; the one-class objective
(Schoelkopf et al. 2001), 1/2 |w|^2 - rho + 1/(nu n) sum max(0, rho - w.phi(x)), is minimised through its dual: the shortest vector
among the means of phi with row weights of at most 1/(nu n). One pass over the rows counts them by score, with the sum of phi per bin of
scores, so it gives at once rho, the mean s of the nu n lowest rows, and a bound: the objective is at most w.(w - s) from its minimum.
The next w is the shortest vector in the hull of all s so far (Frank-Wolfe, fully corrective). It stops when that bound falls below
``tolerance`` times |w|^2. No row is ever moved or collected; a task returns BINS counts a model, and D numbers for each bin that may be low.
Results approximate an exact kernel solver by the D features; thresholds are calibrated afterwards in any case.
``group`` trains one model per value of a column with few values (folds) in the same passes; ``fit_one_class_prefixes`` reads a row once
for all folds of an expanding past.

Only rows that may be low need their exact score. A pass first scores all rows quickly, by a short polynomial for the cosine in 32 bits; that
is off by less than MARGIN bins, which is proved for rows with angles up to TURNS. Rows beyond that, and rows whose quick score lies near the
low bins, are scored exactly: the low bins hold the same rows as with exact scores throughout.

A category's random vector is made where it is needed, from (seed, column, code): no vocabulary is collected or sent. Which categories a
model has seen is a table; scoring joins it, so that an unseen category counts as all zeros.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.forest import GROUP, with_fills, with_group
from tidewatch.operators.ordering import prefix_quantiles
from tidewatch.operators.prep import category_codes, medians, scaling
from tidewatch.roles import Roles
from tidewatch.sources.tables import stored

BINS = 1024
SPARE = 2.0  # a task sums the bins of so many times the wanted share of its rows
CHUNK = 1024  # rows whose angles are worked on at a time, so that they stay in the processor's cache
# sin(2 pi x) for |x| <= 1/4, to the last digit: the odd powers of x
SINE = tuple((-1) ** k * (2 * math.pi) ** (2 * k + 1) / math.factorial(2 * k + 1) for k in range(10))
# cos(2 pi u) for |u| <= 1/2 as a polynomial of u^2 (Chebyshev), off by at most 0.00144. A score is off by at most its reach times the error of
# the cosines, which is 0.74 bins. Rounding adds 0.06 for the angles, if they are made of n terms and these of no more than TURNS / n turns in all,
# and 0.07 for the sum of up to WIDE cosines.
COSINE = (0.9985667768466343, -19.552735135991316, 61.10729715875399, -59.58028076034258)
TURNS, WIDE = 320.0, 1024
MARGIN = 2  # a quick score lies in the exact one's bin or in one beside it; far rows are so many bins above the low ones


@dataclass
class OneClassModel:
    roles: Roles
    fills: dict[str, dict[str, float]]
    state: dict  # arrays shared by all models, and per model: scaling, gamma, w, rho
    seen: list[DataFrame]  # per categorical column: (model, code) of the rows fitted on; of folds (code, number of the first fold)
    folds: dict[str, int] | None = None

    def score(self, frame: DataFrame, group: str | None = None, output: str = "score") -> DataFrame:
        """Adds rho - w.phi(x): positive lies outside the learned region."""
        shared = frame.sparkSession.sparkContext.broadcast(self.state)
        udf = F.pandas_udf(_scorer(shared, len(self.roles.numeric)), T.DoubleType())
        numbers = [f"_num_{i}" for i in range(len(self.roles.numeric))]
        rows = with_fills(with_group(frame, group), self.fills, sorted(self.state["models"]), numbers)
        codes, flags = [f"_code_{j}" for j in range(len(self.seen))], [f"_known_{j}" for j in range(len(self.seen))]
        rows = rows.withColumns({c: code for c, code in zip(codes, category_codes(self.roles.categorical))})
        if self.folds is None:
            for j, seen in enumerate(self.seen):  # small vocabularies are broadcast by Spark's own limit, large ones shuffled
                rows = rows.join(seen.select(GROUP, F.col("code").alias(codes[j]), F.lit(True).alias(flags[j])), [GROUP, codes[j]], "left")
        else:
            fold = F.element_at(F.create_map(*[F.lit(x) for item in self.folds.items() for x in item]), F.col(GROUP))
            for j, seen in enumerate(self.seen):
                rows = rows.join(seen.select(F.col("code").alias(codes[j]), F.col("first").alias(f"_first_{j}")), codes[j], "left")
            rows = rows.withColumns({f: F.col(f"_first_{j}") <= fold for j, f in enumerate(flags)})
        known = [F.coalesce(F.col(f), F.lit(False)) for f in flags]
        inputs = [F.col(GROUP), *[F.col(n) for n in numbers], *[F.when(k, F.col(c)).otherwise(F.lit(0).cast("bigint")) for c, k in zip(codes, known)], *[k.cast("bigint") for k in known]]
        return rows.withColumn(output, udf(*inputs)).select(*frame.columns, output)


def _categories():
    """What the categories of rows add to their projections; the same for all models (runs inside tasks)."""

    vectors = {}  # of this task

    def vector(state, j, code):
        if (j, code) not in vectors:
            if len(vectors) >= 20_000:
                vectors.clear()
            vectors[j, code] = np.random.default_rng([state["seed"], j, code & (2**63 - 1)]).standard_normal(len(state["phase"]))
        return vectors[j, code]

    def parts(state, kinds):
        """Per column the vectors of its codes, and which of them each row has."""
        for j in range(state["categories"]):
            codes, place = np.unique(kinds[:, j], return_inverse=True)
            yield np.stack([vector(state, j, int(c)) for c in codes]) if len(codes) else np.zeros((0, len(state["phase"]))), place

    return parts


def _added(state: dict, parts: Sequence, kinds: np.ndarray, rows=slice(None)) -> np.ndarray:
    """The sum of the rows' category vectors."""
    kinds = kinds[rows]
    total = np.zeros((len(kinds), len(state["phase"])))
    for j, (made, place) in enumerate(parts):
        if kinds.shape[1] > state["categories"]:  # unseen category: all zeros
            total += made[place[rows]] * kinds[:, state["categories"] + j][:, None]
        else:
            total += made[place[rows]]
    return total


def _added_turns(state: dict, parts: Sequence, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for rows of seen categories, in turns and 32 bits, and a bound on each row's numbers."""
    total, largest = np.zeros((n, len(state["phase"])), dtype=np.float32), np.zeros(n, dtype=np.float32)
    for made, place in parts:
        turns = (made / (2 * np.pi)).astype(np.float32)
        for at in range(0, n, CHUNK):
            total[at:at + CHUNK] += turns[place[at:at + CHUNK]]
        largest += np.abs(turns).max(axis=1, initial=0.0)[place]
    return total, largest


def _mapped(state: dict, m: dict, values: np.ndarray, added: np.ndarray) -> np.ndarray:
    """The feature map of one model's rows."""
    scaled, turn = (values - m["mean"]) / m["deviation"], np.sqrt(2.0 * m["gamma"]) / (2 * np.pi)
    phase, size = state["phase"] / (2 * np.pi), len(state["phase"])
    out, spare, powers = np.empty((len(values), size)), *np.empty((2, min(CHUNK, len(values)), size))
    for at in range(0, len(out), CHUNK):
        x = out[at:at + CHUNK]
        t, v = spare[:len(x)], powers[:len(x)]
        np.matmul(scaled[at:at + CHUNK], state["numeric"], out=x)
        x += added[at:at + CHUNK]
        x *= turn
        x += phase
        np.rint(x, out=t)
        x -= t
        np.abs(x, out=x)
        np.subtract(0.25, x, out=x)  # cos(2 pi u) = sin(2 pi (1/4 - |u|))
        np.multiply(x, x, out=v)
        np.multiply(v, SINE[-1], out=t)
        for factor in SINE[-2:0:-1]:
            t += factor
            t *= v
        t += SINE[0]
        x *= t
        x *= np.sqrt(2.0 / size)
    return out


def _features():
    """The feature map with its categories (runs inside tasks)."""
    parts = _categories()

    def phi(state, model, values, kinds):
        return _mapped(state, state["models"][model], values, _added(state, list(parts(state, kinds)), kinds))

    return phi


def _quick_places(state: dict, m: dict, values: np.ndarray, added: np.ndarray, largest: np.ndarray) -> np.ndarray:
    """Scores in bins, off by less than 1; NaN where that isn't certain. ``added`` (what categories add) and its ``largest`` per row are in turns."""
    size, turn = len(state["phase"]), np.sqrt(2.0 * m["gamma"])
    if size > WIDE:
        return np.full(len(values), np.nan, dtype=np.float32)
    scaled = np.ones((values.shape[1] + 1, len(values)), dtype=np.float32)  # a row per column: numpy's loops run along it
    for i in range(len(scaled) - 1):
        scaled[i] = (values[:, i] - m["mean"][i]) / m["deviation"][i]
    matrix = np.vstack([turn * state["numeric"], state["phase"]]) / (2 * np.pi)
    weights = m["w"] * (np.sqrt(2.0 / size) * BINS / (2 * m["reach"]))
    matrix, widest, short, turn = matrix.astype(np.float32), np.abs(matrix).max(axis=1), weights.astype(np.float32), np.float32(turn)
    # the cosines are summed up power by power: three products with weights cost less than three more sums
    first, second, third = (np.float32(c) * short for c in COSINE[1:])
    out = np.empty(len(values), dtype=np.float32)
    angle, spare = (np.empty((min(CHUNK, len(values)), size), dtype=np.float32) for _ in range(2))
    for at in range(0, len(out), CHUNK):
        n = len(out[at:at + CHUNK])
        u, t = angle[:n], spare[:n]
        np.matmul(scaled[:, at:at + n].T, matrix, out=u)
        np.multiply(added[at:at + n], turn, out=t)
        u += t
        np.rint(u, out=t)
        u -= t
        u *= u
        np.multiply(u, u, out=t)
        total = u @ first + t @ second
        t *= u
        out[at:at + n] = total + t @ third
    out += np.float32(COSINE[0] * weights.sum() + BINS / 2)
    out[~(widest @ np.abs(scaled) + turn * largest <= TURNS / (values.shape[1] + 6))] = np.nan
    return out


def _by_model(names) -> tuple[np.ndarray, list[tuple[str, int, int]]]:
    """An order that puts the rows of each model side by side, and where they are then."""
    import pandas as pd

    place, found = pd.factorize(names, use_na_sentinel=False)
    ends = np.cumsum(np.bincount(place, minlength=len(found)))
    return np.argsort(place, kind="stable"), [(name, int(start), int(end)) for name, start, end in zip(found, [0, *ends], ends)]


def _split(state: dict, batch, n_numeric: int):
    """The rows of an Arrow batch, ordered by model or by segment: numbers, their gaps, categories, and where each model's rows are."""
    columns = batch.columns
    gaps = np.column_stack([c.is_null().to_numpy(zero_copy_only=False) for c in columns[1:n_numeric + 1]]) if n_numeric else np.zeros((len(batch), 0), bool)
    values = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns[1:n_numeric + 1]]) if n_numeric else np.zeros((len(batch), 0))
    kinds = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns[n_numeric + 1:]]) if columns[n_numeric + 1:] else np.zeros((len(batch), 0), "int64")
    keys = columns[0].to_numpy(zero_copy_only=False)
    if state.get("folds") is None:
        order, spans = _by_model(keys)
    else:  # a row belongs to the fold of its segment and all later ones
        order = np.argsort(keys, kind="stable")
        ends = {name: int(np.searchsorted(keys[order], k, "right")) for name, k in state["folds"].items()}
        spans = [(name, 0, end) for name, end in ends.items() if end]
    return np.asfortranarray(values[order]), gaps[order] if gaps.any() else None, kinds[order], spans


def _scorer(shared, n_numeric: int):
    parts = _categories()

    def score(model, *columns):
        import pandas as pd

        state, out = shared.value, np.full(len(model), np.nan)
        values = np.column_stack([c.to_numpy("float64") for c in columns[:n_numeric]]) if n_numeric else np.zeros((len(model), 0))
        rest = columns[n_numeric:]
        kinds = np.column_stack([c.to_numpy("int64") for c in rest]) if rest else np.zeros((len(model), 0), "int64")
        added = list(parts(state, kinds))
        order, spans = _by_model(model)
        for name, start, end in spans:
            m, where = state["models"].get(name), order[start:end]
            if m is not None:
                out[where] = m["rho"] - _mapped(state, m, values[where], _added(state, added, kinds, where)) @ m["w"]
        return pd.Series(out)

    return score


def _pass(rows: DataFrame, state: dict, n_numeric: int, shares: dict[str, float], upto: dict[str, int] | None = None) -> DataFrame:
    """One pass over the rows: per model and bin of scores (one bin before there is a w) how many rows, and the sum of phi for the low bins. Stored, a row per task, model and bin.

    Low are the bins up to ``upto``; without it, those that hold SPARE times a model's share of its rows in the task. The others have no sum,
    and their counts go by quick scores.
    """
    shared = rows.sparkSession.sparkContext.broadcast(state)
    parts = _categories()

    def partial(batches):
        import pyarrow as pa

        state, counts, sums, tops = shared.value, {}, {}, {}
        for batch in batches:
            values, gaps, kinds, spans = _split(state, batch, n_numeric)
            spans = [(name, start, end) for name, start, end in spans if not state["models"][name]["done"] and (upto is None or name in upto)]
            if not spans:
                continue
            added = list(parts(state, kinds))
            turns, largest = _added_turns(state, added, len(kinds))
            whole = _added(state, added, kinds) if any(state["models"][name]["w"] is None for name, *_ in spans) else None
            for name, start, end in spans:
                m = state["models"][name]
                own = values[start:end]
                if gaps is not None:
                    own = own.copy(order="F")
                    for i in np.flatnonzero(gaps.any(axis=0)):
                        own[gaps[start:end, i], i] = m["fill"][i]
                if name not in counts:
                    counts[name], sums[name], tops[name] = np.zeros(BINS, dtype=np.int64), {}, BINS - 1 if upto is None else upto[name]
                near = np.arange(end - start)
                if m["w"] is not None and (upto is not None or counts[name].sum() + len(own) >= BINS):
                    with np.errstate(all="ignore"):
                        quick = _quick_places(state, m, own, turns[start:end], largest[start:end])
                    rough = np.bincount(np.clip(np.nan_to_num(quick), 0, BINS - 1).astype(np.int64), minlength=BINS)
                    if upto is None:  # only what lies in low bins so far is summed; sums of higher ones are dropped
                        through = np.cumsum(counts[name] + rough)
                        tops[name] = min(tops[name], int(np.searchsorted(through, SPARE * shares[name] * through[-1])) + 1)
                    far = quick >= tops[name] + MARGIN
                    near = np.flatnonzero(~far)
                    counts[name] += np.bincount(np.clip(quick[far], 0, BINS - 1).astype(np.int64), minlength=BINS)
                mapped = _mapped(state, m, own[near], _added(state, added, kinds, start + near) if whole is None else whole[start:end])
                if m["w"] is None:
                    counts[name][0] += len(mapped)
                    sums[name][0] = sums[name].get(0, 0.0) + mapped.sum(axis=0)
                    continue
                place = _bin(mapped @ m["w"], m["reach"])
                counts[name] += np.bincount(place, minlength=BINS)
                low = np.flatnonzero(place <= tops[name])
                order = low[np.argsort(place[low], kind="stable")]
                bins, starts = np.unique(place[order], return_index=True)
                for b, total in zip(bins.tolist(), np.add.reduceat(mapped[order], starts, axis=0) if len(order) else ()):
                    sums[name][b] = sums[name][b] + total if b in sums[name] else total
        for name, count in counts.items():
            bins = np.flatnonzero(count)
            found = [sums[name].get(b) if b <= tops[name] else None for b in bins.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(bins), pa.string()), pa.array(bins, pa.int32()), pa.array(count[bins], pa.int64()), pa.array(found, pa.list_(pa.float64()))],
                                             names=["model", "bin", "n", "sums"])

    return stored(rows.mapInArrow(partial, "model string, bin int, n long, sums array<double>"), "bins")


def _bin(scores: np.ndarray, reach: float) -> np.ndarray:
    return np.clip(((scores + reach) / (2 * reach) * BINS).astype(np.int64), 0, BINS - 1)


def _weigher(cuts: dict[str, tuple[int, float]]):
    """Adds up a task's sums per model: whole bins below the last one, and its part. NULL if a low bin, or the one after, has rows and no sum."""

    def run(batches):
        import numpy as np
        import pandas as pd

        totals = {}
        for batch in batches:
            for name, part in batch.groupby("model"):
                last, share = cuts.get(name, (-MARGIN, 0.0))
                missing = part.loc[part["bin"] < last + MARGIN, "sums"].isna().any()  # quick scores may be a bin too high
                part = part[part["bin"] <= last]
                if missing:
                    totals[name] = None
                elif len(part) and totals.get(name, 0) is not None:
                    totals[name] = totals.get(name, 0.0) + np.where(part["bin"] == last, share, 1.0) @ np.stack(part["sums"].to_numpy())
        for name, total in totals.items():
            yield pd.DataFrame({"model": [name], "value": [total]})

    return run


def _lowest(rows: DataFrame, state: dict, n_numeric: int, wanted: dict[str, float], sizes: dict[str, int]) -> dict[str, tuple[np.ndarray, int, float]]:
    """Per model: sum of phi over the ``wanted`` lowest rows (the last bin in part), the last bin, and the part of it. One pass over the rows;
    a second one for models of which some task did not sum all the bins that turn out to be low."""
    def read(binned: DataFrame) -> tuple[dict, list]:
        counts = binned.groupBy("model", "bin").agg(F.sum("n").alias("n")).toPandas()  # at most models x BINS rows
        cuts = {}
        for name, part in counts.groupby("model"):
            part = part.sort_values("bin")
            upto = part["n"].cumsum().to_numpy(dtype="float64")
            last = min(int(np.searchsorted(upto, wanted[name])), len(part) - 1)
            before = upto[last] - float(part["n"].iloc[last])
            cuts[name] = (int(part["bin"].iloc[last]), min(1.0, float((wanted[name] - before) / float(part["n"].iloc[last]))))
        return cuts, binned.select("model", "bin", "sums").mapInPandas(_weigher(cuts), "model string, value array<double>").collect()  # a row per task and model

    cuts, found = read(_pass(rows, state, n_numeric, {m: n / sizes[m] for m, n in wanted.items()}))
    missed = {r["model"] for r in found if r["value"] is None}
    if missed:
        # the last bin is known up to one; the second pass knows it, and sums one more than can be asked for
        again, more = read(_pass(rows, state, n_numeric, {}, {m: min(BINS - 1, cuts[m][0] + 1 + MARGIN) for m in missed}))
        cuts, found = cuts | again, [r for r in found if r["model"] not in missed] + more
    sums: dict[str, np.ndarray] = {}
    for r in found:
        sums[r["model"]] = sums.get(r["model"], 0.0) + np.array(r["value"])
    return {name: (total, cuts[name][0], float(cuts[name][1])) for name, total in sums.items()}


def shortest(atoms: np.ndarray, rounds: int = 20_000) -> np.ndarray:
    """The shortest vector in the convex hull of a few vectors: pairwise Frank-Wolfe steps on their Gram matrix."""
    gram = atoms @ atoms.T
    share = np.zeros(len(atoms))
    share[int(np.argmin(np.diag(gram)))] = 1.0
    for _ in range(rounds):
        slope = gram @ share
        towards, away = int(np.argmin(slope)), int(np.argmax(np.where(share > 0, slope, -np.inf)))
        gain = slope[away] - slope[towards]
        if gain <= 1e-12 * max(1e-300, share @ slope):
            break
        bend = gram[towards, towards] - 2 * gram[towards, away] + gram[away, away]
        step = min(share[away], gain / bend) if bend > 0 else share[away]
        share[towards] += step
        share[away] -= step
    return share @ atoms


def fit_one_class(train: DataFrame, roles: Roles, nu: float = 0.01, dimensions: int = 128, tolerance: float = 0.02, steps: int = 40, seed: int = 42,
                  group: str | None = None) -> OneClassModel:
    """Passes go on until every model's objective is known to be within ``tolerance`` * |w|^2 of its minimum, ``steps`` at most;
    the bound reached stands in ``state["models"][..]["gap"]``."""
    keyed = with_group(train, group).select(GROUP, *roles.features)
    models = sorted(r[GROUP] for r in keyed.select(GROUP).distinct().collect())
    fills: dict[str, dict[str, float]] = {c: {m: 0.0 for m in models} for c in roles.numeric}
    for r in medians(keyed, roles.numeric, [GROUP]).collect():
        fills[r["feature"]][r[GROUP]] = r["median"] or 0.0
    numbers = [f"num_{i}" for i in range(len(roles.numeric))]
    rows = stored(with_fills(keyed, fills, models, numbers).select(GROUP, *numbers, *category_codes(roles.categorical)).sortWithinPartitions(GROUP), "one-class")
    seen = [stored(rows.select(GROUP, F.col(f"code_{c}").alias("code")).distinct(), "seen") for c in roles.categorical]
    sizes = {r[GROUP]: r["n"] for r in rows.groupBy(GROUP).agg(F.count("*").alias("n")).collect()}  # one row per model
    moments = {m: {n: (0.0, 0.0) for n in numbers} for m in models}
    for r in scaling(rows, numbers, [GROUP]).collect():
        moments[r[GROUP]][r["feature"]] = (r["mean"] or 0.0, r["deviation"] or 0.0)
    words = {m: 0 for m in models}  # sizes of the one-hot vocabularies
    for table in seen:
        for r in table.groupBy(GROUP).agg(F.count("*").alias("n")).collect():  # one row per model
            words[r[GROUP]] += r["n"]
    state = _initial_state(moments, words, len(seen), numbers, dimensions, seed)
    _train(rows, state, sizes, len(numbers), nu, tolerance, steps)
    return OneClassModel(roles, fills, state, seen)


def fit_one_class_prefixes(rows: DataFrame, roles: Roles, segment: str, folds: Sequence[str], nu: float = 0.01, dimensions: int = 128, tolerance: float = 0.02,
                           steps: int = 40, seed: int = 42) -> OneClassModel:
    """One model per fold of an expanding past; the same models as ``fit_one_class`` on every fold's rows, but a row is stored, read and encoded once.

    ``segment`` is the number of the first fold that a row belongs to (NULL: none); it belongs to all later folds. Rows without a date belong to none.
    Medians, moments and vocabularies are kept per segment and merged along the folds.
    """
    numbers = [f"num_{i}" for i in range(len(roles.numeric))]
    slim = rows.where(F.col(segment).isNotNull() & F.col(roles.date).isNotNull()).select(
        F.col(segment).cast("int").alias("_segment"), *[F.col(c).cast("double").alias(n) for c, n in zip(roles.numeric, numbers)], *category_codes(roles.categorical))
    slim = stored(slim.sortWithinPartitions("_segment"), "one-class")
    parts = {r["_segment"]: r for r in slim.groupBy("_segment").agg(F.count("*").alias("n"), *[F.struct(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("variance"), F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in numbers]).collect()}  # one row per fold
    sizes, total = {}, 0
    for k, name in enumerate(folds):
        total += parts[k]["n"] if k in parts else 0
        if total:
            sizes[name] = total
    models = {name: folds.index(name) for name in sizes}
    fills: dict[str, dict[str, float]] = {c: {m: 0.0 for m in models} for c in roles.numeric}
    if numbers and models:
        for r in prefix_quantiles(slim, numbers, 0.5, "_segment", list(models.values())).collect():  # one row per fold and column
            fills[roles.numeric[numbers.index(r["feature"])]][folds[r["fold"]]] = r["value"] or 0.0
    moments = {m: {} for m in models}
    for c, n in zip(roles.numeric, numbers):
        known = []
        for k, name in enumerate(folds):
            if k in parts and parts[k][n]["n"]:
                known.append(parts[k][n])
            if name in models:
                held = sum(x["n"] for x in known)
                filled = [(sizes[name] - held, fills[c][name], 0.0, fills[c][name], fills[c][name])] if held < sizes[name] else []
                moments[name][n] = _merged([*[(x["n"], x["mean"], x["variance"], x["low"], x["high"]) for x in known], *filled])
    seen = [stored(slim.groupBy(F.col(f"code_{c}").alias("code")).agg(F.min("_segment").alias("first")), "seen") for c in roles.categorical]
    words = {m: 0 for m in models}
    for table in seen:
        for r in table.groupBy("first").agg(F.count("*").alias("n")).collect():  # one row per fold
            for m, k in models.items():
                words[m] += r["n"] if r["first"] <= k else 0
    state = _initial_state(moments, words, len(seen), numbers, dimensions, seed) | {"folds": models}
    for name, m in state["models"].items():
        m["fill"] = np.array([fills[c][name] for c in roles.numeric])
    _train(slim, state, sizes, len(numbers), nu, tolerance, steps)
    return OneClassModel(roles, fills, state, seen, models)


def _merged(parts: Sequence[tuple]) -> tuple[float, float]:
    """Mean and population deviation of rows in several parts, given each part's (size, mean, variance, least, largest); exactly 0 for equal values."""
    size, mean, squares = 0, 0.0, 0.0
    for n, own, variance, *_ in parts:
        apart, size = own - mean, size + n
        mean += apart * n / size
        squares += variance * n + apart * apart * n * (size - n) / size
    if min(p[3] for p in parts) == max(p[4] for p in parts):
        return parts[0][3], 0.0
    return mean, float(np.sqrt(squares / size))


def _train(rows: DataFrame, state: dict, sizes: dict[str, int], width: int, nu: float, tolerance: float, steps: int) -> None:
    for name, (total, *_) in _lowest(rows, state, width, {m: float(n) for m, n in sizes.items()}, sizes).items():
        _set_direction(state["models"][name], [total / sizes[name]])
    for _ in range(steps):
        open_models = {m: nu * sizes[m] for m in state["models"] if not state["models"][m]["done"]}
        if not open_models:
            break
        for name, (total, last, part) in _lowest(rows, state, width, open_models, sizes).items():
            m = state["models"][name]
            s, bin_width = total / open_models[name], 2 * m["reach"] / BINS
            m["rho"] = -m["reach"] + bin_width * (last + part)
            # rows of the last bin are taken alike, which can hide up to a bin's width
            m["gap"] = (float(m["w"] @ (m["w"] - s)) + bin_width) / max(float(m["w"] @ m["w"]), 1e-300)
            if m["gap"] <= tolerance:
                m["done"] = True
            else:
                _set_direction(m, [*m["atoms"], s])
    for m in state["models"].values():
        m["atoms"] = None


def _set_direction(model: dict, atoms: list[np.ndarray]) -> None:
    model["atoms"] = atoms
    model["w"] = shortest(np.stack(atoms))
    model["reach"] = max(float(np.linalg.norm(model["w"])) * np.sqrt(2.0), 1e-9)  # |phi| <= sqrt(2)


def _initial_state(moments: dict, words: dict[str, int], categories: int, numbers: Sequence[str], dimensions: int, seed: int) -> dict:
    """Scaling per model (mean, deviation), the shared random projection, and gamma = 1 / (d Var(X)) of the encoded matrix."""
    rng = np.random.default_rng(seed)
    state: dict = {
        "numeric": rng.standard_normal((len(numbers), dimensions)), "phase": rng.uniform(0, 2 * np.pi, dimensions),
        "seed": seed, "categories": categories, "models": {},
    }
    for m, own in moments.items():
        width, live = len(numbers) + words[m], sum(bool(own[n][1]) for n in numbers)
        # scaled columns have mean 0 and mean square 1 (or 0 when constant); a row has one 1 per categorical column
        variance = (live + categories) / width - (categories / width) ** 2
        state["models"][m] = {
            "mean": np.array([own[n][0] for n in numbers]), "deviation": np.array([own[n][1] or 1.0 for n in numbers]),
            "gamma": 1.0 / (width * variance) if variance > 0 else 1.0, "rho": 0.0, "w": None, "reach": 1.0, "atoms": None, "gap": None, "done": False,
        }
    return state
