"""Scores against few prototypes: zero-shot classification and prototype overlap.

Prototypes are a small table (their number is checked before they are sent to every task), so each row is
compared with all of them where it lies; only counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from embervane.functions import vectors as V
from embervane.operators.targets import hash_rank
from embervane.session import Scratch

#: Most prototype values that are sent to every task.
MAX_VALUES = 20_000_000
#: Rows of a class that its prototypes are fitted on.
FIT_ROWS = 20_000


def class_prototypes(prompts: DataFrame, keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """prompts(label, vec[, template]) to (keys, vec, coherence, n_prompts): the mean of the unit prompts, made
    unit again; coherence is the mean's length before that."""
    u = prompts.where("vec is not null").select(*keys, F.posexplode(V.unit(F.col("vec"), strict=True)).alias("pos", "x"))
    m = u.groupBy(*keys, "pos").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    v = m.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"), F.max("n").alias("n_prompts"))
    return v.select(*keys, V.unit(F.col("mean"), strict=True).alias("vec"), V.norm(F.col("mean")).alias("coherence"), "n_prompts")


def _held(prototypes: DataFrame, keys: list[str]) -> tuple[list[tuple], np.ndarray]:
    """The keys and the matrix of prototypes, in order; their size is checked before they come to the driver."""
    own = Scratch(prototypes.sparkSession).put(prototypes.select(*keys, V.doubles(F.col("vec")).alias("vec")), "prototypes")
    n = own.agg(F.coalesce(F.sum(F.size("vec")), F.lit(0)).alias("n")).first()["n"]
    if n > MAX_VALUES:
        raise ValueError(f"{n} prototype values are more than the {MAX_VALUES} that are sent to every task")
    rows = own.orderBy(*keys).collect()
    return [tuple(r[k] for k in keys) for r in rows], np.array([r["vec"] for r in rows], float).reshape(len(rows), -1)


def _rows(b: pa.RecordBatch, strict: bool, unit: bool) -> np.ndarray:
    x = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
    if unit:
        n = np.sqrt((x * x).sum(1, keepdims=True))
        if strict and not (n > 0).all():
            raise ValueError("a vector of zero norm has no direction")
        x = x / np.where(n > 0, n, 1.0)
    return x


def zero_shot(samples: DataFrame, prototypes: DataFrame, metric: str = "cosine", top_k: tuple[int, ...] = (1, 5), keys: tuple[str, ...] = ()) -> DataFrame:
    """samples(row_id, label, vec) to (row_id, label, predicted, margin, tie, top_<k>): classes by falling similarity,
    ties to the lower class. ``keys`` (as template) give one prediction per value. A batch of samples meets the matrix
    of all prototypes in one product."""
    names, matrix = _held(prototypes, [*keys, "label"])
    sets: dict[tuple, list[int]] = {}
    for i, n in enumerate(names):
        sets.setdefault(n[:-1], []).append(i)
    kinds = dict(prototypes.dtypes)
    id_type, label_type = dict(samples.dtypes)["row_id"], dict(samples.dtypes)["label"]
    sent = samples.sparkSession.sparkContext.broadcast((names, matrix, sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, sets = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x, truth = _rows(b, True, metric == "cosine"), b.column("label").to_pylist()
            for key, at in sets.items():
                p, classes = matrix[at], [names[i][-1] for i in at]
                s = np.round(2 * x @ p.T - (x * x).sum(1)[:, None] - (p * p).sum(1) if metric == "squared_l2" else x @ p.T, 12)
                order = np.argsort(-s, axis=1, kind="stable")
                place = {c: i for i, c in enumerate(classes)}
                own = np.array([place.get(t, -1) for t in truth])
                rank = np.where(own >= 0, (order == own[:, None]).argmax(1), len(at))
                first = np.take_along_axis(s, order[:, :1], 1)[:, 0]
                gap = first - np.take_along_axis(s, order[:, 1:2], 1)[:, 0] if len(at) > 1 else None
                cols = [*(pa.array([k] * len(x)) for k in key), b.column("row_id"), b.column("label"), pa.array([classes[i] for i in order[:, 0]]), pa.array(gap if gap is not None else [None] * len(x), pa.float64()), pa.array(gap == 0 if gap is not None else [False] * len(x), pa.bool_())]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array((rank < k).astype(np.int32)) for k in top_k)], names=[*keys, "row_id", "label", "predicted", "margin", "tie", *(f"top_{k}" for k in top_k)])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"row_id {id_type}", f"label {label_type}", f"predicted {kinds['label']}", "margin double", "tie boolean", *(f"top_{k} int" for k in top_k)])
    return samples.select("row_id", "label", "vec").mapInArrow(run, schema)


def confusion(predictions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return predictions.groupBy(*keys, "label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def per_class(matrix: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """confusion counts to (keys, label, support, precision, recall, f1); a division by zero is 0."""
    hit = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))
    t = matrix.groupBy(*keys, "label").agg(F.sum("n").alias("support"), hit.alias("hit"))
    p = matrix.groupBy(*keys, F.col("predicted").alias("label")).agg(F.sum("n").alias("called"))
    j = t.join(p, [*keys, "label"], "full").fillna(0, ["support", "hit", "called"])
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    j = j.withColumn("precision", ratio("hit", "called")).withColumn("recall", ratio("hit", "support"))
    return j.select(*keys, "label", "support", "precision", "recall", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)).alias("f1"))


def classification_summary(matrix: DataFrame, excluded: tuple = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """accuracy, balanced accuracy, macro and weighted F1; excluded classes leave the rows and the means."""
    c = per_class(matrix, keys)
    rows = matrix
    if excluded:
        c, rows = c.where(~F.col("label").isin(*excluded)), rows.where(~F.col("label").isin(*excluded))
    a = rows.groupBy(*keys).agg((F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    m = c.groupBy(*keys).agg(F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.nullif(F.sum("support"), F.lit(0))).alias("weighted_f1"))
    j = m.join(a, list(keys)) if keys else m.join(F.broadcast(a))  # one row each
    return j.select(*keys, *(F.round(x, 6).alias(x) for x in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")))


def auto_k(counts: DataFrame, min_k: int = 10, max_k: int = 50, min_rows: int = 5, requested: int | None = None) -> DataFrame:
    """(label, n) to (label, n, k): prototypes per class."""
    fits = F.greatest(F.lit(1), F.floor(F.col("n") / min_rows))
    k = F.least(F.lit(max_k), fits, F.greatest(F.lit(2), F.lit(min_k), F.floor(F.sqrt("n")))) if requested is None else F.lit(requested)
    return counts.withColumn("k", F.least(k, F.lit(max_k), fits, F.col("n")).cast("bigint"))


def resolve_k(counts: DataFrame, requested: int | dict | None = None, min_k: int = 10, max_k: int = 50, min_rows: int = 5) -> DataFrame:
    """(label, n) to (label, n, k) with one number for all, one per class (others as ``auto_k``), or none. A class with
    fewer than two rows is an error."""
    small = counts.where("n < 2").limit(5).collect()
    if small:
        raise ValueError(f"classes with fewer than two rows: {[r['label'] for r in small]}")
    if not isinstance(requested, dict):
        return auto_k(counts, min_k, max_k, min_rows, requested)
    auto = auto_k(counts, min_k, max_k, min_rows)
    asked = F.lit(None).cast("bigint")
    for label, k in requested.items():
        asked = F.when(F.col("label") == label, F.lit(k)).otherwise(asked)
    fits = F.greatest(F.lit(1), F.floor(F.col("n") / min_rows))
    return auto.withColumn("k", F.coalesce(F.least(asked, F.lit(max_k), fits, F.col("n")), F.col("k")).cast("bigint"))


def by_label(rows: DataFrame, labels: str) -> DataFrame:
    """Rows with arrays of labels as one row for each of their distinct labels; rows without a label have none."""
    return rows.select(*(c for c in rows.columns if c not in ("label", labels)), F.explode(F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))).alias("label"))


def exemplars(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """The first k rows of each class in pseudo-random order as its prototypes: (label, proto_id, vec)."""
    return hash_rank(rows, ["label"], "row_id", seed).where(F.col("_rank") <= k).select("label", F.col("row_id").alias("proto_id"), V.unit(F.col("vec")).alias("vec"))


def centroids(rows: DataFrame) -> DataFrame:
    """The mean of all unit rows of each class as its one prototype: (label, proto_id, vec)."""
    m = rows.where("label is not null").select("label", F.posexplode(V.unit(F.col("vec"))).alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec")).select("label", F.lit(0).cast("bigint").alias("proto_id"), "vec")


def kmeans_prototypes(rows: DataFrame, counts: DataFrame, rounds: int = 20, seed: int = 42, fit_rows: int = FIT_ROWS) -> DataFrame:
    """k-means per class (k of ``auto_k``) with numpy, one class a task, fitted on at most ``fit_rows`` rows of a class in
    the mean, chosen by hash: the bound keeps a class that holds most of the rows out of one task."""
    import pandas as pd

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row_id")
        x, k = np.stack(part["vec"].to_numpy()), int(part["k"].iloc[0])
        c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
        for _ in range(rounds):
            home = _homes(x, c)
            n = np.bincount(home, minlength=len(c))
            total = np.stack([np.bincount(home, x[:, j], len(c)) for j in range(x.shape[1])], 1)
            moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
            rests = np.allclose(moved, c, rtol=0, atol=1e-12)
            c = moved
            if rests:
                break
        return pd.DataFrame({"label": part["label"].iloc[0], "proto_id": range(len(c)), "vec": list(c)})

    some = F.pmod(F.xxhash64("row_id", F.lit(3)), F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(fit_rows) / F.col("n")) * (1 << 30)
    unit = rows.select("row_id", "label", "vec").join(counts.select("label", "k", "n"), "label").where((F.col("n") <= fit_rows) | some)
    kind = dict(rows.dtypes)["label"]
    return unit.select("row_id", "label", "k", V.unit(F.col("vec")).alias("vec")).groupBy("label").applyInPandas(fit, f"label {kind}, proto_id bigint, vec array<double>")


def overlap_events(rows: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(row_id, label, foreign): the foreign class met among the two nearest prototypes of each row, null if none.

    A row meets a foreign class if its nearest prototype is foreign, or the second one is and its own class has
    at least two. Ties go to the lower class, then to the lower prototype. Batches of rows meet the matrix of all
    prototypes in one product. Without a prototype no row meets any.
    """
    names, matrix = _held(prototypes, ["label", "proto_id"])
    kinds = dict(rows.dtypes)
    sent = rows.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p = sent.value
        classes = np.array([n[0] for n in names], object)
        n_own = {c: int((classes == c).sum()) for c in set(classes)}
        for b in batches:
            if not b.num_rows:
                continue
            truth = b.column("label").to_pylist()
            foreign = [None] * len(truth)
            if len(p):
                x = _rows(b, False, True)
                d = np.round((x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T, 12)
                near = classes[np.argsort(d, axis=1, kind="stable")[:, :2]]
                for i, t in enumerate(truth):
                    met = next((c for j, c in enumerate(near[i]) if c != t and t is not None and (j == 0 or n_own.get(t, 0) >= 2)), None)
                    foreign[i] = met
            yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("label"), pa.array(foreign, b.column("label").type)], names=["row_id", "label", "foreign"])

    return rows.select("row_id", "label", "vec").mapInArrow(run, f"row_id {kinds['row_id']}, label {kinds['label']}, foreign {kinds['label']}")


def overlap_per_class(events: DataFrame) -> DataFrame:
    return events.groupBy("label").agg(F.count(F.lit(1)).alias("n"), (1 - F.count("foreign") / F.count(F.lit(1))).alias("score"))


def overlap_pairs(events: DataFrame) -> DataFrame:
    """(label_a, label_b, score) of the class pairs that meet; 1 means that no row of either meets the other."""
    n = events.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    met = events.where("foreign is not null").groupBy(F.least("label", "foreign").alias("label_a"), F.greatest("label", "foreign").alias("label_b")).agg(F.count(F.lit(1)).alias("met"))
    j = met.join(n.select(F.col("label").alias("label_a"), F.col("n").alias("na")), "label_a").join(n.select(F.col("label").alias("label_b"), F.col("n").alias("nb")), "label_b")
    return j.select("label_a", "label_b", F.round(1 - F.col("met") / (F.col("na") + F.col("nb")), 6).alias("score"))


def overlap_summary(per_class_scores: DataFrame, excluded: tuple = ()) -> DataFrame:
    c = per_class_scores.where(~F.col("label").isin(*excluded)) if excluded else per_class_scores
    return c.agg(F.round(F.avg("score"), 6).alias("macro"), F.round(F.sum(F.col("score") * F.col("n")) / F.sum("n"), 6).alias("weighted"), F.min_by("label", F.struct("score", "label")).alias("weakest"))


def stability(scores: DataFrame, level: float = 0.95, keys: tuple[str, ...] = ()) -> DataFrame:
    """scores(repeat, score): mean, sample deviation (0 of one), range, percentile interval and its width."""
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    a = scores.groupBy(*keys).agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"), F.min("score").alias("low"), F.max("score").alias("high"), F.percentile("score", F.lit(lo)).alias("from"), F.percentile("score", F.lit(hi)).alias("upto"))
    return a.select(*keys, "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high", "from", "upto")), F.round(F.col("upto") - F.col("from"), 6).alias("width"))


def permuted(place: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where a seeded permutation of 0..n-1 sends each place: a Feistel network, walked until it is below n."""
    half = np.uint64(max(1, -(-(n - 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.default_rng(seed).integers(0, 1 << 62, 6, dtype=np.uint64)
    out = place.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for key in keys:
            mixed = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _homes(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _fit(data: DataFrame, k: int, rounds: int) -> np.ndarray:
    """k-means over all rows: the first k distinct vectors by place, moved until they rest or ``rounds`` are over."""
    first = data.groupBy("vec").agg(F.min("place").alias("place")).orderBy("place").limit(k).collect()
    c = np.array([r["vec"] for r in first])

    def sums(c: np.ndarray) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch)
                    home = _homes(x, c)
                    np.add.at(total, home, x)
                    n += np.bincount(home, minlength=len(c))
            yield pa.RecordBatch.from_pydict({"proto": np.arange(len(c)), "n": n, "vec": list(total)})

        return run

    for _ in range(rounds):
        part = data.select("vec").mapInArrow(sums(c), "proto bigint, n bigint, vec array<double>")
        part = part.select("proto", "n", F.posexplode("vec").alias("pos", "x")).groupBy("proto", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        moved = c.copy()
        for r in part.where("n > 0").collect():
            moved[r["proto"], r["pos"]] = r["x"] / r["n"]
        rests = np.allclose(moved, c, rtol=0, atol=1e-9)
        c = moved
        if rests:
            break
    return c


def continuous_overlap(rows: DataFrame, permutations: int = 20, k: int | None = None, rounds: int = 20, seed: int = 42, normalize: bool = True) -> DataFrame:
    """rows(row_id, vec, y) to one row (n, n_prototypes, loss, null_loss, loss_ratio, score).

    Prototypes (k, or as ``auto_k`` says) are fitted on the vectors of all rows, each row goes to the nearest; loss
    is the variance of the target within the prototypes, null_loss the mean of the same over seeded permutations
    of the target, score 1 - loss / null_loss held to 0..1. A permutation sends each row's place to a slot, and
    a prototype owns as many slots as it has rows, so that all permutations are summed up in one pass without
    a shuffle of rows. Rows without a vector or a finite target are left out; a constant target has no score.
    """
    vec = V.unit(F.col("vec")) if normalize else V.doubles(F.col("vec"))
    own = rows.select("row_id", vec.alias("vec"), F.col("y").cast("double").alias("y")).where(V.valid(F.col("vec"), F.size("vec")) & (F.abs("y") < float("inf")))
    data = Scratch(rows.sparkSession).put(hash_rank(own, [], "row_id", seed, "place").select("place", "vec", "y"), "ranked")
    size = data.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high"))
    n, mean, low, high, k = auto_k(size, requested=k).select("n", "mean", "low", "high", "k").first()
    if not n:
        raise ValueError("no row has a vector and a finite target")
    if low != high:
        raise ValueError(f"vectors have lengths from {low} to {high}")
    c = _fit(data, k, rounds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(c), np.int64)
        for batch in batches:
            if batch.num_rows:
                held += np.bincount(_homes(_matrix(batch), c), minlength=len(c))
        yield pa.RecordBatch.from_pydict({"proto": np.arange(len(c)), "n": held})

    held = {r["proto"]: r["n"] for r in data.select("vec").mapInArrow(count, "proto bigint, n bigint").groupBy("proto").agg(F.sum("n").alias("n")).collect()}
    ends = np.cumsum([held.get(j, 0) for j in range(len(c))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, permutations + 1, len(c)))  # of ones, y and y * y; the last row is the target as it is
        for batch in batches:
            if not batch.num_rows:
                continue
            y, place = batch.column("y").to_numpy() - mean, batch.column("place").to_numpy() - 1
            for p in range(permutations + 1):
                home = np.searchsorted(ends, permuted(place, n, seed + p), "right") if p < permutations else _homes(_matrix(batch), c)
                for at, w in enumerate((None, y, y * y)):
                    sums[at, p] += np.bincount(home, w, len(c))
        p, proto = np.divmod(np.arange(sums[0].size), len(c))
        yield pa.RecordBatch.from_pydict({"p": p, "proto": proto, "n": sums[0].ravel(), "s": sums[1].ravel(), "ss": sums[2].ravel()})

    parts = data.mapInArrow(partial, "p bigint, proto bigint, n double, s double, ss double").groupBy("p", "proto").agg(*(F.sum(x).alias(x) for x in ("n", "s", "ss")))
    loss = parts.where("n > 0").groupBy("p").agg((F.sum(F.greatest(F.lit(0.0), F.col("ss") - F.col("s") * F.col("s") / F.col("n"))) / n).alias("loss"))
    actual = F.col("p") == permutations
    j = loss.agg(F.max(F.when(actual, F.col("loss"))).alias("loss"), F.avg(F.when(~actual, F.col("loss"))).alias("null_loss"))
    ratio = F.col("loss") / F.nullif(F.col("null_loss"), F.lit(0.0))
    score = F.when(ratio.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ratio)))
    return j.select(F.lit(n).cast("bigint").alias("n"), F.lit(int((np.diff(ends, prepend=0) > 0).sum())).cast("bigint").alias("n_prototypes"), "loss", "null_loss", ratio.alias("loss_ratio"), score.alias("score"))
