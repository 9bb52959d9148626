"""Compression of embeddings: truncation, quantization, projections, principal components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def variant_name(name: str, method: str, size: str | int | None = None) -> str:
    return f"{name}[{method}_{size}]" if size is not None else name


def calibration(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """(pos, low, high, peak) of every dimension, peak being the largest magnitude; partial before the shuffle."""
    x = rows.select(F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x"))
    return x.groupBy("pos").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.max(F.abs("x")).alias("peak"))


def _per_dimension(cal: DataFrame, expr: Column, name: str) -> DataFrame:
    return cal.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", expr.alias("v")))), lambda s: s["v"]).alias(name))


def quantize(rows: DataFrame, how: str, fit_on: DataFrame | None = None, vec: str = "vec") -> DataFrame:
    """``vec`` quantized to int8 or uint8 and back; the calibration is that of ``fit_on`` (of the rows themselves by default).

    int8: code = clip(rint(x / s * 127), -127, 127) with s the largest magnitude of the dimension; uint8:
    code = clip(rint((x - low) / range * 255), 0, 255). A dimension without spread uses 1 for s or range.
    The calibration is one row of as many values as a vector has.
    """
    cal = calibration(fit_on if fit_on is not None else rows, vec)
    one = lambda c: F.when(c == 0, 1.0).otherwise(c)
    if how == "int8":
        c = _per_dimension(cal, F.struct(one(F.col("peak")).alias("s"), F.lit(0.0).alias("o")), "cal")
        steps, lo, hi = 127.0, -127.0, 127.0
    elif how == "uint8":
        c = _per_dimension(cal, F.struct(one(F.col("high") - F.col("low")).alias("s"), F.col("low").alias("o")), "cal")
        steps, lo, hi = 255.0, 0.0, 255.0
    else:
        raise ValueError("int8 or uint8")
    code = lambda x, k: F.greatest(F.lit(lo), F.least(F.lit(hi), F.rint((x - k["o"]) / k["s"] * steps)))
    j = rows.join(F.broadcast(c))
    return j.withColumn(vec, F.zip_with(F.col(vec).cast("array<double>"), "cal", lambda x, k: code(x, k) * k["s"] / steps + k["o"])).drop("cal")


def _map_vectors(rows: DataFrame, f, vec: str = "vec") -> DataFrame:
    """Applies a matrix function to Arrow batches of the vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(**{vec: list(f(np.stack(b[vec].to_numpy()).astype(np.float64)))})

    schema = ", ".join(f"`{n}` {'array<double>' if n == vec else t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, schema)


def float16(rows: DataFrame, vec: str = "vec") -> DataFrame:
    return _map_vectors(rows, lambda x: x.astype(np.float16).astype(np.float64), vec)


def gaussian_projection(rows: DataFrame, dim: int, n: int, seed: int = 42, vec: str = "vec") -> DataFrame:
    m = np.random.default_rng(seed).normal(0, 1 / np.sqrt(n), (dim, n))
    return rows if n >= dim else _map_vectors(rows, lambda x: x @ m, vec)


def sparse_projection(rows: DataFrame, dim: int, n: int, seed: int = 42, vec: str = "vec") -> DataFrame:
    s = np.sqrt(dim)
    rng = np.random.default_rng(seed)
    m = rng.choice([-1.0, 0.0, 1.0], (dim, n), p=[1 / (2 * s), 1 - 1 / s, 1 / (2 * s)]) * np.sqrt(s / n)
    return rows if n >= dim else _map_vectors(rows, lambda x: x @ m, vec)


def sign_projection(rows: DataFrame, n: int, vec: str = "vec") -> DataFrame:
    """Projection on n directions of signs that md5 gives for (dimension, direction); 1/sqrt(n) scaled."""
    digit = lambda i, j: F.conv(F.substring(F.md5(F.concat_ws("|", i.cast("string"), j.cast("string"))), 1, 1), 16, 10).cast("int")
    sign = lambda i, j: F.when(digit(i, j) < 8, 1.0).otherwise(-1.0)
    v = F.col(vec).cast("array<double>")
    one = lambda j: F.aggregate(F.transform(v, lambda x, i: x * sign(i, j)), F.lit(0.0), lambda a, x: a + x) / F.sqrt(F.lit(float(n)))
    return rows.withColumn(vec, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one))


def second_moments(rows: DataFrame, vec: str = "vec") -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sum, X'X) from partial Gram matrices of the partitions, as large as the dimensions, not the rows."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, None, None
        for b in batches:
            if len(b):
                x = np.stack(b[vec].to_numpy()).astype(np.float64)
                n, s, g = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if g is None else g)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "g": [g.ravel()]})

    parts = rows.select(vec).where(F.col(vec).isNotNull()).mapInPandas(part, "n bigint, s array<double>, g array<double>")
    flat = parts.select(F.posexplode(F.concat(F.array(F.col("n").cast("double")), "s", "g")).alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x")).orderBy("pos")
    x = np.array([r["x"] for r in flat.collect()])  # 1 + d + d * d numbers
    d = int((np.sqrt(4 * len(x) - 3) - 1) / 2) if len(x) else 0
    return (int(x[0]), x[1 : d + 1], x[d + 1 :].reshape(d, d)) if len(x) else (0, np.zeros(0), np.zeros((0, 0)))


def pca(rows: DataFrame, n: int | float, whiten: bool = False, center: bool = True, vec: str = "vec", fit_on: DataFrame | None = None) -> DataFrame:
    """Principal components (``n`` components, or the share of variance to keep); without centering a truncated SVD."""
    count, s, g = second_moments(fit_on if fit_on is not None else rows, vec)
    mean = s / count if center else np.zeros_like(s)
    cov = (g - count * np.outer(mean, mean)) / max(count - 1, 1)
    w, v = np.linalg.eigh(cov)
    w, v = np.maximum(w[::-1], 0), v[:, ::-1]
    k = int(np.searchsorted(np.cumsum(w) / w.sum(), n) + 1) if isinstance(n, float) else n
    v = v[:, :k] * np.sign(v[np.abs(v[:, :k]).argmax(0), np.arange(k)])
    if whiten:
        v = v / np.sqrt(np.maximum(w[:k], 1e-12))
    return rows if k >= len(s) and not whiten else _map_vectors(rows, lambda x: (x - mean) @ v, vec)


METHODS = ("none", "prefix_truncate", "pca", "incremental_pca", "truncated_svd", "gaussian_random_projection", "sparse_random_projection", "quantize_int8", "quantize_uint8", "quantize_float16")


@dataclass(frozen=True)
class Compression:
    """What to do with vectors: a method of METHODS, and a number of components (for pca also a share of variance)."""

    method: str = "none"
    components: int | float | None = None
    whiten: bool = False
    seed: int = 42

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"a compression is one of {METHODS}, not {self.method!r}")
        if self.needs_size and not self.components:
            raise ValueError(f"{self.method} needs a number of components")

    @property
    def needs_size(self) -> bool:
        return self.method not in ("none", "quantize_int8", "quantize_uint8", "quantize_float16")

    def name(self, extractor: str) -> str:
        if self.method == "none":
            return extractor
        return variant_name(extractor, self.method, self.components) if self.needs_size else f"{extractor}[{self.method}]"


def compress(rows: DataFrame, how: Compression, fit_on: DataFrame | None = None, vec: str = "vec") -> tuple[DataFrame, dict]:
    """(rows with compressed vectors, metadata), fitted on ``fit_on`` (the rows themselves by default).

    As many components as dimensions, or more, leave the vectors as they are, with a warning in the metadata, which holds the
    dimensions, the ratio of encoded bytes, the explained variance where there is one, and the warnings.
    """
    fit = fit_on if fit_on is not None else rows
    size = fit.where(F.col(vec).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.min(F.size(vec)).alias("low"), F.max(F.size(vec)).alias("d")).first()
    n, d = size["n"], size["d"] or 0
    if size["low"] != size["d"]:
        raise ValueError(f"vectors have lengths from {size['low']} to {size['d']}")
    meta: dict = {"method": how.method, "input_dim": d, "output_dim": d, "warnings": []}
    item = {"quantize_int8": 1, "quantize_uint8": 1, "quantize_float16": 2}.get(how.method, 4)
    out, k = rows, how.components
    if how.needs_size and isinstance(k, int) and k >= d:
        meta["warnings"].append(f"{how.method} to {k} of {d} dimensions changes nothing")
    elif how.method == "prefix_truncate":
        out = rows.withColumn(vec, F.slice(vec, 1, k))
    elif how.method in ("pca", "incremental_pca", "truncated_svd"):
        if isinstance(k, int) and k > n:
            raise ValueError(f"{k} components need at least as many rows, not {n}")
        out = pca(rows, k, how.whiten, how.method != "truncated_svd", vec, fit)
        meta["explained_variance"] = explained_variance(fit, k, how.method != "truncated_svd", vec)
    elif how.method == "gaussian_random_projection":
        out = gaussian_projection(rows, d, k, how.seed, vec)
    elif how.method == "sparse_random_projection":
        out = sparse_projection(rows, d, k, how.seed, vec)
    elif how.method in ("quantize_int8", "quantize_uint8"):
        out = quantize(rows, how.method.removeprefix("quantize_"), fit, vec)
        meta["calibration"] = {"quantize_int8": "symmetric_absmax", "quantize_uint8": "affine_min_range"}[how.method]
    elif how.method == "quantize_float16":
        out = float16(rows, vec)
    if how.needs_size and not meta["warnings"]:
        meta["output_dim"] = k if isinstance(k, int) else out.select(F.size(vec)).first()[0]
    meta["encoded_bytes"] = n * meta["output_dim"] * item
    meta["ratio"] = (n * d * 4 / meta["encoded_bytes"]) if meta["encoded_bytes"] else None
    return out, meta


def compress_pair(fit_rows: DataFrame, paired: DataFrame, how: Compression, vec: str = "vec") -> tuple[DataFrame, DataFrame, dict]:
    """Both sides compressed by what is fitted on the first (gallery and queries, samples and prompts)."""
    left, meta = compress(fit_rows, how, vec=vec)
    return left, compress(paired, how, fit_rows, vec)[0], meta


def explained_variance(rows: DataFrame, n: int | float, center: bool = True, vec: str = "vec") -> float:
    """The share of variance that the first components hold."""
    count, s, g = second_moments(rows, vec)
    mean = s / count if center else np.zeros_like(s)
    w = np.maximum(np.linalg.eigvalsh(g - count * np.outer(mean, mean))[::-1], 0)
    share = np.cumsum(w) / w.sum()
    return float(share[(int(np.searchsorted(share, n)) if isinstance(n, float) else n - 1)])
