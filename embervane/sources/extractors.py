"""Extractors: functions from rows to vectors, run over Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def call(rows: DataFrame, f: Callable[[pd.Series], np.ndarray], input_col: str, outputs: tuple[str, ...] = ("vec",), retries: int = 0, wait: float = 0.5) -> DataFrame:
    """Rows with the vectors that ``f`` gives for a batch of inputs: one matrix, or a mapping of named matrices.

    A batch that fails is tried again ``retries`` times; a matrix must have a row per input and one width.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width: dict[str, int] = {}
        for b in batches:
            if not len(b):
                continue
            for attempt in range(retries + 1):
                try:
                    got = f(b[input_col])
                    break
                except Exception:
                    if attempt == retries:
                        raise
                    time.sleep(wait * 2**attempt)
            got = got if isinstance(got, dict) else {outputs[0]: got}
            for o in outputs:
                m = np.asarray(got[o], np.float64)
                if m.ndim != 2 or len(m) != len(b) or width.setdefault(o, m.shape[1]) != m.shape[1]:
                    raise ValueError(f"output {o} has the shape {m.shape} for {len(b)} rows")
                b = b.assign(**{o: list(m)})
            yield b

    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes if n not in outputs), *(f"`{o}` array<double>" for o in outputs)])
    return rows.drop(*outputs).mapInPandas(run, schema)


def onnx(rows: DataFrame, model_path: str, input_col: str, input_name: str | None = None, output: str | None = None) -> DataFrame:
    """Vectors of an ONNX model that every executor can read."""
    sessions: dict[str, object] = {}

    def f(batch: pd.Series) -> np.ndarray:
        import onnxruntime

        if model_path not in sessions:
            sessions[model_path] = onnxruntime.InferenceSession(model_path)
        s = sessions[model_path]
        x = np.stack(batch.to_numpy()).astype(np.float32)
        return s.run([output] if output else None, {input_name or s.get_inputs()[0].name: x})[0].reshape(len(x), -1)

    return call(rows, f, input_col)


class Fitted:
    """A pipeline that is fitted on some rows and gives vectors to others: ``fit`` returns the extractor."""

    def __init__(self, stages: Callable[[], list], output: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d, drop: tuple[str, ...] = ()):
        self.stages, self.output, self.prepare, self.drop = stages, output, prepare, drop

    def fit(self, rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
        from pyspark.ml import Pipeline
        from pyspark.ml.functions import vector_to_array

        model = Pipeline(stages=self.stages()).fit(self.prepare(rows))
        return lambda d: model.transform(self.prepare(d)).withColumn("vec", vector_to_array(self.output)).drop(*self.drop)


def text_features(text: str, features: int = 1024, components: int | None = None) -> Fitted:
    """TF-IDF of hashed words, optionally reduced to principal components; null texts have no row."""
    from pyspark.ml.feature import IDF, PCA, HashingTF, RegexTokenizer

    def stages() -> list:
        base = [RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\W+"), HashingTF(inputCol="_w", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_f")]
        return base + ([PCA(k=components, inputCol="_f", outputCol="_p")] if components else [])

    return Fitted(stages, "_p" if components else "_f", lambda d: d.where(F.col(text).isNotNull()), ("_w", "_tf", "_f", "_p"))


def scaled_features(vec: str, components: int | None = None) -> Fitted:
    """Vectors scaled to mean 0 and deviation 1, optionally reduced to principal components."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    def stages() -> list:
        base = [StandardScaler(inputCol="_x", outputCol="_s", withMean=True)]
        return base + ([PCA(k=components, inputCol="_s", outputCol="_p")] if components else [])

    return Fitted(stages, "_p" if components else "_s", lambda d: d.withColumn("_x", array_to_vector(F.col(vec).cast("array<double>"))), ("_x", "_s", "_p"))


def text_pipeline(rows: DataFrame, text: str, features: int = 1024, components: int | None = None) -> DataFrame:
    """``text_features`` fitted on the rows themselves."""
    return text_features(text, features, components).fit(rows)(rows)


def fit_tree_leaves(rows: DataFrame, vec: str, label: str, trees: int = 10, depth: int = 4, seed: int = 42, one_hot: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A random forest fitted on the rows; the extractor it returns gives other rows the ``leaves`` they fall into and, as
    ``vec``, these or their one-hot form, in which a leaf that the fitted rows never reached is all zero."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    put = lambda d: d.withColumn("_x", array_to_vector(F.col(vec).cast("array<double>")))
    data = put(rows.where(F.col(label).isNotNull())).withColumn("_l", F.col(label).cast("string"))
    coded = StringIndexer(inputCol="_l", outputCol="_y").fit(data).transform(data)
    model = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed).setLeafCol("_leaf").fit(coded)
    leaf = lambda d: model.transform(put(d)).withColumn("leaves", vector_to_array("_leaf")).drop("_x", "_leaf", "rawPrediction", "probability", "prediction")
    if not one_hot:
        return lambda d: leaf(d).withColumn("vec", F.col("leaves"))
    seen = leaf(rows).select(F.posexplode("leaves").alias("tree", "leaf")).distinct().orderBy("tree", "leaf").collect()  # trees times leaves
    hot = lambda c: F.array(*((F.get(c, F.lit(r["tree"])) == r["leaf"]).cast("double") for r in seen))
    return lambda d: (out := leaf(d)).withColumn("vec", hot(out["leaves"]))


def tree_leaves(rows: DataFrame, vec: str, label: str, trees: int = 10, depth: int = 4, seed: int = 42) -> DataFrame:
    """``fit_tree_leaves`` fitted on the rows themselves; the leaf ids are in ``leaves``."""
    out = fit_tree_leaves(rows, vec, label, trees, depth, seed)(rows)
    return out.drop("vec").withColumn("vec", rows[vec]) if vec != "vec" else out


def precomputed(vec: str) -> Callable[[DataFrame], DataFrame]:
    """Vectors that are a column already."""
    return lambda d: d.withColumn("vec", F.col(vec))


def from_function(f: Callable[[pd.Series], np.ndarray], input_col: str, retries: int = 0) -> Callable[[DataFrame], DataFrame]:
    """A function of a batch of inputs as an extractor."""
    return lambda d: call(d, f, input_col, retries=retries)


def many_outputs(f: Callable, input_col: str, outputs: tuple[str, ...]) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """A function with several named outputs as one extractor for each."""
    one = lambda o: lambda d: call(d, lambda s: {o: f(s)[o]}, input_col, (o,)).withColumnRenamed(o, "vec")
    return {o: one(o) for o in outputs}


def sided(query: Callable, gallery: Callable, query_col: str, gallery_col: str) -> tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    """The two branches of a retrieval model."""
    return from_function(query, query_col), from_function(gallery, gallery_col)


def nested(rows: DataFrame, f: Callable[[pd.Series], list[np.ndarray]], input_col: str, output: str = "vecs") -> DataFrame:
    """Per row a matrix of vectors (tokens, frames, units, or the cells of a grid row by row): ``f`` gives a list of matrices of
    one width for a batch, or None for a row without any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = None
        for b in batches:
            if not len(b):
                continue
            got = f(b[input_col])
            if len(got) != len(b):
                raise ValueError(f"{len(got)} matrices for {len(b)} rows")
            lists = []
            for m in got:
                m = None if m is None else np.asarray(m, np.float64)
                if m is not None:
                    if m.ndim != 2 or (width is not None and len(m) and m.shape[1] != width):
                        raise ValueError(f"a matrix has the shape {m.shape}")
                    width = m.shape[1] if len(m) else width
                lists.append(None if m is None else [list(r) for r in m])
            yield b.assign(**{output: lists})

    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes if n != output), f"`{output}` array<array<double>>"])
    return rows.drop(output).mapInPandas(run, schema)


def grid(rows: DataFrame, f: Callable[[pd.Series], list[np.ndarray]], input_col: str, row_id: str) -> DataFrame:
    """(img, i, j, vec): the cells of the grids (height, width, dimensions) that ``f`` gives for images."""
    def flat_rows(s: pd.Series) -> list:
        return [None if g is None else np.asarray(g, float).reshape(-1, np.shape(g)[-1]) for g in f(s)]

    def widths(s: pd.Series) -> np.ndarray:
        return np.array([[1 if g is None else np.shape(g)[1]] for g in f(s)], float)

    flat = nested(rows, flat_rows, input_col)
    size = call(rows, widths, input_col, ("w",)).select(row_id, F.col("w")[0].cast("int").alias("w"))
    cells = flat.join(size, row_id).select(F.col(row_id).alias("img"), "w", F.posexplode("vecs").alias("at", "vec"))
    return cells.select("img", F.floor(F.col("at") / F.col("w")).cast("int").alias("i"), (F.col("at") % F.col("w")).cast("int").alias("j"), "vec")


#: Model families and the package each is run with; none is shipped, and none is needed until an extractor of it is called.
FAMILIES = {"torch": "torch", "keras": "keras", "jax_flax": "jax", "tf_hub": "tensorflow_hub", "hf_text": "transformers", "hf_vision": "transformers", "hf_audio": "transformers", "hf_video": "transformers", "hf_time_series": "transformers", "hf_multimodal": "transformers", "open_clip": "open_clip", "siglip": "transformers", "sentence_transformers": "sentence_transformers", "timm": "timm", "torchvision": "torchvision", "graph": "torch"}


def family(kind: str, load: Callable[[], object], encode: Callable[[object, pd.Series], np.ndarray], input_col: str, batch_rows: int = 64) -> Callable[[DataFrame], DataFrame]:
    """An extractor of a model family: ``load`` makes the model, once in each Python worker, and ``encode`` gives a matrix for
    a batch of inputs. A package that is missing is an error that names it, when the first batch is read."""
    package = FAMILIES[kind]

    def f(s: pd.Series) -> np.ndarray:
        import importlib.util

        if importlib.util.find_spec(package) is None:
            raise ModuleNotFoundError(f"extractors of {kind} need the package {package}")
        if kind not in _MODELS:
            _MODELS[kind] = load()
        return np.concatenate([np.asarray(encode(_MODELS[kind], s.iloc[lo : lo + batch_rows])) for lo in range(0, len(s), batch_rows)])

    return from_function(f, input_col)


_MODELS: dict[str, object] = {}


def pool(tokens: Column, how: str, mask: Column | None = None) -> Column:
    """A vector of an array of token vectors: cls (first), last (last of the mask), mean (over the mask), flatten."""
    from embervane.functions.vectors import mean_pool

    kept = F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"].cast("int") == 1) if mask is not None else None
    rows = F.transform(kept, lambda x: x["t"]) if kept is not None else tokens
    return {"cls": lambda: F.element_at(tokens, 1), "last": lambda: F.element_at(rows, -1), "mean": lambda: mean_pool(rows), "flatten": lambda: F.flatten(rows)}[how]()


def select_path(col: str, path: str) -> Column:
    """A dotted path into a nested output: fields, map keys and positions."""
    c = F.col(col)
    for part in path.split("."):
        c = c.getItem(int(part)) if part.lstrip("-").isdigit() else c.getItem(part)
    return c


def sample_frames(frames: Column, n: int) -> Column:
    """n frames evenly from the first to the last."""
    size = F.size(frames)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(frames, (F.round(i * (size - 1) / max(n - 1, 1)) + 1).cast("int")))
