"""Binding of tables to datasets, and their artifacts and reports."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from embervane.functions import vectors as V
from embervane.operators import labels as L, targets as G


@dataclass(frozen=True)
class Dataset:
    """Rows with an id, an input and a target; every operator addresses rows by the id, never by position."""

    rows: DataFrame
    row_id: str = "row_id"
    input_col: str = "vec"
    label_col: str | None = "label"
    target_type: str = "single_label"
    group_col: str | None = None
    modality: str = "embedding"
    metadata: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.target_type not in ("single_label", "multi_label", "regression"):
            raise ValueError(f"unknown target type {self.target_type!r}")
        missing = {c for c in (self.row_id, self.input_col, self.label_col, self.group_col) if c} - set(self.rows.columns)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")

    def subset(self, ids: DataFrame) -> Dataset:
        """The rows with these ids; a null, repeated or unknown id is an error."""
        ids = G.validated_rows(ids.select(self.row_id), self.row_id, self.rows)
        return replace(self, rows=self.rows.join(ids, self.row_id, "left_semi"))

    def validate(self) -> Dataset:
        """Raises where no benchmark can run: repeated or null ids, fewer than two classes of two rows each, a label set
        without labels, a regression target with fewer than three rows or one value only."""
        n = self.rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(self.row_id).alias("d")).first()
        if n["n"] != n["d"]:
            raise ValueError(f"{n['n'] - n['d']} row ids are null or repeated")
        if self.label_col is None:
            raise ValueError("there is no target")
        if self.target_type == "regression":
            t = F.col(self.label_col)[0] if dict(self.rows.dtypes)[self.label_col].startswith("array") else F.col(self.label_col)
            r = self.rows.select(t.cast("double").alias("t")).agg(F.count("t").alias("n"), F.min("t").alias("low"), F.max("t").alias("high")).first()
            if r["n"] < 3 or r["low"] == r["high"]:
                raise ValueError(f"a regression target needs three rows and two values, not {r['n']} rows from {r['low']} to {r['high']}")
            return self
        counts = G.multilabel_counts(self.rows, self.label_col) if self.target_type == "multi_label" else G.class_counts(self.rows, self.label_col)
        c = counts.agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("least")).first()
        if c["classes"] < 2 or (c["least"] < 2 and self.target_type == "single_label"):
            raise ValueError(f"{c['classes']} classes, the smallest with {c['least']} rows, are too few")
        return self

    def batches(self, shard: int = 0, shards: int = 1) -> DataFrame:
        """The rows of one of several shards by the hash of their id; Arrow batches are cut from partitions by Spark."""
        if not 0 <= shard < shards:
            raise ValueError(f"shard {shard} of {shards}")
        return self.rows.where(F.pmod(F.xxhash64(self.row_id), F.lit(shards)) == shard)

    def with_label_hierarchy(self, path_col: str, names: tuple[str, ...] = ()) -> Dataset:
        return replace(self, metadata=self.metadata | {"hierarchy": path_col, "levels": list(names)})

    def hierarchy_view(self, level: int | str) -> Dataset:
        """The same rows labelled by their path down to a level."""
        view = G.label_view(F.col(self.metadata["hierarchy"]), level, tuple(self.metadata["levels"]))
        return replace(self, rows=self.rows.withColumn("view_label", view), label_col="view_label", target_type="single_label")

    def with_unit_annotations(self, annotations: DataFrame, unit_type: str) -> Dataset:
        """annotations(row_id, units: array of structs) joined to the rows; a row without annotations has an empty array."""
        kind = dict(annotations.dtypes)["units"]
        rows = self.rows.join(annotations.select(self.row_id, "units"), self.row_id, "left").withColumn("units", F.coalesce("units", F.array().cast(kind)))
        return replace(self, rows=rows, metadata=self.metadata | {"unit_type": unit_type})

    def with_groups(self, group_col: str) -> Dataset:
        return replace(self, group_col=group_col)

    def identity(self) -> str:
        """A content hash that does not depend on the order of rows: sums of row hashes."""
        h = self.rows.select(F.xxhash64(*sorted(self.rows.columns)).alias("h")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)"))).first()
        return exact_hash({"rows": h[0], "sum": str(h[1]), "columns": sorted(self.rows.dtypes)})


def from_table(df: DataFrame, row_id: str, inputs: str | list[str], label: str | list[str] | None, **how) -> Dataset:
    """From any DataFrame: one or several input columns (numbers become a vector), one or several label columns."""
    if isinstance(inputs, list):
        df, inputs = df.withColumn("vec", F.array(*(F.col(c).cast("double") for c in inputs))), "vec"
    if isinstance(label, list):
        df, label = df.withColumn("labels", F.array_compact(F.array(*(F.when(F.col(c).cast("boolean"), F.lit(c)) for c in label)))), "labels"
        how.setdefault("target_type", "multi_label")
    return Dataset(df, row_id, inputs, label, **how)


def from_files(spark: SparkSession, path: str, modality: str, label_from: str | None = None) -> Dataset:
    """Image, audio or video files: content is read lazily; the label may be a regular expression over the path."""
    rows = spark.read.format("binaryFile").load(path).withColumn("row_id", F.col("path"))
    if label_from:
        rows = rows.withColumn("label", F.regexp_extract("path", label_from, 1))
    return Dataset(rows, "row_id", "content", "label" if label_from else None, modality=modality)


def _packed(df: DataFrame, row_id: str, label: str | None, modality: str, fields: dict[str, str], **how) -> Dataset:
    """A dataset whose input is one struct of the named columns, each cast to its type."""
    kinds = dict(df.dtypes)
    missing = [c for c in fields if c not in kinds]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    packed = F.struct(*(F.col(c).cast(t).alias(c) if t else F.col(c) for c, t in fields.items()))
    return Dataset(df.withColumn("input", packed), row_id, "input", label, modality=modality, **how)


def from_audio_arrays(df: DataFrame, row_id: str, samples: str, sampling_rate: str | int, label: str | None = None, **how) -> Dataset:
    """Waveforms with their sampling rate, a column or one number for all, which must be positive."""
    rate = F.col(sampling_rate) if isinstance(sampling_rate, str) else F.lit(sampling_rate)
    df = df.withColumn("sampling_rate", F.when(rate > 0, rate.cast("int")).otherwise(F.raise_error(F.lit("a sampling rate must be positive")).cast("int"))).withColumn("samples", F.col(samples))
    return _packed(df, row_id, label, "audio", {"samples": "array<float>", "sampling_rate": "int"}, **how)


def from_video_arrays(df: DataFrame, row_id: str, frames: str, frame_rate: float | str, label: str | None = None, **how) -> Dataset:
    """Decoded frames, each a flat array of pixels, with their rate."""
    rate = F.col(frame_rate) if isinstance(frame_rate, str) else F.lit(float(frame_rate))
    return _packed(df.withColumn("frames", F.col(frames)).withColumn("frame_rate", rate), row_id, label, "video", {"frames": "array<array<float>>", "frame_rate": "double"}, **how)


def from_time_series(df: DataFrame, row_id: str, series: str, label: str | None = None, observed: str | None = None, timestamps: str | None = None, features: str | None = None, **how) -> Dataset:
    """Series (steps by channels) with the mask of what was observed (all by default), timestamps and time features; mask and
    timestamps must have a value for each step."""
    n = F.size(series)
    mask = F.col(observed) if observed else F.transform(F.col(series), lambda x: F.lit(True))
    df = df.withColumn("series", F.col(series)).withColumn("observed", mask)
    fields = {"series": "array<array<double>>", "observed": "array<boolean>"}
    good = F.size("observed") == n
    for name, c, t in (("timestamps", timestamps, "array<timestamp>"), ("time_features", features, "array<array<double>>")):
        if c:
            df, good = df.withColumn(name, F.col(c)), good & (F.size(c) == n)
            fields[name] = t
    df = df.withColumn("series", F.when(good, F.col("series")).otherwise(F.raise_error(F.lit("mask, timestamps and features need a value for each step")).cast(dict(df.dtypes)["series"])))
    return _packed(df, row_id, label, "time_series", fields, **how)


def from_multimodal(df: DataFrame, row_id: str, inputs: dict[str, str], label: str | None = None, **how) -> Dataset:
    """Several named modalities of each row; a null in any is an error where it is read."""
    whole = None
    for c in inputs.values():
        whole = F.col(c).isNotNull() if whole is None else whole & F.col(c).isNotNull()
    struct = F.struct(*(F.col(c).alias(n) for n, c in inputs.items()))
    kind = df.select(struct.alias("x")).schema["x"].dataType
    packed = F.when(whole, struct).otherwise(F.raise_error(F.lit("a modality is null")).cast(kind))
    return Dataset(df.withColumn("input", packed), row_id, "input", label, modality="multimodal", **how)


def from_graphs(nodes: DataFrame, edges: DataFrame, graph_id: str, labels: DataFrame | None = None, **how) -> Dataset:
    """nodes(graph_id, node_id, vec) and edges(graph_id, src, dst) to one row a graph, its input a struct of sorted arrays;
    labels(graph_id, label). A graph without edges has an empty array."""
    n = nodes.groupBy(graph_id).agg(F.array_sort(F.collect_list(F.struct("node_id", "vec"))).alias("nodes"))
    e = edges.groupBy(graph_id).agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("edges"))
    rows = n.join(e, graph_id, "left").withColumn("edges", F.coalesce("edges", F.array().cast(dict(e.dtypes)["edges"])))
    if labels is not None:
        rows = rows.join(labels, graph_id, "left")
    return _packed(rows, graph_id, "label" if labels is not None else None, "graph", {"nodes": None, "edges": None}, **how)


def from_embeddings(df: DataFrame, row_id: str, vec: str, label: str | None = None, **how) -> Dataset:
    """Vectors as arrays or as ML vectors, dense or sparse, which become arrays."""
    if df.schema[vec].dataType.typeName() not in ("array",):
        from pyspark.ml.functions import vector_to_array

        df = df.withColumn(vec, vector_to_array(vec))
    return Dataset(df, row_id, vec, label, **how)


def from_units(df: DataFrame, row_id: str, vec: str, label: str, parent: str, unit_type: str = "unit", **optional: str) -> Dataset:
    """Unit rows grouped by their parent; ``optional`` names columns for position, span, coordinates and provenance, which are
    kept as one struct ``unit``."""
    known = ("unit_id", "position", "span", "coordinates", "provenance")
    if set(optional) - set(known):
        raise ValueError(f"a unit has {known}, not {sorted(set(optional) - set(known))}")
    df = df.withColumn("unit", F.struct(*(F.col(optional[k]).alias(k) for k in known if k in optional))) if optional else df
    return Dataset(df, row_id, vec, label, group_col=parent, metadata={"unit_type": unit_type})


def from_nodes(nodes: DataFrame, node_id: str, vec: str, label: str | None = None, edges: DataFrame | None = None) -> Dataset:
    """Nodes of one graph with unique ids; edges(src, dst) must name known nodes and stay in the metadata."""
    if edges is not None:
        ends = edges.select(F.col("src").alias(node_id)).unionByName(edges.select(F.col("dst").alias(node_id))).distinct()
        G.validated_rows(ends, node_id, nodes)
    return Dataset(nodes, node_id, vec, label, modality="graph_node", metadata={"edges": edges} if edges is not None else {})


def from_entities(entities: DataFrame, entity_id: str, vec: str, label: str | None = None, entity_type: str = "entity") -> Dataset:
    return Dataset(entities, entity_id, vec, label, modality="entity", metadata={"entity_type": entity_type})


def from_pairs(pairs: DataFrame, how: str | None = None, entities: DataFrame | None = None, label: str | None = "label") -> Dataset:
    """Pairs (row_id, left, right) with their own ``vec``, or composed from entities(id, vec); ids are matched with their type."""
    if entities is None:
        return Dataset(pairs, "row_id", "vec", label, modality="pair")
    kinds, own = dict(pairs.dtypes), dict(entities.dtypes)["id"]
    if {kinds["left"], kinds["right"]} != {own}:
        raise ValueError(f"pair ids are {kinds['left']} and {kinds['right']}, entity ids {own}")
    return Dataset(compose_edges(pairs, entities, how or "concat", "left", "right"), "row_id", "vec", label, modality="pair")


@dataclass(frozen=True)
class RetrievalDataset:
    """queries(q, vec or input), gallery(g, ...), relevance(q, g, grade), exclusions(q, g); the two id spaces are independent."""

    queries: DataFrame
    gallery: DataFrame
    relevance: DataFrame
    exclusions: DataFrame | None = None
    modalities: tuple[str, str] = ("embedding", "embedding")

    def validate(self) -> RetrievalDataset:
        """Raises for repeated ids, negative or non-finite grades, pairs of unknown ids, and queries without a positive."""
        for df, c in ((self.queries, "q"), (self.gallery, "g")):
            n = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(c).alias("d")).first()
            if n["n"] != n["d"]:
                raise ValueError(f"{n['n'] - n['d']} ids of {c} are null or repeated")
        if self.relevance.where("grade is null or grade < 0 or isnan(grade) or grade = double('infinity')").limit(1).count():
            raise ValueError("a grade is null, negative or not finite")
        for c, df in (("q", self.queries), ("g", self.gallery)):
            unknown = self.relevance.select(c).distinct().join(df.select(c), c, "left_anti").limit(3).collect()
            if unknown:
                raise ValueError(f"relevance names unknown {c}, such as {[r[c] for r in unknown]}")
        lost = self.queries.select("q").join(self.eligible().where("grade > 0").select("q").distinct(), "q", "left_anti").limit(3).collect()
        if lost:
            raise ValueError(f"queries without a positive, such as {[r['q'] for r in lost]}")
        return self

    def eligible(self) -> DataFrame:
        return self.relevance if self.exclusions is None else self.relevance.join(self.exclusions.select("q", "g"), ["q", "g"], "left_anti")


def relevance_from_matrix(matrix: DataFrame, gallery_ids: list | None = None) -> DataFrame:
    """matrix(q, grades: array, a value for each gallery row in order) to (q, g, grade) of the positive grades."""
    rows = matrix.select("q", F.posexplode(F.col("grades").cast("array<double>")).alias("g", "grade")).where("grade > 0")
    if gallery_ids is None:
        return rows.withColumn("g", F.col("g").cast("bigint"))
    return rows.withColumn("g", F.get(F.array(*(F.lit(i) for i in gallery_ids)), F.col("g")))


@dataclass(frozen=True)
class ZeroShotDataset:
    """samples(row_id, label, vec or input) and prompts(label, template_id, prompt[, vec])."""

    samples: DataFrame
    prompts: DataFrame

    def validate(self) -> ZeroShotDataset:
        lacking = self.samples.where("label is not null").select("label").distinct().join(self.prompts.select("label"), "label", "left_anti").limit(3).collect()
        if lacking:
            raise ValueError(f"classes without a prompt, such as {[r['label'] for r in lacking]}")
        return self

    def fingerprint(self) -> str:
        """A hash of classes and prompts, whatever their order."""
        own = [c for c in ("label", "template_id", "prompt") if c in self.prompts.columns]
        return exact_hash(sorted(json.dumps([str(v) for v in r]) for r in self.prompts.select(*own).distinct().collect()))  # prompts


def zero_shot_from_prompts(samples: DataFrame, class_prompts: dict) -> ZeroShotDataset:
    """Every class with its list of prompts."""
    rows = [(label, i, p) for label, ps in class_prompts.items() for i, p in enumerate(ps)]
    kind = dict(samples.dtypes)["label"]
    return ZeroShotDataset(samples, samples.sparkSession.createDataFrame(rows, f"label {kind}, template_id int, prompt string"))


def zero_shot_from_templates(samples: DataFrame, templates: list[str]) -> ZeroShotDataset:
    return ZeroShotDataset(samples, prompts(samples.where("label is not null").select("label").distinct(), templates))


def segmentation(df: DataFrame, row_id: str, mask: str, instance_mask: str | None = None, image: str | None = None, classes: DataFrame | None = None) -> Dataset:
    """Images or paths with a mask of class numbers (rows of columns) and, where there is one, of instances, of equal shape.
    classes(label, background, is_thing) is kept in the metadata."""
    if instance_mask:
        same = (F.size(mask) == F.size(instance_mask)) & F.forall(F.arrays_zip(F.col(mask).alias("a"), F.col(instance_mask).alias("b")), lambda x: F.size(x["a"]) == F.size(x["b"]))
        df = df.withColumn(mask, F.when(same, F.col(mask)).otherwise(F.raise_error(F.lit("masks differ in shape")).cast(dict(df.dtypes)[mask])))
    meta = {"instances": instance_mask} | ({"classes": classes} if classes is not None else {})
    return Dataset(df, row_id, image or mask, mask, modality="segmentation", metadata=meta)


def pixels(d: Dataset) -> DataFrame:
    """(img, r, c, label, instance) of every pixel of a segmentation dataset; instance is 0 without instance masks."""
    held = d.metadata.get("instances")
    row = d.rows.select(F.col(d.row_id).alias("img"), F.posexplode(d.label_col).alias("r", "line"), *([F.col(held).alias("inst")] if held else []))
    row = row.withColumn("inst", F.get("inst", F.col("r"))) if held else row
    px = row.select("img", "r", F.posexplode("line").alias("c", "label"), *(["inst"] if held else []))
    return px.select("img", "r", "c", "label", (F.get("inst", F.col("c")) if held else F.lit(0)).alias("instance"))


def compose_edges(edges: DataFrame, nodes: DataFrame, how: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edge (or pair) vectors from those of their ends; an end without a node is an error."""
    a = nodes.select(F.col("id").alias(src), F.col("vec").alias("_a"))
    b = nodes.select(F.col("id").alias(dst), F.col("vec").alias("_b"))
    j = edges.join(a, src, "left").join(b, dst, "left")
    return j.withColumn("vec", F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("an edge names an unknown node")).cast("array<double>")).otherwise(V.compose(F.col("_a"), F.col("_b"), how))).drop("_a", "_b")


def compose_triplets(triplets: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    """(anchor, positive, negative) to concat(compose(anchor, positive), compose(anchor, negative))."""
    p = compose_edges(triplets, nodes, how, "anchor", "positive").withColumnRenamed("vec", "_p")
    return compose_edges(p, nodes, how, "anchor", "negative").withColumn("vec", F.concat("_p", "vec")).drop("_p")


def prompts(classes: DataFrame, templates: list[str]) -> DataFrame:
    """Every class in every template: (label, template_id, prompt); a template has the field {label} and no other."""
    for t in templates:
        if t.replace("{label}", "").count("{") or "{label}" not in t:
            raise ValueError(f"a template must have the field {{label}} only: {t!r}")
    listed = F.array(*(F.struct(F.lit(i).alias("template_id"), F.lit(t).alias("t")) for i, t in enumerate(templates)))
    return classes.select("label", F.explode(listed).alias("x")).select("label", "x.template_id", F.replace(F.col("x.t"), F.lit("{label}"), F.col("label").cast("string")).alias("prompt"))


def exact_hash(value) -> str:
    """sha256 of the canonical JSON of a value in which types stay apart (1, "1" and true differ)."""
    return hashlib.sha256(json.dumps(_typed(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _typed(v):
    if isinstance(v, dict):
        return {"map": sorted(([_typed(k), _typed(x)] for k, x in v.items()), key=lambda p: json.dumps(p[0], sort_keys=True))}
    if isinstance(v, (list, tuple)):
        return {"list": [_typed(x) for x in v]}
    return {type(v).__name__: v if v is None or isinstance(v, (str, bool, int)) else repr(v)}


def artifact_key(*parts: str) -> str:
    """A relative key of lower-case slugs; what a slug cannot hold is told apart by a hash. Empty parts and ways out of the
    folder are errors."""
    out = []
    for p in parts:
        if not p or p in (".", "..") or "/" in p or "\x00" in p:
            raise ValueError(f"{p!r} cannot be part of an artifact key")
        slug = re.sub(r"[^a-z0-9._-]+", "-", p.lower()).strip("-.")
        out.append(slug if slug == p else f"{slug or 'x'}-{hashlib.sha256(p.encode()).hexdigest()[:12]}")
    return "/".join(out)


def write_artifact(rows: DataFrame, path: str, metadata: dict, row_id: str = "row_id", n_expected: int | None = None) -> None:
    """Rows as parquet with their metadata beside them, written last: an artifact without metadata is none. Null or repeated
    ids, and more or fewer rows than expected, are errors and leave nothing behind."""
    delete(rows.sparkSession, path)
    a = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(row_id).alias("d")).first()
    if a["n"] != a["d"]:
        raise ValueError(f"{a['n'] - a['d']} row ids are null or repeated")
    if n_expected is not None and a["n"] != n_expected:
        raise ValueError(f"{n_expected} rows were expected, {a['n']} came")
    rows.write.parquet(f"{path}/rows")
    put_json(rows.sparkSession, f"{path}/metadata", metadata | {"n_rows": a["n"]})


def read_artifact(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/rows"), get_json(spark, f"{path}/metadata")


def put_json(spark: SparkSession, path: str, value) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def get_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path).first()[0])


def delete(spark: SparkSession, path: str) -> None:
    """Removes everything below a path, on any file system that Hadoop knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_labels(d: Dataset, path: str) -> None:
    """The labels of a dataset with their catalog beside them."""
    write_artifact(d.rows.select(F.col(d.row_id).alias("row_id"), F.col(d.label_col).alias("label")), path, {"target_type": d.target_type, "identity": d.identity()})
    flat = d.rows.select(F.explode(d.label_col).alias("label")) if d.target_type == "multi_label" else d.rows.select(F.col(d.label_col).alias("label"))
    if d.target_type != "regression":
        L.catalog(flat, "label").write.mode("overwrite").parquet(f"{path}/catalog")


def aligned(spark: SparkSession, embeddings: str, labels: str) -> DataFrame:
    """(row_id, vec, label) of two artifacts; different numbers of rows, or rows that one of them lacks, are an error."""
    (a, meta_a), (b, meta_b) = read_artifact(spark, embeddings), read_artifact(spark, labels)
    j = a.join(b, "row_id")
    if not meta_a["n_rows"] == meta_b["n_rows"] == j.count():
        raise ValueError(f"{meta_a['n_rows']} embeddings and {meta_b['n_rows']} labels do not match row by row")
    return j


def save_json_report(table: DataFrame, path: str, **head) -> None:
    """Results as JSON: the head's entries and all rows."""
    rows = [json.loads(r) for r in table.toJSON().toLocalIterator()]
    put_json(table.sparkSession, path, head | {"results": rows})


def markdown(table: DataFrame, title: str, limit: int | None = None) -> str:
    """A result table as Markdown; rows beyond ``limit`` are left out with a remark that says how many."""
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    rows = table.limit(limit + 1).collect() if limit is not None else table.collect()
    rest = f"\n{table.count() - limit} more rows are not shown.\n" if limit is not None and len(rows) > limit else ""
    head = "| " + " | ".join(table.columns) + " |\n|" + "---|" * len(table.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:limit]) + "\n" + rest


def report(sections: dict[str, DataFrame | list[str]], title: str) -> str:
    """A Markdown report of sections, each a table or a list of remarks."""
    out = [f"# {title}\n"]
    for name, body in sections.items():
        out.append(markdown(body, name).replace("# ", "## ", 1) if isinstance(body, DataFrame) else f"## {name}\n\n" + "\n".join(f"* {x}" for x in body) + "\n")
    return "\n".join(out)


def benchmark_report(ranked: DataFrame, results: DataFrame, advice: list[str], diagnostics: dict | None = None) -> str:
    """The report of a benchmark: ranking, all metrics, weakest classes, stability, complexity, advice."""
    overlap = results.where("metric = 'overlap'")
    sections = {"Ranking": ranked.select("view", "place", "variant", "score", "output_dim").orderBy("view", "place"), "Metrics": results.select("view", "variant", "metric", "score").orderBy("view", "variant", "metric"), "Weakest classes": overlap.select("view", "variant", "weakest_class", "weakest_score").orderBy("view", "variant"), "Stability": overlap.select("view", "variant", "stability_width", "advice").orderBy("view", "variant"), "Advice": advice}
    if diagnostics:
        sections["Complexity"] = [f"{view} / {variant}: {d.get('guidance') or d.get('reason')}" for (view, variant), d in diagnostics.items()]
    warnings = [r["warnings"] for r in results.where("warnings <> ''").select("warnings").distinct().collect()]
    return report(sections | ({"Warnings": warnings} if warnings else {}), "Benchmark")


def retrieval_report(results: DataFrame, worst: DataFrame | None = None) -> str:
    return report({"Variants": results.orderBy("place")} | ({"Worst queries": worst} if worst is not None else {}), "Retrieval")


def zero_shot_report(results: DataFrame, per_class: DataFrame | None = None, worst: DataFrame | None = None) -> str:
    return report({"Variants": results.orderBy("place")} | ({"Classes": per_class} if per_class is not None else {}) | ({"Worst samples": worst} if worst is not None else {}), "Zero-shot")
