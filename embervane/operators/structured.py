"""Structured units and segmentation tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from embervane.operators.targets import hash_rank, order_key


def unit_id(parent: Column, local: Column) -> Column:
    """Global id of a unit: sha256 of the parent's and the local id."""
    return F.sha2(F.concat_ws("|", parent.cast("string"), local.cast("string")), 256)


def explode_units(parents: DataFrame, parent: str, labels: str, **optional: str) -> DataFrame:
    """One row per unit: (parent, position, label, unit id and what ``optional`` names, null where it is missing).

    Arrays may be null or shorter than the labels; the position counts from 0.
    """
    row = parents.select(F.col(parent).alias("parent"), F.posexplode(labels).alias("position", "label"), *(F.col(c).alias(f"_{n}") for n, c in optional.items()))
    at = F.col("position") + 1
    cols = [F.when(F.size(f"_{n}") >= at, F.get(f"_{n}", F.col("position"))).alias(n) for n in optional]
    return row.select("parent", "position", "label", unit_id(F.col("parent"), F.col("position")).alias("unit_key"), *cols)


def drop_special(units: DataFrame, leading: int, trailing: int) -> DataFrame:
    """Units at positions [leading, n - trailing) of their parent, positions counted anew."""
    n = F.count(F.lit(1)).over(W.partitionBy("parent"))
    return units.withColumn("_n", n).where((F.col("position") >= leading) & (F.col("position") < F.col("_n") - trailing)).withColumn("position", F.col("position") - leading).drop("_n")


def select_frames(units: DataFrame, every: int, start: int = 0) -> DataFrame:
    return units.where((F.col("position") >= start) & ((F.col("position") - start) % every == 0))


def keep_pairs(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """Alignment by explicit index pairs (embedding_index, annotation_index); each index once."""
    return units.join(pairs, units["position"] == pairs["annotation_index"]).drop("annotation_index")


def align(units: DataFrame, vectors: DataFrame) -> DataFrame:
    """Units with the vectors of the same parent and position."""
    return units.join(vectors, ["parent", "position"])


def alignment_report(units: DataFrame, vectors: DataFrame) -> DataFrame:
    """Parents whose number of vectors is not that of their units."""
    a = units.groupBy("parent").agg(F.count(F.lit(1)).alias("n_units"))
    b = vectors.groupBy("parent").agg(F.count(F.lit(1)).alias("n_vectors"))
    return a.join(b, "parent", "full").fillna(0, ["n_units", "n_vectors"]).where("n_units <> n_vectors")


def grid_tokens(pixels: DataFrame, height: int, width: int, grid_h: int, grid_w: int, coverage: float = 0.7, margin: float = 0.2, ignored: tuple[int, ...] = ()) -> DataFrame:
    """pixels(img, r, c, label) to one row per grid cell: the majority label, its share, the runner-up's, and why
    the cell is dropped (null: kept). Cell (i, j) covers rows floor(i H / h) to floor((i + 1) H / h), one at least;
    ties go to the lower label."""
    cells = pixels.withColumn("i", F.explode(F.filter(F.sequence(F.lit(0), F.lit(grid_h - 1)), lambda i: _inside(F.col("r"), i, height, grid_h))))
    cells = cells.withColumn("j", F.explode(F.filter(F.sequence(F.lit(0), F.lit(grid_w - 1)), lambda j: _inside(F.col("c"), j, width, grid_w))))
    n = cells.groupBy("img", "i", "j", "label").agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("img", "i", "j")
    n = n.withColumn("total", F.sum("n").over(by)).withColumn("place", F.row_number().over(by.orderBy(F.desc("n"), "label")))
    t = n.groupBy("img", "i", "j").agg(F.max(F.when(F.col("place") == 1, F.col("label"))).alias("label"), F.round(F.max(F.when(F.col("place") == 1, F.col("n") / F.col("total"))), 6).alias("share"), F.round(F.coalesce(F.max(F.when(F.col("place") == 2, F.col("n") / F.col("total"))), F.lit(0.0)), 6).alias("second"))
    why = F.when(F.col("label").isin(*ignored) if ignored else F.lit(False), "ignored").when(F.col("share") < coverage, "low_coverage").when(F.col("share") - F.col("second") < margin, "low_margin")
    return t.withColumn("dropped", why)


def _inside(x: Column, i: Column, size: int, n: int) -> Column:
    lo = F.floor(i * size / n)
    return (x >= lo) & (x < F.greatest(lo + 1, F.floor((i + 1) * size / n)))


def instances(pixels: DataFrame, tokens: DataFrame, height: int, width: int, grid_h: int, grid_w: int, ignored: tuple[int, ...] = (0,), things: tuple[int, ...] | None = None) -> DataFrame:
    """tokens with the majority instance among the pixels of their label, ignored instances aside (null: none). Only
    classes of ``things`` (all by default) have instances; the key of an instance includes its class."""
    if things is not None:
        pixels = pixels.where(F.col("label").isin(*things))
    cells = pixels.withColumn("i", F.explode(F.filter(F.sequence(F.lit(0), F.lit(grid_h - 1)), lambda i: _inside(F.col("r"), i, height, grid_h))))
    cells = cells.withColumn("j", F.explode(F.filter(F.sequence(F.lit(0), F.lit(grid_w - 1)), lambda j: _inside(F.col("c"), j, width, grid_w))))
    n = cells.where(~F.col("instance").isin(*ignored) if ignored else F.lit(True)).groupBy("img", "i", "j", "label", "instance").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("img", "i", "j", "label").agg(F.max_by("instance", F.struct("n", -F.col("instance"))).alias("instance"))
    return tokens.join(top, ["img", "i", "j", "label"], "left")


def capped(tokens: DataFrame, row_id: str, label: str, per_class: int, group: str | None = None, per_group: int | None = None, seed: int = 42, instance: str | None = None, per_instance: int | None = None, instances_per_class: int | None = None) -> DataFrame:
    """At most ``per_group`` tokens of a class and group, ``per_instance`` of a class, group and instance, of at most
    ``instances_per_class`` instances, and ``per_class`` of a class, in pseudo-random order.

    Caps are applied one after the other in this order; places are counted in hash buckets, so that no group or class is
    ordered in one task. Tokens without an instance are under no instance cap.
    """
    if group and per_group:
        tokens = hash_rank(tokens, [label, group], row_id, seed, "_r").where(F.col("_r") <= per_group).drop("_r")
    if instance and (per_instance or instances_per_class):
        keys = [label, *([group] if group else []), instance]
        own = tokens.where(F.col(instance).isNotNull())
        if instances_per_class:
            each = own.select(*keys).distinct().withColumn("_id", F.concat_ws("|", *(F.col(k).cast("string") for k in keys)))
            chosen = hash_rank(each, [label], "_id", seed, "_r").where(F.col("_r") <= instances_per_class).select(*keys)
            own = own.join(chosen, keys, "left_semi")
        if per_instance:
            own = hash_rank(own, keys, row_id, seed, "_r").where(F.col("_r") <= per_instance).drop("_r")
        tokens = own.unionByName(tokens.where(F.col(instance).isNull()))
    return hash_rank(tokens, [label], row_id, seed).where(F.col("_rank") <= per_class).drop("_rank")


def segment_tokens(pixels: DataFrame, features: DataFrame, height: int, width: int, grid_h: int, grid_w: int, coverage: float = 0.7, margin: float = 0.2, ignored: tuple[int, ...] = (), background: tuple[int, ...] = (), things: tuple[int, ...] | None = None, include_excluded: bool = True, **caps: int) -> DataFrame:
    """pixels(img, r, c, label, instance) and features(img, i, j, vec) to labelled tokens (row_id, img, i, j, label, instance,
    background, vec), grouped by image.

    Cells that are ignored, too mixed or too near a tie are left out. Background classes stay, marked, unless
    ``include_excluded`` is false. A cell without features is an error.
    """
    cells = grid_tokens(pixels, height, width, grid_h, grid_w, coverage, margin, ignored).where("dropped is null").select("img", "i", "j", "label")
    cells = instances(pixels, cells, height, width, grid_h, grid_w, things=things).withColumn("background", F.col("label").isin(*background) if background else F.lit(False))
    if not include_excluded:
        cells = cells.where(~F.col("background"))
    t = cells.join(features, ["img", "i", "j"], "left").withColumn("vec", F.when(F.col("vec").isNotNull(), F.col("vec")).otherwise(F.raise_error(F.lit("a cell has no features")).cast(dict(features.dtypes)["vec"])))
    t = t.withColumn("row_id", unit_id(F.col("img"), F.concat_ws("-", "i", "j")))
    return capped(t, "row_id", "label", group="img", instance="instance", **caps) if caps else t


# --- adapters: annotations of parents to unit structs ---

UNIT = "array<struct<unit_id:string,label:string,span:array<int>,position:int,coordinates:array<double>,target:double>>"


def _units(annotations: DataFrame, parent: str, column: str, fields: dict, keep=None) -> DataFrame:
    """(parent, units) from an array of structs, each entry mapped to a unit; nulls are left out."""
    held = F.filter(F.coalesce(F.col(column), F.array().cast(dict(annotations.dtypes)[column])), lambda x: x.isNotNull())
    held = F.filter(held, keep) if keep else held
    names = ("unit_id", "label", "span", "position", "coordinates", "target")
    unit = lambda x, i: F.struct(*(fields.get(n, lambda x, i: F.lit(None))(x, i).alias(n) for n in names))
    return annotations.select(F.col(parent).alias("parent"), F.transform(held, unit).cast(UNIT).alias("units"))


def detection_units(annotations: DataFrame, parent: str, boxes: str) -> DataFrame:
    """boxes: array of (label, box: four numbers x0, y0, x1, y1[, id]); a box that is empty or inverted is an error."""
    good = lambda b: (F.size(b) == 4) & (F.get(b, 0) < F.get(b, 2)) & (F.get(b, 1) < F.get(b, 3))
    box = lambda x, i: F.when(good(x["box"]), x["box"].cast("array<double>")).otherwise(F.raise_error(F.lit("a box is empty or inverted")).cast("array<double>"))
    return _units(annotations, parent, boxes, {"unit_id": lambda x, i: i.cast("string"), "label": lambda x, i: x["label"], "position": lambda x, i: i, "coordinates": box})


def sequence_units(annotations: DataFrame, parent: str, tokens: str) -> DataFrame:
    """tokens: array of (label, span: start and end); a span that ends before it starts is an error."""
    span = lambda x, i: F.when(F.get(x["span"], 0) <= F.get(x["span"], 1), x["span"]).otherwise(F.raise_error(F.lit("a span ends before it starts")).cast("array<int>"))
    return _units(annotations, parent, tokens, {"unit_id": lambda x, i: i.cast("string"), "label": lambda x, i: x["label"], "span": span, "position": lambda x, i: i})


def keypoint_units(annotations: DataFrame, parent: str, points: str, visible_only: bool = True) -> DataFrame:
    """points: array of (label, x, y, visible)."""
    fields = {"unit_id": lambda x, i: x["label"], "label": lambda x, i: x["label"], "position": lambda x, i: i, "coordinates": lambda x, i: F.array(x["x"].cast("double"), x["y"].cast("double"))}
    return _units(annotations, parent, points, fields, (lambda x: F.coalesce(x["visible"].cast("boolean"), F.lit(False))) if visible_only else None)


def depth_units(annotations: DataFrame, parent: str, values: str) -> DataFrame:
    """values: array of (depth, valid): regression units of the valid entries; a valid depth that is not finite is an error."""
    depth = lambda x, i: F.when(x["depth"].isNotNull() & ~F.isnan(x["depth"].cast("double")) & (F.abs(x["depth"].cast("double")) < float("inf")), x["depth"].cast("double")).otherwise(F.raise_error(F.lit("a depth is not finite")).cast("double"))
    numbered = annotations.withColumn(values, F.transform(values, lambda x, i: F.struct(x["depth"].alias("depth"), x["valid"].alias("valid"), i.alias("at"))))
    return _units(numbered, parent, values, {"unit_id": lambda x, i: x["at"].cast("string"), "position": lambda x, i: x["at"], "target": depth}, lambda x: F.coalesce(x["valid"].cast("boolean"), F.lit(False)))


def slot_units(annotations: DataFrame, parent: str, slots: str) -> DataFrame:
    """slots: array of labels, one per latent slot; null slots keep their place."""
    a = annotations.withColumn(slots, F.transform(slots, lambda x, i: F.struct(x.alias("label"), i.alias("at"))))
    return _units(a, parent, slots, {"unit_id": lambda x, i: F.concat(F.lit("slot-"), x["at"].cast("string")), "label": lambda x, i: x["label"], "position": lambda x, i: x["at"]})


def align_by(units: DataFrame, vectors: DataFrame, pairs: DataFrame | None = None, f=None) -> DataFrame:
    """(parent, position, vec, and the unit's columns): units(parent, position, ...) with vectors(parent, at, vec) of equal place, of
    explicit pairs(parent, unit_at, vector_at), or of those that ``f(units, vectors)``, pandas frames of one parent, gives as
    a list of (unit position, vector place). A pair of unknown places, or a place that stands twice, is an error."""
    if f is not None:
        import pandas as pd

        def run(key, u: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            got = list(f(u, v))
            return pd.DataFrame({"parent": [key[0]] * len(got), "unit_at": [a for a, _ in got], "vector_at": [b for _, b in got]})

        kind = dict(units.dtypes)["parent"]
        pairs = units.groupBy("parent").cogroup(vectors.groupBy("parent")).applyInPandas(run, f"parent {kind}, unit_at int, vector_at int")
    if pairs is None:
        lost = units.join(vectors.select("parent", F.col("at").alias("position")), ["parent", "position"], "left_anti").limit(1).count()
        if lost or units.count() != vectors.count():
            raise ValueError("units and vectors differ in number; see alignment_report")
        return units.join(vectors.withColumnRenamed("at", "position"), ["parent", "position"])
    for c in ("unit_at", "vector_at"):
        if pairs.groupBy("parent", c).count().where("count > 1").limit(1).count():
            raise ValueError(f"a {c} stands twice")
    j = pairs.join(units.withColumnRenamed("position", "unit_at"), ["parent", "unit_at"], "left").join(vectors.withColumnRenamed("at", "vector_at").withColumn("_held", F.lit(True)), ["parent", "vector_at"], "left")
    known = units.select("parent", F.col("position").alias("unit_at"), F.lit(True).alias("_unit"))
    if j.where("_held is null").limit(1).count() or pairs.join(known, ["parent", "unit_at"], "left_anti").limit(1).count():
        raise ValueError("a pair names an unknown place")
    return j.drop("_held", "vector_at").withColumnRenamed("unit_at", "position")


def materialize(annotations: DataFrame, outputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """annotations(parent, units) and, by output, vectors(parent, vecs: one a unit) to labelled unit rows (row_id, group, position,
    label, target, vec) of each output. A parent with more or fewer vectors than units is an error where it is read."""
    out = {}
    for name, v in outputs.items():
        j = annotations.join(v.select("parent", "vecs"), "parent", "left")
        same = F.when(F.size("units") == F.coalesce(F.size("vecs"), F.lit(0)), F.arrays_zip("units", "vecs")).otherwise(F.raise_error(F.lit(f"output {name}: units and vectors of a parent differ in number")).cast(j.select(F.arrays_zip("units", "vecs").alias("z")).schema["z"].dataType))
        rows = j.select("parent", F.posexplode(same).alias("position", "z"))
        out[name] = rows.select(unit_id(F.col("parent"), F.col("z.units.unit_id")).alias("row_id"), F.col("parent").alias("group"), "position", F.col("z.units.label").alias("label"), F.col("z.units.target").alias("target"), F.col("z.vecs").alias("vec"))
    return out
