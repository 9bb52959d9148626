"""Splits that keep related records together.

Records that share an author, source or entity are connected, directly or through others. The connected sets
are found by breadth-first search from many seeds at once over hash-partitioned adjacency lists; where the
regions of two seeds touch, the pair of seed labels goes into a small graph, and merging that graph joins the
regions. Whole sets are then laid out in hash order and cut at the target shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from embervane.session import Scratch, empty, table

#: Values that stand for "not known" in a group key.
UNKNOWN = ("", "-", "--", "?", "n/a", "na", "none", "null", "nan", "nil", "unknown", "not known", "unspecified", "missing")
#: Links up to which the graph of colliding labels is merged in one task (two bigints a link).
SMALL_GRAPH = 1_000_000
MAX_SPLITS = 1000
#: Components that are ordered in one task in the mean.
BUCKET_COMPONENTS = 20_000


def group_key(entry: Column, unknown: tuple[str, ...] = UNKNOWN) -> Column:
    """``tag:value`` without regard to case and white space around either; null where it relates nothing: without a
    colon or a tag, or with a value in ``unknown`` (in lower case)."""
    blank = lambda c: F.lower(F.regexp_replace(c, r"^[\s\x{00a0}]+|[\s\x{00a0}]+$", ""))
    tag, value = blank(F.substring_index(entry, ":", 1)), blank(F.regexp_replace(entry, r"^[^:]*:", ""))
    return F.when(entry.contains(":") & (tag != "") & ~value.isin("", *unknown), F.concat(tag, F.lit(":"), value))


def memberships(samples: DataFrame, unknown: tuple[str, ...] = UNKNOWN) -> DataFrame:
    """samples(sample_id, dataset_key, groups) to distinct (sample_id, dataset_key, key)."""
    keys = F.array_distinct(F.filter(F.transform("groups", lambda g: group_key(g, unknown)), lambda k: k.isNotNull()))
    return samples.where("sample_id is not null").select("sample_id", "dataset_key", F.explode(keys).alias("key")).distinct()


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labels of one small graph: each node with the smallest node of its component."""
    parts = list(batches)
    if not parts:
        return
    e = pd.concat(parts)
    nodes, at = np.unique(e[["u", "v"]].to_numpy(np.int64), return_inverse=True)
    at = at.reshape(-1, 2)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[at[:, 0]], label[at[:, 1]])
        new = label.copy()
        np.minimum.at(new, label[at[:, 0]], low)
        np.minimum.at(new, label[at[:, 1]], low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new[label], label):
            break
        label = new[label]
    yield pd.DataFrame({"node": nodes, "label": nodes[label]})


def _regions(edges: DataFrame, scratch: Scratch, level: int, share: int, depth: int) -> DataFrame:
    """(node, label): regions grown from every ``share``-th node for ``depth`` hops; other nodes stand alone."""
    sym = scratch.put(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "adjacency")
    nodes = sym.select(F.col("u").alias("node")).distinct()
    parts = [scratch.put(nodes.where(F.pmod(F.xxhash64("node", F.lit(level)), F.lit(share)) == 0).withColumn("label", F.col("node")), "seeds")]
    for _ in range(depth):
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.unionByName(p)
        reached = parts[-1].join(sym, F.col("node") == F.col("u")).groupBy(F.col("v").alias("node")).agg(F.min("label").alias("label"))
        new = scratch.put(reached.join(seen.select("node"), "node", "left_anti"), "frontier")
        if empty(new):
            break
        parts.append(new)
    seen = parts[0]
    for p in parts[1:]:
        seen = seen.unionByName(p)
    out = scratch.put(nodes.join(seen, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "regions")
    for p in [sym, *parts]:
        scratch.drop(p)
    return out


def components(edges: DataFrame, scratch: Scratch, share: int = 8, depth: int = 3, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """Connected components of undirected links (u, v): one row (node, label) per node, label the smallest node.

    Links may repeat, point either way or be loops. Each level grows regions from seeds and keeps only the
    links between different regions, as links of their labels; once these are at most ``small_graph``, one task
    merges them. Nothing is sent to the driver but counts.
    """
    current = edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    current, maps, level = scratch.put(current, "links"), [], 0
    while True:
        regions = _regions(current, scratch, level, share if level < 3 else 2, depth)
        maps.append(regions)
        lu = regions.select(F.col("node").alias("u"), F.col("label").alias("lu"))
        lv = regions.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        touch = current.join(lu, "u").join(lv, "v").where("lu <> lv").select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct()
        after = scratch.put(touch, "collisions")
        scratch.drop(current)
        current, n, level = after, after.count(), level + 1
        if n <= small_graph:
            break
    top = scratch.put(current.coalesce(1).mapInPandas(_union_find, "node bigint, label bigint"), "merged")
    for regions in reversed(maps):
        up = top.select(F.col("node").alias("label"), F.col("label").alias("root"))
        top = scratch.put(regions.join(up, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
    low = top.groupBy("label").agg(F.min("node").alias("low"))
    return top.join(low, "label").select("node", F.col("low").alias("label"))


def links(held: DataFrame) -> DataFrame:
    """held(reps) to (u, v): the first representative of each list with every other."""
    return held.where("size(reps) > 1").select(F.element_at("reps", 1).alias("u"), F.explode(F.slice("reps", F.lit(2), F.size("reps"))).alias("v"))


def related_sets(samples: DataFrame, scratch: Scratch | None = None, unknown: tuple[str, ...] = UNKNOWN, **how: int) -> DataFrame:
    """(sample_id, dataset_key, component): the smallest sample_id related to each sample, itself if there is none.

    samples(sample_id, dataset_key, groups). Repeated deliveries count once; null arrays, null or empty
    entries and markers for "not known" relate nothing; equal keys of different datasets or tags are different.
    A key is stood for by its smallest sample, so links are as many as memberships, however large a group is.
    """
    scratch = scratch or Scratch(samples.sparkSession)
    m = memberships(samples, unknown)
    rep = m.groupBy("dataset_key", "key").agg(F.min("sample_id").alias("rep"))
    # a null dataset is a dataset of its own
    held = scratch.put(m.join(rep, m["dataset_key"].eqNullSafe(rep["dataset_key"]) & (m["key"] == rep["key"])).groupBy("sample_id").agg(F.array_sort(F.collect_set("rep")).alias("reps")), "held")
    labels = components(links(held), scratch, **how)
    anchor = held.select("sample_id", F.element_at("reps", 1).alias("anchor"))
    own = samples.where("sample_id is not null").select("sample_id", "dataset_key").distinct().join(anchor, "sample_id", "left")
    return own.join(labels, own["anchor"] == labels["node"], "left").select("sample_id", "dataset_key", F.coalesce("label", "anchor", "sample_id").alias("component"))


def assign_splits(related: DataFrame, targets: DataFrame) -> DataFrame:
    """related(sample_id, dataset_key, component) with a split_name for every sample.

    The components of a dataset lie end to end in the order of their hash; each goes to the split in which
    its middle falls, the targets (split_name, target_share; normalised to 1) being laid out in order of name.
    Prefix sums run over buckets of leading hash digits first, as many as the components need, so that no dataset
    is ordered in one task. Without a target of positive share, the split is null.
    """
    sizes = related.groupBy("dataset_key", "component").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.md5(F.col("component").cast("string")))
    sizes = Scratch(related.sparkSession).put(sizes, "components")
    digits, room = 1, sizes.count() / BUCKET_COMPONENTS
    while 16**digits < room:
        digits += 1
    sizes = sizes.withColumn("bucket", F.substring("h", 1, digits))
    bucket = sizes.groupBy("dataset_key", "bucket").agg(F.sum("n").alias("bn"))
    by = W.partitionBy("dataset_key")
    bucket = bucket.withColumn("start", F.sum("bn").over(by.orderBy("bucket")) - F.col("bn")).withColumn("total", F.sum("bn").over(by))
    inner = F.sum("n").over(W.partitionBy("dataset_key", "bucket").orderBy("h", "component"))
    placed = sizes.withColumn("cum", inner).alias("s").join(bucket.alias("b"), F.col("s.dataset_key").eqNullSafe(F.col("b.dataset_key")) & (F.col("s.bucket") == F.col("b.bucket")))
    placed = placed.select("s.dataset_key", "component", ((F.col("start") + F.col("cum") - F.col("n") / 2.0) / F.col("total")).alias("at"))
    cuts = sorted((r["split_name"], float(r["target_share"])) for r in targets.where("target_share > 0 and split_name is not null").distinct().limit(MAX_SPLITS + 1).collect())  # a list of splits, not data
    if len(cuts) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits")
    whole, upto, choice = sum(s for _, s in cuts), 0.0, None
    for name, share in cuts:
        upto += share / whole
        edge = F.col("at") <= (1.0 if name == cuts[-1][0] else upto)
        choice = F.when(edge, name) if choice is None else choice.when(edge, name)
    placed = placed.withColumn("split_name", choice if choice is not None else F.lit(None).cast("string"))
    return related.join(placed.drop("dataset_key", "at"), "component").select("sample_id", "dataset_key", "component", "split_name")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(dataset_key, split_name, n_samples, n_components, reached_share, target_share): whole components can keep a
    dataset from its targets; a split that got nothing has a row with 0."""
    t = targets.where("target_share > 0 and split_name is not null").select("split_name", "target_share").distinct()
    whole = t.agg(F.sum("target_share").alias("whole"))
    t = t.join(F.broadcast(whole)).select("split_name", (F.col("target_share") / F.col("whole")).alias("target_share"))  # one row
    n = assigned.groupBy("dataset_key", "split_name").agg(F.count(F.lit(1)).alias("n_samples"), F.count_distinct("component").alias("n_components"))
    size = n.groupBy("dataset_key").agg(F.sum("n_samples").alias("total"))
    rows = size.withColumn("t", F.lit(1)).join(F.broadcast(t.withColumn("t", F.lit(1))), "t").alias("w")  # datasets by splits
    on = F.col("w.dataset_key").eqNullSafe(F.col("n.dataset_key")) & (F.col("w.split_name") == F.col("n.split_name"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(n.alias("n"), on, "left").select("w.dataset_key", "w.split_name", zero("n_samples"), zero("n_components"), F.round(F.coalesce("n_samples", F.lit(0)) / F.col("total"), 6).alias("reached_share"), F.round("target_share", 6).alias("target_share"))


def grouped_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the datasets that at least one result marks as grouped."""
    marked = table(spark, sf_dir, "results").where("probe_grouped").select("dataset_key").distinct()
    return table(spark, sf_dir, "sample_groups").select("sample_id", "dataset_key", "groups").join(marked, "dataset_key", "left_semi")
