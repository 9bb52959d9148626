"""Targets: classes, label sets, views, groups and deterministic subsamples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def order_key(*ids: Column, seed: int = 42) -> Column:
    """A pseudo-random order that every engine agrees on."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(i.cast("string") for i in ids)))


def hash_rank(df: DataFrame, keys: list[str], row_id: str, seed: int = 42, name: str = "_rank") -> DataFrame:
    """Adds the place of each row among those of equal keys in pseudo-random order, from 1.

    Places are counted in 256 hash buckets a key, whose sizes are summed up first, so that a key that holds
    most of the rows is not ordered in one task.
    """
    d = df.withColumn("_k", order_key(F.col(row_id), seed=seed)).withColumn("_b", F.substring("_k", 1, 2))
    n = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_from", F.sum("_n").over(W.partitionBy(*keys).orderBy("_b")) - F.col("_n")).drop("_n")
    n = n.select(*(F.col(k).alias(f"_r_{i}") for i, k in enumerate(keys)), F.col("_b").alias("_rb"), "_from")
    on = F.col("_b") == F.col("_rb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{i}"))
    place = F.row_number().over(W.partitionBy(*keys, "_b").orderBy("_k", row_id))
    return d.join(n, on).withColumn(name, F.col("_from") + place).drop("_k", "_b", "_rb", "_from", *(f"_r_{i}" for i in range(len(keys))))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def multilabel_counts(df: DataFrame, labels: str) -> DataFrame:
    """Rows that hold each label (a label repeated in a row counts once)."""
    return df.select(F.explode(F.array_distinct(labels)).alias("label")).where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def labelset_counts(df: DataFrame, labels: str) -> DataFrame:
    key = F.array_join(F.array_sort(F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))), "|")
    return df.where(F.col(labels).isNotNull()).groupBy(key.alias("labelset")).agg(F.count(F.lit(1)).alias("n"))


def indicator(labels: Column, names: list[str]) -> Column:
    return F.array(*(F.coalesce(F.array_contains(labels, n), F.lit(False)).cast("int") for n in names))


def target_summary(df: DataFrame, labels: str, n_classes: int) -> DataFrame:
    size = F.size(F.array_distinct(labels))
    return df.where(F.col(labels).isNotNull()).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(size), 6).alias("cardinality"), F.round(F.avg(size) / n_classes, 6).alias("density"))


def regression_summary(df: DataFrame, target: str) -> DataFrame:
    return df.agg(F.count(target).alias("n"), F.round(F.avg(target), 4).alias("mean"), F.round(F.stddev_pop(target), 4).alias("std"), F.min(target).alias("low"), F.max(target).alias("high"), (F.min(target) == F.max(target)).alias("constant"))


def validate(df: DataFrame, label: str, least_rows: int = 2) -> DataFrame:
    """One row: number of rows and classes, the smallest class, and whether a benchmark may run on it."""
    c = class_counts(df, label)
    return c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("smallest")).withColumn("valid", (F.col("n_classes") >= 2) & F.coalesce(F.col("smallest") >= least_rows, F.lit(False)))


def stratified_subsample(df: DataFrame, row_id: str, label: str, rate: float, least: int, seed: int = 42) -> DataFrame:
    """Per class floor(n * rate) rows, at least ``least`` (as far as there are so many), one at least."""
    n, take = F.col("_n"), F.floor(F.col("_n") * F.lit(rate))
    take = F.greatest(F.lit(1), F.least(n, F.when(n >= least, F.greatest(F.lit(least), take)).otherwise(take)))
    counts = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = hash_rank(df, [label], row_id, seed).join(counts, F.col(label).eqNullSafe(F.col("_label")))
    return ranked.where(F.col("_rank") <= take).drop("_n", "_label", "_rank")


def regression_subsample(df: DataFrame, row_id: str, target: str, n_take: int, seed: int = 42) -> DataFrame:
    """Two anchors of different target (the extremes, lowest id first) and a pseudo-random fill up to ``n_take`` rows."""
    low = df.orderBy(F.col(target).asc_nulls_last(), row_id).limit(1)
    high = df.orderBy(F.col(target).desc_nulls_last(), row_id).limit(1)
    anchors = low.unionByName(high).dropDuplicates([row_id])
    fill = df.join(anchors.select(row_id), row_id, "left_anti").orderBy(order_key(F.col(row_id), seed=seed), row_id).limit(max(0, n_take - 2))
    return anchors.unionByName(fill)


def label_view(path: Column, level: int | str, names: tuple[str, ...] = ()) -> Column:
    """Key of the path down to a level (a number, negative from the end, or one of ``names``); a path that is not so deep
    is an error."""
    if isinstance(level, str):
        if level not in names:
            raise ValueError(f"no level {level!r} among {names}")
        level = names.index(level)
    depth = F.size(path)
    at = F.lit(level) if level >= 0 else depth + level
    key = F.sha2(F.to_json(F.slice(path, F.lit(1), at + 1)), 256)
    return F.when((at >= 0) & (at < depth), key).otherwise(F.raise_error(F.lit("a label path lacks the level")).cast("string"))


def target_views(df: DataFrame, row_id: str, views: list[str]) -> DataFrame:
    """Wide target columns to (row_id, view, label)."""
    return df.unpivot([row_id], views, "view", "label").where("label is not null")


def exclude_classes(df: DataFrame, label: str, excluded: list[str]) -> DataFrame:
    return df.where(~F.col(label).isin(*excluded)) if excluded else df


def folds(df: DataFrame, row_id: str, label: str | None, k: int, group: str | None = None, seed: int = 42) -> DataFrame:
    """Adds ``fold``: rows of a class dealt out in pseudo-random order; whole groups, or rows without a class, by hash."""
    if group or not label:
        h = F.conv(F.substring(order_key(F.col(group or row_id), seed=seed), 1, 8), 16, 10).cast("bigint")
        return df.withColumn("fold", (h % k).cast("int"))
    return hash_rank(df, [label], row_id, seed).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def safe_folds(df: DataFrame, row_id: str, label: str, k: int, group: str | None = None, seed: int = 42) -> tuple[int, DataFrame]:
    """(number of folds, rows with ``fold``): as many folds as asked for, as the smallest class has rows (or groups) at
    most; fewer than two are an error, as is a training set that lacks a class.

    With groups, whole groups are dealt out by falling size of their rarest class and hash, group by group to the fold
    that has fewest rows so far; the table of groups and classes is dealt in one task, the rows join it.
    """
    unit = F.count_distinct(group) if group else F.count(F.lit(1))
    least = df.where(F.col(label).isNotNull()).groupBy(label).agg(unit.alias("n")).agg(F.min("n").alias("n")).first()["n"]
    k = min(k, least or 0)
    if k < 2:
        raise ValueError("the smallest class is too small for two folds")
    if not group:
        return k, folds(df, row_id, label, k, None, seed)
    import pandas as pd

    cells = df.groupBy(F.col(group).alias("g"), F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n"))

    def deal(batches):
        t = pd.concat(list(batches) or [pd.DataFrame({"g": [], "l": [], "n": []})])
        if not len(t):
            return
        wide = t.assign(l=t["l"].astype(str)).pivot_table(index="g", columns="l", values="n", aggfunc="sum", fill_value=0)
        share = wide / wide.sum()
        order = share.max(axis=1).rename("s").reset_index().assign(h=lambda o: o["g"].map(lambda g: _digest(g, seed))).sort_values(["s", "h"], ascending=[False, True])["g"]
        held = pd.DataFrame(0.0, index=range(k), columns=wide.columns)
        out = []
        for g in order:
            cost = ((held + share.loc[g]) ** 2).sum(axis=1) - (held**2).sum(axis=1) + held.sum(axis=1) * 1e-9
            f = int(cost.idxmin())
            held.loc[f] += share.loc[g]
            out.append((g, f))
        yield pd.DataFrame(out, columns=["g", "fold"])

    dealt = cells.coalesce(1).mapInPandas(deal, f"g {dict(df.dtypes)[group]}, fold int").withColumnRenamed("g", "_dealt")
    out = df.join(dealt, F.col(group).eqNullSafe(F.col("_dealt"))).drop("_dealt")
    lacking = out.groupBy(label).agg(F.count_distinct("fold").alias("n")).where(F.col(label).isNotNull() & (F.col("n") < 2)).limit(1).collect()
    if lacking:
        raise ValueError(f"class {lacking[0][label]!r} lies in one fold, so that a training set lacks it")
    return k, out


def _digest(value, seed: int) -> str:
    import hashlib

    return hashlib.md5(f"{seed}|{value}".encode()).hexdigest()


def multilabel_subsample(df: DataFrame, row_id: str, labels: str, rate: float, least: int, seed: int = 42) -> DataFrame:
    """Rows such that every label keeps floor(n * rate) rows, ``least`` at least, as far as there are so many: for each label
    the first rows in one pseudo-random order that all labels share, so that rows with several labels serve them all."""
    each = df.select(row_id, F.explode(F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))).alias("_each"))
    return df.join(stratified_subsample(each, row_id, "_each", rate, least, seed).select(row_id).distinct(), row_id, "left_semi")


def validated_rows(ids: DataFrame, row_id: str, rows: DataFrame) -> DataFrame:
    """ids checked against rows: a null, repeated or unknown id is an error."""
    n = ids.agg(F.count(F.lit(1)).alias("n"), F.count(row_id).alias("held"), F.count_distinct(row_id).alias("distinct")).first()
    if n["held"] < n["n"] or n["distinct"] < n["held"]:
        raise ValueError(f"{n['n'] - n['held']} ids are null and {n['held'] - n['distinct']} are repeated")
    unknown = ids.join(rows.select(row_id), row_id, "left_anti").limit(3).collect()
    if unknown:
        raise ValueError(f"unknown ids, such as {[r[row_id] for r in unknown]}")
    return ids
