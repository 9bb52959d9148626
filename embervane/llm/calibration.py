"""Samples whose category shares match given targets.

Category moments are aggregated in the cluster; on them, per draw, the dual of exponential tilting is solved by
Newton steps, floors and supplies being fixed where they bind. The resulting inclusion probabilities are
realised by the pivotal method: units duel in pairs, each duel settling one of them, so that the sample has
exactly the calibrated size. Units of one category in one block duel first, then what is left over of each block
and category, so that minimums hold in the sample and not only in its mean. What a plan could not reach and what a
sample lacks against its demand are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from embervane.session import Scratch, table

#: Units of a block in the mean, draws that meet a block in one row, and blocks whose open units duel in one task.
BLOCK_UNITS, RESULTS_PER_ROW, REST_BLOCKS = 20_000, 256, 1024


def category(label: Column) -> Column:
    """A label without regard to case and surrounding white space; null if blank."""
    c = F.lower(F.regexp_replace(label, r"^[\s\x{00a0}]+|[\s\x{00a0}]+$", ""))
    return F.when(c != "", c)


def units(annotations: DataFrame) -> DataFrame:
    """annotations(parent_id, dataset_key, labels), distinct, with ``cats``: the category of each entry (null: none)."""
    return annotations.select("parent_id", "dataset_key", "labels").distinct().where("dataset_key is not null").select("parent_id", "dataset_key", F.transform("labels", category).alias("cats"))


def supply(unit_rows: DataFrame) -> DataFrame:
    """(dataset_key, cat, n): the category moments; partial sums before the shuffle."""
    return unit_rows.select("dataset_key", F.explode("cats").alias("cat")).where("cat is not null").groupBy("dataset_key", "cat").agg(F.count(F.lit(1)).alias("n"))


def tilt(size: float, share: np.ndarray, floor: np.ndarray, stock: np.ndarray, demand: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected draws per category, the dual variables, and what is unreachable of each demand.

    Newton steps on the dual of exponential tilting for the total: the tilted draw of category c is
    share_c * exp(t), held at its floor below and its stock above, and t is such that the draws add up to
    ``size`` (to the sum of the floors or of the stock if size lies outside of them). The bracket of t is exact: a
    draw is at most floor + share * exp(t), which bounds t from below, and every draw is at its stock at the
    highest breakpoint. Steps that leave it are bisected, and a gap that stays open is an error. The dual of each
    category, log(draw / (base * stock)) with base = size / sum(stock), is what tilts its units' inclusion
    probability; where a demand lies beyond the stock the dual of its own constraint has no solution, the category
    is fixed at the stock and the rest of the demand is returned as unreachable.
    """
    share, stock = np.maximum(share, 0.0), np.maximum(stock, 0.0)
    unreachable = np.maximum((np.maximum(share, floor) if demand is None else demand) - stock, 0.0)
    floor = np.minimum(np.maximum(floor, 0.0), stock)
    live = share > 0
    top = np.where(live, stock, floor)
    least, most = floor.sum(), top.sum()
    if size <= least:
        d = floor.copy()
    elif size >= most:
        d = top.copy()
    else:
        full = top > floor
        hi = float(np.log(top[full] / share[full]).max())
        lo = min(float(np.log((size - least) / share.sum())), hi)
        t = float(np.clip(np.log(size / share.sum()), lo, hi))
        for _ in range(200):
            d = np.clip(share * np.exp(t), floor, top)
            gap = d.sum() - size
            if abs(gap) <= 1e-9 * max(1.0, size):
                break
            lo, hi = (lo, t) if gap > 0 else (t, hi)
            slope = d[live & (d > floor) & (d < top)].sum()
            step = t - gap / slope if slope > 0 else np.nan
            t = step if lo < step < hi else (lo + hi) / 2
        else:
            raise ArithmeticError(f"the tilting of a draw of {size} stayed open by {gap}")
    base = size / stock.sum() if stock.sum() > 0 and size > 0 else 1.0
    with np.errstate(divide="ignore"):
        dual = np.where((d > 0) & (stock > 0), np.log(np.maximum(d, 1e-300) / np.where(stock > 0, stock, 1) / base), -np.inf)
    return d, dual, unreachable


PLAN = "result_id bigint, dataset_key string, cat string, label string, draw_size bigint, target_percent double, min_samples bigint, demand bigint, supply bigint, expected double, dual double, unreachable double"


def _plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in PLAN.split(", ")]
    for batch in batches:
        out: list[tuple] = []
        for r in batch.itertuples(index=False):
            t = r.targets
            col = lambda c: np.array([x[c] for x in t], float)  # noqa: E731, B023
            d, dual, rest = tilt(r.draw_size, col("percent") / 100 * r.draw_size, col("floor"), col("supply"), col("demand"))
            out += [(r.result_id, r.dataset_key, x["cat"], x["label"], r.draw_size, x["percent"], x["floor"], x["demand"], x["supply"], e, u, v) for x, e, u, v in zip(t, d, dual, rest)]
        yield pd.DataFrame(out, columns=names)


def calibrate(draws: DataFrame, targets: DataFrame, stock: DataFrame) -> DataFrame:
    """The calibrated plan of every draw: one row per draw and target category.

    draws(result_id, dataset_key, draw_size), repeated rows count once, rows with a null count not;
    targets(dataset_key, label, target_percent, min_samples): spellings of one label are added up, null and
    negative percents and minimums are 0; stock(dataset_key, cat, n) as of ``supply``. ``demand`` is
    draw_size * percent / 100 rounded up, or the minimum if that is more; ``unreachable`` is the part of it that
    the solved plan had to give up at the stock. ``expected`` is what the sample will hold: minimums are kept
    first, categories that are used up pass their part on to the others in proportion, and categories without a
    target are not drawn. Draws of datasets without a target have no row.
    """
    t = targets.where("dataset_key is not null").distinct().withColumn("cat", category(F.col("label"))).where("cat is not null")
    t = t.groupBy("dataset_key", "cat").agg(F.min("label").alias("label"), F.sum(F.greatest(F.coalesce(F.col("target_percent"), F.lit(0)), F.lit(0))).cast("double").alias("percent"), F.max(F.greatest(F.coalesce(F.col("min_samples"), F.lit(0)), F.lit(0))).cast("bigint").alias("floor"))
    t = t.join(stock, ["dataset_key", "cat"], "left").select("dataset_key", F.struct("cat", "label", "percent", "floor", F.coalesce("n", F.lit(0)).alias("supply")).alias("x"))
    t = t.groupBy("dataset_key").agg(F.array_sort(F.collect_list("x")).alias("targets"))  # a dataset's categories
    d = draws.where("result_id is not null and dataset_key is not null and draw_size is not null and draw_size >= 0").select("result_id", "dataset_key", "draw_size").distinct()
    demand = lambda x: F.greatest(F.ceil(F.round(F.col("draw_size") * x["percent"] / 100, 9)).cast("bigint"), x["floor"])
    rows = d.join(t, "dataset_key").withColumn("targets", F.transform("targets", lambda x: x.withField("demand", demand(x))))
    return rows.mapInPandas(_plan, PLAN)


def shortfalls(plan: DataFrame) -> DataFrame:
    """(result_id, label) where the solved plan leaves a part of the demand unreachable."""
    return plan.where("unreachable > 0").select("result_id", "label")


def _duel(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Pivotal method: probabilities to 0 and 1 but for one unit at most; pairs duel in rounds."""
    p = np.where(p < 1e-9, 0.0, np.where(p > 1 - 1e-9, 1.0, p))
    open_ = rng.permutation(np.flatnonzero((p > 0) & (p < 1)))
    while len(open_) > 1:
        half = len(open_) // 2
        i, j = open_[:half], open_[half : 2 * half]
        a, b, u = p[i], p[j], rng.random(half)
        s = a + b
        small = s <= 1
        win = u * np.where(small, s, 2 - s) < np.where(small, a, 1 - b)  # i keeps the sum, or becomes 1
        p[i] = np.where(small, np.where(win, s, 0.0), np.where(win, 1.0, s - 1))
        p[j] = np.where(small, np.where(win, 0.0, s), np.where(win, s - 1, 1.0))
        p = np.where(p < 1e-9, 0.0, np.where(p > 1 - 1e-9, 1.0, p))
        open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
    return p


def _duel_within(p: np.ndarray, at: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Duels inside each category only: one open unit per category remains at most."""
    for c in np.unique(at):
        own = np.flatnonzero(at == c)
        p[own] = _duel(p[own], rng)
    return p


DRAWN = "result_id bigint, block bigint, parent_id string, unit_no int, cat string, p double"


def _draw_blocks(seed: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The duels inside each category of a block.

    All units of a category have one probability p, so their duels are exchangeable: n of them leave floor(n p) drawn
    units and one open unit with the rest as its probability, each set being equally likely. It is picked by a
    partial shuffle, at the cost of what is drawn and not of what lies in the block.
    """
    for batch in batches:
        for r in batch.itertuples(index=False):
            parents, nos, codes = np.asarray(r.parents, object), np.asarray(r.nos), np.asarray(r.cats, object)
            order = np.lexsort((nos, parents.astype(str), codes.astype(str)))
            parents, nos, codes = parents[order], nos[order], codes[order]
            names, first = np.unique(codes.astype(str), return_index=True)
            upto = np.append(first[1:], len(codes))
            place = {c: (a, b) for c, a, b in zip(names, first, upto)}
            for w in r.draws:
                rng = np.random.default_rng([seed, w["result_id"] & 0xFFFFFFFF, r.block])
                at, p = [], []
                for x in sorted(w["rates"], key=lambda x: x["cat"]):
                    a, b = place.get(x["cat"], (0, 0))
                    much = (b - a) * x["rate"]
                    whole = int(np.floor(much + 1e-9))
                    rest = max(0.0, much - whole)
                    n = min(b - a, whole + (rest > 1e-9))
                    if n:
                        at.append(a + rng.choice(b - a, n, replace=False, shuffle=True))
                        p.append(np.where(np.arange(n) < whole, 1.0, rest))
                if at:
                    i = np.concatenate(at)
                    yield pd.DataFrame({"result_id": w["result_id"], "block": r.block, "parent_id": parents[i], "unit_no": nos[i], "cat": codes[i], "p": np.concatenate(p)})


def _draw_rest(seed: int, level: int, last: bool):
    """Open units of some blocks duel inside their category and, on the last level, across categories."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["parent_id", "unit_no"])
        rng = np.random.default_rng([seed, int(key[0]) & 0xFFFFFFFF, int(key[1]), level])
        p = _duel_within(part["p"].to_numpy(copy=True), np.unique(part["cat"], return_inverse=True)[1], rng)
        if last:
            p = np.round(_duel(p, rng))
        return part.assign(p=p, block=part["block"] // REST_BLOCKS)[p > 0]

    return run


def draw(plan: DataFrame, unit_rows: DataFrame, seed: int = 42, block_units: int = BLOCK_UNITS) -> DataFrame:
    """The sample: (result_id, parent_id, unit_no, cat), unit_no being the position in the parent's labels.

    Every unit of a category has the inclusion probability expected / supply. A dataset's units lie in blocks of
    bounded size, chosen by hash, and meet the draws of their dataset ``RESULTS_PER_ROW`` at a time. One open unit
    a block and category is left, and these duel ``REST_BLOCKS`` blocks at a time, level by level, so that no draw,
    however large its dataset, is settled in one task. A draw holds as many units as its plan expects in total, and
    each category's number is its expected one rounded up or down. Equal seeds give equal samples. Null parents
    count as one parent without a name; null arrays and blank entries hold no unit.
    """
    flat = unit_rows.select("dataset_key", F.coalesce("parent_id", F.lit("")).alias("parent_id"), F.posexplode("cats").alias("unit_no", "cat")).where("cat is not null")
    size = F.sum(F.greatest(F.size("cats"), F.lit(0)))
    blocks = unit_rows.groupBy("dataset_key").agg(F.greatest(F.lit(1), F.ceil(size / block_units)).cast("bigint").alias("n_blocks"))
    flat = flat.join(blocks, "dataset_key").withColumn("block", F.pmod(F.xxhash64("parent_id", "unit_no"), F.col("n_blocks")))
    cells = flat.groupBy("dataset_key", "block").agg(F.collect_list(F.struct("parent_id", "unit_no", "cat")).alias("u"))  # block_units in the mean
    cells = cells.select("dataset_key", "block", F.col("u.parent_id").alias("parents"), F.col("u.unit_no").alias("nos"), F.col("u.cat").alias("cats"))
    rates = plan.where("expected > 0 and supply > 0").groupBy("dataset_key", "result_id").agg(F.collect_list(F.struct("cat", F.least(F.lit(1.0), F.col("expected") / F.col("supply")).alias("rate"))).alias("rates"))
    sizes = rates.groupBy("dataset_key").agg(F.ceil(F.count(F.lit(1)) / RESULTS_PER_ROW).cast("bigint").alias("chunks"))
    per = rates.join(sizes, "dataset_key").groupBy("dataset_key", F.pmod(F.xxhash64("result_id"), F.col("chunks")).alias("chunk")).agg(F.collect_list(F.struct("result_id", "rates")).alias("draws"))
    scratch = Scratch(plan.sparkSession)
    first = scratch.put(cells.join(per, "dataset_key").select("block", "parents", "nos", "cats", "draws").mapInPandas(lambda it: _draw_blocks(seed, it), DRAWN), "duels")
    most = first.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0] + 1  # one number
    rest, level = first.where("p < 1"), 0
    while True:
        group, last = F.floor(F.col("block") / REST_BLOCKS), most <= REST_BLOCKS
        rest = rest.groupBy("result_id", group.alias("g")).applyInPandas(_draw_rest(seed, level, last), DRAWN)
        if last:
            break
        most, level = -(-most // REST_BLOCKS), level + 1
    return first.where("p >= 1").unionByName(rest).drop("p", "block")


def report(plan: DataFrame, sample: DataFrame) -> DataFrame:
    """Per draw and category: what was wanted, held and drawn, the gap between demand and draw, and how much of it no
    sample could have met (the rest went to others' minimums or to rounding)."""
    n = sample.groupBy("result_id", "cat").agg(F.count(F.lit(1)).alias("drawn"))
    rows = plan.join(n, ["result_id", "cat"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    return rows.select("result_id", "dataset_key", "label", "draw_size", "target_percent", "min_samples", "demand", "supply", "expected", "drawn", F.greatest(F.lit(0), F.col("demand") - F.col("drawn")).alias("gap"), F.col("unreachable").cast("bigint").alias("unreachable"))


def totals(plan: DataFrame, sample: DataFrame) -> DataFrame:
    """Per draw: the units drawn, the units its plan expects, and whether each category holds its expected number rounded up or down."""
    rows = report(plan, sample).groupBy("result_id").agg(F.sum("drawn").alias("n_drawn"), F.round(F.sum("expected")).cast("bigint").alias("n_expected"), F.bool_and(F.abs(F.col("drawn") - F.col("expected")) < 1).alias("within_one"))
    return rows.select("result_id", "n_drawn", "n_expected", "within_one")


def probe_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The calibrated plan of every probe with a sample size, and the units it draws from."""
    u = units(table(spark, sf_dir, "unit_annotations"))
    draws = table(spark, sf_dir, "results").select("result_id", "dataset_key", F.col("probe_n_samples_used").alias("draw_size"))
    return calibrate(draws, table(spark, sf_dir, "sample_targets"), supply(u)), u
