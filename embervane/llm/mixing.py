"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer. The shares of a mix are tempered from the natural shares of its sources
towards the target weights, and each source follows as far as it can give: at most ``max_repeats`` times what it
has. The exponent at which a limit binds is found by bisection, and the tempered weights are the budgets. Each budget
is realised as passes over the source: whole passes, then a block permutation of which a last part is taken.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from embervane.session import Scratch, table

#: Documents of a hash block in the mean.
BLOCK_DOCS = 100_000


def tokenizer_file() -> str:
    """Path of the default vocabulary; EMBERVANE_TOKENIZERS names another folder."""
    return os.path.join(os.environ.get("EMBERVANE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_name(source: Column) -> Column:
    """A source without regard to case and outer white space, hyphens and blanks as underscores; null if blank."""
    s = F.regexp_replace(F.regexp_replace(F.lower(source), r"^[\s\x{00a0}]+|[\s\x{00a0}]+$", ""), r"[-\s\x{00a0}]", "_")
    return F.when(s != "", s)


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of every document that has a source; null texts have 0 tokens, repeats count once."""
    path = path or tokenizer_file()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]})

    docs = documents.where("doc_id is not null").select("doc_id", source_name(F.col("source")).alias("source"), "text").where("source is not null")
    return docs.mapInPandas(count, "doc_id bigint, source string, tokens bigint").dropDuplicates(["doc_id"])


def exponents(rows: list[tuple[float, float, float]], size: float) -> list[tuple[float, float]]:
    """(exponent, tempered weight) of each source of a mix.

    rows: (natural share, target weight, most tokens the source can give). The weights of a mix are tempered from
    the natural shares to the targets, w_i(a) = share_i ** (1 - a) * target_i ** a, normalised to the sum of the
    targets. A source follows this path as far as its limit allows: its exponent is, by bisection, the last at
    which it is within the limit, 1 where its target is, and there its weight stops. Where even the natural share is
    beyond the limit (or the source has no tokens) the exponent is 0 and the weight what the limit allows.
    """
    share, target, most = (np.array(c, float) for c in zip(*rows))
    whole = target.sum()
    live = (share > 0) & (target > 0)

    def at(a: float) -> np.ndarray:
        # a source without documents or without a target has a weight at the end of the path only
        w = np.where(live, np.exp((1 - a) * np.log(np.where(live, share, 1.0)) + a * np.log(np.where(live, target, 1.0))), 0.0)
        w = w / w.sum() * target[live].sum() if live.any() else w
        return np.where(live, w, target * (a == 1.0))

    out = []
    for i in range(len(rows)):
        within = lambda a: at(a)[i] * size <= most[i]  # noqa: E731, B023
        if target[i] * size <= most[i]:
            out.append((1.0, target[i]))
            continue
        lo, hi = 0.0, 1.0
        if live[i] and within(0.0):
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if within(mid) else (lo, mid)
        out.append((lo, min(float(at(lo)[i]) if lo > 0 else most[i] / size, most[i] / size)))
    return out if whole > 0 else [(1.0, 0.0)] * len(rows)


PLAN = "mix_id string, source string, target_weight double, mix_tokens double, source_tokens bigint, max_repeats bigint, wanted double, most double, exponent double, weight double, budget double"


def _temper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            tempered = exponents([(x["natural"], x["weight"], x["most"]) for x in r.parts], r.mix_tokens)
            for x, (a, w) in zip(r.parts, tempered):
                out.append((r.mix_id, x["source"], x["weight"], r.mix_tokens, x["tokens"], x["repeats"], x["weight"] * r.mix_tokens, x["most"], a, w, w * r.mix_tokens))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PLAN.split(", ")])


def mix_plan(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per mix and source: its exponent, its tempered weight, and the budget in tokens that this weight gives.

    The size of a mix is size_factor times the tokens of all documents with a source; a source without documents
    has 0 tokens. Null weights are 0, null or negative repeat limits are 0, several rows of a source in a mix add
    up their weights under the largest limit. ``exponents`` tempers the natural shares towards the targets: a
    source whose limit does not bind reaches its target, one whose limit binds stops there.
    """
    own = counts.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    t = targets.where("mix_id is not null").distinct().withColumn("source", source_name(F.col("source"))).where("source is not null")
    t = t.groupBy("mix_id", "source").agg(F.max("size_factor").alias("size_factor"), F.sum(F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.max(F.greatest(F.coalesce(F.col("max_repeats"), F.lit(0)), F.lit(0))).cast("bigint").alias("repeats"))
    whole = own.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]  # one number
    j = t.join(own, "source", "left").withColumn("all_tokens", F.lit(whole)).withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    here = F.sum("tokens").over(W.partitionBy("mix_id"))
    j = j.withColumn("natural", F.coalesce(F.col("tokens") / F.nullif(here, F.lit(0)), F.lit(0.0)))
    part = F.struct("source", "weight", "repeats", "tokens", "natural", (F.col("repeats") * F.col("tokens")).cast("double").alias("most"))
    rows = j.groupBy("mix_id").agg(F.coalesce(F.max("size_factor") * F.max("all_tokens"), F.lit(0)).cast("double").alias("mix_tokens"), F.array_sort(F.collect_list(part)).alias("parts"))  # a mix's sources
    return rows.mapInPandas(_temper, PLAN)


def short_sources(plan: DataFrame) -> DataFrame:
    """(mix_id, source) whose limit stops the tempering before the target."""
    return plan.where("exponent < 1").select("mix_id", "source")


def realise(counts: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: (mix_id, doc_id, source, tokens, copies).

    Documents of a source lie in a permutation by hash, block after block; a budget is met by whole passes and
    the first documents of one more, so copies of two documents of a source differ by one at most and none
    exceeds the limit. The last document is the one with which the budget is reached or passed, unless that
    would exceed the limit. Prefix sums run over hash blocks first, as many as the documents need, so that no source
    is ordered in one task.
    """
    n_blocks = max(256, counts.count() // BLOCK_DOCS)
    c = counts.where("tokens > 0").withColumn("h", F.xxhash64("doc_id", F.lit(7))).withColumn("block", F.pmod("h", F.lit(n_blocks)))
    blocks = c.groupBy("source", "block").agg(F.sum("tokens").alias("bt"))
    blocks = blocks.withColumn("start", F.sum("bt").over(W.partitionBy("source").orderBy("block")) - F.col("bt")).drop("bt")
    inner = F.sum("tokens").over(W.partitionBy("source", "block").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1))
    placed = c.withColumn("inner", F.coalesce(inner, F.lit(0))).join(blocks, ["source", "block"]).withColumn("before", F.col("start") + F.col("inner"))
    p = plan.where("budget > 0 and source_tokens > 0").select("mix_id", "source", "budget", "source_tokens", "max_repeats")
    whole = F.floor(F.col("budget") / F.col("source_tokens") + 1e-12)
    rest = F.col("budget") - whole * F.col("source_tokens")
    copies = F.least((whole + (F.col("before") < rest - 1e-6).cast("bigint")).cast("bigint"), F.col("max_repeats"))
    return placed.join(p, "source").select("mix_id", "doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")


def mix_report(plan: DataFrame, mix: DataFrame) -> DataFrame:
    """Per mix and source: the target, the tempered weight, and the share reached of the mix's intended size and of what
    the mix holds in the end (less where limits bind), and how often the source was repeated."""
    got = mix.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("given"), F.max("copies").alias("most_copies"), F.count(F.lit(1)).alias("n_docs"))
    j = plan.join(got, ["mix_id", "source"], "left").fillna(0, ["given", "most_copies", "n_docs"])
    j = j.withColumn("held", F.sum("given").over(W.partitionBy("mix_id")))
    share = lambda of: F.round(F.col("given") / F.nullif(F.col(of).cast("double"), F.lit(0.0)), 6)
    return j.select("mix_id", "source", "target_weight", F.round("mix_tokens", 3).alias("mix_tokens"), "source_tokens", "given", share("mix_tokens").alias("share_of_size"), share("held").alias("share_of_mix"), "most_copies", "n_docs", F.round("exponent", 6).alias("exponent"), F.round("weight", 6).alias("tempered_weight"))


def corpus_mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Token counts, written once to the shared scratch folder, and the plan of every mix."""
    counts = Scratch(spark).put(token_counts(table(spark, sf_dir, "documents")), "tokens")
    return counts, mix_plan(counts, table(spark, sf_dir, "mix_targets"))
