"""Texts cut off by field limits or in transfer.

Two kinds of evidence are combined as log odds. Per source, a log-normal length distribution is fitted by maximum
likelihood with the lengths at candidate limits taken as right-censored; what a limit holds beyond the fitted density
gives the posterior that a text of that length was censored there. The ending of each text falls into one of a few
kinds, by its shape and by where words stand in the whole lines of the corpus. How often a cut leaves each kind is
known from texts that are cut here at random places, and which kinds whole writing hardly has from the ends of lines
before the last; how whole texts end otherwise, and how many are cut at each limit and elsewhere, is fitted by
expectation maximisation, which starts from the censoring posteriors. No weight is set by hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from embervane.llm.mixing import source_name
from embervane.session import Scratch, table

#: A length is a candidate limit where it holds this many times what the fitted density expects and what the lengths
#: within 5 % hold in the mean, and at least so many texts.
LIMIT_EXCESS, LIMIT_TEXTS = 6.0, 5
#: Texts, in the mean, that are cut at random places to learn the endings of cuts (all of them in a smaller corpus).
SAMPLE_CUTS = 20_000
#: A corpus of fewer texts than these cuts has each cut several times, at most so many.
FEWEST_CUTS, MOST_TURNS = 5_000, 20
#: Rates at which a word ends its line that tell kinds of endings apart.
END_RATES = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3)

#: A kind of ending is none of whole texts where line ends have it this much less often than cuts.
RARE = 0.05
REMARKS = ("remark", "short_remark", "remark_begun", "remark_again")

SPACE = " \t\n\r\f\v\u00a0"

# --- lengths ---

LIMITS = "source string, length int, n bigint, expected double, posterior double"


def _upper_tail(a: np.ndarray) -> np.ndarray:
    """Upper tail of the normal distribution (the usual rational approximation of the error function)."""
    t = 1 / (1 + 0.2316419 * np.abs(a))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    near = np.exp(-a * a / 2) / np.sqrt(2 * np.pi) * poly
    return np.where(a >= 0, near, 1 - near)


def censored_fit(length: np.ndarray, n: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(mu, sigma, posterior of each length) of a log-normal histogram right-censored at its own limits.

    For given limits, expectation maximisation: the logarithm of a censored length is replaced by its mean above the
    limit. The limits are those lengths that hold far more than the density and their surroundings, and are found again
    until they stay.
    """
    x, total = np.log(length), n.sum()
    upto = np.concatenate([[0.0], np.cumsum(n)])
    near = np.searchsorted(length, 0.95 * length, "left"), np.searchsorted(length, 1.05 * length, "right")
    around = (upto[near[1]] - upto[near[0]] - n) / np.maximum(1.0, np.floor(1.05 * length) - np.ceil(0.95 * length))
    post = np.zeros(len(x))
    mu = (n * x).sum() / total
    sigma = np.sqrt(max((n * (x - mu) ** 2).sum() / total, 1e-4))
    for _ in range(50):
        for _ in range(500):
            a = (x - mu) / sigma
            ratio = np.exp(-np.minimum(a * a, 1400) / 2) / np.sqrt(2 * np.pi) / np.maximum(_upper_tail(a), 1e-300)
            ratio = np.where(a > 8, a + 1 / np.maximum(a, 1), ratio)  # its expansion far above the mean
            m = x * (1 - post) + post * (mu + sigma * ratio)
            spread = post * sigma**2 * np.maximum(0.0, 1 + a * ratio - ratio**2)
            new_mu = (n * m).sum() / total
            new_sigma = np.sqrt(max((n * ((m - new_mu) ** 2 + spread)).sum() / total, 1e-4))
            moved = abs(new_mu - mu) + abs(new_sigma - sigma)
            mu, sigma = new_mu, new_sigma
            if moved < 1e-9:
                break
        z = (x - mu) / sigma
        expected = total * np.exp(-z * z / 2) / (length * sigma * np.sqrt(2 * np.pi))
        limit = (n >= LIMIT_TEXTS) & (n >= LIMIT_EXCESS * np.maximum(np.maximum(expected, around), 0.2))
        new = np.where(limit, 1 - np.minimum(1.0, expected / n), 0.0)
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return mu, sigma, post


def length_limits(documents: DataFrame) -> DataFrame:
    """(source, length, n, expected, posterior): the candidate limits of each source.

    documents(source, length) with the source normalised (null is a source of its own, named ''). A source's histogram
    of lengths, not its texts, is fitted in one task. ``posterior`` is the share of the texts of that length that the
    density does not explain.
    """
    hist = documents.where("length > 0").groupBy(F.coalesce("source", F.lit("")).alias("source"), "length").agg(F.count(F.lit(1)).alias("n"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("length")
        length, n = part["length"].to_numpy(np.float64), part["n"].to_numpy(np.float64)
        _, _, post = censored_fit(length, n)
        return part.assign(expected=n * (1 - post), posterior=post)[post > 0]

    return hist.groupBy("source").applyInPandas(fit, LIMITS)


# --- words of whole lines ---


def _form(line: Column) -> Column:
    """Coarse form of a line."""
    return F.when(line.rlike(r"^\s*\|"), "table").when(line.rlike(r"^\s*([-*+•]|\d{1,3}[.)])\s"), "list").when(line.rlike(r"^\s*(#{1,6}\s|[^\p{L}]*\p{Lu})"), "prose").when(line.rlike(r"^\s*\P{L}*\p{Ll}"), "casual").otherwise("prose")


def _tokens(line: Column) -> Column:
    """Words of a line in lower case, numbers alike."""
    return F.filter(F.split(F.regexp_replace(F.lower(line), r"\d+", "0"), r"\s+"), lambda w: w != "")


def _whole_lines(text: Column) -> Column:
    """The lines before the last, outside code."""
    parts = F.split(F.regexp_replace(text, r"(?s)```.*?(```|$)", ""), "\n")
    return F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: F.trim(s) != "")


def line_counts(documents: DataFrame) -> DataFrame:
    """documents(body) to (form, pair, n_end, n_all) over whole list and casual lines: how often two consecutive
    words (and, under ``pair`` with one word, a single one) occur, and how often they end their line."""
    lines = documents.select(F.explode(_whole_lines(F.col("body"))).alias("line")).select(_form(F.col("line")).alias("form"), _tokens(F.regexp_replace("line", r"[.!?]+\s*$", "")).alias("w")).where("form in ('list', 'casual') and size(w) > 0")
    pairs = F.transform("w", lambda x, i: F.struct(F.concat_ws(" ", F.when(i > 0, F.element_at("w", F.greatest(i, F.lit(1)))), x).alias("pair"), (i == F.size("w") - 1).cast("int").alias("last")))
    ones = F.transform("w", lambda x, i: F.struct(F.concat(F.lit("\u0001"), x).alias("pair"), (i == F.size("w") - 1).cast("int").alias("last")))
    return lines.select("form", F.inline(F.concat(pairs, ones))).groupBy("form", "pair").agg(F.sum("last").alias("n_end"), F.count(F.lit(1)).alias("n_all"))


def openings(documents: DataFrame) -> DataFrame:
    """documents(body) to (said, n_long): how many sentences of more than five words begin with these two."""
    sentences = documents.select(F.explode(F.split("body", r"(?<=[.!?])\s+|\n+")).alias("s")).where(F.col("s").rlike(r"^\p{Lu}\S*\s+\S+\s+\S+\s+\S+\s+\S+\s+\S"))
    said = F.regexp_replace(F.lower(F.regexp_extract("s", r"^(\S+\s+\S+)", 1)), r"\d+", "0")
    return sentences.groupBy(said.alias("said")).agg(F.count(F.lit(1)).alias("n_long"))


def beginnings(vocabulary: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(form, last) that are the beginning of a longer word of vocabulary(form, word).

    In the order of words, the next word after a beginning begins with it. Words meet by their first two letters.
    """
    both = vocabulary.select("form", "word", F.lit(1).alias("held")).unionByName(asked.select("form", F.col("last").alias("word"), F.lit(0).alias("held")))
    after = W.partitionBy("form", F.substring("word", 1, 2)).orderBy(F.desc("word"), "held").rowsBetween(W.unboundedPreceding, -1)
    both = both.withColumn("next", F.last(F.when(F.col("held") == 1, F.col("word")), ignorenulls=True).over(after))
    return both.where((F.col("held") == 0) & F.col("next").startswith(F.col("word")) & (F.col("next") != F.col("word"))).select("form", F.col("word").alias("last")).distinct()


# --- endings ---

_MARK = {"dots": r"\.{3}|\x{2026}", "tag": r"\[(?:\.{3}|\x{2026}|cut|truncated)\]|\((?:cut|truncated)\)", "broken": r"\x{fffd}+|&[a-zA-Z]{0,7}|&#[xX]?[0-9a-fA-F]{0,6}|<[/!]?\w{0,30}"}


def endings(documents: DataFrame) -> DataFrame:
    """documents(*, text) with the signs of their endings, the text left out: (length, mark, form, kind, w, said).

    ``mark``: none, or what stands at the very end: dots, a tag that says so, or a broken character or entity.
    ``kind`` is the kind of ending by its shape (null where words must decide).
    """
    keep = [c for c in documents.columns if c != "text"]
    d = documents.select(*keep, F.length("text").alias("length"), F.rtrim("text", F.lit(SPACE)).alias("body")).where("body <> ''")
    # what tells a mark is shorter than the tail
    tail = F.substring("body", -100, 100)
    found = {m: F.regexp_extract(tail, f"({p})$", 1) for m, p in _MARK.items()}
    mark = F.when(found["broken"] != "", "broken").when(found["tag"] != "", "tag").when(found["dots"] != "", "dots").otherwise("none")
    cut_by = F.when(F.col("mark") == "broken", F.length(found["broken"])).when(F.col("mark") == "tag", F.length(found["tag"])).when(F.col("mark") == "dots", F.length(found["dots"])).otherwise(0)
    d = d.withColumn("mark", mark)
    d = d.withColumn("bare", F.rtrim(F.substring("body", F.lit(1), F.length("body") - cut_by), F.lit(SPACE)))
    d = d.withColumn("line", F.substring_index("bare", "\n", -1)).withColumn("open_code", (F.length("body") - F.length(F.replace("body", F.lit("```"), F.lit("")))) % 6 == 3)
    d = d.withColumn("form", F.when(F.col("open_code") | F.col("line").rlike(r"^\s*```"), "code").otherwise(_form(F.col("line"))))
    last = F.when(F.col("form").isin("list", "casual"), F.col("line")).when((F.col("form") == "prose") & (F.col("mark") == "dots"), F.element_at(F.split("line", r"(?<=[.!?])\s+"), -1)).otherwise("")
    d = d.withColumn("last", last).withColumn("w", _tokens(F.col("last")))
    rows = F.filter(F.split("body", "\n"), lambda s: s.rlike(r"^\s*\|"))
    cells = lambda s: F.size(F.split(s, r"\|"))
    whole_row = F.col("line").rlike(r"\|\s*$") & (cells(F.col("line")) >= cells(F.element_at(F.concat(rows, F.array(F.col("line"))), 1)))
    n_items = lambda p: F.regexp_count("body", F.lit(p))
    points, items = n_items(r"(?m)^\s*([-*+]|\d{1,3}[.)])\s.*[.]\s*$"), n_items(r"(?m)^\s*([-*+]|\d{1,3}[.)])\s")
    c, marked = F.col("line"), F.col("mark") != "none"
    alone, bare = r"(?:^|\n\s*\n)\s*", F.col("bare")
    signed = (c.rlike(r"^\s*\p{Ll}[\p{Ll}\d._-]{2,}$") & bare.rlike(alone + r"\p{Ll}[\p{Ll}\d._-]{2,}$")) | (c.rlike(r"^\s*\S+$") & bare.rlike(alone + r"\p{Lu}\p{Ll}+,?\s*\n\s*\S+$"))
    remark = (F.col("mark") == "dots") & (F.col("form") == "prose") & F.size("w").between(1, 5) & F.col("last").rlike(r"^\p{Lu}") & ~F.col("last").rlike(r"[,;:]$|,[^.!?]*$")
    kind = (
        F.when(F.col("form") == "code", F.when(F.col("open_code"), "inside").otherwise("fence"))
        .when(F.col("form") == "table", F.when(whole_row, "row").otherwise("cut_row"))
        .when(c.rlike(r"</\w+>$"), "closing_tag")
        .when(c.rlike(r"(^|[\s(])\d+\.$") & (F.col("form") != "list"), "number_point")
        .when(remark, F.lit(None).cast("string"))
        .when(c.rlike(r"https?://\S+$"), "link")
        .when(c.rlike(r"^\s*(/|--\s|—\s?)\S+$"), "signature")
        .when(c.rlike(r"\([^()]*$"), "open_bracket")
        .when(c.rlike(r"[.!?\x{2026}:][\"'\x{00bb}\x{201d})\]]*$"), F.when(marked, "point_and_mark").otherwise("point"))
        .when(c.rlike(r"[)\]}]$"), "bracket")
        .when(signed, "signed")
        .when((F.col("form") == "list") & (points > 0) & (points == items - 1), "lacks_point")
        .when(c.rlike(r"^\s*#{1,6}\s"), "heading")
        .when((F.col("form") == "prose") & (F.size(F.split(F.trim("line"), r"\s+")) <= 3), F.when(c.rlike(r"^\D*,$"), "salutation").otherwise("few_words"))
        .when(c.rlike(r"[,;(\[{/&+=-]$"), "joint")
        .when(F.col("form") == "prose", "open")
    )
    said = F.when(remark & (F.size("w") >= 2), F.concat_ws(" ", F.slice("w", 1, 2)))
    return d.select(*keep, "length", "mark", "form", kind.alias("kind"), remark.alias("remark"), F.col("w"), said.alias("said"), F.regexp_extract("bare", r"(\S+)$", 1).alias("word"))


def worded(ends: DataFrame, counts: DataFrame, said: DataFrame) -> DataFrame:
    """Endings whose kind the words must tell, with that kind.

    A list entry or casual line: how often, in whole lines, its last words end a line (in steps of ``END_RATES``), or, for
    a word of no whole line, whether it is a number, a name, the beginning of a word or none of these. A short remark
    before dots: whether longer sentences begin like it, else whether other texts end with it. A signature: whether other texts end with it, or with a
    longer one.
    """
    sure = ends.where("kind is not null and kind <> 'signed'").select(*(c for c in ends.columns if c not in ("w", "said", "remark", "word")))
    keep = sure.columns
    lines = ends.where("kind is null and not remark").withColumn("last", F.element_at("w", -1)).withColumn("pair", F.concat_ws(" ", F.when(F.size("w") > 1, F.element_at("w", -2)), F.col("last")))
    two = counts.select("form", "pair", F.col("n_end").alias("e2"), F.col("n_all").alias("a2"))
    one = counts.where(F.col("pair").startswith("\u0001")).select("form", F.expr("substring(pair, 2)").alias("last"), F.col("n_end").alias("e1"), F.col("n_all").alias("a1"))
    lines = lines.join(two, ["form", "pair"], "left").join(one, ["form", "last"], "left").fillna(0, ["e2", "a2", "e1", "a1"])
    starts = beginnings(one.select("form", F.col("last").alias("word")), lines.where("a1 = 0").select("form", "last").distinct()).withColumn("begins", F.lit(True))
    lines = lines.join(starts, ["form", "last"], "left")
    p1 = (F.col("e1") + 0.01) / (F.col("a1") + 0.5)
    rate = (F.col("e2") + p1) / (F.col("a2") + 1)  # the pair's rate of ending a line, backed off to the word's
    step = F.lit(0)
    for r in END_RATES:
        step = step + (rate >= r).cast("int")
    words = F.when(F.col("a1") > 0, F.concat(F.lit("ends_"), step.cast("string"))).when(F.col("last").rlike(r"^[0.,:%/-]+$"), "number").when(F.coalesce("begins", F.lit(False)), "begins_word").otherwise(F.when(F.col("word").rlike(r"^\p{Lu}"), "name").otherwise("new_word"))
    remarks = ends.where("kind is null and remark").withColumn("whole", F.concat_ws(" ", "w"))
    again = remarks.where("role = 'text'").groupBy("whole").agg(F.count(F.lit(1)).alias("n_same"))
    remarks = remarks.join(again, "whole", "left").join(said, "said", "left")
    told = F.when(F.col("n_long") > 0, "remark_begun").when(F.col("n_same") > (F.col("role") == "text").cast("int"), "remark_again").when(F.size("w") >= 3, "remark").otherwise("short_remark")
    signed = ends.where("kind = 'signed'").withColumn("last", F.lower("word"))
    seen = signed.where("role = 'text'").groupBy("form", "last").agg(F.count(F.lit(1)).alias("n_same"))
    longer = beginnings(seen.select("form", F.col("last").alias("word")), signed.select("form", "last").distinct()).withColumn("begins", F.lit(True))
    signed = signed.join(seen, ["form", "last"], "left").join(longer, ["form", "last"], "left")
    own = F.when(F.col("n_same") > (F.col("role") == "text").cast("int"), "signed_again").when(F.coalesce("begins", F.lit(False)), "signed_begun").otherwise("signed_once")
    out = sure.unionByName(lines.withColumn("kind", words).select(*keep)).unionByName(remarks.withColumn("kind", told).select(*keep))
    return out.unionByName(signed.withColumn("kind", own).select(*keep))


# --- both together ---

CELLS = "source string, at int, mark string, form string, kind string, evidence double, prior double, log_odds double"


def combine(cells: pd.DataFrame, cuts: pd.DataFrame, stops: pd.DataFrame) -> pd.DataFrame:
    """The log odds of a cut of every cell.

    cells(source, at, posterior, mark, form, kind, n): texts counted by source, candidate limit (0: at none) with its
    censoring posterior, and ending; cuts and stops(form, kind, n): the endings of texts that end here at a random
    place and at the end of a random line before the last. In expectation maximisation the share of cuts in each group
    (source and limit; its prior counts like two texts of the censoring posterior, or of the common rate at no limit),
    the endings of whole texts and the marks of both are fitted; the endings of cuts are given, and kinds that cuts
    leave and lines do not (``RARE``) are taken for none of whole texts (half a text), which is what tells the two apart.
    Ends when no log odds move any more.
    """
    n, post = cells["n"].to_numpy(float), cells["posterior"].to_numpy(float)
    group, groups = pd.factorize(cells["source"] + "\u0001" + cells["at"].astype(str))
    name = lambda t: t["form"] + " " + t["kind"]
    kinds = sorted({*name(cells), *name(cuts), *name(stops)})
    at = {k: i for i, k in enumerate(kinds)}
    kind = name(cells).map(at).to_numpy(int)
    # a remark is one because of its dots, which then tell nothing more
    mark, marks = pd.factorize(cells["mark"].where(~cells["kind"].isin(REMARKS), "none"))
    one = lambda v: v / v.sum()
    counted = lambda t: np.bincount(name(t).map(at).to_numpy(int), t["n"].to_numpy(float), len(kinds))
    cut, line = one(counted(cuts) + 0.5), one(counted(stops) + 0.5)
    free = post == 0
    share = one(np.bincount(kind, n * free, len(kinds)) + 1e-9)
    # not what is too frequent to be all cuts, nor remarks, as lines have no dots
    anchor = (counted(cuts) >= 5) & (line <= RARE * cut) & (share <= cut / 2) & ~np.array([k.endswith(REMARKS) for k in kinds])

    def endings_of(counts: np.ndarray) -> np.ndarray:
        return one(np.where(anchor, 0.5 / n.sum(), counts + 0.1 / len(kinds) / n.sum()))

    whole = endings_of(np.maximum(share - 0.05 * cut, 0.0))
    p_group = np.bincount(group, post * n) / np.bincount(group, n)
    limit = p_group > 0
    pi = np.where(limit, np.clip(p_group, 0.05, 0.95), 0.05)
    of_cut, of_whole = np.where(marks == "none", 0.6, 0.2), np.where(marks == "none", 0.97, 0.01)
    old = None
    for _ in range(5000):
        evidence = np.log(cut / whole)[kind] + np.log(of_cut / of_whole)[mark]
        prior = np.log(pi / (1 - pi))[group]
        odds = evidence + prior
        if old is not None and np.abs(odds - old).max() < 1e-6:
            break
        old, r = odds, 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        rate = float((n * r * free).sum() / max((n * free).sum(), 1.0))
        pi = (np.bincount(group, n * r) + 2 * np.where(limit, p_group, rate)) / (np.bincount(group, n) + 2)
        pi = np.clip(pi, 1e-6, 1 - 1e-6)
        whole = endings_of(np.bincount(kind, n * (1 - r), len(kinds)) / n.sum())
        of_cut = (np.bincount(mark, n * r, len(marks)) + 0.5) / (n @ r + 0.5 * len(marks))
        of_whole = (np.bincount(mark, n * (1 - r), len(marks)) + 0.5) / (n @ (1 - r) + 0.5 * len(marks))
    return cells.assign(evidence=evidence, prior=prior, log_odds=odds)


def _fit_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(batches)
    t = pd.concat(parts) if parts else None
    if t is None or not (t["role"] == "text").any():
        return
    of = lambda role: t[t["role"] == role].groupby(["form", "kind"], as_index=False)["n"].sum()
    real = t[t["role"] == "text"].rename(columns={"key": "source"}).sort_values(["source", "at", "mark", "form", "kind"]).reset_index(drop=True)
    yield combine(real, of("cut"), of("stop"))[[c.split()[0] for c in CELLS.split(", ")]]


def tries(documents: DataFrame, rate: float, times: int = 1) -> DataFrame:
    """(doc_id, source, turn, text, role) of a share of documents(doc_id, source, text), by hash, so many times each: ended at
    a random place, every other one with dots (role cut), and at the end of a random line before the last and outside code, which in prose must
    be the last of its paragraph (role stop)."""
    some = documents.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1).where("length(text) > 1")
    some = some.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(times))))
    place = (1 + F.pmod(F.xxhash64("doc_id", "turn", F.lit(12)), F.greatest(F.lit(1), F.length("text") - 1))).cast("int")
    dots = F.when(F.pmod(F.xxhash64("doc_id", "turn", F.lit(13)), F.lit(2)) == 0, "...").otherwise("")
    cut = some.select("doc_id", "source", "turn", F.concat(F.rtrim(F.substring("text", F.lit(1), place), F.lit(SPACE)), dots).alias("text"), F.lit("cut").alias("role"))
    lines = some.withColumn("lines", F.split(F.rtrim("text", F.lit(SPACE)), "\n")).where("size(lines) > 1")
    upto = (1 + F.pmod(F.xxhash64("doc_id", "turn", F.lit(14)), F.greatest(F.lit(1), F.size("lines") - 1))).cast("int")
    lines = lines.withColumn("upto", upto).where((F.trim(F.element_at("lines", F.col("upto") + 1)) == "") | (_form(F.element_at("lines", F.col("upto"))) != "prose"))
    stop = lines.select("doc_id", "source", "turn", F.array_join(F.slice("lines", F.lit(1), F.col("upto")), "\n").alias("text"), F.lit("stop").alias("role"))
    return cut.unionByName(stop.where(F.size(F.split("text", "```")) % 2 == 1))


def scores(documents: DataFrame, sample_cuts: int = SAMPLE_CUTS) -> DataFrame:
    """(doc_id, source, length, form, kind, mark, posterior, evidence, prior, log_odds) for every document with text.

    documents(doc_id, text, source); repeated deliveries count once. ``log_odds`` above 0 is a cut: ``evidence`` of the
    ending plus the ``prior`` of its source and limit, which starts from the censoring ``posterior`` of its length. Null
    and blank texts have no row. Whole texts are read where they lie; what is shuffled are endings and counts.
    """
    scratch = Scratch(documents.sparkSession)
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", source_name(F.col("source")).alias("source"), "text")
    ends = scratch.put(endings(docs.withColumn("role", F.lit("text"))).dropDuplicates(["doc_id"]), "endings")
    n = max(1, ends.count())
    rate, times = min(1.0, sample_cuts / n), min(MOST_TURNS, -(-FEWEST_CUTS // n))
    tried = scratch.put(endings(tries(docs, rate, times)).dropDuplicates(["doc_id", "role", "turn"]).drop("turn"), "tried")
    counts = scratch.put(line_counts(docs.select(F.rtrim("text", F.lit(SPACE)).alias("body"))), "line_counts")
    limits = scratch.put(length_limits(ends.select("source", "length")), "limits")
    judged = worded(ends.unionByName(tried), counts, openings(docs.select(F.col("text").alias("body"))))
    judged = judged.withColumn("key", F.coalesce("source", F.lit(""))).join(limits.select(F.col("source").alias("key"), "length", "posterior"), ["key", "length"], "left")
    judged = scratch.put(judged.withColumn("posterior", F.coalesce("posterior", F.lit(0.0))).withColumn("at", F.when(F.col("posterior") > 0, F.col("length")).otherwise(0)), "judged")
    cells = judged.groupBy("role", "key", "at", "posterior", "mark", "form", "kind").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as there are sources, limits and kinds of endings, whatever the number of texts
    fitted = cells.coalesce(1).mapInPandas(_fit_cells, CELLS).withColumnRenamed("source", "key")
    return judged.where("role = 'text'").join(fitted, ["key", "at", "mark", "form", "kind"]).select("doc_id", "source", "length", "form", "kind", "mark", "posterior", "evidence", "prior", "log_odds")


def truncation_report(scored: DataFrame) -> DataFrame:
    """Per source (null where a text has none): texts, texts cut, texts cut at a candidate limit, and the rate."""
    g = scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.sum((F.col("log_odds") > 0).cast("bigint")).alias("n_cut"), F.sum(((F.col("log_odds") > 0) & (F.col("posterior") > 0)).cast("bigint")).alias("n_cut_at_limit"))
    return g.withColumn("cut_rate", F.round(F.col("n_cut") / F.col("n_texts"), 6))


def corpus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
