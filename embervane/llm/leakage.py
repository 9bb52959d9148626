"""Evaluation texts leaking into training text.

Every window of twelve words of the items' own text gets a SimHash fingerprint, as does every window of a document
whose word shingles can all be shingles of items (a filter of fixed size tells). Fingerprints meet in a multi-index
over four 16-bit blocks, a join on (block, value): by pigeonhole it brings together all fingerprints within a
Hamming radius of three. Windows that meet are compared exactly by their weighted word shingles.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from embervane.session import Scratch, table

WINDOW = 12
SHINGLE = 5
RADIUS = 3
BLOCKS = 4
#: Bits of the filter of item shingles (what every task is sent): 2 MB; ten million shingles fill less than half.
FILTER_BITS = 1 << 24
_CHUNK = 1 << 15

#: Anything short in angle brackets; at any length what begins like a comment or a tag with attributes (a lone < before prose does not).
_TAG = re.compile(r"""<[^<>]{0,200}>|<!--[^<>]*>|</?[a-z][\w:-]*(?:\s+[\w:@.-]+){1,20}(?:=|\s*=\s*["'])[^<>]*>""")
_SIGN = re.compile(r"[^\w\s]|_")
_SENTENCE, _CLAUSE = re.compile(r"(?<=[.?!])\s+"), re.compile(r"(?<=[;:])\s+")


def words(text: str | None) -> list[str]:
    """The words of a text without regard to case, punctuation, white space, line marks, markup and invisible characters."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _SIGN.sub("", _TAG.sub(" ", text.lower())).split()


OPENINGS = "item_id bigint, sentence string, after_sentence array<string>, clause string, after_clause array<string>, words array<string>"


def _openings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for i, text in zip(batch["item_id"], batch["text"]):
            text, row = text.strip(), [i]
            for cut in (_SENTENCE, _CLAUSE):
                first, *rest = cut.split(text, maxsplit=1)
                row += [" ".join(words(first)), words(rest[0]) if rest else []]
            out.append((*row, words(text)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OPENINGS.split(", ")])


def own_words(items: DataFrame) -> DataFrame:
    """items(item_id, text) to (item_id, words): each item's words without a sentence that opens several items, or,
    where the whole sentence does not, without a clause up to a colon or semicolon that does. Null texts have no row."""
    rows = items.where("item_id is not null and text is not null").select("item_id", "text").distinct().mapInPandas(_openings, OPENINGS)
    rows = Scratch(items.sparkSession).put(rows, "openings")
    own = F.col("words")
    for unit in ("clause", "sentence"):
        shared = rows.groupBy(unit).agg(F.count_distinct("item_id").alias("n")).where(f"n > 1 and {unit} <> ''").select(unit, F.lit(True).alias(f"shared_{unit}"))
        rows = rows.join(shared, unit, "left")
        own = F.when(F.col(f"shared_{unit}"), F.col(f"after_{unit}")).otherwise(own)
    return rows.select("item_id", own.alias("words"))


def _signs(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


def fingerprints(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """SimHash of every window of consecutive word hashes (each word votes on each of 64 bits)."""
    if len(hashes) < window:
        return np.empty(0, np.uint64)
    votes = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(_signs(hashes), axis=0, dtype=np.int32, out=votes[1:])
    on = (votes[window:] - votes[:-window]) > 0
    return np.packbits(on, axis=1, bitorder="little").view("<u8").ravel()


def hash_words(tokens: list[str]) -> np.ndarray:
    codes = pa.array(tokens, pa.string()).dictionary_encode()
    table_ = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in codes.dictionary.to_pylist()), np.uint64, len(codes.dictionary))
    return table_[codes.indices.to_numpy()] if len(tokens) else np.empty(0, np.uint64)


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """A hash of every run of SHINGLE word hashes."""
    n = len(hashes) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = (out + hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def shingles(w: list[str]) -> list[str]:
    return [" ".join(w[k : k + SHINGLE]) for k in range(len(w) - SHINGLE + 1)]


ITEM_WINDOWS = "item_id bigint, item_words bigint, start bigint, print bigint, item_text string"


def _item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i, w in zip(batch["item_id"], batch["words"]):
            w = list(w)
            p = fingerprints(hash_words(w)).view(np.int64)
            if len(p):
                yield pd.DataFrame({"item_id": i, "item_words": len(w), "start": np.arange(len(p)), "print": p, "item_text": [" ".join(w[k : k + WINDOW]) for k in range(len(p))]})


def item_windows(own: DataFrame) -> DataFrame:
    """own(item_id, words) to every window of every item with its fingerprint and the weights of its shingles: a
    shingle weighs one over the number of items that have it."""
    rows = own.mapInPandas(_item_windows, ITEM_WINDOWS)
    spread = F.expr(f"transform(sequence(1, {WINDOW - SHINGLE + 1}), k -> array_join(slice(split(item_text, ' '), k, {SHINGLE}), ' '))")
    s = rows.select("item_id", "start", F.explode(spread).alias("shingle"))
    df = s.groupBy("shingle").agg((1.0 / F.count_distinct("item_id")).alias("weight"))
    s = s.join(df, "shingle").groupBy("item_id", "start").agg(F.map_from_entries(F.collect_set(F.struct("shingle", "weight"))).alias("weights"))
    return rows.join(s, ["item_id", "start"])


def shingle_filter(own: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the items' shingles: what reaches the driver has ``bits`` bits, whatever the number of items."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = [np.unique(shingle_hashes(hash_words(list(w))) % np.uint64(bits)) for w in batch["words"]]
            yield pd.DataFrame({"place": np.concatenate([*at, np.empty(0, np.uint64)]).astype(np.int64)})

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(_CHUNK, bool)
        on[part["place"].to_numpy() % _CHUNK] = True
        return pd.DataFrame({"chunk": [key[0]], "bits": [np.packbits(on, bitorder="little").tobytes()]})

    rows = own.select("words").mapInPandas(places, "place bigint").distinct()
    rows = rows.groupBy(F.floor(F.col("place") / _CHUNK).alias("chunk")).applyInPandas(pack, "chunk bigint, bits binary")
    out = np.zeros(-(-bits // _CHUNK) * _CHUNK // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r["chunk"] * (_CHUNK // 8) : (r["chunk"] + 1) * (_CHUNK // 8)] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _scan(sent, bits: int, all_of: bool, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    on = sent.value
    span = WINDOW - SHINGLE + 1
    for batch in batches:
        ids, lists = batch["doc_id"].to_numpy(), [words(t) for t in batch["text"]]
        starts = np.concatenate([[0], np.cumsum([len(w) for w in lists])]).astype(np.int64)
        flat = [w for ws in lists for w in ws]
        hashes = hash_words(flat)
        at = shingle_hashes(hashes) % np.uint64(bits)
        held = (on[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        sums = np.concatenate([[0], np.cumsum(held, dtype=np.int64)])
        n = sums[span:] - sums[:-span] if len(sums) > span else np.empty(0, np.int64)
        first = np.flatnonzero(n == span if all_of else n > 0)
        doc = np.searchsorted(starts, first, side="right") - 1
        inside = first + WINDOW <= starts[doc + 1]
        first, doc = first[inside], doc[inside]
        for lo in range(0, len(first), 20_000):
            f, d = first[lo : lo + 20_000], doc[lo : lo + 20_000]
            signs = _signs(hashes[(f[:, None] + np.arange(WINDOW)).ravel()]).reshape(len(f), WINDOW, 64)
            prints = np.packbits(signs.sum(1, dtype=np.int32) > 0, axis=1, bitorder="little").view("<i8").ravel()
            yield pd.DataFrame({"doc_id": ids[d], "first_word": f - starts[d], "print": prints, "text": [" ".join(flat[k : k + WINDOW]) for k in f]})


def document_windows(documents: DataFrame, filter_: np.ndarray, min_similarity: float = 1.0, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, first_word, print, text) of the windows that can be similar to one of an item: all their shingles are
    in the filter, or any of them if ``min_similarity`` is below 1. Whole texts are read, nothing is shuffled."""
    sent = documents.sparkSession.sparkContext.broadcast(filter_)  # of fixed size
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return docs.mapInPandas(lambda it: _scan(sent, bits, min_similarity >= 1, it), "doc_id bigint, first_word bigint, print bigint, text string")


def candidates(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs of a window and an item's window whose fingerprints differ in at most ``radius`` bits, which must be
    fewer than the blocks; both sides have a column ``print``. A pair that agrees in several blocks is met once."""
    block = lambda side, b: f"(shiftrightunsigned({side}, 16 * {b}) & 65535)"
    cut = lambda df: df.selectExpr("*", f"posexplode(transform(sequence(0, {BLOCKS - 1}), b -> {block('print', 'b')})) as (block, value)")
    j = cut(windows).join(cut(items).withColumnRenamed("print", "item_print"), ["block", "value"])
    earlier = f"not exists(sequence(0, {BLOCKS - 1}), b -> b < block and {block('print', 'b')} = {block('item_print', 'b')})"
    return j.where(f"bit_count(print ^ item_print) <= {radius} and {earlier}").drop("block", "value")


def similarity(a: list[str], b: list[str], weights: dict[str, float]) -> float:
    """Weighted Jaccard of the word shingles of a window and an item's window; shingles without a weight weigh 1."""
    x, y = Counter(shingles(a)), Counter(shingles(b))
    w = lambda s: weights.get(s, 1.0)
    low = sum(min(x[s], y[s]) * w(s) for s in x.keys() & y.keys())
    return low / sum(max(x[s], y[s]) * w(s) for s in x.keys() | y.keys())


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.drop(columns=["text", "item_text", "weights"]).assign(similarity=[similarity(t.split(" "), i.split(" "), dict(w)) for t, i, w in zip(b["text"], b["item_text"], b["weights"])])


def leaks(documents: DataFrame, items: DataFrame, min_similarity: float = 1.0, bits: int = FILTER_BITS) -> DataFrame:
    """Every document that holds a passage of an item's own text, one row per document and item.

    documents(doc_id, text), items(item_id, text); whole texts are scanned once, repeated deliveries count once. A
    passage is ``WINDOW`` consecutive words; with ``min_similarity`` 1 all of them must be equal. Returns (doc_id,
    item_id, n_windows, first_word, item_words, covered_words, similarity). Of the items a filter of ``bits`` bits is
    sent to the tasks; windows that pass it meet the items' windows in a join. Null or short texts are in no row.
    """
    own = Scratch(items.sparkSession).put(own_words(items), "own")
    pairs = candidates(document_windows(documents, shingle_filter(own, bits), min_similarity, bits), item_windows(own))
    pairs = pairs.select("doc_id", "first_word", "text", "item_id", "item_words", "start", "item_text", "weights")
    checked = pairs.mapInPandas(_verify, "doc_id bigint, first_word bigint, item_id bigint, item_words bigint, start bigint, similarity double").where(F.col("similarity") >= min_similarity)
    g = checked.groupBy("doc_id", "item_id").agg(F.count_distinct("first_word").alias("n_windows"), F.min("first_word").alias("first_word"), F.max("item_words").alias("item_words"), F.collect_set("start").alias("starts"), F.max("similarity").alias("similarity"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + WINDOW - 1))))).cast("bigint")
    return g.select("doc_id", "item_id", "n_windows", "first_word", "item_words", covered.alias("covered_words"), "similarity")


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """Which items leaked: documents holding them, and the largest share of their own words in one document."""
    by = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max(F.round(F.col("covered_words") / F.col("item_words"), 6)).alias("largest_share"))
    return items.select("item_id", "task").distinct().join(by, "item_id", "left").select("item_id", "task", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("largest_share", F.lit(0.0)).alias("largest_share"))


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
