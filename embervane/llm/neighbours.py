"""Most similar vectors for every vector.

Vectors that are equal stand for each other and are searched once. The rest are spread over shards, the cells of one
or two levels of centroids fitted on a bounded sample. Searches for the k nearest visit the shards of the
nearest centroids; every shard is a robust-pruned directed graph built and beam-searched in one task. Searches for all
partners above a similarity visit every shard that can hold one, as the planes between centroids tell, and compare
exactly, as a visitor has no place in a graph to set out from and rarely a partner. For these a vector is sent once to
each first-level centroid below which it visits, with the list of the shards: they are a dozen but lie close together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from embervane.llm.graph import PrunedGraph, within
from embervane.session import Scratch, empty, table

#: Vectors a shard should hold.
SHARD_ROWS = 2_500
#: Centroids of one level, and of both (these are sent to every task: 64 MB at 64 values; beyond, shards grow).
ONE_LEVEL, MAX_CENTROIDS = 512, 262_144
#: The same for pairs, whose shards below one top are one task: tops beyond one level (about as many as clusters have the fewest copies), vectors a top should hold.
PAIR_LEVEL, PAIR_TOPS, TOP_ROWS = 128, 64, 150_000
#: Vectors of the sample that centroids are fitted on (the only sample taken): so many a centroid, so many at least.
SAMPLE_PER_CENTROID, SAMPLE_ROWS = 64, 8_192
#: Partitions of the routed vectors; beyond, a task has several shards, one after the other.
MAX_PARTITIONS = 50_000
#: Shards a search for the k nearest visits.
PROBES = 16
#: Groups of more equal vectors are given as links to their lowest id, and not as all pairs.
EXPAND_COPIES = 32


def fit_vectors(tokens: DataFrame, outputs: DataFrame) -> DataFrame:
    """(token_id, output_name, embeddings) of the vectors fit for comparison.

    A vector is fit if its length is the embedding_dim of its output and its values are neither null nor
    non-finite nor all zero.
    """
    dims = outputs.where("output_name is not null and embedding_dim is not null").select("output_name", "embedding_dim").distinct()
    # infinite and NaN values make the sum of squares non-finite, nulls make it null
    norm = F.expr("aggregate(embeddings, 0D, (a, x) -> a + cast(x as double) * x, a -> sqrt(a))")
    t = tokens.where("token_id is not null and embeddings is not null").join(dims, "output_name")
    t = t.where("size(embeddings) = embedding_dim").withColumn("norm", norm).where("norm > 0 and norm < double('infinity')")
    return t.select("token_id", "output_name", "embeddings")


def _unit(batch: pa.RecordBatch) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(output, token ids, unit vectors) of an Arrow batch with token_id, output_name, embeddings."""
    names = batch.column("output_name").dictionary_encode()
    ids, lists, out = batch.column("token_id").to_numpy(), batch.column("embeddings"), []
    codes = names.indices.to_numpy()
    for c, name in enumerate(names.dictionary.to_pylist()):
        at = np.flatnonzero(codes == c)
        own = lists.take(pa.array(at))
        x = own.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(at), -1)
        n = np.sqrt(np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64)))
        good = np.isfinite(n) & (n > 0)
        out.append((name, ids[at][good], (x[good] / n[good, None]).astype(np.float32)))
    return out


def _kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    c = x[np.random.default_rng(3).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        home = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(n > 1e-6, sums / np.maximum(n, 1e-6), c).astype(np.float32)
    return c


@dataclass
class Cells:
    """The shards of one output: ``tops`` are the centroids of the first level, ``kids[j]`` those below top j."""

    tops: np.ndarray
    kids: list[np.ndarray]

    def __post_init__(self):
        self.first = np.concatenate([[0], np.cumsum([len(k) for k in self.kids])]).astype(np.int64)
        self.above = np.repeat(np.arange(len(self.kids)), [len(k) for k in self.kids])
        self.all = np.concatenate(self.kids)
        self.gap = _gaps(self.tops, self.tops)

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(top, shard, similarities to the tops) of every row."""
        s = x @ self.tops.T
        top = s.argmax(1)
        shard = self.first[top]
        for j in np.unique(top):
            if len(self.kids[j]) > 1:
                at = np.flatnonzero(top == j)
                shard[at] += (x[at] @ self.kids[j].T).argmax(1)
        return top, shard, s

    def reach(self, x: np.ndarray, top: np.ndarray, s: np.ndarray, chord: float, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard): what the rows must visit so that one side of each pair no further apart than ``chord`` meets the other.

        Let q and y be such a pair in the shards of the centroids c and d. Then q (c - d) + y (d - c) = (q - y)(c - d)
        is at most chord * |c - d|, so that one of the terms is at most half of it, whatever the levels: that side
        visits. For tops neither term is negative, so that each is at most the whole: other tops hold no partner.
        """
        home = self.home(x)[1] if home is None else home
        rows, shards = [], []
        lead = np.einsum("ij,ij->i", x, self.all[home])[:, None]
        visit = np.take_along_axis(s, top[:, None], 1) - s <= chord * self.gap[top] + 1e-6
        for j in np.flatnonzero(visit.any(0)):
            r, own = np.flatnonzero(visit[:, j]), self.kids[j]
            used, at = np.unique(home[r], return_inverse=True)
            a, b = np.nonzero(lead[r] - x[r] @ own.T <= chord / 2 * _gaps(self.all[used], own)[at] + 1e-6)
            rows.append(r[a])
            shards.append(self.first[j] + b)
        return np.concatenate(rows), np.concatenate(shards)

    def nearest(self, x: np.ndarray, s: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) of the ``probes`` nearest centroids below the ``probes`` nearest tops of every row."""
        t = min(probes, len(self.tops))
        tops = np.argpartition(-s, t - 1, axis=1)[:, :t]
        width = max(len(k) for k in self.kids)
        sims, shards = np.full((len(x), t, width), -np.inf, np.float32), np.full((len(x), t, width), -1, np.int64)
        for j in np.unique(tops):
            r, slot = np.nonzero(tops == j)
            n = len(self.kids[j])
            sims[r, slot, :n] = x[r] @ self.kids[j].T if n > 1 else s[r, j][:, None]
            shards[r, slot, :n] = self.first[j] + np.arange(n)
        sims, shards = sims.reshape(len(x), -1), shards.reshape(len(x), -1)
        best = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
        found = np.take_along_axis(shards, best, 1)
        row, _ = np.nonzero(found >= 0)
        return row, found[found >= 0]


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)).astype(np.float32)


def _centroids(t: pa.Table, k: int) -> np.ndarray:
    x = np.concatenate([u for b in t.sort_by("token_id").combine_chunks().to_batches() for _, _, u in _unit(b)])
    return _kmeans(x, min(k, len(x)))


def fit_shards(vectors: DataFrame, sizes: dict[str, int], shard_rows: int = SHARD_ROWS, one_level: int = ONE_LEVEL, most: int = MAX_CENTROIDS, least_tops: int = 1, top_rows: int | None = None) -> dict[str, Cells]:
    """The cells of every output, from a sample chosen by hash.

    An output of n vectors has n / shard_rows cells, ``most`` at most; above ``one_level`` they lie on two levels,
    the first of the root of their number, of ``least_tops`` at least, and of n / top_rows. What reaches the driver
    are centroids, ``most`` an output.
    """
    if not sizes:
        return {}
    cells = {o: int(min(most, max(1, -(-n // shard_rows)))) for o, n in sizes.items()}
    tops = {o: k if k <= one_level else min(k, max(int(np.ceil(np.sqrt(k))), min(least_tops, one_level), -(-sizes[o] // top_rows) if top_rows else 1)) for o, k in cells.items()}

    def sample(wanted: dict[str, int]) -> DataFrame:
        keep = F.lit(False)
        for o, k in wanted.items():
            rate = min(1.0, max(SAMPLE_ROWS, SAMPLE_PER_CENTROID * k) / sizes[o])
            keep = keep | ((F.col("output_name") == o) & (F.pmod(F.xxhash64("token_id"), F.lit(1 << 40)) < int(rate * (1 << 40)) + 1))
        return vectors.where(keep).select("token_id", "output_name", "embeddings")

    kind = "output_name string, top bigint, cell bigint, centroid binary"

    def rows(name: str, top: int, c: np.ndarray) -> pa.Table:
        return pa.table({"output_name": [name] * len(c), "top": pa.array([top] * len(c), pa.int64()), "cell": np.arange(len(c)), "centroid": [r.tobytes() for r in c]})

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        return rows(key[0].as_py(), -1, _centroids(t, tops[key[0].as_py()]))

    def stacked(found: list, name: str, top: int) -> np.ndarray:
        own = sorted((r for r in found if r["output_name"] == name and r["top"] == top), key=lambda r: r["cell"])
        return np.stack([np.frombuffer(bytes(r["centroid"]), np.float32) for r in own])

    found = sample(tops).groupBy("output_name").applyInArrow(fit, kind).collect()
    names = {r["output_name"] for r in found}
    upper = {o: stacked(found, o, -1) for o in sizes if o in names}
    two = {o: cells[o] for o in upper if cells[o] > one_level}
    out = {o: Cells(c, [c[j : j + 1] for j in range(len(c))]) for o, c in upper.items() if o not in two}
    if two:
        sent = vectors.sparkSession.sparkContext.broadcast({o: upper[o] for o in two})

        def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, ids, x in _unit(batch):
                    if name in sent.value and len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([name] * len(ids), pa.string()), pa.array((x @ sent.value[name].T).argmax(1)), pa.array(list(x), pa.list_(pa.float32()))], names=["token_id", "output_name", "top", "embeddings"])

        def split(key: tuple, t: pa.Table) -> pa.Table:
            name = key[0].as_py()
            share = len(t) / max(SAMPLE_ROWS, SAMPLE_PER_CENTROID * two[name])
            return rows(name, key[1].as_py(), _centroids(t.select(["token_id", "output_name", "embeddings"]), max(1, round(share * two[name]))))

        found = sample(two).mapInArrow(below, "token_id bigint, output_name string, top bigint, embeddings array<float>").groupBy("output_name", "top").applyInArrow(split, kind).collect()
        held: dict[tuple, list] = {}
        for r in found:
            held.setdefault((r["output_name"], r["top"]), []).append(r)
        for o in two:
            out[o] = Cells(upper[o], [stacked(held[o, j], o, j) if (o, j) in held else upper[o][j : j + 1] for j in range(len(upper[o]))])
    return out


ROUTED = "output_name string, shard bigint, token_id bigint, member boolean, query boolean, vec binary"
SPREAD = "output_name string, top bigint, token_id bigint, cell int, visits binary, vec binary"


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values, the i-th from ``bounds[i]`` to ``bounds[i + 1]`` (bytes)."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _rows(x: np.ndarray) -> pa.Array:
    return _blobs(x, np.arange(len(x) + 1) * x.shape[1] * 4)


def route(vectors: DataFrame, shards: dict[str, Cells], every: int = 1, probes: int = PROBES, least: float = -1.0) -> DataFrame:
    """Each vector to its own shard as a member and, if it asks, to the visited shards as a query.

    vectors(token_id, output_name, embeddings, ask): rows whose token_id is divisible by ``every`` or whose ``ask`` is
    true ask the ``probes`` nearest shards. With ``least`` above -1 all rows ask every shard that can hold a partner of
    that similarity (see ``Cells.reach``); then a row (see SPREAD) goes to a top and says its own shard below it, -1 if
    that lies below another, and which others it visits there.
    """
    chord = float(np.sqrt(max(0.0, 2 - 2 * least)))
    sent = vectors.sparkSession.sparkContext.broadcast(shards)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("ask").to_numpy(zero_copy_only=False).astype(bool)
            asked = set(batch.column("token_id").to_numpy()[wanted].tolist())
            for name, ids, x in _unit(batch):
                if name not in sent.value or not len(ids):
                    continue
                cells = sent.value[name]
                top, own, s = cells.home(x)
                asks = (ids % every == 0) | np.array([i in asked for i in ids.tolist()] if asked else False)
                q = np.flatnonzero(asks)
                row, shard = cells.nearest(x[q], s[q], probes) if len(q) else (q, q)
                row = q[row]
                other = shard != own[row]
                row, shard = np.concatenate([np.arange(len(ids)), row[other]]), np.concatenate([own, shard[other]])
                member = np.arange(len(row)) < len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(row), pa.string()), pa.array(shard), pa.array(ids[row]), pa.array(member), pa.array(asks[row]), _rows(x[row])], names=["output_name", "shard", "token_id", "member", "query", "vec"])

    def spread_tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, ids, x in _unit(batch):
                if name not in sent.value or not len(ids):
                    continue
                cells = sent.value[name]
                top, own, s = cells.home(x)
                row, shard = cells.reach(x, top, s, chord, own)
                other = shard != own[row]
                row, shard = row[other], shard[other]
                # one row a vector and top: the vector's own, marked by -1, and those of the visits
                to = cells.above[shard]
                row, to, kid = np.concatenate([np.arange(len(ids)), row]), np.concatenate([top, to]), np.concatenate([np.full(len(ids), -1), shard - cells.first[to]])
                o = np.lexsort((kid, to, row))
                row, to, kid = row[o], to[o], kid[o]
                head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (to[1:] != to[:-1])]))
                bounds = np.concatenate([[0], np.cumsum(np.add.reduceat(kid >= 0, head, dtype=np.int64))]) * 4
                at, to = row[head], to[head]
                cell = np.where(kid[head] < 0, own[at] - cells.first[to], -1)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(to, pa.int64()), pa.array(ids[at]), pa.array(cell, pa.int32()), _blobs(kid[kid >= 0].astype(np.int32), bounds), _rows(x[at])], names=["output_name", "top", "token_id", "cell", "visits", "vec"])

    rows = vectors.select("token_id", "output_name", "embeddings", "ask")
    return rows.mapInArrow(spread_tops, SPREAD) if least > -1 else rows.mapInArrow(spread, ROUTED)


HITS = "output_name string, token_id bigint, neighbour_id bigint, similarity double"


def _vectors(t: pa.Table) -> np.ndarray:
    blob = t.column("vec").chunk(0)
    size = len(blob[0].as_py())
    return np.frombuffer(blob.buffers()[2], np.uint8)[blob.offset * size : (blob.offset + len(blob)) * size].view(np.float32).reshape(len(blob), -1)


def _table(t: pa.Table, found: list[tuple]) -> pa.Table:
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
    who, hit, s = (np.concatenate(c) for c in zip(none, *found))
    return pa.table({"output_name": pa.array([t.column("output_name")[0].as_py()] * len(who), pa.string()), "token_id": pa.array(who, pa.int64()), "neighbour_id": pa.array(hit, pa.int64()), "similarity": pa.array(s.astype(np.float64))})


def _search(k: int, beam: int, degree: int, t: pa.Table) -> pa.Table:
    t = t.combine_chunks()
    ids, member, query, x = t.column("token_id").to_numpy(), t.column("member").to_numpy(), t.column("query").to_numpy(), _vectors(t)
    # repeated deliveries count once; the order, and with it the graph, depends on the ids alone
    o = np.lexsort((~member, ids))
    o = o[np.concatenate([[True], ids[o][1:] != ids[o][:-1]])]
    ids, member, query, x = ids[o], member[o], query[o], x[o]
    own_ids, own_x = ids[member], x[member]
    if not len(own_ids) or not query.any():
        return _table(t, [])
    # equal vectors stand in the graph once
    _, lead, at = np.unique(np.ascontiguousarray(own_x).view([("v", np.void, own_x.shape[1] * 4)]).ravel(), return_index=True, return_inverse=True)
    graph = PrunedGraph(own_x[lead], degree=degree, beam=2 * degree, alpha=1.1)
    copies = np.argsort(at, kind="stable")
    from_ = np.searchsorted(at[copies], np.arange(len(lead) + 1))
    q_own, out = query[member], []
    for asked, xs, start in ((own_ids[q_own], own_x[q_own], at[q_own].astype(np.int32)), (ids[query & ~member], x[query & ~member], None)):
        for lo in range(0, len(asked), 8192):
            part = slice(lo, lo + 8192)
            node, sim = graph.search(xs[part], max(beam, k + 1), None if start is None else start[part])
            r, c = np.nonzero(node >= 0)
            n, sims = node[r, c], sim[r, c]
            # as many copies of a hit as can be among the k best
            count = np.minimum(from_[n + 1] - from_[n], k + 1)
            rep = np.repeat(np.arange(len(r)), count)
            pos = np.repeat(from_[n] - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(n) else from_[n], count) + np.arange(len(rep))
            who, hit, s = asked[part][r[rep]], own_ids[copies[pos]], sims[rep]
            keep = who != hit
            who, hit, s = who[keep], hit[keep], s[keep]
            o = np.lexsort((hit, -s, who))
            who, hit, s = who[o], hit[o], s[o]
            rank = np.arange(len(who)) - np.searchsorted(who, who, side="left")
            out.append((who[rank < k], hit[rank < k], s[rank < k]))
    return _table(t, out)


def _compare_top(least: float, t: pa.Table) -> pa.Table:
    """Pairs in all shards below one top, one shard after the other: its vectors with one another and with its visitors.

    A vector lies here once, whatever the number of its visits.
    """
    t = t.combine_chunks()
    ids, cell, x = t.column("token_id").to_numpy(), t.column("cell").to_numpy(), _vectors(t)
    blob = t.column("visits").chunk(0)
    bounds = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1] // 4
    kid = np.frombuffer(blob.buffers()[2] or b"", np.int32)[bounds[0] : bounds[-1]]
    visitor = np.repeat(np.arange(len(ids)), np.diff(bounds))
    o = np.lexsort((cell < 0, ids))
    o = o[np.concatenate([[True], ids[o][1:] != ids[o][:-1]])]
    once = np.zeros(len(ids), bool)
    once[o] = True
    kid, visitor = kid[once[visitor]], visitor[once[visitor]]
    by = np.lexsort((ids[visitor], kid))
    kid, visitor = kid[by], visitor[by]
    o = o[np.argsort(cell[o], kind="stable")]
    found = []
    for c in np.unique(cell[o][cell[o] >= 0]):
        own, guests = o[slice(*np.searchsorted(cell[o], [c, c + 1]))], visitor[slice(*np.searchsorted(kid, [c, c + 1]))]
        asked = np.concatenate([own, guests])
        r, n, sims = within(x[own], x[asked], least)
        who, hit = ids[asked[r]], ids[own[n]]
        found.append((who[who != hit], hit[who != hit], sims[who != hit]))
    return _table(t, found)


def equal_vectors(vectors: DataFrame, scratch: Scratch) -> tuple[dict[str, int], DataFrame]:
    """Vectors by output, and the copies: (token_id, rep), rep being the lowest id with the same vector (two 64-bit hashes).

    Only ids and hashes are shuffled. Groups of copies are counted by partial aggregates, so one that holds most of
    the rows is no hot spot.
    """
    keyed = scratch.put(vectors.select("output_name", "token_id", F.xxhash64("embeddings").alias("h1"), F.xxhash64(F.lit(5), "embeddings").alias("h2")), "hashes")
    sizes = {r["output_name"]: r["n"] for r in keyed.groupBy("output_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    same = keyed.groupBy("output_name", "h1", "h2").agg(F.min("token_id").alias("rep"), F.max("token_id").alias("last")).where("rep < last").drop("last")
    return sizes, scratch.put(keyed.join(same, ["output_name", "h1", "h2"]).where("token_id <> rep").select("token_id", "rep").distinct(), "copies")


def _once(vectors: DataFrame, copies: DataFrame, every: int = 1) -> DataFrame:
    """The vectors without copies; ``ask`` marks those that have a copy whose token_id is divisible by ``every``."""
    if empty(copies):
        return vectors.withColumn("ask", F.lit(False))
    ask = copies.where(F.pmod("token_id", F.lit(every)) == 0).select(F.col("rep").alias("token_id"), F.lit(True).alias("ask")).distinct()
    marks = copies.select("token_id", F.lit(True).alias("copy"), F.lit(False).alias("ask")).unionByName(ask.withColumn("copy", F.lit(False)))
    searched = vectors.join(marks.groupBy("token_id").agg(F.max("copy").alias("copy"), F.max("ask").alias("ask")), "token_id", "left")
    return searched.where(~F.coalesce("copy", F.lit(False))).withColumn("ask", F.coalesce("ask", F.lit(False)))


def _by(routed: DataFrame, place: str, n: int, search) -> DataFrame:
    # a few partitions a shard, so that large shards rarely meet in one task
    return routed.repartition(min(max(1, 3 * n), MAX_PARTITIONS), "output_name", place).groupBy("output_name", place).applyInArrow(lambda key, t: search(t), HITS)


def nearest(tokens: DataFrame, outputs: DataFrame, k: int = 10, every: int = 1, beam: int = 64, degree: int = 16, probes: int = PROBES, **how) -> DataFrame:
    """(output_name, token_id, neighbour_id, similarity, rank): the k most similar tokens of the same output.

    tokens(token_id, output_name, embeddings), outputs(output_name, embedding_dim). Queries are the tokens whose
    id is divisible by ``every``; every token fit for comparison is in the index. Ties go to the lower id,
    repeated deliveries count once, tokens unfit for comparison are in no row. Equal vectors are searched once, and
    of a group of them the k + 1 lowest ids are enough to fill any list. Recall is measured in the tests.
    """
    vectors, scratch = fit_vectors(tokens, outputs), Scratch(tokens.sparkSession)
    sizes, copies = equal_vectors(vectors, scratch)
    shards = fit_shards(vectors, sizes, **how)
    hits = _by(route(_once(vectors, copies, every), shards, every, probes), "shard", sum(int(c.first[-1]) for c in shards.values()), lambda t: _search(k, beam, degree, t))
    if not empty(copies):
        hits = scratch.put(hits, "hits")
        members = copies.unionByName(copies.select(F.col("rep").alias("token_id"), "rep").distinct())
        few = members.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("token_id"))).where(F.col("r") <= k + 1).drop("r")
        asking = members.where(F.pmod("token_id", F.lit(every)) == 0)
        # hits on a representative are hits on its copies, and the hits of a representative are those of its copies
        near = hits.join(few.select(F.col("rep").alias("neighbour_id"), F.col("token_id").alias("copy")), "neighbour_id", "left").withColumn("neighbour_id", F.coalesce("copy", "neighbour_id")).drop("copy")
        near = near.join(asking.select(F.col("rep").alias("token_id"), F.col("token_id").alias("copy")), "token_id", "left").withColumn("token_id", F.coalesce("copy", "token_id")).drop("copy")
        name = vectors.select("token_id", "output_name").join(asking.select("token_id"), "token_id", "left_semi").distinct()
        own = asking.join(name, "token_id").join(few.select("rep", F.col("token_id").alias("neighbour_id")), "rep").select("output_name", "token_id", "neighbour_id", F.lit(1.0).alias("similarity"))
        hits = near.select("output_name", "token_id", "neighbour_id", "similarity").unionByName(own).where(F.pmod("token_id", F.lit(every)) == 0)
    best = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("similarity")).alias("d"), "neighbour_id"))), 1, k)  # k a visited shard, k + 1 a group of copies
    top = hits.where("token_id <> neighbour_id").groupBy("output_name", "token_id").agg(best.alias("best"))
    return top.select("output_name", "token_id", F.posexplode("best").alias("pos", "b")).select("output_name", "token_id", F.col("b.neighbour_id").alias("neighbour_id"), (-F.col("b.d")).alias("similarity"), (F.col("pos") + 1).alias("rank"))


def similar_pairs(tokens: DataFrame, outputs: DataFrame, least: float = 0.95, expand: int = EXPAND_COPIES, **how) -> DataFrame:
    """(token_id_a, token_id_b): pairs of tokens of one output with a cosine similarity of at least ``least``, a < b.

    Of each pair at least one side visits the shard of the other, and shards are compared exactly, so that none is lost.
    Groups
    of up to ``expand`` equal vectors are listed pair by pair; of larger ones the lowest id stands for all, and each
    other id has a row with it.
    """
    vectors, scratch = fit_vectors(tokens, outputs), Scratch(tokens.sparkSession)
    sizes, copies = equal_vectors(vectors, scratch)
    shards = fit_shards(vectors, sizes, **{"one_level": PAIR_LEVEL, "least_tops": PAIR_TOPS, "top_rows": TOP_ROWS} | how)
    hits = _by(route(_once(vectors, copies), shards, least=least), "top", sum(len(c.tops) for c in shards.values()), lambda t: _compare_top(least, t))
    pairs = hits.select(F.least("token_id", "neighbour_id").alias("a"), F.greatest("token_id", "neighbour_id").alias("b")).distinct()
    if not empty(copies):
        small = copies.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < expand).select("rep")
        listed = copies.join(small, "rep", "left_semi")
        members = scratch.put(listed.unionByName(listed.select(F.col("rep").alias("token_id"), "rep").distinct()), "members")
        for side in ("a", "b"):
            pairs = pairs.join(members.select(F.col("rep").alias(side), F.col("token_id").alias("copy")), side, "left").withColumn(side, F.coalesce("copy", side)).drop("copy")
        inside = members.select("rep", F.col("token_id").alias("a")).join(members.select("rep", F.col("token_id").alias("b")), "rep").where("a < b").select("a", "b")  # expand * expand a group
        rest = copies.join(small, "rep", "left_anti").select(F.col("rep").alias("a"), F.col("token_id").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(inside).unionByName(rest)
    return pairs.select(F.col("a").alias("token_id_a"), F.col("b").alias("token_id_b"))


def spatial(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "spatial_tokens").select("token_id", "output_name", "embeddings"), table(spark, sf_dir, "spatial_outputs")
