"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one a shard.

Equal vectors form one class, and only classes are compared. Classes are dealt by hash into shards of bounded bytes; each shard's
graph is built in one task and is a file in the shared folder. A block of a shard's vectors searches the graph of its own shard and
of every later one, so a pair is looked for from one side; all queries of a batch go in step. A search follows its beam, then widens
through every neighbour above the threshold, so a large cluster is found whole whatever the beam.

One beam serves all shards. An audit stage compares a bounded sample of the table with every shard by brute force, and takes the
first beam, from BEAM doubling, that finds the wanted share of the sample's true links. Each sampled vector also asks with a
slightly turned copy of itself, which must find it, so a table with few links is audited by as many queries as any other. Only
the audit compares exhaustively, and its cost is the sample's size a vector. Pairs are verified by cosine in double precision and
dropped, batch by batch: a task holds link counts and a forest, and returns the counts and the forest's edges, never the pairs.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from palisade.llm.common import components, new_folder, shard_count, stored
from palisade.llm.warc_bundles import _file_system

THRESHOLD = 0.95
#: The least number of shards, so that a small table is not one task's work.
SHARDS = 4
SHARD_BYTES = 24_000_000
ROWS_PER_BLOCK = 4096
LINKS = 12
BUILD_BEAM = 32
BEAM = 24
#: Sampled vectors of the audit, and true links of one of them with one shard that count.
AUDIT_ROWS = 512
AUDIT_LINKS = 32
AUDIT_RECALL = 0.99
#: Queries that go in step, and (query, node) pairs that are widened or compared in one go.
STEP_ROWS = 512
PAIRS_AT_ONCE = 20_000
SLACK = 1e-4


class Graph:
    """A navigable small-world graph over unit vectors; level 0 holds all of them, each level above about one in LINKS."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 5):
        self.x = np.ascontiguousarray(vectors, np.float32)
        n = len(self.x)
        rng = np.random.default_rng(seed)
        height = np.minimum((-np.log(rng.random(n).clip(1e-12)) / np.log(links)).astype(int), 12) if n else np.zeros(0, int)
        self.levels = [np.full((n, 2 * links if level == 0 else links), -1, np.int32) for level in range((height.max() if n else 0) + 1)]
        self.entry, self.links = (int(np.argmax(height)) if n else -1), links
        order = np.concatenate([[self.entry], np.delete(np.arange(n), self.entry)]).astype(int) if n else np.zeros(0, int)
        at = 1
        while at < n:
            batch = order[at : at + max(1, min(at, STEP_ROWS))]
            self._insert(batch, height, beam)
            at += len(batch)

    def _insert(self, batch: np.ndarray, height: np.ndarray, beam: int) -> None:
        q = self.x[batch]
        entries = np.full((len(batch), 1), self.entry)
        for level in range(len(self.levels) - 1, -1, -1):
            here = height[batch] >= level
            if (~here).any():
                ids, _ = self._search(q[~here], entries[~here], 1, level)
                entries[~here] = ids
            if here.any():
                own = batch[here]
                ids, sims = self._search(q[here], entries[here], beam, level)
                entries[here] = np.where(ids[:, :1] >= 0, ids[:, :1], entries[here])
                mutual = q[here] @ q[here].T
                np.fill_diagonal(mutual, -np.inf)
                k = min(self.links, len(own) - 1)
                if k > 0:
                    near = np.argpartition(-mutual, k - 1, axis=1)[:, :k]
                    ids = np.concatenate([ids, own[near]], axis=1)
                    sims = np.concatenate([sims, np.take_along_axis(mutual, near, 1)], axis=1)
                chosen = self._choose(ids, sims, self.links)
                self.levels[level][own, : self.links] = chosen
                self._link_back(own, chosen, level)

    def _choose(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates those nearer to the row than to one chosen before; free places go to the nearest others."""
        sims = np.where(ids >= 0, sims, -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        rows, width = ids.shape
        vectors = self.x[np.maximum(ids, 0)]
        between = vectors @ vectors.transpose(0, 2, 1)
        nearest = np.full((rows, width), -np.inf, np.float32)
        taken, count = np.zeros((rows, width), bool), np.zeros(rows, int)
        for j in range(width):
            take = (sims[:, j] > nearest[:, j]) & (count < most) & np.isfinite(sims[:, j])
            taken[:, j] = take
            count += take
            nearest[take] = np.maximum(nearest[take], between[take, j])
        rank = np.where(taken, 0, np.where(np.isfinite(sims), 1, 2)) * width + np.arange(width)
        best = np.argsort(rank, axis=1)[:, :most]
        out = np.take_along_axis(np.where(np.isfinite(sims), ids, -1), best, 1)
        return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _link_back(self, own: np.ndarray, chosen: np.ndarray, level: int) -> None:
        table = self.levels[level]
        to, back = chosen.ravel(), np.repeat(own, chosen.shape[1])
        back, to = back[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        nodes, first, n = np.unique(to, return_index=True, return_counts=True)
        have = (table[nodes] >= 0).sum(axis=1)
        rank = np.arange(len(to)) - np.repeat(first, n)
        fits = np.repeat(have + n <= table.shape[1], n)
        table[to[fits], (np.repeat(have, n) + rank)[fits]] = back[fits]
        full = np.flatnonzero(have + n > table.shape[1])
        for at in range(0, len(full), 512):
            part = full[at : at + 512]
            new = np.full((len(part), n[part].max()), -1)
            at_row = np.repeat(np.arange(len(part)), n[part])
            at_col = np.arange(len(at_row)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            new[at_row, at_col] = back[np.repeat(first[part], n[part]) + at_col]
            ids = np.concatenate([table[nodes[part]], new], axis=1)
            sims = np.einsum("nd,nkd->nk", self.x[nodes[part]], self.x[np.maximum(ids, 0)])
            sims = np.where(ids >= 0, sims, -np.inf)
            wide = table.shape[1] * 2
            if ids.shape[1] > wide:
                best = np.argpartition(-sims, wide, axis=1)[:, :wide]
                ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            table[nodes[part]] = self._choose(ids, sims, table.shape[1])

    def _search(self, q: np.ndarray, entries: np.ndarray, beam: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam nearest nodes of a level that the walk finds for each query, nearest first (-1 where there are fewer).

        Nodes met before are known by their place in the sorted beam, where they stand beside themselves; those that fell out of it
        are too far to come back. So a query keeps no list of what it has seen.
        """
        table, b = self.levels[level], len(q)
        step = max(1, min(4, beam // 4))
        out_ids, out_sims = np.full((b, beam), -1), np.full((b, beam), -np.inf, np.float32)
        rows, ids, sims, done = np.arange(b), out_ids.copy(), out_sims.copy(), np.ones((b, beam), bool)
        ids[:, 0], done[:, 0] = entries[:, 0], False
        sims[:, 0] = np.einsum("ij,ij->i", q, self.x[entries[:, 0]])
        while len(rows):
            pick = np.argsort(done, axis=1, kind="stable")[:, :step]
            fresh = ~np.take_along_axis(done, pick, 1)
            on = fresh[:, 0]
            if not on.all():
                out_ids[rows[~on]], out_sims[rows[~on]] = ids[~on], sims[~on]
                rows, ids, sims, done, pick, fresh, q = (x[on] for x in (rows, ids, sims, done, pick, fresh, q))
                continue
            nodes = np.where(fresh, np.take_along_axis(ids, pick, 1), -1)
            np.put_along_axis(done, pick, True, 1)
            near = np.where(nodes[:, :, None] >= 0, table[np.maximum(nodes, 0)], -1).reshape(len(rows), -1)
            s = np.matmul(self.x[np.maximum(near, 0)], q[:, :, None])[:, :, 0]
            s = np.where((near >= 0) & (s > sims[:, -1:]), s, -np.inf)
            if near.shape[1] > beam:
                top = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
                near, s = np.take_along_axis(near, top, 1), np.take_along_axis(s, top, 1)
            missing = np.isneginf(s)
            ids = np.concatenate([ids, np.where(missing, -1, near)], axis=1)
            sims, done = np.concatenate([sims, s], axis=1), np.concatenate([done, missing], axis=1)
            # Older entries stand before newer ones of the same similarity, so the copy that goes is the one not yet opened.
            order = np.argsort(-sims, axis=1, kind="stable")
            ids, sims, done = (np.take_along_axis(a, order, 1) for a in (ids, sims, done))
            twice = np.zeros(ids.shape, bool)
            twice[:, 1:] = (ids[:, 1:] == ids[:, :-1]) & (ids[:, 1:] >= 0)
            keep = np.argsort(twice, axis=1, kind="stable")[:, :beam]
            twice = np.take_along_axis(twice, keep, 1)
            ids, sims, done = (np.take_along_axis(a, keep, 1) for a in (ids, sims, done))
            ids[twice], sims[twice], done[twice] = -1, -np.inf, True
        return out_ids, out_sims

    def _spread(self, q: np.ndarray, rows: np.ndarray, nodes: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The unseen neighbours on level 0 of (row, node) pairs, with their similarity to the row's query."""
        near = self.levels[0][nodes]
        rows = np.repeat(rows, near.shape[1])
        near = near.ravel()
        keep = near >= 0
        rows, near = rows[keep], near[keep]
        fresh = ~seen[rows, near]
        key = np.unique(rows[fresh].astype(np.int64) * len(self.x) + near[fresh])
        rows, near = key // len(self.x), key % len(self.x)
        seen[rows, near] = True
        return rows, near, np.einsum("ij,ij->i", q[rows], self.x[near])

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of similarity >= least that a beam search and the spread from its finds reach."""
        return _joined(self.pieces(q, least, beam))

    def pieces(self, q: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """within() piece by piece; every pair once. Only queries with a find hold marks of what they have seen."""
        if self.entry < 0:
            return
        beam = min(beam, len(self.x))
        for at in range(0, len(q), STEP_ROWS):
            part = q[at : at + STEP_ROWS]
            entries = np.full((len(part), 1), self.entry)
            for level in range(len(self.levels) - 1, 0, -1):
                entries = self._search(part, entries, 1, level)[0]
            ids, sims = self._search(part, entries, beam, 0)
            hit = np.flatnonzero((sims >= least).any(axis=1))
            some = max(1, min(64, 4_000_000 // len(self.x)))
            for k in range(0, len(hit), some):
                of = hit[k : k + some]
                for rows, nodes in self._widened(part[of], ids[of], sims[of], least):
                    yield of[rows] + at, nodes

    def _widened(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        row, col = np.nonzero(sims >= least)
        node = ids[row, col]
        seen = np.zeros((len(q), len(self.x)), bool)
        fresh = np.unique(row.astype(np.int64) * len(self.x) + node)
        row, node = fresh // len(self.x), fresh % len(self.x)
        seen[row, node] = True
        while len(row):
            yield row, node
            wider = [(np.empty(0, np.int64), np.empty(0, np.int64))]
            for k in range(0, len(row), PAIRS_AT_ONCE):
                r, n, s = self._spread(q, row[k : k + PAIRS_AT_ONCE], node[k : k + PAIRS_AT_ONCE], seen)
                wider.append((r[s >= least], n[s >= least]))
            row, node = _joined(wider)


def _joined(pieces: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    rows, nodes = zip((np.empty(0, np.int64), np.empty(0, np.int64)), *pieces)
    return np.concatenate(rows), np.concatenate(nodes)


def true_links(q: np.ndarray, x: np.ndarray, least: float, most: int = AUDIT_LINKS) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) by brute force, of each query at most so many, evenly over its nodes: what the audit of a sample asks for."""
    rows, nodes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(q), 64):
        for i, hit in enumerate(q[at : at + 64] @ x.T >= least):
            found = np.flatnonzero(hit)
            if len(found) > most:
                found = found[np.linspace(0, len(found) - 1, most).astype(int)]
            rows.append(np.full(len(found), at + i))
            nodes.append(found)
    return np.concatenate(rows), np.concatenate(nodes)


def turned(q: np.ndarray, least: float, seed: int = 11) -> np.ndarray:
    """Unit vectors between the threshold and q, each a third of the way from the threshold."""
    noise = unit(np.random.default_rng(seed).normal(size=q.shape))
    noise = unit(noise - np.einsum("ij,ij->i", noise, q)[:, None] * q)
    cosine = least + (1 - least) / 3
    return (cosine * q + np.sqrt(1 - cosine * cosine) * noise).astype(np.float32)


def audit(graph: Graph, q: np.ndarray, rows: np.ndarray, nodes: np.ndarray, least: float, beam: int = BEAM, recall: float = AUDIT_RECALL) -> list[tuple[int, int, int]]:
    """(beam, wanted, found) of the links (rows, nodes) for beams that double until all but few are found, or the beam holds the graph."""
    out, n = [], len(graph.x)
    wanted = np.unique(rows.astype(np.int64) * n + nodes)
    asked = np.unique(rows)
    while True:
        r, found = graph.within(q[asked], least, beam) if len(asked) else (asked, asked)
        hits = int(np.isin(wanted, asked[r].astype(np.int64) * n + found).sum())
        out.append((beam, len(wanted), hits))
        # A little better than asked for, since other shards may be worse.
        if hits >= (1 - (1 - recall) / 4) * len(wanted) or beam >= n:
            return out
        beam *= 2


def chosen_beam(rows: list[tuple[int, int, int, int]], recall: float = AUDIT_RECALL) -> tuple[int, float]:
    """(beam, measured recall) of the first beam that passes over all shards' (shard, beam, wanted, found); a shard that stopped
    earlier finds at least as much with wider beams."""
    beams = sorted({b for _, b, _, _ in rows})
    measured = 1.0
    for beam in beams:
        last: dict[int, tuple[int, int, int]] = {}
        for shard, b, wanted, found in rows:
            if b <= beam and b >= last.get(shard, (0, 0, 0))[0]:
                last[shard] = (b, wanted, found)
        wanted, found = sum(x[1] for x in last.values()), sum(x[2] for x in last.values())
        measured = found / wanted if wanted else 1.0
        if measured >= recall:
            return beam, measured
    return (beams[-1] if beams else BEAM), measured


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _verified(left: np.ndarray, right: np.ndarray, rows: np.ndarray, nodes: np.ndarray, threshold: float) -> np.ndarray:
    keep = np.zeros(len(rows), bool)
    for at in range(0, len(rows), PAIRS_AT_ONCE):
        a, b = left[rows[at : at + PAIRS_AT_ONCE]], right[nodes[at : at + PAIRS_AT_ONCE]]
        norm = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
        keep[at : at + PAIRS_AT_ONCE] = np.einsum("ij,ij->i", a, b) / norm >= threshold
    return keep


def _summary(pieces: Iterator[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, copies: np.ndarray) -> pd.DataFrame:
    """Counts of links (b = -1) and star edges of the components of the links between places of ids; a piece is dropped when counted."""
    count, low = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for i, j in pieces:
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])
        i, j = low[i], low[j]
        if (i == j).all():
            continue
        new = np.arange(len(ids))
        while True:
            last = new.copy()
            np.minimum.at(new, i, last[j])
            np.minimum.at(new, j, last[i])
            new = new[new]
            if (new == last).all():
                break
        low = new[low]
    some = np.flatnonzero(count)
    star = np.flatnonzero(low != np.arange(len(ids)))
    table = {"a": np.concatenate([ids[some], ids[star]]), "b": np.concatenate([np.full(len(some), -1), ids[low[star]]]), "n": np.concatenate([count[some], np.zeros(len(star))])}
    return pd.DataFrame(table).astype("int64")


_OPEN: dict[str, tuple] = {}


def _write(body: bytes, folder: str, shard: int) -> str:
    """A file of its own for each attempt; the one whose name is returned is whole."""
    system, root = _file_system(folder)
    system.create_dir(root, recursive=True)
    name = f"graph-{shard}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{root}/{name}", compression=None) as f:
        f.write(body)
    return f"{folder}/{name}"


def _read(path: str) -> tuple:
    """(graph, vectors, ids, copies); the worker holds the last one."""
    if path not in _OPEN:
        _OPEN.clear()
        system, name = _file_system(path)
        with system.open_input_file(name) as f:
            _OPEN[path] = pickle.loads(f.read())
    return _OPEN[path]


class Shards:
    """The table's classes and its graphs."""

    def __init__(self, classes: DataFrame, least_shards: int = SHARDS):
        n, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
        self.width = width or 1
        self.shards = shard_count(n, max(1, SHARD_BYTES // (4 * self.width)), least_shards)
        self.blocks = -(-n // (self.shards * ROWS_PER_BLOCK)) or 1
        self.dealt = classes.select("c", "copies", "v", F.pmod(F.xxhash64("c"), F.lit(self.shards)).cast("int").alias("shard"))
        folder, width = new_folder(classes.sparkSession, "graphs"), self.width

        def build(frame: pd.DataFrame) -> pd.DataFrame:
            vectors = _matrix(frame["v"], width)
            small = vectors.astype(np.float32)
            kept = small if (small == vectors).all() else vectors
            body = pickle.dumps((Graph(unit(vectors)), kept, frame["c"].to_numpy(), frame["copies"].to_numpy()), 5)
            shard = int(frame["shard"].iloc[0])
            return pd.DataFrame({"shard": [shard], "path": [_write(body, folder, shard)]})

        self.graphs = stored(self.dealt.groupBy("shard").applyInPandas(build, "shard int, path string"), "graphs")

    def audited(self, threshold: float, sample_rows: int = AUDIT_ROWS) -> tuple[int, float]:
        """The beam for the table, and the recall that the sample measures at it."""
        least, width = threshold - SLACK, self.width
        # The sample is bounded, and so is what reaches the driver.
        sample = self.dealt.orderBy(F.xxhash64("c", F.lit(7)), "c").limit(sample_rows).select("c", "v").toPandas()
        ids, q = sample["c"].to_numpy(), unit(_matrix(sample["v"], width)) if len(sample) else np.empty((0, width))
        twins, q = turned(q, least), q.astype(np.float32)

        def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for shard, path in zip(frame["shard"], frame["path"]):
                    graph, _, own, _ = _read(path)
                    rows, nodes = true_links(q, graph.x, least)
                    apart = own[nodes] != ids[rows]
                    rows, nodes = rows[apart], nodes[apart]
                    place = {c: i for i, c in enumerate(own.tolist())}
                    here = [(len(q) + i, place[c]) for i, c in enumerate(ids.tolist()) if c in place]
                    rows, nodes = (np.append(a, [h[k] for h in here]).astype(np.int64) for k, a in ((0, rows), (1, nodes)))
                    found = audit(graph, np.concatenate([q, twins]), rows, nodes, least)
                    yield pd.DataFrame([(shard, *x) for x in found], columns=["shard", "beam", "wanted", "found"])

        spread = self.graphs.repartition(self.shards, "shard")
        rows = spread.mapInPandas(check, "shard int, beam long, wanted long, found long").collect()
        return chosen_beam([tuple(r) for r in rows])

    def links(self, threshold: float, beam: int) -> DataFrame:
        """(a, b, n): counts of links of class a (b = -1), and edges a - b that join what is linked."""
        shards, blocks, width = self.shards, self.blocks, self.width
        number = lambda shard, of, block: (shard * F.lit(shards) + of) * F.lit(blocks) + block
        pairs = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("shard")), lambda o: F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(o.alias("of"), k.alias("block"))))))
        left = self.graphs.select("path", "shard", pairs.alias("t")).select("path", number(F.col("shard"), F.col("t.of"), F.col("t.block")).alias("task"), (F.col("t.of") == F.col("shard")).alias("own"))
        to = F.explode(F.sequence(F.col("shard"), F.lit(shards - 1))).alias("to")
        right = self.dealt.select("c", "copies", "v", "shard", to, F.pmod(F.xxhash64("c", F.lit(3)), F.lit(blocks)).cast("int").alias("block"))
        right = right.select("c", "copies", "v", number(F.col("to"), F.col("shard"), F.col("block")).alias("task"))

        def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
            graph, vectors, ids, copies = _read(left["path"].iloc[0])
            own, asked, c = left["own"].iloc[0], _matrix(right["v"], width), right["c"].to_numpy()
            if own:
                sort = np.argsort(ids)
                place, places, k = sort[np.searchsorted(ids, c, sorter=sort)], ids, copies
            else:
                place, places, k = np.arange(len(c)) + len(ids), np.concatenate([ids, c]), np.concatenate([copies, right["copies"]])

            def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for rows, nodes in graph.pieces(unit(asked).astype(np.float32), threshold - SLACK, beam):
                    if own:  # a pair of the graph's own vectors is looked for from the smaller number
                        later = ids[nodes] > c[rows]
                        rows, nodes = rows[later], nodes[later]
                    keep = _verified(asked, vectors, rows, nodes, threshold)
                    yield place[rows[keep]], nodes[keep]

            return _summary(found(), places, k)

        return stored(left.groupBy("task").cogroup(right.groupBy("task")).applyInPandas(search, "a long, b long, n long"), "links")


def vector_classes(embeddings: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, v, bad), and classes (c, rep, copies, v) of equal good vectors."""
    x = F.col(vector_col)
    bad = F.coalesce(F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))), F.lit(True)) | ~F.coalesce(F.exists(x, lambda c: c.cast("double") != 0), F.lit(False))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("v"), (bad | F.col(id_col).isNull()).alias("bad"))
    classes = rows.where(~F.col("bad")).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    return rows, stored(stored(classes, "vectors").withColumn("c", F.monotonically_increasing_id()), "vectors")


def near_duplicates(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, least_shards: int = SHARDS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: other rows with a cosine >= threshold, and the smallest id links reach.

    Vectors that are null, empty, zero or hold null or non-finite parts, and rows with a null id, link with nothing and are their
    own component; kept is true for them, also where the id is null. Repeated rows and equal vectors link with each other;
    shorter vectors end in zeros. A pair is found from one of its sides, so counts are symmetric. An empty table stays empty.
    """
    rows, classes = vector_classes(embeddings, id_col, vector_col)
    shards = Shards(classes, least_shards)
    beam, _ = shards.audited(threshold)
    found = shards.links(threshold, beam)
    links = found.where("b < 0").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "c")
    joined = components(found.where("b >= 0")).withColumnRenamed("node", "c")
    out = classes.join(links, "c", "left").join(joined, "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = out.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_vector = out.join(least, "component").select("v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.where("not bad").select("vec_id", "v").join(by_vector, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("bad").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
