"""Problem 2: the k most similar vectors for every vector.

A partitioned index with score-aware four-bit quantisation, used for a join of all vectors
with all others of their dimension:

1. equal vectors become one (copies are ordered by id again at the end);
2. partition centres and codebooks are fitted on a bounded sample (SAMPLE vectors of each
   dimension, drawn by hash); the quantisation loss weighs the part of the residual parallel
   to the vector more than the rest, as only that part moves high inner products;
3. every vector goes to its SPREAD nearest partitions, as entry and as query;
4. a partition is one task: codes of four bits are scanned by lookup tables, two codes a
   lookup for a block of queries at once, and the best candidates are scored again with the
   exact vectors at hand. Where a least cosine is asked for, the candidates are all whose
   scanned score is not too low for it by what the entry lost in its code.
   Partitions far above the usual size are divided again by centres of their own; what is
   large even then is cut into tiles of queries and of entries, and every pair of tiles is a task.

Work grows with the number of vectors as long as the number of partitions does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.tables import Stage

#: Vectors of each dimension that centres and codebooks are fitted on; every vector is indexed.
SAMPLE = 30_000
#: Entries meant for a partition (before spreading), partitions a vector goes to, entries of a tile.
PARTITION, SPREAD, TILE = 700, 4, 8192
#: Candidates scored exactly for each query and partition.
RERANK = 96
#: Inner products over this count for the score-aware loss.
THRESHOLD = 0.2
#: Queries and entries scanned at once, so that their scores and tables stay in a core's cache.
QUERIES, ENTRIES = 64, 2048
#: What float32 may take from a scanned score.
ROUNDING = 1e-4

_CODES, _WIDTH = 16, 2


class Index:
    """Centres and codebooks for one dimension."""

    def __init__(self, sample: np.ndarray, count: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        parts = int(max(1, min(count // PARTITION, len(sample) // 16)))
        self.centres = _spherical_means(sample, parts, rng)
        near = _nearest(sample, self.centres, 1)[:, 0]
        self.pad = -self.dim % (2 * _WIDTH)
        x = self._padded(sample)
        r = x - self._padded(self.centres)[near]
        t = THRESHOLD**2
        self.parallel = max(1.0, (self.dim - 1) * t / (1 - t))
        self.books = self._fit(r, x, rng)

    def _padded(self, v: np.ndarray) -> np.ndarray:
        return np.pad(v, ((0, 0), (0, self.pad))) if self.pad else v

    def _fit(self, r: np.ndarray, x: np.ndarray, rng) -> np.ndarray:
        m = r.shape[1] // _WIDTH
        parts, sides = r.reshape(len(r), m, _WIDTH), x.reshape(len(x), m, _WIDTH)
        books = parts[rng.choice(len(parts), _CODES)].transpose(1, 0, 2).copy()
        for _ in range(8):
            codes = self._encode(parts, sides, books)
            chosen = books[np.arange(m), codes]
            left = ((parts - chosen) * sides).sum(2)
            total = left.sum(1)
            for j in range(m):
                rest = total - left[:, j]
                target = rest + (parts[:, j] * sides[:, j]).sum(1)
                for c in range(_CODES):
                    of = codes[:, j] == c
                    if of.sum() < 2:
                        books[j, c] = parts[rng.integers(len(parts)), j]
                        continue
                    s = sides[of, j]
                    w = self.parallel - 1
                    a = np.eye(_WIDTH) * of.sum() + w * s.T @ s
                    b = parts[of, j].sum(0) + w * (target[of, None] * s).sum(0)
                    books[j, c] = np.linalg.solve(a, b)
        return books.astype(np.float32)

    def _encode(self, parts: np.ndarray, sides: np.ndarray, books: np.ndarray, rounds: int = 1) -> np.ndarray:
        """Codes by the score-aware loss: nearest ones first, then one coordinate after the other."""
        n, m, _ = parts.shape
        plain = np.empty((m, n, _CODES), np.float32)  # squared distance
        along = np.empty((m, n, _CODES), np.float32)  # parallel residual
        for j in range(m):
            plain[j] = (parts[:, j] ** 2).sum(1)[:, None] - 2 * parts[:, j] @ books[j].T + (books[j] ** 2).sum(1)
            along[j] = (parts[:, j] * sides[:, j]).sum(1)[:, None] - sides[:, j] @ books[j].T
        codes = plain.argmin(2)
        rows = np.arange(n)
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(0)
        for _ in range(rounds):
            for j in range(m):
                rest = total - along[j, rows, codes[j]]
                codes[j] = (plain[j] + (self.parallel - 1) * (rest[:, None] + along[j]) ** 2).argmin(1)
                total = rest + along[j, rows, codes[j]]
        return codes.T

    def assign(self, v: np.ndarray) -> np.ndarray:
        return _nearest(v, self.centres, min(SPREAD, len(self.centres)))

    def search(self, part: int, ids: np.ndarray, v: np.ndarray, query: np.ndarray, entry: np.ndarray, k: int, least: float | None) -> list[tuple]:
        """For each query row of a partition its best entry rows: (id, ids, cosines).

        Entries whose scanned score may belong to ``least`` are all scored exactly; without it the
        best RERANK are.
        """
        x = self._padded(v)
        centre = self._padded(self.centres[part : part + 1])
        d, d_ids = x[entry], ids[entry]
        x, ids = x[query], ids[query]
        if not len(d) or not len(x):
            return []
        m = x.shape[1] // _WIDTH
        codes = self._encode((d - centre).reshape(len(d), m, _WIDTH), d.reshape(len(d), m, _WIDTH), self.books)
        pairs = (codes[:, 0::2] * _CODES + codes[:, 1::2]).astype(np.uint8).T.copy()  # two codes a byte
        keep = min(RERANK, len(d))
        reach = None if least is None else self._reach(d, centre, codes, least)[:, None]
        out = []
        for b in range(0, len(x), QUERIES):
            q, q_ids = x[b : b + QUERIES], ids[b : b + QUERIES]
            score = self._scan(q, centre, pairs)
            if least is not None:
                cols, rows = np.divmod(np.flatnonzero(score >= reach), len(q))
                other = q_ids[rows] != d_ids[cols]
                rows, cols = rows[other], cols[other]
                if len(rows) <= len(q) * keep:
                    exact = np.einsum("ij,ij->i", q[rows], d[cols], dtype=np.float64)
                else:  # so many that all products at once cost less
                    exact = (q.astype(np.float64) @ d.T.astype(np.float64))[rows, cols]
                good = exact >= least
                out += _by_row(q_ids, rows[good], d_ids[cols[good]], exact[good], k)
                continue
            score = score.T.copy()
            score[q_ids[:, None] == d_ids[None]] = -9
            best = np.argpartition(-score, keep - 1, axis=1)[:, :keep] if keep < len(d) else np.tile(np.arange(len(d)), (len(q), 1))
            exact = np.einsum("bd,bkd->bk", q, d[best]).astype(np.float64)
            exact[q_ids[:, None] == d_ids[best]] = -9
            order = np.argsort(-exact, axis=1, kind="stable")[:, :k]
            exact, best = np.take_along_axis(exact, order, 1), np.take_along_axis(best, order, 1)
            for i in range(len(q)):
                ok = exact[i] >= -1.5
                if ok.any():
                    out.append((int(q_ids[i]), d_ids[best[i][ok]].tolist(), exact[i][ok].tolist()))
        return out

    def _scan(self, q: np.ndarray, centre: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Scanned scores, a row an entry and a column a query, so that a lookup copies one run of numbers."""
        m = q.shape[1] // _WIDTH
        table = np.matmul(self.books, q.reshape(len(q), m, _WIDTH).transpose(1, 2, 0))
        table = (table[0::2, :, None] + table[1::2, None]).reshape(m // 2, _CODES * _CODES, len(q))
        score = np.repeat(centre @ q.T, pairs.shape[1], 0)
        found = np.empty((min(ENTRIES, len(score)), len(q)), np.float32)
        for b in range(0, len(score), ENTRIES):
            some = score[b : b + ENTRIES]
            for j in range(m // 2):
                some += np.take(table[j], pairs[j, b : b + ENTRIES], axis=0, out=found[: len(some)], mode="clip")  # no code is out of range
        return score

    def _reach(self, d: np.ndarray, centre: np.ndarray, codes: np.ndarray, least: float) -> np.ndarray:
        """For each entry the lowest scanned score of a unit vector whose cosine with it is ``least`` or more.

        With the residual's part p along the entry and t across it, a vector of cosine c scans as
        c (1 - p) - t sqrt(1 - c^2) at least; of the c from ``least`` to 1 the lowest of these counts.
        """
        r = (d - centre - self.books[np.arange(codes.shape[1]), codes].reshape(d.shape)).astype(np.float64)
        p = (r * d).sum(1)
        t = np.sqrt(np.maximum((r * r).sum(1) - p * p, 0))
        c = np.clip((p - 1) / np.maximum(np.hypot(1 - p, t), 1e-12), least, 1)
        return (c * (1 - p) - t * np.sqrt(1 - c * c) - ROUNDING).astype(np.float32)


def _by_row(q_ids, rows, found, exact, k) -> list[tuple]:
    out = []
    order = np.lexsort((-exact, rows))
    rows, found, exact = rows[order], found[order], exact[order]
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else []
    for s, e in zip(starts, [*starts[1:], len(rows)]):
        e = min(e, s + k)
        out.append((int(q_ids[rows[s]]), found[s:e].tolist(), exact[s:e].tolist()))
    return out


def _nearest(v: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    out = []
    for b in range(0, len(v), 4096):
        s = v[b : b + 4096] @ centres.T
        out.append(np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1)))
    return np.concatenate(out) if out else np.zeros((0, n), int)


def _spherical_means(v: np.ndarray, parts: int, rng, rounds: int = 8) -> np.ndarray:
    centres = v[rng.choice(len(v), parts, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(v, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, v)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres.astype(np.float32)


def _array(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, dim)


def unit_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, dim, v (unit vector as float32 bytes). Null vectors, and ones with a null, NaN or infinite
    number or without length, have no direction and are left out."""

    @F.pandas_udf("binary")
    def unit(vectors: pd.Series) -> pd.Series:
        out = []
        for x in vectors:
            x = np.asarray(x, np.float64)
            n = np.linalg.norm(x)
            out.append((x / n).astype(np.float32).tobytes() if np.isfinite(n) and n > 0 else None)
        return pd.Series(out, dtype=object)

    whole = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    data = rows.where(F.col(key).isNotNull() & whole).select(F.col(key).alias("key"), F.size(vector).alias("dim"), unit(F.col(vector)).alias("v"))
    return data.where(F.col("v").isNotNull())


def fit(table: DataFrame) -> dict[int, Index]:
    """An index for each dimension, fitted on the driver from a bounded sample."""
    out = {}
    for dim, n in sorted((r["dim"], r["n"]) for r in table.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()):
        share = -(-SAMPLE * 2**20 // n)
        drawn = table.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("v"), F.lit(2**20)) < share)).select("v").collect()
        out[dim] = Index(_array([r.v for r in drawn], dim), n)
    return out


def nearest(rows: DataFrame, key: str, vector: str, k: int = 10, least: float | None = None) -> DataFrame:
    """key, neighbour, cosine: for each vector the k most similar others of its dimension.

    Equal cosines are ordered by key. ``least`` leaves out lower cosines, which are then not
    even sent. Approximate: recall of the exact 10 is given in the README. Repeated rows of a
    key count once; a key with several vectors keeps the one that comes first by its bytes.
    """
    stage = Stage(rows.sparkSession, "nearest")
    table = unit_vectors(rows, key, vector).groupBy("key").agg(F.min(F.struct("v", "dim")).alias("s")).select("key", "s.dim", "s.v")
    table = stage.put(table.withColumn("n", F.monotonically_increasing_id()))
    same = table.groupBy("dim", "v").agg(F.min("n").alias("rep"), F.count(F.lit(1)).alias("copies"))
    firsts = stage.put(same)
    models = fit(firsts)

    def route(batches):
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                if not len(part):
                    continue
                to = models[dim].assign(_array(part["v"], dim))
                at = np.repeat(np.arange(len(part)), to.shape[1])
                yield pd.DataFrame({"dim": dim, "part": to.ravel().astype(np.int32), "n": part["rep"].to_numpy()[at], "v": part["v"].to_numpy()[at]})

    routed = firsts.select("dim", "rep", "v").mapInPandas(route, "dim int, part int, n long, v binary").withColumn("sub", F.lit(0))
    large = {}
    if firsts.count() > TILE:  # the routes are cheap enough to be counted first
        large = _larger_than_a_tile(routed)
    if large:
        routed = stage.put(_divided(stage, routed, large))
        large = _larger_than_a_tile(routed)
    routed = _tiled(routed, large)

    def scan(group, data):
        dim, part = group[0], group[1]
        found = models[dim].search(part, data["n"].to_numpy(), _array(data["v"], dim), data["query"].to_numpy(), data["entry"].to_numpy(), k, least)
        return pd.DataFrame(found, columns=["n", "near", "cosine"]).astype({"n": "int64"})

    hits = routed.groupBy("dim", "part", "sub", "asks", "tile").applyInPandas(scan, "n long, near array<long>, cosine array<double>")
    # a partition's answers to a query are merged as arrays, k long each
    merged = hits.groupBy("n").agg(F.flatten(F.collect_list(F.arrays_zip("cosine", "near"))).alias("all"))
    best = F.slice(F.reverse(F.array_sort(F.array_distinct("all"))), 1, k)
    pairs = merged.select("n", F.explode(best).alias("b")).select("n", F.col("b.near").alias("m"), F.col("b.cosine").alias("cosine"))
    return _with_copies(stage, table, firsts, pairs, k)


def _larger_than_a_tile(routed: DataFrame) -> dict[tuple[int, int, int], int]:
    """Sizes of the partitions above TILE; of them there are as many as centres at most."""
    sizes = routed.groupBy("dim", "part", "sub").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE)
    return {(r["dim"], r["part"], r["sub"]): r["n"] for r in sizes.collect()}


def _marked(routed: DataFrame, sizes: dict, column: str, value) -> DataFrame:
    rows = [(*key, int(value(n))) for key, n in sizes.items()]
    marks = routed.sparkSession.createDataFrame(rows, f"dim int, part int, sub int, {column} int")
    return routed.join(F.broadcast(marks), ["dim", "part", "sub"], "left")


def _divided(stage: Stage, routed: DataFrame, large: dict) -> DataFrame:
    """Large partitions divided by centres of their own, fitted in one task each on at most
    SAMPLE of their vectors; every vector goes to its two nearest. Rows meet their partition's
    centres in groups of bounded size, so no centre is sent to all tasks."""
    rows = _marked(routed, large, "size", lambda n: n)
    big = rows.where("size is not null")
    per_part = F.least(F.lit(SAMPLE), F.greatest(F.lit(64), (F.col("size") * 32 / (PARTITION * SPREAD)).cast("int")))
    drawn = big.where(F.pmod(F.xxhash64("v", F.lit(5)), F.lit(2**20)) < per_part / F.col("size") * 2**20)

    def centres(group, data):
        v = _array(data["v"], group[0])
        parts = max(1, min(-(-int(data["size"].iloc[0]) // (PARTITION * SPREAD)), len(v) // 8))
        found = _spherical_means(v, parts, np.random.default_rng(group[1]))
        return pd.DataFrame({"dim": [group[0]], "part": [group[1]], "rows": [int(data["size"].iloc[0])], "centres": [found.tobytes()]}).astype({"dim": "int32", "part": "int32"})

    fitted = stage.put(drawn.groupBy("dim", "part").applyInPandas(centres, "dim int, part int, rows long, centres binary"))
    asked = big.withColumn("salt", F.pmod(F.xxhash64("n"), F.ceil(F.col("size") / 50_000).cast("long")))
    salts = F.ceil(F.col("rows") / 50_000)
    each = fitted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), (salts - 1).cast("long"))))

    def divide(group, vectors, own):
        dim = group[0]
        to = _nearest(_array(vectors["v"], dim), _array(own["centres"], dim), min(2, len(own["centres"].iloc[0]) // (4 * dim)))
        at = np.repeat(np.arange(len(vectors)), to.shape[1])
        return pd.DataFrame({"dim": dim, "part": group[1], "n": vectors["n"].to_numpy()[at], "v": vectors["v"].to_numpy()[at], "sub": 1 + to.ravel()}).astype({"dim": "int32", "part": "int32", "sub": "int32"})

    keys = ["dim", "part", "salt"]
    parts = asked.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInPandas(divide, "dim int, part int, n long, v binary, sub int")
    return rows.where("size is null").select("dim", "part", "n", "v", "sub").unionByName(parts)


def _tiled(routed: DataFrame, large: dict) -> DataFrame:
    """What is still large by tiles: a row asks in the groups (own tile, each tile) and is an entry in (each tile, own tile)."""
    if not large:
        return routed.withColumns({"asks": F.lit(0), "tile": F.lit(0), "query": F.lit(True), "entry": F.lit(True)})
    rows = _marked(routed, large, "tiles", lambda n: -(-n // TILE)).withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("n"), F.col("tiles")).cast("int"))
    all_ = F.sequence(F.lit(0), F.col("tiles") - 1)
    own = F.col("_own")
    groups = F.concat(F.transform(all_, lambda t: F.struct(own.alias("asks"), t.alias("tile"))), F.transform(F.filter(all_, lambda t: t != own), lambda t: F.struct(t.alias("asks"), own.alias("tile"))))
    rows = rows.withColumn("_g", F.explode(groups)).withColumns({"asks": F.col("_g.asks"), "tile": F.col("_g.tile")})
    return rows.withColumn("query", F.col("asks") == own).withColumn("entry", F.col("tile") == own).drop("tiles", "_own", "_g")


def _with_copies(stage: Stage, table: DataFrame, firsts: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """From pairs of different vectors to the k neighbours of every key, copies included."""
    members = stage.put(table.join(firsts.select("dim", "v", "rep", "copies"), ["dim", "v"]).select("key", "rep", "copies"))
    # the first k + 1 keys of a vector are enough for every list they can stand in
    order = Window.partitionBy("rep").orderBy("key")
    heads = members.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).select("rep", F.col("key").alias("neighbour"))
    other = pairs.join(heads, pairs["m"] == heads["rep"]).select(pairs["n"], "neighbour", "cosine")
    own = heads.join(firsts.where("copies > 1").select("rep"), "rep").select(F.col("rep").alias("n"), "neighbour", F.lit(1.0).alias("cosine"))
    reach = other.unionByName(own)
    reach = reach.withColumn("_r", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("_r") <= k + 1)
    lists = members.join(reach.select(F.col("n").alias("rep"), "neighbour", "cosine"), "rep").where("key <> neighbour")
    rank = Window.partitionBy("key").orderBy(F.desc("cosine"), "neighbour")
    return lists.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= k).select("key", "neighbour", "cosine")


def chunk_neighbours(chunks: DataFrame, k: int = 10, least: float | None = None) -> DataFrame:
    """p2_neighbours: chunk_id, neighbour_id, cosine."""
    rows = chunks.where(F.size("embedding") == F.col("embedding_dim")).select("id", "embedding")
    found = nearest(rows, "id", "embedding", k, least)
    return found.select(F.col("key").alias("chunk_id"), F.col("neighbour").alias("neighbour_id"), "cosine")


def similar_pairs(chunks: DataFrame, least: float = 0.95) -> DataFrame:
    """p2_found: chunk_id_1 < chunk_id_2, one among the 10 most similar of the other, cosine at least 0.95."""
    found = chunk_neighbours(chunks, 10, least)
    return found.select(F.least("chunk_id", "neighbour_id").alias("chunk_id_1"), F.greatest("chunk_id", "neighbour_id").alias("chunk_id_2")).distinct()
