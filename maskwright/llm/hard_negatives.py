"""Hard negatives: for each anchor and each of its nearest rows of the same label, the nearest rows of other labels inside a
window of scores.

A score is the integer inner product of scaled vectors, higher first, ties by smaller id. The index is product quantisation:
every row is stored as a code for each two dimensions with the norm of what the code misses there (its residual), rounded up. A
table of products of an anchor with all centroids gives the row's approximate score by lookups, and the norms of the
anchor's parts times the residuals bound the error (Cauchy-Schwarz, dimension pair by pair). So no row that belongs in a result is
ever filtered out: a row is a candidate unless its upper bound is below the k-th best lower bound, or its bounds miss the
window. Candidates get their exact integer score, so results are exact and recall is 1, whatever the data and codebook.

Rows are packed into blocks, and blocks are dealt into groups; blocks of anchors go to each group and meet its blocks in a
merge join, in pairs of blocks. What is kept is at most k rows an anchor and group. Nothing is broadcast but the codebook, which
is fitted on at most SAMPLE vectors (those of least id hash); every row is indexed.

Rows without an id, label or vector, or with a null or non-finite component, take no part; neither do vectors so large (scaled norm 2**31 or
more) that scores might not fit in a long. Of rows that repeat an id the one of smallest label, then vector, takes part. Shorter
vectors count as filled with zeros. Empty tables, and anchors without rows in a window, give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, save, table

#: Greatest number of vectors that the codebook is fitted on, and centroids for each part of WIDTH dimensions.
SAMPLE, CENTROIDS, WIDTH, ROUNDS = 4096, 256, 2, 6
#: Rows of a block and anchors of a block (fewer for long vectors), rows of a group, anchors looked up at a time.
BLOCK, ANCHORS, GROUP, STRIP = 1024, 256, 1 << 18, 64
ROWS = "block long, ids binary, labels binary, codes binary, missed binary, vecs binary"


# ---- codebook and codes ------------------------------------------------------------------


def fit(sample: np.ndarray) -> np.ndarray:
    """Centroids (parts, CENTROIDS, WIDTH) of vectors (n, parts * WIDTH): k-means in each part from evenly spread seeds."""
    parts = sample.reshape(len(sample), sample.shape[1] // WIDTH, WIDTH).transpose(1, 0, 2)
    book = np.zeros((len(parts), CENTROIDS, WIDTH))
    for points, centroids in zip(parts, book):
        seeds = np.unique(points, axis=0)
        seeds = seeds[np.linspace(0, len(seeds) - 1, CENTROIDS).astype(int)] if len(seeds) else np.zeros((CENTROIDS, WIDTH))
        centroids[:] = seeds
        for _ in range(ROUNDS):
            near = nearest(points, centroids)
            n = np.bincount(near, minlength=CENTROIDS)
            for k in range(WIDTH):
                total = np.bincount(near, points[:, k], CENTROIDS)
                centroids[:, k] = np.where(n > 0, total / np.maximum(n, 1), centroids[:, k])
    return book


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points @ (-2 * centroids.T) + (centroids**2).sum(1)).argmin(1) if len(points) else np.zeros(0, int)


def encode(vecs: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (parts, n) and an upper bound of the residual's norm (parts, n) that also covers rounding of scores."""
    parts = vecs.astype(float).reshape(len(vecs), -1, WIDTH).transpose(1, 0, 2)
    codes, missed = np.zeros(parts.shape[:2], np.uint8), np.zeros(parts.shape[:2], np.float32)
    for k, (points, centroids) in enumerate(zip(parts, book)):
        codes[k] = nearest(points, centroids)
        held = centroids[codes[k]]
        far = np.linalg.norm(points - held, axis=1) + 1e-9 * (np.linalg.norm(points, axis=1) + np.linalg.norm(held, axis=1))
        missed[k] = np.nextafter(far.astype(np.float32), np.float32(np.inf))
    return codes, missed


def _matrix(column, dims: int) -> np.ndarray:
    """An Arrow column of integer lists as a matrix with dims columns; shorter lists end in zeros."""
    out = np.zeros((len(column), dims), np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _packed(vecs: np.ndarray) -> bytes:
    small = not vecs.size or np.abs(vecs).max() < 1 << 31
    return vecs.astype(np.int32 if small else np.int64).tobytes()


def _unpacked(data: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if len(data) == 4 * n * dims else np.int64).reshape(n, dims).astype(np.int64)


# ---- search in pairs of blocks -----------------------------------------------------------


class _Best:
    """The best k rows of each slot by score, then smaller id."""

    def __init__(self, slots: int, k: int):
        self.slots, self.k = slots, k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def least(self) -> np.ndarray:
        """The k-th best score of each slot, minus infinity where there are fewer."""
        out = np.full(self.slots, -np.inf)
        full = np.bincount(self.slot, minlength=self.slots) == self.k
        ends = np.flatnonzero(np.diff(self.slot, append=-1))
        out[self.slot[ends]] = self.score[ends]
        return np.where(full, out, -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        heads = np.searchsorted(slot, slot)
        keep = np.arange(len(slot)) - heads < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each column, minus infinity where there are fewer rows."""
    return np.partition(values, len(values) - k, axis=0)[len(values) - k] if len(values) >= k else np.full(values.shape[1], -np.inf)


def _exact(rows: np.ndarray, anchors: np.ndarray, r: np.ndarray, a: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 21) // max(1, rows.shape[1]))
    out = [np.einsum("ij,ij->i", rows[r[i : i + step]], anchors[a[i : i + step]]) for i in range(0, len(r), step)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def search(rows: dict, anchors: dict, book: np.ndarray, best: _Best) -> None:
    """Add what a block of rows has for a block of anchors to best. A slot is a window of an anchor: its owner, whether labels must agree, and
    the least and greatest score."""
    owners = anchors["owner"]
    for first in range(0, len(anchors["ids"]), STRIP):
        own = slice(first, min(first + STRIP, len(anchors["ids"])))
        vecs = anchors["vecs"][own].astype(float).reshape(own.stop - own.start, -1, WIDTH)
        about = np.zeros((len(rows["ids"]), len(vecs)))
        for k, centroids in enumerate(book):
            about += np.take(centroids @ vecs[:, k].T, rows["codes"][k], axis=0)
        error = rows["missed"].T.astype(float) @ np.linalg.norm(vecs, axis=2).T
        same = rows["labels"][:, None] == anchors["labels"][None, own]
        usable = same & (rows["ids"][:, None] != anchors["ids"][None, own]) if anchors["same"] else ~same
        slots = np.arange(*np.searchsorted(owners, (own.start, own.stop)))
        if not len(slots):
            continue
        at = owners[slots] - own.start
        upper, lower, usable = (about + error)[:, at], (about - error)[:, at], usable[:, at]
        low, high = anchors["low"][slots].astype(float), anchors["high"][slots].astype(float)
        least = best.least()[slots]
        if (least == -np.inf).any():
            sure = usable & (lower >= low) & (upper <= high)
            least = np.maximum(least, _kth(np.where(sure, lower, -np.inf), best.k))
        r, s = np.nonzero(usable & (upper >= np.maximum(low, least)) & (lower <= high))
        slot = slots[s]
        score = _exact(rows["vecs"], anchors["vecs"], r, owners[slot])
        good = (score >= anchors["low"][slot]) & (score <= anchors["high"][slot])
        best.add(slot[good], score[good], rows["ids"][r[good]])


def _pairs(blocks: DataFrame, anchors: DataFrame, groups: int, book: np.ndarray, dims: int, k: int, same: bool) -> DataFrame:
    """anchor_id, positive_id, positive_score, found_id, found_score: at most k an anchor's window and group of blocks."""
    import pyarrow as pa

    ints = lambda x: np.frombuffer(x, np.int64)

    def run(batches):
        def settled(anchors, best):
            own = anchors["owner"][best.slot]
            columns = (anchors["ids"][own], anchors["positive"][best.slot], anchors["score"][best.slot], best.id, best.score)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "positive_id", "positive_score", "found_id", "found_score"])

        current, held, best = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["anchors"], row["group"]) != current:
                    if held:
                        yield settled(held, best)
                    current = row["anchors"], row["group"]
                    ids = ints(row["a_ids"])
                    held = {"ids": ids, "labels": ints(row["a_labels"]), "vecs": _unpacked(row["a_vecs"], len(ids), dims), "same": same}
                    held |= {name: ints(row[name]) for name in ("owner", "positive", "score", "low", "high")}
                    best = _Best(len(held["owner"]), k)
                ids = ints(row["ids"])
                rows = {"ids": ids, "labels": ints(row["labels"]), "vecs": _unpacked(row["vecs"], len(ids), dims)}
                rows |= {"codes": np.frombuffer(row["codes"], np.uint8).reshape(len(book), -1), "missed": np.frombuffer(row["missed"], np.float32).reshape(len(book), -1)}
                search(rows, held, book, best)
        if held:
            yield settled(held, best)

    sent = anchors.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = sent.join(blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).hint("merge"), "group")
    return met.mapInArrow(run, "anchor_id long, positive_id long, positive_score long, found_id long, found_score long")


def _best_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of each key, with their rank; each task keeps its own first k before anything is shuffled."""
    order = Window.partitionBy(*keys).orderBy(F.desc("found_score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _anchor_blocks(anchors: DataFrame, dims: int, low: int, high: int) -> DataFrame:
    """Blocks of anchors (anchors, id, label, vec, positives) with a slot for each positive; without positives one slot for any score."""
    import pyarrow as pa

    names = ("a_ids", "a_labels", "a_vecs", "owner", "positive", "score", "low", "high")
    wide = np.iinfo(np.int64)

    def pack(group):
        ids, labels = group.column("id").to_numpy(), group.column("label").to_numpy()
        slots = [(i, *p) for i, own in enumerate(group.column("positives").to_pylist()) for p in ([(0, 0, wide.min, wide.max)] if own is None else [(x["id"], x["score"], -(-low * x["score"] // 100), high * x["score"] // 100) for x in own])]
        columns = np.array(slots, np.int64).reshape(-1, 5).T
        vecs = _packed(_matrix(group.column("vec").combine_chunks(), dims))
        values = [ids.astype(np.int64).tobytes(), labels.astype(np.int64).tobytes(), vecs, *(np.ascontiguousarray(c).tobytes() for c in columns)]
        return pa.table([group.column("anchors")[:1], *(pa.array([v], pa.binary()) for v in values)], names=["anchors", *names])

    return anchors.groupBy("anchors").applyInArrow(pack, "anchors int, " + ", ".join(f"{n} binary" for n in names))


def _row_blocks(rows: DataFrame, book: np.ndarray, dims: int) -> DataFrame:
    import pyarrow as pa
    from pyspark import TaskContext

    size = max(1, min(BLOCK, (1 << 18) // dims))

    def run(batches):
        n = 0
        held = []

        def block(table):
            vecs = _matrix(table.column("vec").combine_chunks(), dims)
            codes, missed = encode(vecs, book)
            values = [table.column("id").to_numpy().astype(np.int64).tobytes(), table.column("label").to_numpy().astype(np.int64).tobytes(), codes.tobytes(), missed.tobytes(), _packed(vecs)]
            number = (TaskContext.get().partitionId() << 32) + n
            return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([v], pa.binary()) for v in values)], names=["block", "ids", "labels", "codes", "missed", "vecs"])

        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= size:
                whole = pa.Table.from_batches(held)
                yield block(whole.slice(0, size))
                n += 1
                held = whole.slice(size).to_batches()
        if sum(map(len, held)):
            yield block(pa.Table.from_batches(held))

    return rows.select("id", "label", "vec").mapInArrow(run, ROWS)


def usable_rows(embeddings: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, label and vec (scaled integers) of the rows that take part."""
    vec = F.col("raw")
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("raw"))
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & vec.isNotNull() & finite)
    rows = rows.select("id", "label", F.transform(vec, lambda x: F.floor(x * float(scale))).alias("vec"))
    rows = rows.where(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")) < 2.0**62)
    return rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row")).select("id", "row.label", "row.vec")


def hard_negatives(
    embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor reads the column id; a negative's score is from
    low to high hundredths of the positive's."""
    spark = embeddings.sparkSession
    rows = save(usable_rows(embeddings, id_col, label_col, vector_col, scale), "vectors")
    n, longest, asked = rows.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.count_if(is_anchor)).first()
    dims = -(-max(longest or 0, 1) // WIDTH) * WIDTH
    most = max(CENTROIDS, min(SAMPLE, (1 << 20) // dims))
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < min(1 << 20, (most << 21) // max(n, 1) + 1)
    sample = [r.vec for r in rows.where(share).orderBy(F.xxhash64("id")).limit(most).select("vec").collect()]
    points = np.zeros((len(sample), dims))
    for i, vec in enumerate(sample):
        points[i, : len(vec)] = vec
    book = fit(points)
    blocks = save(_row_blocks(rows, book, dims), "codes")
    groups = int(max(1, n // GROUP, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 256)))
    parts = max(1, -(-asked // max(1, min(ANCHORS, (1 << 16) // dims))))
    anchors = rows.where(is_anchor).withColumn("anchors", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int"))
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
    found = _pairs(blocks, _anchor_blocks(anchors.withColumn("positives", none), dims, low, high), groups, book, dims, positives, same=True)
    near = save(_best_of(found.select("anchor_id", "found_id", "found_score"), ["anchor_id"], positives), "positives")
    windows = near.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("found_id").alias("id"), F.col("found_score").alias("score"))).alias("positives"))
    asked_rows = anchors.join(windows.withColumnRenamed("anchor_id", "id"), "id")
    found = _pairs(blocks, _anchor_blocks(asked_rows, dims, low, high), groups, book, dims, negatives, same=False)
    out = save(_best_of(found, ["anchor_id", "positive_id"], negatives), "negatives")
    for used in (rows, blocks, near):
        drop(used)
    return out.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("found_score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("id") % 50 == 0)


OP11_SQL = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 3
"""
