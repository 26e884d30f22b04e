"""Removal of passages that repeat: windows of `width` words, found by a count-min prefilter and exact counts.

1. Sketch. Of every run of `width` words the smallest hash of its `gram`-word shingles is its anchor; equal windows
   have equal anchors, and about one shingle in 14 is an anchor. Each task counts its anchor positions in a
   sparse count-min sketch; the partial sketches meet by slices of cells, as many as the texts need, and only a bitmap of a
   fixed size (2**cells bits, 16 MiB by default; a bit says that some cell behind it was counted at least twice) comes to the
   driver and is broadcast. Counts are never too low: no repeated window is lost.
2. Exact counts. Only windows whose anchor is estimated to repeat leave the task. A task remembers windows it has met:
   one that repeats there goes at most twice, its places are told apart, so a passage found in every document costs a
   row or two a task, and no key collects more rows than that. They are grouped by 96 bits of hash.
3. The repeated starts meet their document again and the covered words go.

The bitmap fills up with anchors that do repeat, not with all; on inputs with hundreds of millions of those
step 2 passes more windows, all of them at worst. Results stay exact, and `cells` should grow with the memory of a worker.

Null and empty texts have no words. Very long texts are one document. A document that occurs in several rows repeats itself, as other copies do.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_bytes, blocks, counted, in_bitmap, mix, shingle_hashes, table, word_hashes, words

WIDTH, GRAM, CELLS = 35, 8, 27
BLOCK, SEEN = 2 << 20, 2_000_000


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of values[i : i + width] at each i, in log2(width) passes."""
    span, out = 1, values
    while span * 2 <= width:
        out = best(out[:-span], out[span:])
        span *= 2
    return best(out[: len(out) - (width - span)], out[width - span :]) if span < width else out


class Windows:
    """The windows of a block of texts."""

    def __init__(self, column, width: int, gram: int):
        data, offsets = arrow_bytes(column)
        starts, ends, self.offsets = words(data, offsets)
        self.width, self.hashes = width, word_hashes(data, starts, ends)
        n = len(self.hashes) - width + 1
        self.text = np.searchsorted(self.offsets, np.arange(max(n, 0)), side="right") - 1
        self.inside = np.arange(max(n, 0)) + width <= self.offsets[1:][self.text] if n > 0 else np.zeros(0, bool)
        self.grams, self.per = shingle_hashes(self.hashes, gram, salt=7), width - gram + 1
        self.anchor = sliding(self.grams, self.per, np.minimum) if n > 0 else np.zeros(0, np.uint64)

    def anchor_positions(self) -> np.ndarray:
        """Anchors of the windows, once for each position at which one stands (ties count each)."""
        if not self.inside.any():
            return np.zeros(0, np.uint64)
        pad = np.zeros(len(self.grams) + self.per - 1, np.uint64)
        pad[self.per - 1 : self.per - 1 + len(self.anchor)] = np.where(self.inside, self.anchor, 0)
        return self.grams[sliding(pad, self.per, np.maximum) == self.grams]


def repeated_anchors(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, cells: int = CELLS) -> np.ndarray:
    """A bitmap of the anchors that are estimated to stand at two positions or more, over all texts."""

    def anchors(batches):
        for part in blocks(batches, "text", BLOCK):
            yield Windows(part.column("text"), width, gram).anchor_positions()

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About one shingle in (width - gram + 2) / 2 is an anchor; words have six bytes or so.
    return counted(docs.select("text"), anchors, size // (3 * (width - gram + 2)), (2,), cells)[0]


class Seen:
    """What a task has met of windows, by their 96 bits of hash: bounded, and what doesn't fit is met anew."""

    def __init__(self, most: int = SEEN):
        self.most = most
        self.first, self.second, self.known = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, bool)

    def places(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Index of each window in the table, or -1."""
        if not len(self.first):
            return np.full(len(first), -1)
        at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        return np.where((self.first[at] == first) & (self.second[at] == second), at, -1)

    def add(self, first: np.ndarray, second: np.ndarray, known: np.ndarray) -> None:
        room = max(0, self.most - len(self.first))
        first = np.concatenate((self.first, first[:room]))
        order = np.argsort(first, kind="stable")
        self.first = first[order]
        self.second = np.concatenate((self.second, second[:room]))[order]
        self.known = np.concatenate((self.known, known[:room]))[order]


def versions(docs: DataFrame) -> DataFrame:
    """doc_id, text and version, which tells rows with one id apart: a hash of the text, or 0 where ids are enough."""
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    version = F.xxhash64("text") if again else F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return docs.select("doc_id", "text", version.alias("version"))


def repeated_starts(keyed: DataFrame, width: int = WIDTH, gram: int = GRAM, cells: int = CELLS, most: int = SEEN) -> DataFrame:
    """doc_id, version, starts and runs of versions(): the windows that start anywhere else too.

    starts are word positions; runs are little-endian 32-bit positions of windows that repeat within one task.
    """
    import pyarrow as pa

    shared = keyed.sparkSession.sparkContext.broadcast(repeated_anchors(keyed, width, gram, cells))

    def candidates(batches):
        bits, seen = shared.value, Seen(most)
        names = ["first", "second", "pos", "doc_id", "version", "runs"]
        for part in blocks(batches, "text", BLOCK):
            w = Windows(part.column("text"), width, gram)
            at = np.flatnonzero(w.inside)
            at = at[in_bitmap(bits, w.anchor[at])] if len(at) else at
            if not len(at):
                continue
            first = shingle_hashes(w.hashes, width)[at]
            second = shingle_hashes(w.hashes, width, salt=99)[at].astype(np.uint32)
            order = np.lexsort((second, first))
            f, s = first[order], second[order]
            new = np.ones(len(f), bool)
            new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(f)))
            place = seen.places(f[head], s[head])
            known = (place >= 0) & seen.known[place] if len(seen.known) else np.zeros(len(head), bool)
            lone = (place < 0) & (n == 1)
            # A window that this task meets alone, for the first time, goes with its document. One that repeats in this task has
            # no document, its places are told apart: it goes once and only tells others, and later not at all.
            seen.known[place[(place >= 0) & ~known]] = True
            seen.add(f[head][place < 0], s[head][place < 0], ~lone[place < 0])
            text, pos = w.text[at], at - w.offsets[w.text[at]]
            # In the order of the text, so that all but the hashes packs well.
            rows = np.sort(order[head[~known]])
            alone = np.zeros(len(at), bool)
            alone[order[head[lone]]] = True
            owner = pa.array(text[rows], pa.int32(), mask=~alone[rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array(first[rows].view(np.int64)), pa.array(second[rows].view(np.int32)), pa.array(pos[rows].astype(np.int32), mask=~alone[rows]), part.column("doc_id").take(owner), part.column("version").take(owner), pa.nulls(len(rows), pa.binary())], names=names
            )
            local = np.flatnonzero(~alone)
            if len(local):
                groups = np.split(local, np.flatnonzero(np.diff(text[local])) + 1)
                who = pa.array([int(text[g[0]]) for g in groups], pa.int32())
                runs = pa.array([pos[g].astype("<u4").tobytes() for g in groups], pa.binary())
                # Spread by the text's place: these rows only travel with the others.
                spread = mix(np.array([int(text[g[0]]) for g in groups], np.uint64) + w.hashes[at[[g[0] for g in groups]]]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(np.zeros(len(groups), np.int32)), pa.nulls(len(groups), pa.int32()), part.column("doc_id").take(who), part.column("version").take(who), runs], names=names)

    kind = dict(keyed.dtypes)["doc_id"]
    rows = keyed.mapInArrow(candidates, f"first long, second int, pos int, doc_id {kind}, version long, runs binary")
    same = Window.partitionBy("first", "second")
    total = rows.withColumn("n", F.count(F.when(F.col("runs").isNull(), 1)).over(same))
    marks = total.where("runs IS NOT NULL OR (n >= 2 AND pos IS NOT NULL)")
    return marks.groupBy("doc_id", "version").agg(F.collect_list("pos").alias("starts"), F.collect_list("runs").alias("runs"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, cells: int = CELLS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the words that stay, joined by one space), kept_sha256."""
    import pyarrow as pa

    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = versions(docs)
    marks = repeated_starts(keyed, width, gram, cells).select(F.col("doc_id").alias("mark_id"), F.col("version").alias("mark_version"), "starts", "runs")
    joined = keyed.join(marks, keyed["doc_id"].eqNullSafe(marks["mark_id"]) & (keyed["version"] == marks["mark_version"]), "left")

    def finish(batches):
        for part in blocks(batches, "text", BLOCK):
            n, gone, kept, sums = [], [], [], []
            for text, starts, runs in zip(*(part.column(c).to_pylist() for c in ("text", "starts", "runs"))):
                ws = text.encode().split()
                n.append(len(ws))
                if starts or runs:
                    edge = np.zeros(len(ws) + 1, np.int64)
                    for at in (np.array(starts or [], np.int64), *(np.frombuffer(r, "<u4") for r in runs or [])):
                        at = np.unique(at)
                        edge[at] += 1
                        edge[at + width] -= 1
                    stay = np.cumsum(edge[:-1]) == 0
                    ws = [ws[i] for i in np.flatnonzero(stay)]
                gone.append(n[-1] - len(ws))
                kept.append(b" ".join(ws))
                sums.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sums, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return joined.select("doc_id", "text", "starts", "runs").mapInArrow(finish, f"doc_id {kind}, n_words long, n_removed long, kept string, kept_sha256 string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i+34], ' ')) AS h FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, w, list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(coalesce(gone, []), p)) AS keep
      FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, len(w) AS n_words, len(w) - len(keep) AS n_removed,
       sha256(coalesce(array_to_string(list_transform(keep, lambda p: w[p]), ' '), '')) AS kept_sha256
FROM k
"""
