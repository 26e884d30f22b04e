"""Toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy.

A word is four rows of hashed tables: two independent hashes of the whole word (so that a collision
in one is outvoted by the other) and hashes of its first four and five bytes (so that inflected forms share). Each row
has one fixed column, the z-score of the log odds of the bucket in toxic and clean training texts, and
learned columns. Filters of widths 1, 2 and 3 slide over the words of the whole text; the maximum over all positions
of each filter goes into a logistic layer. The z-scores of a training text leave the text itself out.

Thresholds are calibrated by language: the language is guessed from function words of the text (never from a
column), each language's threshold is chosen on training texts outside the fit, and scores are shifted so that
it becomes THRESHOLD.

Training takes at most MAX_TEXTS labelled texts of MAX_BYTES in all, those with the smallest hashes of their ids; everything
else is applied to every row. Texts are scored whole. Null and empty texts have no words and get the score of an empty text.
Repeated rows get equal scores; ids without exactly one label value are not learned from. Without labels of both kinds every score is 0.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_bytes, blocks, drop, save, table, word_hashes, words

BITS, LEARNED, FILTERS, WIDTHS = 16, 3, 6, (1, 2, 3)
TABLES = 4
DIM = TABLES * (1 + LEARNED)
MAX_TEXTS, MAX_BYTES, EPOCHS, BATCH, RATE, THRESHOLD = 6_000, 64 << 20, 4, 48, 0.02, 0.7

_READ = np.full(256, 32, np.uint8)
_READ[48:58] = np.arange(48, 58)
_READ[97:123] = np.arange(97, 123)
_READ[65:91] = np.arange(97, 123)
_READ[128:] = np.arange(128, 256)

#: Common function words by language, to guess a text's language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are with as be this by at from".split(),
    "de": "der die und das ist ein eine den von mit zu auf für im nicht auch des dem".split(),
    "fr": "le la les et des est un une du que dans pour sur qui au par en de".split(),
    "es": "el la los las de que y en un una es por con para del se no lo".split(),
}


def _word_hash(words_: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words_).encode(), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]))
    return word_hashes(data, starts, ends)


def language_table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of function words and for each the share of every language that has it."""
    share: dict[int, np.ndarray] = {}
    for k, ws in enumerate(FUNCTION_WORDS.values()):
        for h in _word_hash(ws).tolist():
            share.setdefault(h, np.zeros(len(FUNCTION_WORDS), np.float32))[k] = 1
    keys = np.array(sorted(share), np.uint64)
    return keys, np.array([share[h] / share[h].sum() for h in keys.tolist()], np.float32)


class Reader:
    """Texts of a block as buckets of the four tables and a guessed language."""

    def __init__(self):
        self.keys, self.shares = language_table()

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """buckets [words, TABLES], offsets of texts into words, language of each text."""
        data, offsets = arrow_bytes(column)
        data = _READ[data]
        starts, ends, at = words(data, offsets)
        whole = word_hashes(data, starts, ends)
        parts = [whole & np.uint64((1 << BITS) - 1), (whole >> np.uint64(24)) & np.uint64((1 << BITS) - 1)]
        for size in (4, 5):
            parts.append(word_hashes(data, starts, np.minimum(starts + size, ends)) & np.uint64((1 << BITS) - 1))
        buckets = np.stack(parts, 1).astype(np.int32) if len(starts) else np.zeros((0, TABLES), np.int32)
        place = np.minimum(np.searchsorted(self.keys, whole), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[place] == whole) if len(whole) else np.zeros(0, np.int64)
        votes = np.zeros((len(at) - 1, self.shares.shape[1]), np.float32)
        np.add.at(votes, np.searchsorted(at, hit, side="right") - 1, self.shares[place[hit]])
        return buckets, at, votes.argmax(1)


# ---- the network -------------------------------------------------------------------------


def z_scores(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """z of the log odds ratio of document counts, shrunk by a prior; within -3..3."""
    a, b = np.maximum(toxic, 0), np.maximum(clean, 0)
    p = 0.5 * (a + b + 0.1) / max(1, n_toxic + n_clean) + 1e-4
    x, y = a + p * 20, b + p * 20 * max(1.0, n_clean / max(1, n_toxic))
    odds = np.log(x / np.maximum(n_toxic - a + 1, 0.5)) - np.log(y / np.maximum(n_clean - b + 1, 0.5))
    return np.clip(odds / np.sqrt(1 / x + 1 / y) / 2, -3, 3).astype(np.float32)


class Network:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.z = np.zeros((TABLES, 1 << BITS), np.float32)
        self.table = r.normal(0, 0.05, (TABLES, 1 << BITS, LEARNED)).astype(np.float32)
        self.filters = [r.normal(0, 0.15, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        for f in self.filters:
            f[:, :: 1 + LEARNED, : FILTERS // 2] += 0.35 / len(f)
        self.bias = [np.full(FILTERS, -0.5, np.float32) for _ in WIDTHS]
        self.out = np.full(len(WIDTHS) * FILTERS, 0.3, np.float32)
        self.c = np.float32(-2)
        self.shift = np.zeros(len(FUNCTION_WORDS), np.float32)

    def embed(self, buckets: np.ndarray, z: np.ndarray | None = None) -> np.ndarray:
        z = self.z if z is None else z
        x = np.empty((len(buckets), TABLES, 1 + LEARNED), np.float32)
        for t in range(TABLES):
            x[:, t, 0] = z[t][buckets[:, t]]
            x[:, t, 1:] = self.table[t][buckets[:, t]]
        return x.reshape(len(buckets), DIM)

    @staticmethod
    def spaced(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x with rows of zeros after each text (no filter sees two texts), starts of texts, rows of words."""
        gap = max(WIDTHS)
        n = len(offsets) - 1
        text = np.repeat(np.arange(n), np.diff(offsets))
        rows = np.arange(len(x)) + gap * text
        wide = np.zeros((len(x) + gap * n, x.shape[1]), np.float32)
        wide[rows] = x
        return wide, offsets[:-1] + gap * np.arange(n), rows

    def pooled(self, wide: np.ndarray, starts: np.ndarray, places: bool = False):
        found, where = [], []
        for f, b in zip(self.filters, self.bias):
            k = len(f)
            n = len(wide) - k + 1
            z = wide[:n] @ f[0]
            for j in range(1, k):
                z += wide[j : n + j] @ f[j]
                z[starts[1:] - j] = -np.inf  # from there the filter would reach into the next text
            top = np.maximum.reduceat(z, starts, axis=0)
            if places:
                ends = np.append(starts[1:], n)
                where.append(np.array([s + z[s:e].argmax(0) for s, e in zip(starts, ends)]))
            found.append(top + b)
        return np.concatenate(found, 1), where

    def logits(self, buckets: np.ndarray, offsets: np.ndarray, z: np.ndarray | None = None) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0, np.float32)
        wide, starts, _ = self.spaced(self.embed(buckets, z), offsets)
        top, _ = self.pooled(wide, starts)
        return np.maximum(top, 0) @ self.out + self.c

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 1, epochs: int = EPOCHS) -> None:
        """texts: buckets of each; Adam on the weighted logistic loss, gradients through the pooled maxima."""
        r = np.random.default_rng(seed)
        n_toxic, n_clean = int(labels.sum()), int(len(labels) - labels.sum())
        counts = np.zeros((2, TABLES, 1 << BITS), np.float32)
        for b, y in zip(texts, labels):
            for t in range(TABLES):
                counts[y, t, np.unique(b[:, t])] += 1
        clean, toxic = counts
        self.z = z_scores(toxic, clean, n_toxic, n_clean)
        without = z_scores(toxic, clean - 1, n_toxic, n_clean - 1), z_scores(toxic - 1, clean, n_toxic - 1, n_clean)
        self.without = without
        weight = np.where(labels == 1, min(4.0, n_clean / n_toxic), 1.0).astype(np.float32)
        slots = [*self.filters, *self.bias, self.out]
        m, v, c_m, c_v, step = [np.zeros_like(s) for s in slots], [np.zeros_like(s) for s in slots], 0.0, 0.0, 0
        square = np.full(self.table.shape[:2], 1e-6, np.float32)
        for epoch in range(epochs):
            for batch in np.array_split(r.permutation(len(texts)), max(1, len(texts) // BATCH)):
                step += 1
                rate = RATE * (1 - (epoch / epochs)) + 1e-3
                offsets = np.cumsum([0, *(len(texts[i]) for i in batch)])
                buckets = np.concatenate([texts[i] for i in batch])
                x = np.concatenate([self.embed(texts[i], without[labels[i]]) for i in batch])
                wide, starts, rows = self.spaced(x, offsets)
                top, where = self.pooled(wide, starts, places=True)
                h = np.maximum(top, 0)
                p = 1 / (1 + np.exp(-(h @ self.out + self.c)))
                g = (p - labels[batch]) * weight[batch] / len(batch)
                grads = [np.zeros_like(s) for s in slots]
                grads[-1][:] = h.T @ g + 1e-4 * self.out
                dh = (g[:, None] * self.out) * (top > 0)
                back = np.zeros_like(wide)
                for i, f in enumerate(self.filters):
                    d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                    grads[len(self.filters) + i][:] = d.sum(0)
                    for j in range(len(f)):
                        at = where[i] + j
                        for q in range(FILTERS):
                            grads[i][j, :, q] = d[:, q] @ wide[at[:, q]]
                            np.add.at(back, at[:, q], d[:, q, None] * f[j, :, q])
                used = np.flatnonzero(back[rows].any(1))
                dx = back[rows[used]].reshape(-1, TABLES, 1 + LEARNED)[:, :, 1:]
                for t in range(TABLES):
                    b = buckets[used, t]
                    np.add.at(square[t], b, (dx[:, t] ** 2).mean(1))
                    np.add.at(self.table[t], b, -0.3 * rate * dx[:, t] / np.sqrt(square[t][b])[:, None])
                for k, (s, d) in enumerate(zip(slots, grads)):
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.99 * v[k] + 0.01 * d * d
                    s -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
                d = float(g.sum())
                c_m, c_v = 0.9 * c_m + 0.1 * d, 0.99 * c_v + 0.01 * d * d
                self.c = np.float32(self.c - rate * (c_m / (1 - 0.9**step)) / ((c_v / (1 - 0.99**step)) ** 0.5 + 1e-7))

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, languages: np.ndarray, least: int = 25) -> None:
        """Per language the logit that best parts the two kinds, precision first; few toxic texts: that of all."""
        aim = np.log(THRESHOLD / (1 - THRESHOLD))
        common = cut(logits, labels)
        for k in range(len(self.shift)):
            own = languages == k
            self.shift[k] = aim - (cut(logits[own], labels[own]) if labels[own].sum() >= least else common)

    def scores(self, logits: np.ndarray, languages: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((logits + self.shift[languages]).astype(np.float64), -40, 40)))


def cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap after which F0.7 is highest."""
    order = np.argsort(-logits, kind="stable")
    y, s = labels[order], logits[order].astype(float)
    hits = np.cumsum(y)
    precision, recall = hits / np.arange(1, len(y) + 1), hits / max(1, y.sum())
    f = 1.49 * precision * recall / np.maximum(0.49 * precision + recall, 1e-9)
    best = int(f.argmax())
    below = s[best + 1] if best + 1 < len(s) else s[best] - 1
    # Nearer to the clean side only where the gap is wide.
    return float(s[best] - 0.5 * min(s[best] - below, 2.0))


# ---- Spark -------------------------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TEXTS, most_bytes: int = MAX_BYTES, seed: int = 1) -> Network | None:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1). None without texts of both kinds.

    The sample: labelled ids in the order of their hashes, at most `most`, one text each (of several, that of least hash),
    until their texts would have more than most_bytes. So what the driver gets has a bound.
    """
    import pyarrow as pa

    one = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("label_id"), "toxic")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    found = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"), F.min("toxic").alias("toxic"))
    found = save(found, "labelled")
    sample = found
    if (found.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > most_bytes:
        sizes = found.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0))).collect()
        sample = found.where(F.col("doc_id").isin([i for (i, _), total in zip(sizes, np.cumsum([n for _, n in sizes]).tolist()) if total <= most_bytes]))

    def run(batches):
        read = Reader()
        for part in blocks(batches, "text", 1 << 20):
            buckets, at, languages = read(part.column("text"))
            rows = [buckets[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.string()), part.column("toxic").cast(pa.int32()), pa.array(languages, pa.int32()), pa.array(rows, pa.binary())], names=["doc_id", "toxic", "language", "buckets"])

    rows = sample.mapInArrow(run, "doc_id string, toxic int, language int, buckets binary").collect()
    drop(found)
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], bytes(r["buckets"])))
    y = np.array([r["toxic"] for r in rows], np.int64)
    if not len(y) or y.sum() in (0, len(y)):
        return None
    texts = [np.frombuffer(bytes(r["buckets"]), np.int32).reshape(-1, TABLES) for r in rows]
    languages = np.array([r["language"] for r in rows])
    del rows
    # Thresholds come from texts that the fit behind them has not seen: two halves judge each other.
    fold = np.random.default_rng(seed).permutation(len(y)) % 2
    held = np.zeros(len(y), np.float32)
    for k in (0, 1):
        inside = np.flatnonzero(fold != k)
        if y[inside].sum() in (0, len(inside)):
            held[:] = np.nan
            break
        half = Network(seed)
        half.fit([texts[i] for i in inside], y[inside], seed)
        held[fold == k] = _all_logits(half, [texts[i] for i in np.flatnonzero(fold == k)])
    network = Network(seed)
    network.fit(texts, y, seed)
    if not np.isnan(held).any():
        network.calibrate(held, y, languages)
    del network.without  # not needed for scoring
    return network


def _all_logits(network: Network, texts: list[np.ndarray]) -> np.ndarray:
    out = []
    for k in range(0, len(texts), 256):
        some = texts[k : k + 256]
        out.append(network.logits(np.concatenate(some), np.cumsum([0, *map(len, some)])))
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text)."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        read, model = Reader(), shared.value
        for part in blocks(batches, "text", 1 << 20):
            if model is None:
                found = np.zeros(part.num_rows)
            else:
                buckets, at, languages = read(part.column("text"))
                found = model.scores(model.logits(buckets, at), languages)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects; all columns, one pass, no shuffle of texts."""
    network = train(docs, labels.where(fold_of() != 1).select("doc_id", "toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        import pyarrow as pa

        read, model = Reader(), shared.value
        for part in blocks(batches, "text", 1 << 20):
            if model is not None:
                buckets, at, languages = read(part.column("text"))
                part = part.filter(pa.array(model.scores(model.logits(buckets, at), languages) < THRESHOLD))
            yield part

    return docs.mapInArrow(run, docs.schema)


def fold_of(doc_id="doc_id"):
    """crc32 of the id as text, modulo 3: rows with 1 are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns only from labelled rows outside the held-out fold."""
    allowed = labels.where(fold_of() != 1).select("doc_id", "toxic")
    return score(docs, train(docs, allowed)).select(
        "doc_id", F.coalesce(fold_of() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
