"""Near-duplicate join on word n-grams: exact Jaccard links, without listing all pairs of a group.

The prefix filter with rare-first order: two sets with Jaccard >= t share one of the first |x| - ceil(t |x|) + 1
n-grams of either, in any global order. The order is by estimated document frequency (counters of a fixed number
over all texts), rare first, then by hash; an estimate may be too high, never inconsistent.

1. prefixes: per text the set's fingerprint, size and prefix n-grams, written once. Equal sets become one node.
2. counts: how many nodes have an n-gram in their prefix, by packed partial counts. Two bitmaps of fixed size follow:
   n-grams that more than one node may have, and crowded ones, that `crowd` nodes or more may have. Both only err on
   the side of more, and with a bitmap that fills up more postings travel; results don't depend on it.
3. pairs of n-grams that aren't crowded, at most `crowd` a posting, made distinct so that each is verified once. Length and
   positional filters are join conditions; the suffix filter runs before the full intersection.
4. hub rounds for crowded n-grams, in buckets by n-gram and class of sizes (the length filter). Each round deals a bucket
   anew into parts of about `part` members; of each part two members, its hubs, are compared with those of other
   components. So no member is in many pairs, and there are about as many as members, however large the bucket. Links
   merge components, and buckets inside one component are done. The rounds go on while they connect much; then the
   pairs of different components that are left are made as in step 3, by keys of an n-gram and two classes of sizes: a
   place in a prefix bounds the sizes of partners, so members go only to classes in which they can link.

Components come from the links by star rounds; nothing about all documents reaches the driver.

Texts without words have an empty set and link with nothing. Nulls count as empty. Very long texts are one set like
others. Repeated rows are copies of one node; rows with one id and different texts are in one component. An empty table
gives an empty result. Other columns are ignored. Ids may be of any type with an order; those that aren't integers get
numbers first. near_duplicates links rows by their id: one without an id is in a component only if its set equals that
of a row with one. keep_one_of_each numbers such rows first.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_bytes, blocks, bounded_batches, counted, delete, drop, in_bitmap, mix, private, save, scratch, scratch_path, shingle_hashes, table, twin, word_hashes, words

#: Logarithms of the number of frequency counters, of the bits of each of the two bitmaps of n-grams, and of the bitmap of nodes.
SKETCH, CELLS, MARKS = 25, 27, 26
BLOCK = 1 << 19
#: Classes of sizes for a ratio of sizes that may link.
FINE = 8


def ngram_sets(column, width: int):
    """Yields for each text its sorted distinct n-gram hashes; with fewer words, the whole sequence as one."""
    data, offsets = arrow_bytes(column)
    starts, ends, at = words(data, offsets)
    hashes = word_hashes(data, starts, ends, fold=True)
    whole = shingle_hashes(hashes, width)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            yield np.unique(whole[a : b - width + 1])
        elif b > a:
            yield shingle_hashes(hashes[a:b], b - a, salt=width)
        else:
            yield np.zeros(0, np.uint64)


def counter_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def document_frequency(docs: DataFrame, width: int, bits: int = SKETCH) -> np.ndarray:
    """uint8[2**bits]: logarithms of how many texts have an n-gram of the counter."""
    import pyarrow as pa

    size = min(1 << 18, 1 << bits)
    slices = (1 << bits) // size

    def count(batches):
        # Within a task 255 stands for all above it, too; only the order of n-grams depends on it.
        counters = np.zeros(1 << bits, np.uint8)
        for part in blocks(batches, "text", BLOCK):
            sets = list(ngram_sets(part.column("text"), width))
            found, n = np.unique(counter_of(np.concatenate(sets), bits), return_counts=True)
            counters[found] = np.minimum(counters[found] + n, 255)
        for k, piece in enumerate(counters.reshape(slices, size)):
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())], names=["slice", "counts"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                held.setdefault(k, np.zeros(size, np.uint32))[:] += np.frombuffer(zlib.decompress(packed), np.uint8)
        for k, piece in held.items():
            logs = np.minimum(255, np.round(8 * np.log2(piece.astype(float) + 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(logs.tobytes(), 1)], pa.binary())], names=["slice", "logs"])

    partial = docs.select("text").mapInArrow(count, "slice int, counts binary")
    out = np.zeros((slices, size), np.uint8)
    for k, logs in partial.repartition(slices, "slice").mapInArrow(merge, "slice int, logs binary").collect():
        out[k] = np.frombuffer(zlib.decompress(logs), np.uint8)
    return out.reshape(-1)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefixes(docs: DataFrame, width: int, percent: int, bits: int = SKETCH) -> DataFrame:
    """doc_id, n, a and b (fingerprint of the set) and prefix (its n-grams in global order)."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(document_frequency(docs, width, bits))

    def run(batches):
        logs = shared.value
        for part in blocks(batches, "text", BLOCK):
            n, a, b, prefix = [], [], [], []
            for s in ngram_sets(part.column("text"), width):
                n.append(len(s))
                mixed = mix(s ^ np.uint64(0x5851F42D4C957F2D))
                a.append(int(np.bitwise_xor.reduce(mixed)) if len(s) else 0)
                b.append(int(np.add.reduce(mix(mixed))) if len(s) else 0)
                # Rare first, then by hash: the sort is stable and s is sorted.
                order = np.argsort(logs[counter_of(s, bits)], kind="stable")
                prefix.append(s[order[: prefix_size(len(s), percent)]].view(np.int64) if len(s) else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix)))],
                names=["doc_id", "n", "a", "b", "prefix"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, a long, b long, prefix array<long>")


# ---- which n-grams can link --------------------------------------------------------------


def postings_of(firsts: DataFrame, crowd: int, cells: int = CELLS) -> DataFrame:
    """node, n, few and many: the node's prefix n-grams (gram, pos) that another node may have, by whether they are crowded."""
    import pyarrow as pa

    def prefix_of(batches):
        for batch in batches:
            yield batch.column("prefix").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)

    total = firsts.agg(F.sum(F.size("prefix"))).first()[0] or 0
    shared = firsts.sparkSession.sparkContext.broadcast(counted(firsts.select("prefix"), prefix_of, total, (2, crowd), cells))

    def run(batches):
        again, often = shared.value
        for batch in batches:
            lists = batch.column("prefix")
            grams = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            owner, first = np.repeat(np.arange(len(lists)), lengths), np.concatenate(([0], np.cumsum(lengths)))
            crowded = in_bitmap(often, grams.view(np.uint64))
            columns = []
            for keep in (in_bitmap(again, grams.view(np.uint64)) & ~crowded, crowded):
                keep = np.flatnonzero(keep)
                ends = np.searchsorted(owner[keep], np.arange(len(lists) + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(grams[keep]), pa.array((keep - first[owner[keep]]).astype(np.int32))], names=["gram", "pos"])
                columns.append(pa.ListArray.from_arrays(pa.array(ends), items))
            out = pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), *columns], names=["node", "n", "few", "many"])
            yield out.filter(pa.array([len(x) + len(y) > 0 for x, y in zip(*columns)], pa.bool_()))

    items = "array<struct<gram:bigint,pos:int>>"
    return firsts.select("node", "n", "prefix").mapInArrow(run, f"node long, n long, few {items}, many {items}")


# ---- sets and verification ---------------------------------------------------------------


def pack48(grams: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.sort(grams & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(data) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def marks_of(nodes: DataFrame, bits: int = MARKS) -> np.ndarray:
    """A bitmap of nodes, by hash: partial ones meet by slices, and the whole, of a fixed size, comes to the driver."""
    import pyarrow as pa

    size = 1 << min(17, bits - 3)
    slices = (1 << (bits - 3)) // size

    def mark(batches):
        seen = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            h = mix(batch.column("node").to_numpy().view(np.uint64)) & np.uint64((1 << bits) - 1)
            np.bitwise_or.at(seen, (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
        for k, piece in enumerate(seen.reshape(slices, size)):
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())], names=["slice", "bits"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column("slice").to_pylist(), batch.column("bits").to_pylist()):
                held.setdefault(k, np.zeros(size, np.uint8))[:] |= np.frombuffer(zlib.decompress(packed), np.uint8)
        for k, piece in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())], names=["slice", "bits"])

    kind = "slice int, bits binary"
    out = np.zeros((slices, size), np.uint8)
    for k, packed in nodes.select("node").mapInArrow(mark, kind).repartition(slices, "slice").mapInArrow(merge, kind).collect():
        out[k] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return out.reshape(-1)


class Sets:
    """A table of node and grams (the set's hashes, 48 bits each) of the nodes, bucketed by node: it travels once.

    The few other texts that the bitmap lets through, and repeated rows, do no harm to joins with pairs.
    """

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int, bits: int = MARKS):
        import pyarrow as pa

        self.spark = docs.sparkSession
        shared = self.spark.sparkContext.broadcast(marks_of(nodes, bits))

        def run(batches):
            seen = shared.value
            for part in blocks(batches, "text", BLOCK):
                ids = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                h = mix(ids.view(np.uint64)) & np.uint64((1 << bits) - 1)
                part = part.take(pa.array(np.flatnonzero((seen[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1)))
                grams = [pack48(s) for s in ngram_sets(part.column("text"), width)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(grams, pa.binary())], names=["node", "grams"])

        buckets = max(64, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.name, self.path = f"ngram_sets_{uuid.uuid4().hex}", scratch_path(self.spark, "sets")
        out = docs.mapInArrow(run, "node long, grams binary").repartition(buckets, "node").write
        out.bucketBy(buckets, "node").sortBy("node").format("parquet").option("path", self.path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """An upper bound of the intersection: parts of both between the same pivots can share at most the smaller."""
    if depth == 0 or len(x) < 16 or len(y) < 16:
        return min(len(x), len(y))
    pivot = y[len(y) // 2]
    k = int(np.searchsorted(x, pivot))
    j = len(y) // 2
    return suffix_bound(x[:k], y[:j], depth - 1) + suffix_bound(x[k:], y[j:], depth - 1)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets have 100 * intersection >= percent * union."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            keep = []
            for i, (gx, gy) in enumerate(zip(batch.column("gx"), batch.column("gy"))):
                x, y = unpack48(gx.as_buffer()), unpack48(gy.as_buffer())
                total = len(x) + len(y)
                need = -(-percent * total // (100 + percent))
                if suffix_bound(x, y) < need:
                    continue
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                if int((both[1:] == both[:-1]).sum()) >= need:
                    keep.append(i)
            out = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([out.column("x"), out.column("y")], names=["x", "y"])

    one = sets.select(F.col("node").alias("x"), F.col("grams").alias("gx"))
    two = sets.select(F.col("node").alias("y"), F.col("grams").alias("gy"))
    return pairs.select("x", "y").join(one, "x").join(two, "y").select("x", "y", "gx", "gy").mapInArrow(run, "x long, y long")


# ---- components --------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that links reach) of every node in links (x, y).

    Alternating large-star and small-star steps: each star hangs on the smallest neighbour, so rows never
    outnumber the links and a component of any shape is done in a logarithmic number of rounds.
    """
    edges = save(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), twin("u"))
        # The extra key gives both sides an exchange of their own, so a large star can be split at run time.
        tagged = both.withColumn("twin", twin("u"))
        large = save(tagged.join(least, ["u", "twin"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        drop(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumn("twin", twin("u"))
        tagged = large.withColumn("twin", twin("u")).join(least, ["u", "twin"])
        small = tagged.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = save(small.where("u <> v").distinct(), "small")
        drop(large)
        h = F.xxhash64("u", "v")
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 20))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", hub_rounds: int = 12, crowd: int = 64, part: int = 128) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id that links of at least percent reach)."""
    kind = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if isinstance(kind, T.IntegralType):
        found = _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, percent, hub_rounds, crowd, part)
        return found.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_shingles", F.col("component_id").cast(kind).alias("component_id"))
    # Numbers are written once, so that a row's number doesn't change between uses.
    numbered = save(docs.withColumn("number", F.monotonically_increasing_id()), "numbered")
    classes = _classes(numbered.select(F.col("number").alias("doc_id"), "text"), width, percent, hub_rounds, crowd, part)
    found = save(numbered.join(classes, numbered["number"] == classes["doc_id"]).select(numbered["doc_id"], "n_shingles", classes["component_id"].alias("class")), "classes")
    least = found.groupBy("class").agg(F.min("doc_id").alias("component_id")).withColumn("twin", twin("class"))
    return found.withColumn("twin", twin("class")).join(least, ["class", "twin"]).select("doc_id", "n_shingles", "component_id")


def _classes(docs: DataFrame, width: int, percent: int, hub_rounds: int, crowd: int, part: int) -> DataFrame:
    """near_duplicates of (doc_id long, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with scratch(spark) as keep:
        every = save(prefixes(docs, width, percent), "prefixes")
        # Equal sets are one node, that of the smallest id; their prefixes are equal too.
        firsts = save(every.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("node"), F.first("prefix").alias("prefix")), "firsts")
        rows = keep(save(every.select("doc_id", "a", "b", "n"), "rows"))
        drop(every)
        nodes = save(firsts.select("a", "b", "n", "node"), "nodes")
        posted = save(postings_of(firsts.where("node IS NOT NULL"), crowd), "posted")
        drop(firsts)

        pairs = save(_pairs(posted.select("node", "n", F.inline("few")), percent), "pairs")
        # A bucket is a crowded n-gram and a class of sizes: each set is in its class and the next one, so that two
        # sets whose sizes allow a link share a bucket, the one of the greater class.
        own = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100) * (1 + 1e-6))).cast("int")
        spots = F.flatten(F.transform("many", lambda p: F.transform(F.array(own, own + 1), lambda k: F.struct(p["gram"].alias("gram"), k.alias("k"), p["pos"].alias("pos")))))
        active = save(posted.where(F.size("many") > 0).select("node", "n", own.alias("own"), spots.alias("spots")), "active")
        drop(posted)
        used = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).union(active.select("node")).distinct()
        belongs = save(used.withColumn("component", F.col("node")), "belongs")
        sets = Sets(docs, belongs, width)
        try:
            belongs = _merge(belongs, save(verify(pairs, sets.read(), percent), "links"))
            belongs = _settle(active, belongs, pairs, sets.read(), percent, hub_rounds, part)
        finally:
            sets.drop()
        classes = keep(save(nodes.join(belongs, "node", "left").select("a", "b", "n", F.coalesce("component", "node").alias("component")), "classes"))
    out = rows.join(classes, ["a", "b", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def _settle(active: DataFrame, belongs: DataFrame, tried: DataFrame, sets: DataFrame, percent: int, hub_rounds: int, part: int) -> DataFrame:
    """belongs after all links in crowded buckets. active: node, n, own and spots (gram, k, pos), a row a node."""
    fits = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
    for turn in range(hub_rounds + 1):
        live = _unsettled(active, belongs)
        drop(active)
        active = live
        if turn == hub_rounds or not live.limit(1).count():
            break
        spread = live.select("node", "n", "component", F.size("spots").alias("central"), F.inline("spots"))
        dealt = spread.withColumn("part", F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("size") / part)))
        # Of each part the member with most crowded n-grams, so with the fewest rare ones: it links with most. Then one
        # by hash, often the same one for all n-grams that its members share.
        member, chance = F.struct("node", "n", "component"), F.xxhash64("node", F.lit(-1 - turn))
        hubs = dealt.groupBy("gram", "k", "part").agg(F.array(F.max_by(member, F.struct("central", chance)), F.min_by(member, chance)).alias("hubs"))
        hubs = hubs.select("gram", "k", "part", F.explode(F.array_distinct("hubs")).alias("hub"))
        hubs = hubs.select("gram", "k", "part", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.component").alias("hub_component"))
        near = dealt.join(hubs, ["gram", "k", "part"]).where((F.col("component") != F.col("hub_component")) & fits)
        near = near.select(F.least("node", "hub").alias("x"), F.greatest("node", "hub").alias("y")).distinct()
        near = save(near.join(tried, ["x", "y"], "left_anti"), "pairs")
        tried = tried.union(near)
        found = save(verify(near, sets, percent), "links")
        n_pairs, n_found = near.count(), found.count()
        if n_found:
            belongs = _merge(belongs, found)
        if n_found < 0.02 * n_pairs or not n_found:
            active = _unsettled(live, belongs)
            break
    # What no hub has settled in the crowded buckets: all pairs of different components that are left.
    if active.limit(1).count():
        rest = _pairs_apart(active, percent).join(tried, ["x", "y"], "left_anti")
        belongs = _merge(belongs, save(verify(rest, sets, percent), "links"))
    return belongs


def _unsettled(active: DataFrame, belongs: DataFrame) -> DataFrame:
    """A row a node with its component and its spots, now with the bucket's size, in buckets in which more than one component is left."""
    placed = active.select("node", "n", "own", "spots").join(belongs, "node")
    spread = placed.select("node", "n", "own", "component", F.inline("spots"))
    mixed = spread.groupBy("gram", "k").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"))
    mixed = mixed.where("low <> high").select("gram", "k", "size", twin("gram"))
    live = spread.drop("size").withColumn("twin", twin("gram")).join(mixed, ["gram", "k", "twin"])
    return save(live.groupBy("node", "n", "own", "component").agg(F.collect_list(F.struct("gram", "k", "pos", "size")).alias("spots")), "active")


def _allowed(percent: int):
    """The length and positional filters on x_n, x_pos, y_n and y_pos.

    At the first n-gram that both prefixes have, what is behind it bounds the intersection; later ones have less behind them.
    """
    need = F.ceil(F.lit(percent) * (F.col("x_n") + F.col("y_n")) / F.lit(100.0 + percent) - 1e-9)
    rest_of = 1 + F.least(F.col("x_n") - F.col("x_pos") - 1, F.col("y_n") - F.col("y_pos") - 1)
    return (F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent) & (rest_of >= need)


def _sides(one: DataFrame, two: DataFrame) -> tuple[DataFrame, DataFrame]:
    return one.select(*[F.col(c).alias(f"x_{c}") for c in one.columns]), two.select(*[F.col(c).alias(f"y_{c}") for c in two.columns])


def _pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (x < y) of nodes with an n-gram in common that the length and positional filters allow."""
    rows = postings.select("gram", "node", "n", "pos")
    one, two = _sides(rows, rows)
    found = one.join(two, (F.col("x_gram") == F.col("y_gram")) & (F.col("x_node") < F.col("y_node")) & _allowed(percent))
    return found.select(F.col("x_node").alias("x"), F.col("y_node").alias("y")).distinct()


def _pairs_apart(active: DataFrame, percent: int, share: int = 1024) -> DataFrame:
    """Distinct pairs (x < y) of different components with a crowded n-gram in common, as _allowed lets them.

    What is behind an n-gram's place in a prefix bounds the sizes of the sets that its set can link with there. So a member
    goes only to the classes of partners' sizes (`FINE` for a ratio of sizes that may link) within that bound, and only keys of
    n-gram, greater and smaller class with members on both sides are joined: texts that share a passage too short to
    link them never meet. Where the n-gram before it, of those left, is the same in both prefixes, a pair isn't made again: so
    a passage gives a pair once, not once for each of its n-grams. A key with more than `share` members on its greater side
    is dealt to several tasks: each has a share of them and all of the other side.
    """
    ordered, again = private("ordered"), private("again")
    sort = F.array_sort(F.array_distinct(F.transform("spots", lambda s: F.struct(s["pos"].alias("pos"), s["gram"].alias("gram")))))

    def with_last(s, i):
        return F.struct(s["pos"].alias("pos"), s["gram"].alias("gram"), F.get(F.col(ordered), i - 1)["gram"].alias("last"))

    def size_class(n):
        return F.floor(F.log(n.cast("double")) * float(-FINE / np.log(percent / 100))).cast("int")

    rows = active.withColumn(ordered, sort).withColumn(again, F.transform(ordered, with_last)).select("node", "n", "component", F.inline(again))
    # need <= n - pos solved for the partner's size; a class may hold sizes that are too great, which _allowed leaves out.
    most = F.least(F.floor((100 + percent) * (F.col("n") - F.col("pos")) / F.lit(float(percent)) + 1e-6) - F.col("n"), F.floor(100 * F.col("n") / F.lit(float(percent)) + 1e-6))
    least = F.ceil(F.col("n") * percent / F.lit(100.0) - 1e-6)
    rows = rows.withColumn("own", size_class(F.col("n"))).where(most >= least)
    rows = rows.select("*", F.explode(F.sequence(size_class(least), size_class(most))).alias("other"))
    rows = save(rows.select("*", F.greatest("own", "other").alias("high"), F.least("own", "other").alias("low")).drop("other"), "sides")
    key = ["gram", "high", "low"]
    greater, smaller = F.col("own") == F.col("high"), F.col("own") == F.col("low")
    met = rows.groupBy(*key).agg(F.count_if(greater).alias("g"), F.count_if(smaller).alias("s"), F.min("component").alias("c"), F.max("component").alias("d"))
    met = met.where("g > 0 AND s > 0 AND c <> d").select(*key, F.ceil(F.col("g") / share).alias("shares"), twin("gram"))
    rows = save(rows.withColumn("twin", twin("gram")).join(met, [*key, "twin"]).drop("twin"), "buckets")
    tasks = int(active.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = rows.where(greater).withColumn("share", F.pmod(F.xxhash64("node"), "shares")).repartition(tasks, *key, "share")
    two = rows.where(smaller).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).repartition(tasks, *key, "share")
    one, two = _sides(one, two)
    same = (F.col("x_gram") == F.col("y_gram")) & (F.col("x_high") == F.col("y_high")) & (F.col("x_low") == F.col("y_low")) & (F.col("x_share") == F.col("y_share"))
    # Within one class both sides have all members.
    ready = same & ((F.col("x_high") > F.col("x_low")) | (F.col("x_node") < F.col("y_node"))) & (F.col("x_component") != F.col("y_component"))
    found = one.join(two, ready & F.coalesce(F.col("x_last") != F.col("y_last"), F.lit(True)) & _allowed(percent))
    return found.select(F.least("x_node", "y_node").alias("x"), F.greatest("x_node", "y_node").alias("y")).distinct()


def _merge(belongs: DataFrame, found: DataFrame) -> DataFrame:
    """belongs with the components that the new links join."""
    at = belongs.select(F.col("node").alias("x"), F.col("component").alias("cx"))
    to = belongs.select(F.col("node").alias("y"), F.col("component").alias("cy"))
    joined = found.join(at, "x").join(to, "y").select(F.col("cx").alias("x"), F.col("cy").alias("y"))
    new = components(joined).select(F.col("node").alias("old"), F.col("component").alias("new"), twin("node"))
    tagged = belongs.withColumn("twin", twin("component"))
    changed = tagged.join(new, (tagged["component"] == new["old"]) & (tagged["twin"] == new["twin"]), "left")
    return save(changed.select("node", F.coalesce("new", "component").alias("component")), "belongs")


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id; all columns.

    Rows without an id come after all that have one: their folded texts get numbers above the largest id.
    """
    from .exact_dedup import fold_ascii, keep_rows

    nameless = docs.where("doc_id IS NULL")
    if not nameless.limit(1).count():
        return keep_rows(docs, save(_firsts(docs, width, percent), "kept"))
    digest, number = private("digest"), private("number")
    nameless = nameless.withColumn(digest, F.sha2(fold_ascii(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256))
    top = docs.agg(F.max("doc_id")).first()[0] or 0
    # Written once, so that a text's number doesn't change between uses.
    numbers = save(nameless.select(digest).distinct().withColumn(number, F.monotonically_increasing_id() + F.lit(top + 1)), "numbers")
    numbered = nameless.select(digest, "text").join(numbers, digest).select(F.col(number).alias("doc_id"), "text")
    named = docs.where("doc_id IS NOT NULL")
    kept = save(_firsts(named.select(F.col("doc_id").cast("long").alias("doc_id"), "text").union(numbered), width, percent), "kept")
    texts = numbers.join(kept, F.col(number) == F.col("doc_id"), "left_semi").select(digest)
    rest = nameless.join(texts, digest, "left_semi").dropDuplicates([digest])
    return keep_rows(named, kept).union(rest.select(*docs.columns))


def _firsts(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id and text_sha256, as keep_rows asks for them, of the first row of each component."""
    classes = near_duplicates(docs, width, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return classes.select("doc_id", F.lit("").alias("text_sha256"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * n_both >= 85 * (a.n + b.n - n_both)),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.c)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""
