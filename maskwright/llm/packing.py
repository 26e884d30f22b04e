"""Best-fit packing of token sequences by bin completion.

1. Tokens: every text becomes ids by the tokenizers library; each match of its split is encoded once and looked up
   from then on.
2. Pieces of at most `capacity` tokens; only longer documents are cut.
3. Groups of about `group_rows` pieces, dealt by a hash of the row's place, so that neither a key nor repeated rows can
   grow a group. In a group, bin completion: around the largest piece left, undominated fillings are enumerated;
   branches whose waste exceeds what the incumbent allows are cut; the incumbent is best-fit decreasing. The search
   stops at the proven lower bound, or after `nodes` nodes with the best packing found. With the default bounds a bin has the
   `width` best fillings that begin with one of the `tries` longest pieces; None for `nodes`, `width` and `tries` makes
   the search complete.
4. Bins that are well filled, and of the others the better half, are done; the pieces of the rest go into another
   round of groups, until one group is left. So the loss against one global packing is a few bins in all, not a few in
   each group.

Null texts are empty: just the end token. Very long texts are many pieces. Repeated rows are packed as documents of their own.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, delete, save, table
from .token_counts import byte_alphabet

CAPACITY, GROUP_ROWS, NODES, WELL_FILLED = 4096, 8192, 2000, 0.98
#: Bounds of the search at a bin: fillings that are kept, and first pieces that are tried for them.
WIDTH, TRIES = 3, 8


# ---- bins of one group -------------------------------------------------------------------


class Supply:
    """How many pieces of each length are left; the lengths in stock are the set bits of an integer."""

    def __init__(self, lengths, capacity: int):
        self.capacity = capacity
        self.count = np.bincount(lengths, minlength=capacity + 1).tolist()
        self.bits = sum(1 << n for n, c in enumerate(self.count) if c)
        self.left = int(sum(lengths))

    def take(self, n: int) -> None:
        self.count[n] -= 1
        self.left -= n
        if not self.count[n]:
            self.bits &= ~(1 << n)

    def give(self, n: int) -> None:
        self.count[n] += 1
        self.left += n
        self.bits |= 1 << n

    def best(self, room: int) -> int:
        """The longest piece of at most room tokens, or 0."""
        return (self.bits & ((2 << room) - 1)).bit_length() - 1 if room > 0 and self.bits & ((2 << room) - 1) else 0


def completions(supply: Supply, room: int, top: int, tries: int | None):
    """Fillings of room by pieces of at most top, longest first, to which no such piece can be added; at each step the `tries`
    longest pieces that fit are tried (None: all), a quarter of that one step down."""
    n, tried = supply.best(min(room, top)), 0
    if not n:
        yield ()
    while n and (tries is None or tried < max(1, tries)):
        supply.take(n)
        for rest in completions(supply, room - n, n, tries and tries // 4):
            yield (n, *rest)
        supply.give(n)
        n, tried = supply.best(n - 1), tried + 1


def dominates(one: tuple[int, ...], two: tuple[int, ...]) -> bool:
    """Whether two's pieces fit into bins as large as one's pieces: then one is no worse a filling (Martello and Toth)."""
    if not two:
        return True
    if sum(two) > sum(one):
        return False
    for k, room in enumerate(one):
        if two[0] <= room and room not in one[:k] and dominates((*one[:k], room - two[0], *one[k + 1 :]), two[1:]):
            return True
    return False


def fillings(supply: Supply, room: int, tries: int | None = TRIES) -> list[tuple[int, ...]]:
    """Undominated ways to fill room, least waste first, then fewer and so longer pieces.

    tries None: all of them. Else those that begin with one of the `tries` longest pieces that fit, and an exact pair
    wherever it is. Fillings of more than six pieces are not tested for dominance.
    """
    first = supply.best(room)
    if not first:
        return [()]
    found = {f for f in completions(supply, room, first, tries)}
    n = first if tries and first < room else 0
    while 2 * n >= room:  # a pair that fits exactly
        rest = room - n
        if supply.bits >> rest & 1 and (rest != n or supply.count[n] > 1):
            found.add((n, rest))
            break
        n = supply.best(n - 1)
    out: list[tuple[int, ...]] = []
    for f in sorted(found, key=lambda f: (-sum(f), len(f), f)):
        if len(f) > 6 or not any(len(g) <= 6 and dominates(g, f) for g in out):
            out.append(f)
    return out


def best_fit_decreasing(lengths, capacity: int) -> list[list[int]]:
    supply, bins = Supply(lengths, capacity), []
    while supply.bits:
        out, room = [], capacity
        while room > 0 and (n := supply.best(room)):
            supply.take(n)
            out.append(n)
            room -= n
        bins.append(out)
    return bins


def lower_bound(lengths, capacity: int) -> int:
    """Martello and Toth's L2."""
    lengths = np.asarray(lengths)
    best = -(-int(lengths.sum()) // capacity)
    for k in np.unique(lengths[lengths <= capacity // 2]).tolist() or [0]:
        big = int((lengths > capacity - k).sum())
        mid = lengths[(lengths > capacity // 2) & (lengths <= capacity - k)]
        small = int(lengths[(lengths >= k) & (lengths <= capacity // 2)].sum())
        free = len(mid) * capacity - int(mid.sum())
        best = max(best, big + len(mid) + max(0, -(-(small - free) // capacity)))
    return best


def pack_lengths(lengths, capacity: int = CAPACITY, nodes: int | None = NODES, width: int | None = WIDTH, tries: int | None = TRIES) -> list[list[int]]:
    """Bins of lengths, by bin completion with branch and bound.

    At most `nodes` nodes (or two a bin), `width` fillings a bin and `tries` first pieces; with None for all three the
    search is complete and its packing optimal, in exponential time.
    """
    if not len(lengths):
        return []
    incumbent, bound = best_fit_decreasing(lengths, capacity), lower_bound(lengths, capacity)
    supply, total = Supply(lengths, capacity), int(sum(lengths))
    bins: list[list[int]] = []
    waste, spent = 0, 0
    # One frame a bin: the largest piece, what fillings are still to try.
    frames: list[tuple[int, list[tuple[int, ...]]]] = []

    def open_bin() -> None:
        largest = supply.bits.bit_length() - 1
        supply.take(largest)
        frames.append((largest, fillings(supply, capacity - largest, tries)[:width][::-1]))
        bins.append([])

    def undo() -> None:
        nonlocal waste
        if bins[-1]:
            for n in bins[-1][1:]:
                supply.give(n)
            waste -= capacity - sum(bins[-1])
            bins[-1] = []

    if len(incumbent) > bound:
        open_bin()
    while frames and len(incumbent) > bound and (nodes is None or spent < nodes or spent < 2 * len(incumbent)):
        spent += 1
        undo()
        largest, choices = frames[-1]
        if not choices:
            supply.give(largest)
            frames.pop()
            bins.pop()
            continue
        chosen = choices.pop()
        for n in chosen:
            supply.take(n)
        bins[-1] = [largest, *chosen]
        waste += capacity - sum(bins[-1])
        if not supply.bits:
            if len(bins) < len(incumbent):
                incumbent = [list(b) for b in bins]
        elif waste <= (len(incumbent) - 1) * capacity - total:  # else even full bins from here on win nothing
            open_bin()
    return incumbent


# ---- tokens and pieces -------------------------------------------------------------------


class Recent(dict):
    """A table of what make gave for a key, bounded: the two youngest generations of `most` keys stay."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def age(self) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()


class Packed:
    """Text -> little-endian 32-bit ids, by a table of the split's matches.

    Texts in composed Latin letters without special strings are split here, as the library's normaliser and split would,
    and each match goes to the library's BPE model once. All others go through the whole library, by parts between
    white space, which no match spans.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or "(?!)")
        self.alphabet = {b: c for c, b in byte_alphabet().items()}
        kinds = {k: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        space = "".join(re.escape(chr(c)) for c in (*range(9, 14), 32, 0x85, 0xA0))
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^{space}{kinds['L']}{kinds['N']}]+")
        self.foreign = re.compile("[\u0130\u0250-\U0010ffff]")
        self.matches, self.parts = Recent(self.of_match, most), Recent(self.of_part, most // 4)

    @staticmethod
    def packed(ids) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def of_match(self, match: str) -> bytes:
        return self.packed([t.id for t in self.library.model.tokenize(match.encode().decode("latin-1").translate(self.alphabet))])

    def of_part(self, part: bytes) -> bytes:
        return self.packed(self.library.encode(part.decode(), add_special_tokens=False).ids)

    def of_text(self, text: str) -> bytes:
        plain = text.isascii() or not self.foreign.search(text) and unicodedata.is_normalized("NFC", text)
        if plain and not self.special.search(text):
            return b"".join(map(self.matches.__getitem__, self.split.findall(text.lower())))
        return b"".join(map(self.parts.__getitem__, text.encode().split()))

    def __call__(self, texts: list[str]) -> list[bytes]:
        self.matches.age()
        self.parts.age()
        return [self.of_text(t) for t in texts]


_packed: dict[str, Packed] = {}


def pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the piece's ids as little-endian bytes."""
    import pyarrow as pa

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pack = _packed.get(path) or _packed.setdefault(path, Packed(path))
        end = np.array([end_id], "<u4").tobytes()
        for part in blocks(batches, "text", 1 << 20):
            rows = []
            for i, ids in enumerate(pack(part.column("text").to_pylist())):
                ids += end
                for k in range(0, len(ids), 4 * capacity):
                    cut = ids[k : k + 4 * capacity]
                    rows.append((i, k // (4 * capacity), k // 4, len(cut) // 4, zlib.crc32(cut), cut if with_ids else None))
            at, *rest = zip(*rows) if rows else [()] * 6
            arrays = [part.column("doc_id").take(pa.array(at, pa.int32())), pa.array(rest[0], pa.int32()), *(pa.array(x, pa.int64()) for x in rest[1:4])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(rest[4], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


# ---- rounds of groups --------------------------------------------------------------------


def _pack_group(pdf, capacity: int, bounds: tuple, keep_all: bool, stride: int, first: int):
    """Rows of one group with sequence_id, offset and whether the bin is final."""
    order = np.argsort(pdf["length"].to_numpy(), kind="stable")
    lengths = pdf["length"].to_numpy()[order]
    bins = pack_lengths(lengths, capacity, *bounds)
    enough = min(WELL_FILLED * capacity, float(np.median([sum(b) for b in bins])))
    at = {int(n): int(i) for n, i in zip(*np.unique(lengths, return_index=True))}
    sequence, offset, final = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
    group = int(pdf["grp"].iloc[0])
    for b, content in enumerate(bins):
        used = 0
        done = keep_all or sum(content) >= enough
        for n in content:
            row = order[at[n]]
            at[n] += 1
            sequence[row], offset[row], final[row] = first + group * stride + b, used, done
            used += n
    return pdf.drop(columns="grp").assign(sequence_id=sequence, offset=offset, final=final)


def _group_packer(*settings):
    return lambda pdf: _pack_group(pdf, *settings)


def pack(found: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, nodes: int | None = NODES, width: int | None = WIDTH, tries: int | None = TRIES) -> DataFrame:
    """found: pieces(), written as a table; adds sequence_id (long) and offset (long)."""
    base = found.columns
    schema = T.StructType(found.schema.fields).add("sequence_id", "long").add("offset", "long").add("final", "boolean")
    rest, done, turn = found, [], 0
    stride = group_rows * 16
    while True:
        groups = max(1, -(-rest.count() // group_rows))
        # The place of a row in a written table, so the same in every attempt of a task.
        key = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(groups)).alias("grp")
        run = _group_packer(capacity, (nodes, width, tries), groups == 1, stride, turn << 56)
        out = save(rest.select(*base, key).groupBy("grp").applyInPandas(run, schema), f"packed{turn}")
        done.append(out.where("final").select(*base, "sequence_id", "offset"))
        if groups == 1:
            break
        rest, turn = out.where(~F.col("final")).select(*base), turn + 1
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def best_fit_packing(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, **bounds) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. bounds: those of pack()."""
    found = save(pieces(docs, path, end_id, capacity), "pieces")
    packed = pack(found, capacity, **bounds)
    delete(docs.sparkSession, found._scratch_path)
    return packed


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
