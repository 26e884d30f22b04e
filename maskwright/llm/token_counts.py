"""Exact token counts by finite-state transducers compiled from a byte-level BPE tokenizer file.

Two transducers, both deterministic, with emitted counts on their transitions:

* The splitter reads one symbol a character (its class, with the lookahead that the split pattern needs folded
  in) and emits 1 where a pre-token begins. Long inputs are cut into chunks; every chunk gives a map from entry
  state to exit state, the maps compose by a parallel prefix scan, and then all chunks run at once from
  their true entry states. A chunk may begin anywhere, inside a pre-token or a run of spaces too.
* The merger reads the bytes of a pre-token. A state is what can still matter: the longest suffix that begins
  some token, with the last token and the relative count of the best encoding at each of its positions. A
  transition emits the change of the token count (it may be negative: a merge). States are made when first
  reached and kept in a bounded table, so any text of any length runs in constant memory.

Added special strings inside a text count as one token each, as the library does by default.
Null and empty texts have 0 tokens. Repeated rows are counted once each. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, table

#: Symbols of the splitter. APOS2 and APOS3 begin a contraction of 2 or 3 characters; MID is white space
#: before white space or the end; LAST and LAST_BLANK (U+0020) stand before another character.
LETTER, NUMBER, OTHER, APOS2, APOS3, MID, LAST, LAST_BLANK, RESET = range(9)
#: States of the splitter.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, BLANK, ONE_LEFT, TWO_LEFT, ENDED = range(9)
N_STATES = 9
CHUNK = 512


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """next[state, symbol] and emits[state, symbol]."""
    to, out = np.zeros((N_STATES, 9), np.uint8), np.ones((N_STATES, 9), np.uint8)
    to[:] = [IN_LETTERS, IN_NUMBERS, IN_OTHER, ONE_LEFT, TWO_LEFT, IN_SPACE, IN_SPACE, BLANK, START]
    out[:, RESET] = 0
    for state, symbol, end in (
        (IN_LETTERS, LETTER, IN_LETTERS), (BLANK, LETTER, IN_LETTERS), (IN_NUMBERS, NUMBER, IN_NUMBERS),
        (BLANK, NUMBER, IN_NUMBERS), (IN_OTHER, OTHER, IN_OTHER), (BLANK, OTHER, IN_OTHER),
        (IN_OTHER, APOS2, IN_OTHER), (IN_OTHER, APOS3, IN_OTHER), (BLANK, APOS2, IN_OTHER), (BLANK, APOS3, IN_OTHER),
        (TWO_LEFT, LETTER, ONE_LEFT), (ONE_LEFT, LETTER, ENDED), (IN_SPACE, MID, IN_SPACE),
    ):
        to[state, symbol], out[state, symbol] = end, 0
    return to, out


def character_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or MID (white space) of each code point."""
    import regex

    found = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", MID)):
        for m in regex.finditer(pattern, every):
            a, b = (x + 0x800 * (x >= 0xD800) for x in m.span())
            found[a:b] = kind
    return found


class Splitter:
    def __init__(self):
        self.classes = character_classes()
        self.next, self.emits = splitter()
        self.flat = self.next.ravel()

    def symbols(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """codes: texts one after the other, each followed by one slot (ends) that becomes RESET."""
        s = self.classes[codes]
        s[ends] = RESET
        after = np.empty_like(s)
        after[:-1], after[-1:] = s[1:], RESET
        space = s == MID
        last = space & (after != MID) & (after != RESET)
        s[last] = LAST
        s[last & (codes == 32)] = LAST_BLANK
        for i in np.flatnonzero((codes == 39) & (after == LETTER)):
            tail = codes[i + 1 : i + 3]
            a, b = chr(tail[0]), chr(tail[1]) if len(tail) > 1 else ""
            if a in "stmd":
                s[i] = APOS2
            elif a + b in ("re", "ve", "ll"):
                s[i] = APOS3
        return s

    def chunk_maps(self, grid: np.ndarray) -> np.ndarray:
        """Exit state of each chunk (a row of grid) for each entry state."""
        maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (len(grid), 1))
        for column in grid.T:
            maps = self.flat[maps * np.uint8(9) + column[:, None]]
        return maps

    @staticmethod
    def prefix_scan(maps: np.ndarray) -> np.ndarray:
        """Composition of all maps up to and with each row, in log2(rows) parallel steps."""
        maps, step = maps.copy(), 1
        while step < len(maps):
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), 1)
            step *= 2
        return maps

    def boundaries(self, s: np.ndarray) -> np.ndarray:
        """Whether a pre-token begins at each symbol."""
        rows = -(-len(s) // CHUNK)
        grid = np.full(rows * CHUNK, RESET, np.uint8)
        grid[: len(s)] = s
        grid = grid.reshape(rows, CHUNK)
        grid = np.ascontiguousarray(grid.T).T  # columns are read one by one
        state = np.zeros(rows, np.uint8)
        state[1:] = self.prefix_scan(self.chunk_maps(grid))[:-1, START]
        out = np.empty((CHUNK, rows), bool)
        emits = self.emits.ravel().astype(bool)
        for i, column in enumerate(grid.T):
            at = state * np.uint8(9) + column
            out[i] = emits[at]
            state = self.flat[at]
        return out.T.ravel()[: len(s)]


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """Counts of the canonical encoding of a byte string, by a transducer that grows as texts need it."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[int, int, int]], most_states: int = 300_000, most_words: int = 500_000):
        self.tokens = tokens
        self.prefixes = {t[:k] for t in tokens for k in range(1, len(t))}  # of longer tokens
        self.rank = {(a, b): i for i, (a, b, _) in enumerate(merges)}
        self.parts = {c: (a, b, i) for i, (a, b, c) in enumerate(merges)}
        self.fits: dict[int, bool] = {}
        self.most_states, self.most_words = most_states, most_words
        self.words: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        # A state: the suffix, and for each of its open positions (distance from the end, last token, relative count).
        self.states = [(b"", ((0, -1, 0),))]
        self.number = {self.states[0]: 0}
        self.arcs: dict[int, tuple[int, int]] = {}

    def pair_fits(self, a: int, b: int) -> bool:
        """Whether the two tokens may stand side by side: undo their merges, latest first, and see whether
        an earlier merge across the border would have come before."""
        key = a << 32 | b
        if (known := self.fits.get(key)) is not None:
            return known
        x, y, bound, fit = a, b, len(self.rank), True
        while True:
            if self.rank.get((x, y), bound) < bound:
                fit = False
                break
            left, right = self.parts.get(x), self.parts.get(y)
            # What was made last is undone first; of equal rank, the left one was made first, so the right one goes first.
            if left and (not right or left[2] > right[2]):
                bound, x = left[2], left[1]
            elif right:
                bound, y = right[2] + 1, right[0]
            else:
                break
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[key] = fit
        return fit

    def arc(self, at: int, byte: int) -> tuple[int, int]:
        suffix, spots = self.states[at]
        grown = suffix + bytes((byte,))
        size, new, n = len(grown), -1, 0
        token_of, begins, kept = self.tokens.get, self.prefixes, []
        for back, last, count in spots:
            part = grown[size - back - 1 :]
            if new < 0 and (token := token_of(part)) is not None and (last < 0 or self.pair_fits(last, token)):
                new, n = token, count + 1
            if part in begins:
                kept.append((back + 1, last, count))
        if new < 0:
            raise ValueError("the vocabulary lacks a byte")
        state = (grown[size - kept[0][0] :] if kept else b"", (*((back, last, count - n) for back, last, count in kept), (0, new, 0)))
        to = self.number.get(state)
        if to is None:
            to = self.number[state] = len(self.states)
            self.states.append(state)
        self.arcs[at << 8 | byte] = step = to, n
        return step

    def count(self, data: bytes) -> int:
        if len(self.states) > self.most_states:
            self.reset()
        at = total = 0
        arcs = self.arcs
        for byte in data:
            step = arcs.get(at << 8 | byte)
            if step is None:
                step = self.arc(at, byte)
                if len(self.states) > 4 * self.most_states:
                    keep = self.states[step[0]]
                    self.reset()
                    arcs = self.arcs
                    self.number[keep] = 1
                    self.states.append(keep)
                    step = 1, step[1]
            at = step[0]
            total += step[1]
        return total

    def of_word(self, word: str) -> int:
        n = self.count(word.encode())
        if len(word) <= 64:
            if len(self.words) >= self.most_words:
                self.words.clear()
            self.words[word] = n
        return n


class Counter:
    """Both transducers for a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        alphabet = byte_alphabet()
        raw = {t: bytes(alphabet[c] for c in t) for t in j["model"]["vocab"]}
        tokens = {raw[t]: i for t, i in j["model"]["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in j["model"]["merges"]]
        merges = [(tokens[raw[a]], tokens[raw[b]], tokens[raw[a] + raw[b]]) for a, b in pairs]
        self.special = [t["content"] for t in j.get("added_tokens") or []]
        self.splitter, self.merger = Splitter(), Merger(tokens, merges)

    def __call__(self, texts: list[str]) -> np.ndarray:
        pieces, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = [text]
            if any(s in text for s in self.special):
                import re

                parts = re.split("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))), text)
                extra[i] = len(parts) - 1
            pieces += parts
            owner += [i] * len(parts)
        if not pieces:
            return extra
        big = "\x00".join(pieces) + "\x00"
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        codes = np.frombuffer(big.encode("utf-32-le"), np.uint32)
        starts = np.flatnonzero(self.splitter.boundaries(self.splitter.symbols(codes, ends)))
        if not len(starts):
            return extra
        stops = np.empty_like(starts)
        stops[:-1], stops[-1] = starts[1:], ends[-1]
        piece = np.searchsorted(ends, starts)
        stops = np.minimum(stops, ends[piece])
        get, of_word = self.merger.words.get, self.merger.of_word
        counts = np.fromiter(
            (n if (n := get(w := big[a:b])) is not None else of_word(w) for a, b in zip(starts.tolist(), stops.tolist())), np.int64, len(starts)
        )
        return extra + np.bincount(np.array(owner)[piece], counts, len(texts)).astype(np.int64)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """Compiled once in each Python worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs."""
    import pyarrow as pa

    def run(batches):
        count = counter(path)
        for part in blocks(batches, "text", 1 << 20):
            texts = part.column("text").to_pylist()
            n = count(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
