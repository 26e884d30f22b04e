"""Scalar column functions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shannon_entropy(c) -> Column:
    """Bits per byte of the UTF-8 form; 0 for the empty string, null for null."""
    return bytes_entropy(byte_chars(c))


def byte_chars(c) -> Column:
    """A string with one character (U+0000 to U+00FF) for each byte of the UTF-8 form."""
    return F.decode(F.encode(_col(c), "utf-8"), "ISO-8859-1")


def bytes_entropy(h) -> Column:
    """Bits per byte of a string of byte_chars: what is left when a byte is taken out gives its count in linear time.

    The string and its length are computed once, not again for each byte that occurs: a lambda evaluates what it names at each call.
    """

    def of(held):
        h, n = held["h"], held["n"]
        count = lambda b: (held["size"] - F.octet_length(F.replace(h, b, F.lit("")))) / F.greatest(F.octet_length(b), F.lit(1))
        shares = F.transform(F.array_distinct(F.split(h, "")), lambda b: count(b) / n)
        total = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
        return F.when(n > 0, total).otherwise(F.when(n == 0, F.lit(0.0)))

    return bound(h, lambda h: bound(F.struct(h.alias("h"), F.char_length(h).alias("n"), F.octet_length(h).alias("size")), of))


def digits(c) -> Column:
    return F.regexp_replace(_col(c), "[^0-9]", "")


def luhn_valid(c) -> Column:
    """Luhn over the digits; at least two are needed."""
    d = digits(c)
    return (F.length(d) >= 2) & F.call_function("luhn_check", d)


def luhn_digit(c) -> Column:
    """The digit that makes the given digits valid when appended."""
    d = F.split(F.reverse(_col(c)), "")
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, F.floor(x.cast("int") * 2 / 10) + x.cast("int") * 2 % 10).otherwise(x.cast("int")).cast("int"))
    return (10 - F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10) % 10


def mod97(c) -> Column:
    """Remainder modulo 97 of alphanumerics with A = 10 to Z = 35, read from left to right."""

    def step(rest, ch):
        code = F.ascii(ch)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(_col(c), ""), F.lit(0), step)


def iban_check_digits(country, bban) -> Column:
    return 98 - mod97(F.concat(_col(bban), _col(country), F.lit("00")))


def iban_valid(c) -> Column:
    compact = F.upper(F.regexp_replace(_col(c), " ", ""))
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))
    return compact.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (mod97(turned) == 1)


def slugify(c) -> Column:
    """Lower case; runs of anything but letters and numbers become one hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def snippet(text, start, end, radius: int) -> Column:
    """The span with up to radius characters around it, and dots where text was left out."""
    text, start, end = _col(text), _col(start), _col(end)
    low = F.greatest(start - radius, F.lit(0))
    high = F.least(end + radius, F.char_length(text))
    return F.concat(F.when(low > 0, "...").otherwise(""), F.substr(text, low + 1, high - low), F.when(high < F.char_length(text), "...").otherwise(""))


def truncate(c, most: int) -> Column:
    c = _col(c)
    return F.when(F.char_length(c) > most, F.concat(F.substr(c, F.lit(1), F.lit(most - 3)), F.lit("..."))).otherwise(c)


def byte_offset(text, char_offset) -> Column:
    """Offset in UTF-8 bytes of an offset in characters."""
    return F.octet_length(F.substr(_col(text), F.lit(1), _col(char_offset)))


def bound(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def match_spans(gaps: Column, raws: Column, kind: str, make, piece: int = 64) -> Column:
    """array<kind> of make(start, raw) for the matches between gaps, as split and regexp_extract_all give them.

    Spark copies an accumulator at each step. So lengths are added up in pieces, and each piece's spans from the piece's
    start: a text with many matches takes time in proportion to them, nearly.
    """
    pairs = F.zip_with(gaps, raws, lambda gap, raw: F.struct(gap.alias("gap"), raw.alias("raw")))
    size = lambda p: F.char_length(p["gap"]) + F.coalesce(F.char_length(p["raw"]), F.lit(0))
    nothing = F.array().cast(f"array<{kind}>")

    def step(acc, pair):
        begin = acc["at"] + F.char_length(pair["gap"])
        one = F.concat(acc["out"], F.array(make(begin, pair["raw"])))
        return F.struct((acc["at"] + size(pair)).alias("at"), F.when(pair["raw"].isNull(), acc["out"]).otherwise(one).alias("out"))

    def placed(pieces):
        sums = F.transform(pieces, lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + size(p)))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        both = F.zip_with(pieces, starts, lambda c, at: F.struct(c.alias("pairs"), at.alias("at")))
        spans = F.transform(F.filter(both, lambda b: b["pairs"].isNotNull()), lambda b: F.aggregate(b["pairs"], F.struct(b["at"].alias("at"), nothing.alias("out")), step, lambda acc: acc["out"]))
        return F.flatten(spans)

    return bound(pairs, lambda p: bound(pieces(p, piece), placed))


def folded(items: Column, start: Column, kind: str, step, piece: int = 64) -> Column:
    """array<kind> of what step gives for each item: step(state, item) is the next state and an array to add.

    An array that grows item by item is copied at each step. So items are folded in pieces, whose arrays are joined at the end: a text with
    many matches takes time in proportion to them, nearly.
    """
    none = F.array().cast(f"array<{kind}>")

    def inner(acc, item):
        state, more = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["out"], more).alias("out"))

    def outer(acc, part):
        done = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), inner)
        return bound(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    items = _col(items)

    def whole(rows):
        first = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.flatten(F.aggregate(pieces(rows, piece), first, outer, lambda acc: acc["out"]))

    return bound(items, whole)


def pieces(items: Column, piece: int = 64) -> Column:
    """The array cut into arrays of so many items; one empty array for an empty one."""
    last = F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / piece).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * piece + 1, piece))
