"""Detection: texts and rules become spans.

Built-in expressions compute everything for small rule sets (each pattern is a literal, compiled once a task, and no
text is shuffled); for hundreds of rules one Arrow pass with all patterns compiled once in each worker (see matcher).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import bounded_batches, slices
from ..functions.scalar import byte_chars, bytes_entropy, folded, luhn_valid, match_spans, shannon_entropy
from ..sources.rules import CORE, Rule, for_java
from .matcher import count_words, matcher

ONE = "struct<start:int,end:int,raw:string>"
SPAN = f"array<{ONE}>"


def keyword_gate(text: Column, rules=CORE) -> Column:
    """Whether any keyword of any rule occurs, case-sensitively. Without keywords nothing passes."""
    words = sorted({k for r in rules for k in r.keywords})
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def rule_gate(text: Column, rule: Rule) -> Column:
    """A rule without keywords passes every text."""
    out = F.lit(not rule.keywords)
    for w in rule.keywords:
        out = out | F.contains(text, F.lit(w))
    return out


def spans(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches: gaps and matches in turn give the offsets (characters)."""
    raws = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    one = lambda start, raw: F.struct(start.alias("start"), (start + F.char_length(raw)).alias("end"), raw.alias("raw"))
    found = match_spans(F.split(text, pattern, -1), raws, ONE, one)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def keep(rule: Rule, raw: Column) -> Column:
    """Exclusion, entropy and checksum filters, cheapest first."""
    out = F.lit(True)
    if rule.exclude_regex:
        out = out & ~raw.rlike(for_java(rule.exclude_regex))
    if rule.entropy is not None:
        out = out & (shannon_entropy(raw) >= rule.entropy)
    if rule.checksum_type == "luhn":
        out = out & luhn_valid(raw)
    return out


def scan(docs: DataFrame, rules=CORE, gate: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, rule_id, start, end, raw) of all matches that pass the rules' filters.

    gate: only texts with some keyword of some rule are searched, as for whole bodies; fields are searched without.
    """
    text = F.col("_text")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).where(text.isNotNull())
    if gate:
        base = base.where(keyword_gate(text, rules))

    def one(rule: Rule) -> Column:
        found = F.filter(spans(text, for_java(rule.regex)), lambda s: keep(rule, s["raw"]))
        rows = F.transform(found, lambda s: F.struct(F.lit(rule.id).alias("rule_id"), s["start"].alias("start"), s["end"].alias("end"), s["raw"].alias("raw")))
        return F.when(rule_gate(text, rule), rows).otherwise(F.array().cast("array<struct<rule_id:string,start:int,end:int,raw:string>>"))

    return base.select("doc_id", F.inline(F.concat(*[one(r) for r in rules])))


def scan_many(docs: DataFrame, rules, gate: bool = True, id_col: str = "doc_id", text_col: str = "text", literals: bool = True) -> DataFrame:
    """scan() for hundreds of rules: one Arrow pass over the texts, in bounded slices, with everything made ready once a worker.

    One automaton finds the keywords of all rules, and the literals that patterns require; only rules whose keywords (if any) and literals (if any, and
    unless literals is false) occur are searched. Nulls have no spans.
    """
    rules = tuple(rules)

    def run(batches):
        import pyarrow as pa

        held = matcher(rules, literals)
        names = [r.id for r in rules]
        for part in slices(batches, ["_text"]):
            at, rows = [], []
            for i, text in enumerate(part.column("_text").to_pylist()):
                found = held.scan(text, gate)
                at += [i] * len(found)
                rows += found
            starts, ends, which, raws = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(at, pa.int32())), pa.array([names[k] for k in which], pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(raws, pa.string())],
                names=["doc_id", "rule_id", "start", "end", "raw"],
            )

    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).where("_text IS NOT NULL")
    return base.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, rule_id string, start int, end int, raw string")


def count_keywords(docs: DataFrame, keywords, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n): matches of an automaton of keywords in each text, earliest end first and none overlapping; 0 for nulls.

    A keyword is counted as soon as it ends, whatever longer one it begins, and the search starts anew behind it; so counts differ from those of a
    pattern of alternatives.
    """
    words = tuple(sorted(set(keywords)))

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, ["_text"]):
            n = [count_words(text or "", words) for text in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n"])

    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return base.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, n long")


def _order():
    return Window.partitionBy("doc_id").orderBy("start", F.desc(F.col("end") - F.col("start")), "rule_id")


def resolve_overlaps(found: DataFrame) -> DataFrame:
    """Drops a span inside an earlier one (by start, longer first, rule id). Partial overlaps stay.

    A running maximum of ends replaces the pairwise test: an earlier span starts no later, so it
    contains this one exactly if it ends no sooner.
    """
    before = F.max("end").over(_order().rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("_before", before).where("_before IS NULL OR _before < end").drop("_before")


def drop_partial_overlaps(found: DataFrame) -> DataFrame:
    """Of resolved spans, those that start before the end of the span kept before go, from left to right."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "rule_id", "raw")))
    step = lambda at, s: (F.when(s["start"] >= at, s["end"]).otherwise(at), F.when(s["start"] >= at, F.array(s)).otherwise(F.array().cast(f"array<{kind}>")))
    kind = "struct<start:int,end:int,rule_id:string,raw:string>"
    grouped = found.groupBy("doc_id").agg(ordered.alias("s"))
    return grouped.select("doc_id", F.inline(folded("s", F.lit(-1), kind, step))).select("doc_id", "rule_id", "start", "end", "raw")


def context_boost(text: Column, start: Column, raw: Column, words) -> Column:
    """Whether a keyword occurs, whatever its case, in the five tokens before the match's, its own or the four after."""
    tokens = F.split(F.lower(text), r"[ \t\n\f\r]+")
    before = F.size(F.split(F.substr(text, F.lit(1), start), r"[ \t\n\f\r]+")) - 1
    low = F.greatest(before - 5, F.lit(0))
    window = F.slice(tokens, low + 1, before + 5 - low)
    out = F.lit(False)
    for w in words:
        out = out | F.exists(window, lambda t: F.contains(t, F.lit(w.lower())))
    return out


def at_least(level: Column, least: str, order=("low", "medium", "high", "critical")) -> Column:
    """Ordinal threshold on confidence or severity; critical counts as high where only three levels are known."""
    rank = F.create_map(*[F.lit(x) for i, name in enumerate(order) for x in (name, i)])
    return F.coalesce(F.try_element_at(rank, level), F.lit(0)) >= order.index(least)


def sliding_entropy_hits(text: Column, width: int = 20, above: float = 4.5) -> Column:
    """Number of windows of `width` bytes whose entropy is above the bound."""
    held = byte_chars(text)
    n = F.char_length(held) - width + 1
    windows = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(held, i, F.lit(width)))
    return F.when(n > 0, F.size(F.filter(windows, lambda w: bytes_entropy(w) > above))).otherwise(0)
