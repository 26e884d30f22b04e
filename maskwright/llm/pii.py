"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

All kinds but iban (email, ip, card, phone, ssn) are leftmost, non-overlapping matches per kind. A candidate that fails
its validator is dropped and nothing is tried again inside it. An iban is the longest prefix of a run of capitals and
digits that ends at a blank or with the run and passes its checksum; each head in a run is tried, from left to right.
Base spans always stay; the added kinds (iban, ssn) stay when base score + validator + context reaches the threshold: an iban by its checksum, an ssn only with a
word of its kind nearby. Offsets count code points.

The patterns are written so that Java's matcher needs linear time and a constant stack on any text: runs are
possessive, and a match can only begin where a run begins (or where the last match ended).

Null and empty texts have no spans; very long texts are searched whole. Repeated rows are reported once each. An empty
table gives an empty result. Other columns are ignored by detect and kept by redact.
DataFrame operations only: one projection, no shuffle.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import bound, folded, match_spans
from ..operators.rewrite import splice
from .common import private, table

SPAN = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)

#: Pattern, needed literal or class, and score of each kind, in the order of the listing.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.6),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", 0.4),
    "card": (r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+", None, 0.5),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.5),
    # Group 1 is the head and the longest run behind it; only the head is consumed, so other heads in the run are tried too.
    "iban": (r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))[A-Z]{2}[0-9]{2}", None, 0.4),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.5),
}
BASE = ("email", "ip", "card", "phone")
#: Words that make a kind likelier within CONTEXT characters.
WORDS = {
    "email": "mail|contact|reach",
    "ip": "ip|host|server|address",
    "card": "card|visa|mastercard|amex|payment",
    "phone": "phone|call|tel|mobile",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security",
}
CONTEXT = 40
THRESHOLD = 0.7


def _empty():
    return F.array().cast(T.ArrayType(SPAN))


def _spans(text: Column, kind: str) -> Column:
    """array<SPAN> of all matches of the kind's pattern: gaps and matches in turn give the offsets."""
    if kind == "iban":
        return _ibans(text)
    pattern, needed, _ = KINDS[kind]
    rank = F.lit(list(KINDS).index(kind))

    def one(start, raw):
        return F.struct(start.alias("start"), rank.alias("rank"), (start + F.char_length(raw)).alias("end"), F.lit(kind).alias("kind"), raw.alias("raw"))

    found = match_spans(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), SPAN.simpleString(), one)
    found_any = text.rlike(pattern)
    if needed:
        found_any = F.contains(text, F.lit(needed)) & found_any
    return F.when(found_any, found).otherwise(_empty())


def _ibans(text: Column) -> Column:
    """array<SPAN> of account numbers: each head's longest valid prefix, without those inside the last one taken."""
    pattern = KINDS["iban"][0]
    rank = F.lit(list(KINDS).index("iban"))

    def longest(run):
        groups = F.split(run, " ")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda k: F.array_join(F.slice(groups, 1, k), " "))
        # A run cut off by a small letter or by its greatest length has that character at its end and is no account number.
        good = F.filter(prefixes, lambda raw: F.length(F.replace(raw, F.lit(" "))).between(15, 34) & ~raw.rlike("[a-z]") & (mod97(raw) == 1))
        return F.try_element_at(good, F.lit(-1))

    gaps, raws = F.split(text, pattern, -1), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), longest)
    pairs = F.zip_with(gaps, raws, lambda gap, raw: F.struct(gap.alias("gap"), raw.alias("raw")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("past"))

    def step(acc, pair):
        begin = acc["at"] + F.char_length(pair["gap"])
        end = begin + F.char_length(pair["raw"])
        taken = pair["raw"].isNotNull() & (begin >= acc["past"])
        span = F.struct(begin.alias("start"), rank.alias("rank"), end.alias("end"), F.lit("iban").alias("kind"), pair["raw"].alias("raw"))
        return F.struct((begin + 4).alias("at"), F.when(taken, end).otherwise(acc["past"]).alias("past")), F.when(taken, F.array(span)).otherwise(_empty())

    return F.when(text.rlike(pattern), folded(pairs, start, SPAN.simpleString(), step)).otherwise(_empty())


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def mod97(raw: Column) -> Column:
    """Remainder of an account number as ISO 13616 checks it; 1 is valid."""
    compact = F.regexp_replace(raw, " ", "")
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))

    def step(rest, ch):
        code = F.ascii(ch)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _valid(span: Column, kind: str) -> Column:
    raw = span["raw"]
    if kind == "ip":
        parts = F.transform(F.split(raw, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(_digits(raw)).between(12, 19) & F.call_function("luhn_check", _digits(raw))
    if kind == "phone":
        return F.length(_digits(raw)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(raw, " ", "")).between(15, 34) & (mod97(raw) == 1)
    if kind == "ssn":
        return ~raw.rlike("^(000|666|9)") & ~raw.rlike("-00-") & ~raw.rlike("-0000$")
    return F.lit(True)


def _score(text: Column, span: Column, kind: str) -> Column:
    """Base score, 0.3 for a checksum, 0.2 for a word of the kind around the span."""
    begin = F.greatest(span["start"] - CONTEXT, F.lit(0))
    around = F.concat(
        F.substr(text, begin + 1, span["start"] - begin), F.lit(" "), F.substr(text, span["end"] + 1, F.lit(CONTEXT))
    )
    near = F.lower(around).rlike(rf"(?<![a-z])(?:{WORDS[kind]})")
    checked = 0.3 if kind in ("card", "iban") else 0.0
    return F.round(F.lit(KINDS[kind][2] + checked) + F.when(near, F.lit(0.2)).otherwise(F.lit(0.0)), 3)


def _scored(text: Column, span: Column, kind: str) -> Column:
    return F.struct(*[span[c].alias(c) for c in ("start", "rank", "end", "kind", "raw")], _score(text, span, kind).alias("score"))


def _likely(text: Column, threshold: float, span: Column, kind: str) -> Column:
    return _score(text, span, kind) >= threshold


def _bind(f, kind: str):
    """A one-argument function, as the higher-order functions ask for."""
    return lambda span: f(span, kind)


def _confirmed(frame: DataFrame, text: str, kinds, threshold: float) -> tuple[DataFrame, dict[str, str]]:
    """frame with a column of confirmed spans for each kind, and the columns' names."""
    names = {kind: private(kind) for kind in kinds}
    for kind, name in names.items():
        # Two columns, so that the patterns run once.
        frame = frame.withColumn(name, _spans(F.col(text), kind))
        good = F.filter(F.col(name), _bind(_valid, kind))
        frame = frame.withColumn(name, good if kind in BASE else F.filter(good, _bind(partial(_likely, F.col(text), threshold), kind)))
    return frame, names


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds=tuple(KINDS), threshold: float = THRESHOLD, scores: bool = True) -> DataFrame:
    """doc_id, text and spans: array of (start, rank, end, kind, raw and, unless scores is false, score), by start, then kind."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out, names = _confirmed(out, "text", kinds, threshold)
    found = [F.transform(F.col(n), _bind(partial(_scored, F.col("text")), k)) if scores else F.col(n) for k, n in names.items()]
    return out.select("doc_id", "text", F.array_sort(F.concat(*found)).alias("spans"))


def listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


LAST = 2**31 - 1
GROUP = "struct<start:int,end:int,fake:string>"


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets, all columns kept.

    Overlapping spans become one replacement that covers them all, named after the first.
    A null text stays null. length_col, if there is one, is set to the new text's length.
    """
    columns, whole, all_spans, changed = docs.columns, private("text"), private("spans"), private("new")
    wide, names = _confirmed(docs.withColumn(whole, F.coalesce(F.col(text_col), F.lit(""))), whole, tuple(KINDS), THRESHOLD)
    wide = wide.withColumn(all_spans, F.array_sort(F.concat(*[F.col(n) for n in names.values()])))
    text = F.col(whole)
    # A span past all others ends the last group of overlapping spans.
    end = F.struct(F.lit(LAST).alias("start"), F.lit(0).alias("rank"), F.lit(LAST).alias("end"), F.lit("").alias("kind"), F.lit("").alias("raw"))
    start = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(None).cast("string").alias("kind"))

    def step(group, span):
        inside = span["start"] < group["end"]
        done = F.struct(group["start"].alias("start"), group["end"].alias("end"), F.concat(F.lit("["), F.upper(group["kind"]), F.lit("]")).alias("fake"))
        more = F.when(inside | group["kind"].isNull(), F.array().cast(f"array<{GROUP}>")).otherwise(F.array(done))
        grown = F.struct(group["start"].alias("start"), F.greatest(group["end"], span["end"]).alias("end"), group["kind"].alias("kind"))
        return F.when(inside, grown).otherwise(F.struct(span["start"].alias("start"), span["end"].alias("end"), span["kind"].alias("kind"))), more

    groups = folded(F.concat(F.col(all_spans), F.array(end)), start, GROUP, step)
    new = bound(groups, lambda found: splice(text, found))
    new = F.when(F.size(all_spans) > 0, new).otherwise(F.col(text_col))
    out = wide.withColumn(changed, new)
    return out.select(*[F.col(changed).alias(c) if c == text_col else F.coalesce(F.char_length(changed).cast(docs.schema[c].dataType), F.col(c)).alias(c) if c == length_col else F.col(c) for c in columns])


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter(spans, _bind(lambda s, kind: s["kind"] == kind, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return detect(table(spark, sf_dir, "documents"), scores=False).select(
        "doc_id", *counts, F.sha2(listing(base).cast("binary"), 256).alias("base_sha256"), listing(spans).alias("spans")
    )


def pii_span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per span with its score. op6_pii_spans has the columns of its SQL, so the scores are a query of their own."""
    rows = detect(table(spark, sf_dir, "documents")).select("doc_id", F.explode("spans").alias("s"))
    return rows.select("doc_id", "s.kind", "s.start", "s.end", "s.score")


def _sql_kind(kind: str, pattern: str) -> str:
    """Per document the matches with their starts, by the same gap-and-match form in RE2."""
    return f"""
  SELECT doc_id, '{kind}' AS kind, {list(KINDS).index(kind)} AS rank, unnest(range(1, len(raws) + 1)) AS i, gaps, raws, t
  FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_split_to_array(coalesce(text, ''), '{pattern}') AS gaps,
               regexp_extract_all(coalesce(text, ''), '{pattern}') AS raws FROM documents)"""


#: The contract's own patterns: the SQL has the base kinds only, the tests the added ones.
_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OP6_SQL = (
    "WITH m AS ("
    + " UNION ALL ".join(_sql_kind(k, p) for k, p in _SQL_PATTERNS.items())
    + r"""),
p AS (
  SELECT doc_id, kind, rank, raws[i] AS raw, regexp_replace(raws[i], '[^0-9]', '', 'g') AS d,
         coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(raws[1:i-1], lambda x: length(x))), 0) AS s
  FROM m),
v AS (
  SELECT doc_id, kind, rank, s::BIGINT AS s, (s + length(raw))::BIGINT AS e FROM p
  WHERE CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN list_max(list_transform(string_split(raw, '.'), lambda x: x::HUGEINT)) <= 255
    WHEN 'card' THEN length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda j:
      CASE WHEN j % 2 = 1 THEN d[length(d) + 1 - j]::INT
           ELSE (d[length(d) + 1 - j]::INT * 2) // 10 + (d[length(d) + 1 - j]::INT * 2) % 10 END)) % 10 = 0
    ELSE length(d) BETWEEN 9 AND 15 END),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS l
  FROM v GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(l, '')) AS base_sha256, coalesce(l, '') AS spans
FROM documents d LEFT JOIN g USING (doc_id)
"""
)
