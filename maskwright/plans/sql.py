"""Fragments of DuckDB SQL that several oracles share."""

from __future__ import annotations

from ..sources.rules import CORE, Rule


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ENTROPY = """(CASE WHEN strlen({x}) = 0 THEN 0.0 ELSE (SELECT -list_sum(list_transform(list_distinct(h), lambda b: len(list_filter(h, lambda y: y = b)) / len(h) * log2(len(list_filter(h, lambda y: y = b)) / len(h))))
  FROM (SELECT list_transform(range(0, strlen({x})), lambda i: substr(hex(encode({x})), 2 * i + 1, 2)) AS h)) END)"""
DIGITS = "regexp_replace({x}, '[^0-9]', '', 'g')"
LUHN = """(length({d}) >= 2 AND list_sum(list_transform(range(1, length({d}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN {d}[length({d}) + 1 - j]::INT
  ELSE ({d}[length({d}) + 1 - j]::INT * 2) // 10 + ({d}[length({d}) + 1 - j]::INT * 2) % 10 END)) % 10 = 0)"""


def rule_hits(rule: Rule, source: str, id_col: str, text_col: str, gate: str = "true") -> str:
    words = " OR ".join(f"contains(t, {quoted(k)})" for k in rule.keywords) or "true"
    keep = ["true"]
    if rule.entropy is not None:
        keep.append(f"{ENTROPY.format(x='raw')} >= {rule.entropy}")
    if rule.checksum_type == "luhn":
        keep.append(LUHN.format(d=DIGITS.format(x="raw")))
    p = quoted(rule.regex)
    return f"""SELECT doc_id, {quoted(rule.id)} AS rule_id, s AS "start", (s + length(raw))::INT AS "end", raw FROM (
  SELECT doc_id, raws[i] AS raw, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(raws[1:i-1], lambda x: length(x))), 0))::INT AS s
  FROM (SELECT doc_id, gaps, raws, unnest(range(1, len(raws) + 1)) AS i FROM (
    SELECT doc_id, regexp_split_to_array(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS raws
    FROM (SELECT {id_col} AS doc_id, {text_col} AS t FROM {source}) WHERE ({words}) AND ({gate})))) WHERE {' AND '.join(keep)}"""


def hits(rules=CORE, source: str = "documents", id_col: str = "doc_id", text_col: str = "text", gate: str = "true") -> str:
    """Common table expression body of all hits."""
    return " UNION ALL ".join(rule_hits(r, source, id_col, text_col, gate) for r in rules)


RESOLVED = """SELECT doc_id, rule_id, "start", "end", raw FROM (
  SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" - "start" DESC, rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {hits})
  WHERE b IS NULL OR b < "end\""""

#: Characters of the SHA-256 counter stream, as functions.fakes.Stream draws them.
STREAM = "list_aggregate(list_transform(range(0, greatest(1, ceil({n} / 32.0)::INT)), lambda k: sha256({seed} || ':{salt}:' || k)), 'string_agg', '')"


def byte(stream: str, i: str) -> str:
    return f"(instr('0123456789abcdef', substr({stream}, 2 * ({i}) + 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr({stream}, 2 * ({i}) + 2, 1)) - 1"


def chars(seed: str, n: str, alphabet: str, salt: str = "") -> str:
    stream = STREAM.format(n=n, seed=seed, salt=salt)
    return f"(SELECT list_aggregate(list_transform(range(0, {n}), lambda i: substr({quoted(alphabet)}, ({byte('h', 'i')}) % {len(alphabet)} + 1, 1)), 'string_agg', '') FROM (SELECT {stream} AS h))"


def number(seed: str, low: int, high: int, salt: str = "n") -> str:
    return f"(('0x' || substr(sha256({seed} || ':{salt}:0'), 1, 8))::BIGINT % {high - low} + {low})"
