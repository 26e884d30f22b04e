"""Detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrow import byte_entropy
from ..functions.scalar import byte_offset, luhn_valid, snippet
from ..operators import detect, evaluate
from ..session import table
from ..sources.rules import CORE, Rule
from . import sql
from .registry import query

RULE = {r.id: r for r in CORE}
GATED = "contains(t, '@') OR contains(t, 'token')"


def _spans_query(rule_id: str, name: str):
    @query(sql.rule_hits(RULE[rule_id], "documents", "doc_id", "text"), name)
    def run(spark, sf):
        return detect.scan(table(spark, sf, "documents"), [RULE[rule_id]])

    return run


for _id, _name in (("card", "card_spans"), ("email", "email_spans"), ("phone", "phone_spans"), ("ipv4", "ipv4_spans"), ("token", "token_keyword_gate"), ("hex40", "entropy_filter")):
    _spans_query(_id, _name)


@query(f"WITH c AS ({sql.rule_hits(Rule('any', '[0-9]{13,16}'), 'documents', 'doc_id', 'text')}) SELECT doc_id, \"start\", raw, {sql.LUHN.format(d='raw')} AS valid FROM c")
def card_luhn_filter(spark, sf):
    found = detect.scan(table(spark, sf, "documents"), [Rule("any", "[0-9]{13,16}")])
    return found.select("doc_id", "start", "raw", luhn_valid("raw").alias("valid"))


@query("SELECT count(*) FILTER (contains(text, '@') OR contains(text, 'token')) AS passed, count(*) AS texts FROM documents")
def keyword_prefilter(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.agg(F.count_if(detect.keyword_gate(F.col("text"))).alias("passed"), F.count(F.lit(1)).alias("texts"))


@query(sql.hits(gate=GATED))
def scan_bodies(spark, sf):
    """Whole bodies: searched only if some keyword of some rule occurs."""
    return detect.scan(table(spark, sf, "documents"), gate=True)


@query(sql.hits())
def scan_fields(spark, sf):
    return detect.scan(table(spark, sf, "documents"))


@query(sql.hits(source="pages", id_col="page_id", text_col="html"))
def scan_pages(spark, sf):
    return detect.scan(table(spark, sf, "pages"), id_col="page_id", text_col="html")


@query(sql.hits(gate=GATED))
def scan_rule_table(spark, sf):
    """The one-pass operator for large rule tables; here with the core rules, so that SQL can follow."""
    return detect.scan_many(table(spark, sf, "documents"), CORE, gate=True)


KEYLESS = tuple(Rule(r.id, r.regex, entropy=r.entropy, checksum_type=r.checksum_type) for r in CORE)


@query(sql.hits(KEYLESS))
def scan_literal_gate(spark, sf):
    """Rules without keywords, searched only where the literals that their patterns require occur."""
    return detect.scan_many(table(spark, sf, "documents"), KEYLESS, gate=False)


@query(f"WITH h AS ({sql.hits()}) {sql.RESOLVED.format(hits='h')}")
def overlap_resolve(spark, sf):
    return detect.resolve_overlaps(detect.scan_many(table(spark, sf, "documents"), CORE, gate=False))


PARTIAL = (Rule("a", "[0-9]{4}-[0-9]{4}|[0-9]{3}\\) [0-9]{3}"), Rule("b", "[0-9]{3}-[0-9]{4}"), Rule("c", r"\+1 \([0-9]{3}\) [0-9]{3}"))


@query(f"""WITH RECURSIVE h AS ({sql.hits(PARTIAL)}), r AS ({sql.RESOLVED.format(hits='h')}),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", rule_id) AS k FROM r),
w AS (SELECT *, true AS fits, "end" AS at FROM n WHERE k = 1
  UNION ALL SELECT n.*, n."start" >= w.at, CASE WHEN n."start" >= w.at THEN n."end" ELSE w.at END FROM w JOIN n ON n.doc_id = w.doc_id AND n.k = w.k + 1)
SELECT doc_id, rule_id, "start", "end", raw FROM w WHERE fits""")
def partial_overlap_drop(spark, sf):
    return detect.drop_partial_overlaps(detect.resolve_overlaps(detect.scan(table(spark, sf, "documents"), PARTIAL)))


BOOST = ("card", "token", "phone", "the")


@query(f"""WITH c AS ({sql.rule_hits(RULE['phone'], 'documents', 'doc_id', 'text')}),
t AS (SELECT c.*, lower(text) AS low, text FROM c JOIN documents USING (doc_id)),
k AS (SELECT *, len(regexp_split_to_array(substr(text, 1, "start"), '[ \\t\\n\\f\\r]+')) - 1 AS b, regexp_split_to_array(low, '[ \\t\\n\\f\\r]+') AS tokens FROM t)
SELECT doc_id, "start", len(list_filter(tokens[greatest(b - 5, 0) + 1 : b + 5], lambda x: {' OR '.join(f"contains(x, '{w}')" for w in BOOST)})) > 0 AS boost FROM k""")
def context_boost(spark, sf):
    docs = table(spark, sf, "documents")
    found = detect.scan(docs, [RULE["phone"]])
    joined = found.join(docs.select("doc_id", "text"), "doc_id")
    return joined.select("doc_id", "start", detect.context_boost(F.col("text"), F.col("start"), F.col("raw"), BOOST).alias("boost"))


@query(f"WITH h AS ({sql.hits()}), r AS ({sql.RESOLVED.format(hits='h')}) SELECT lang, rule_id, count(*) AS n, count(DISTINCT doc_id) AS docs FROM r JOIN documents USING (doc_id) GROUP BY 1, 2")
def match_counts_by_lang(spark, sf):
    docs = table(spark, sf, "documents")
    found = detect.resolve_overlaps(detect.scan_many(docs, CORE, gate=False))
    return found.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(f"WITH h AS ({sql.rule_hits(RULE['phone'], 'documents', 'doc_id', 'text')}) SELECT doc_id, \"start\", strlen(substr(text, 1, \"start\")) AS start_byte, strlen(substr(text, 1, \"end\")) AS end_byte FROM h JOIN documents USING (doc_id)")
def byte_spans(spark, sf):
    docs = table(spark, sf, "documents")
    found = detect.scan(docs, [RULE["phone"]]).join(docs.select("doc_id", "text"), "doc_id")
    return found.select("doc_id", "start", byte_offset("text", "start").cast("long").alias("start_byte"), byte_offset("text", "end").cast("long").alias("end_byte"))


EXCLUDING = Rule("card", "4[0-9]{15}", exclude_regex="0$")


@query("SELECT doc_id, raw FROM (SELECT doc_id, unnest(regexp_extract_all(text, '4[0-9]{15}')) AS raw FROM documents) WHERE NOT regexp_matches(raw, '0$')")
def exclude_filter(spark, sf):
    return detect.scan(table(spark, sf, "documents"), [EXCLUDING]).select("doc_id", "raw")


@query("""WITH b AS (SELECT doc_id, byte, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents) GROUP BY 1, 2),
n AS (SELECT doc_id, sum(c) AS n FROM b GROUP BY 1), e AS (SELECT doc_id, -sum(c / n * log2(c / n)) AS e FROM b JOIN n USING (doc_id) GROUP BY 1)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN round(coalesce(e, 0.0), 6) END AS entropy FROM documents LEFT JOIN e USING (doc_id)""")
def text_entropy(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(byte_entropy(F.col("text")), 6).alias("entropy"))


@query("""WITH w AS (SELECT item_id, i, unnest(range(i, i + 20)) AS j, h FROM (SELECT item_id, unnest(range(0, greatest(strlen(text) - 19, 0))) AS i, hex(encode(text)) AS h FROM benchmark)),
c AS (SELECT item_id, i, substr(h, 2 * j + 1, 2) AS byte, count(*) / 20.0 AS p FROM w GROUP BY 1, 2, 3), e AS (SELECT item_id, i, -sum(p * log2(p)) AS e FROM c GROUP BY 1, 2)
SELECT item_id, count(e.i) FILTER (e > 3.6) AS hits FROM benchmark LEFT JOIN e USING (item_id) GROUP BY 1""")
def sliding_entropy(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", detect.sliding_entropy_hits(F.col("text"), 20, 3.6).cast("long").alias("hits"))


@query("SELECT doc_id, len(regexp_extract_all(text, 'token|the |[@]')) AS n FROM documents")
def keyword_hit_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit("token|the |[@]")).cast("long").alias("n"))


#: Words inside, at the beginning and at the end of others; none overlaps itself, so splitting finds all its places.
NESTED = ("token", "ken", "the", "then", "there", "here", "he", "tion", "ion", "on")


@query("WITH w AS (" + " UNION ALL ".join(f"SELECT doc_id, {sql.quoted(w)} AS w, string_split(text, {sql.quoted(w)}) AS gaps FROM documents" for w in NESTED) + """),
g AS (SELECT doc_id, w, len(gaps) AS n, unnest(gaps) AS gap, generate_subscripts(gaps, 1) AS i FROM w),
p AS (SELECT doc_id, length(w) AS k, i < n AS found, sum(length(gap)) OVER (PARTITION BY doc_id, w ORDER BY i) + i * length(w) AS e FROM g),
l AS (SELECT doc_id, list({'s': e - k, 'e': e, 'n': 0::BIGINT} ORDER BY e, k DESC) AS hits FROM p WHERE found GROUP BY 1),
c AS (SELECT doc_id, list_reduce(list_prepend({'s': 0::HUGEINT, 'e': 0::HUGEINT, 'n': 0::BIGINT}, hits), lambda acc, x: CASE WHEN x.s >= acc.e THEN {'s': x.s, 'e': x.e, 'n': acc.n + 1} ELSE acc END).n AS n FROM l)
SELECT doc_id, coalesce(n, 0) AS n FROM documents LEFT JOIN c USING (doc_id)""")
def automaton_hit_count(spark, sf):
    """Counts of an automaton's matches: a word counts as soon as it ends, none overlap."""
    return detect.count_keywords(table(spark, sf, "documents"), NESTED)


@query("SELECT doc_id, " + " + ".join(f"len(regexp_extract_all(text, {sql.quoted(r.regex)}))" for r in CORE) + " AS n FROM documents")
def regex_hit_count(spark, sf):
    n = sum((F.regexp_count("text", F.lit(r.regex)) for r in CORE[1:]), F.regexp_count("text", F.lit(CORE[0].regex)))
    return table(spark, sf, "documents").select("doc_id", n.cast("long").alias("n"))


LEVELS = ", ".join(f"({sql.quoted(r.id)}, {sql.quoted(r.confidence)}, {sql.quoted(r.severity)})" for r in CORE)


@query(f"""WITH h AS ({sql.hits()}), r(rule_id, confidence, severity) AS (VALUES {LEVELS})
SELECT rule_id, count(*) AS n FROM h JOIN r USING (rule_id) WHERE confidence IN ('high', 'medium') AND severity = 'high' GROUP BY 1""")
def level_thresholds(spark, sf):
    from ..sources.rules import frame

    rules = F.broadcast(frame(spark).select(F.col("id").alias("rule_id"), "confidence", "severity"))
    kept = detect.scan(table(spark, sf, "documents")).join(rules, "rule_id")
    kept = kept.where(detect.at_least(F.col("confidence"), "medium") & detect.at_least(F.col("severity"), "high"))
    return kept.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH h AS ({sql.rule_hits(RULE['email'], 'documents', 'doc_id', 'text')}) SELECT doc_id, "start",
 (CASE WHEN "start" > 55 THEN '...' ELSE '' END) || substr(text, greatest("start" - 55, 0) + 1, least("end" + 55, length(text)) - greatest("start" - 55, 0)) || (CASE WHEN "end" + 55 < length(text) THEN '...' ELSE '' END) AS snippet
 FROM h JOIN documents USING (doc_id)""")
def context_snippet(spark, sf):
    docs = table(spark, sf, "documents")
    found = detect.scan(docs, [RULE["email"]]).join(docs.select("doc_id", "text"), "doc_id")
    return found.select("doc_id", "start", snippet("text", "start", "end", 55).alias("snippet"))


MATRIX = " UNION ALL ".join(f"SELECT {sql.quoted(r.id)} AS rule_id, len(regexp_extract_all(text, {sql.quoted(r.regex)})) AS hits FROM benchmark" for r in CORE)


@query(f"WITH m AS ({MATRIX}) SELECT rule_id, count(*) AS pairs, count(*) FILTER (hits > 0) AS positive_pairs, sum(hits)::BIGINT AS hits, round(count(*) FILTER (hits > 0) / count(*), 6) AS rate FROM m GROUP BY 1")
def fp_matrix(spark, sf):
    return evaluate.false_positive_rates(evaluate.false_positive_matrix(table(spark, sf, "benchmark"), CORE, "item_id"))


CAUGHT = "doc_id % 3"
PER_ENTRY = f"""WITH h AS ({sql.hits()}), f AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1),
e AS (SELECT d.doc_id AS entry_id, coalesce(n, 0) AS found, {CAUGHT.replace('doc_id', 'd.doc_id')} AS caught, greatest(coalesce(n, 0) - {CAUGHT.replace('doc_id', 'd.doc_id')}, 0) AS missed FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id)"""


def _per_entry(spark, sf):
    docs = table(spark, sf, "documents")
    found = detect.scan_many(docs, CORE, gate=False).withColumnRenamed("doc_id", "entry_id")
    entries = docs.select(F.col("doc_id").alias("entry_id"))
    return found, evaluate.found_against_caught(found, entries.withColumn("caught", F.col("entry_id") % 3), entries)


@query(PER_ENTRY + " SELECT count(*) AS entries, sum(found)::BIGINT AS found, sum(caught)::BIGINT AS caught, sum(missed)::BIGINT AS missed, count(*) FILTER (missed > 0) AS entries_with_misses, round(100.0 * sum(missed) / greatest(sum(found), 1), 4) AS miss_pct FROM e")
def missed_redactions(spark, sf):
    return evaluate.missed_totals(_per_entry(spark, sf)[1])


@query(PER_ENTRY + f", r(rule_id, confidence, severity) AS (VALUES {LEVELS}) SELECT rule_id, count(*) AS count FROM h JOIN e ON h.doc_id = entry_id JOIN r USING (rule_id) WHERE missed > 0 AND severity <> 'low' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def miss_top_rules(spark, sf):
    from ..sources.rules import frame

    found, entries = _per_entry(spark, sf)
    return evaluate.top_missed(found, entries, frame(spark).select(F.col("id").alias("rule_id"), "severity"), "medium", 3)


@query("SELECT CASE WHEN toxic = 1 THEN 'TRUE_MISS' WHEN quality = 1 THEN 'FALSE_POSITIVE' ELSE 'AMBIGUOUS' END AS verdict, count(*) AS count FROM labels GROUP BY 1")
def verdict_counts(spark, sf):
    verdict = F.when(F.col("toxic") == 1, "TRUE_MISS").when(F.col("quality") == 1, "FALSE_POSITIVE").otherwise("AMBIGUOUS")
    return evaluate.verdict_counts(table(spark, sf, "labels").select(verdict.alias("verdict")))


FIXTURES = " UNION ALL ".join(f"SELECT {sql.quoted(r.id)} AS rule_id, CASE WHEN contains(text, '@') OR contains(text, 'token') THEN 'pos' ELSE 'neg' END AS polarity, regexp_matches(coalesce(text, ''), {sql.quoted(r.regex)}) AS matched FROM documents" for r in CORE)


@query(f"WITH f AS ({FIXTURES}) SELECT rule_id, polarity, count(*) AS fixtures, count(*) FILTER (matched <> (polarity = 'pos')) AS failed FROM f WHERE polarity IS NOT NULL GROUP BY 1, 2")
def golden_fixtures(spark, sf):
    """Every document as a fixture of every rule: positive if it has a keyword, negative if not."""
    from ..sources.rules import frame

    polarity = F.when(detect.keyword_gate(F.coalesce("text", F.lit(""))), "pos").otherwise("neg")
    docs = table(spark, sf, "documents").select(F.explode(F.array(*[F.lit(r.id) for r in CORE])).alias("rule_id"), polarity.alias("polarity"), "text")
    return evaluate.fixture_totals(evaluate.fixture_verdicts(docs, frame(spark)))
