"""Rule ETL queries over a rule list that is made from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import slugify
from ..operators import rule_etl
from ..session import table
from . import sql
from .registry import query

SLUG = "regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')"


def rows(values) -> str:
    """SQL VALUES of tuples of strings and numbers."""
    return "(VALUES " + ", ".join("(" + ", ".join(sql.quoted(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in values) + ")"


def pick(options, i):
    return F.element_at(F.array(*[F.lit(o) for o in options]), (i + 1).cast("int"))


def listed(options) -> str:
    return "[" + ", ".join(map(sql.quoted, options)) + "]"


@query(f"SELECT conv_id, turn, sha256({SLUG.format('text')}) AS slug_sha256 FROM conversations", "slugify")
def slugs(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(slugify("text").cast("binary"), 256).alias("slug_sha256"))


@query(f"SELECT pos, 'spdb.' || slug || CASE WHEN rn > 1 THEN '-' || rn ELSE '' END AS id FROM (SELECT pos, slug, row_number() OVER (PARTITION BY slug ORDER BY pos) AS rn FROM (SELECT p_partkey AS pos, {SLUG.format('p_type')} AS slug FROM part))")
def list_rule_ids(spark, sf):
    return rule_etl.list_ids(table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.col("p_type").alias("name"))).select("pos", "id")


#: Words for names of list entries: all that count, and others.
WORDS = [w.title() for t in rule_etl.NAME_WORDS.values() for _, ws in t for w in ws] + ["Key", "Card", "Token of"]
WORD_TABLE = rows([(kind, k, sub, w) for kind, t in rule_etl.NAME_WORDS.items() for k, (sub, ws) in enumerate(t) for w in ws])


@query(f"""WITH n AS (SELECT p_partkey AS pos, {listed(WORDS)}[p_partkey % {len(WORDS)} + 1] || ' ' || p_type || ' ' || {listed(WORDS)}[p_partkey * 7 % {len(WORDS)} + 1] AS name, CASE WHEN p_size % 2 = 0 THEN 'pii' ELSE 'secret' END AS category FROM part)
SELECT pos, coalesce(arg_min(sub, ord), 'generic') AS subcategory FROM n LEFT JOIN {WORD_TABLE} w(kind, ord, sub, word) ON kind = category AND contains(lower(name), word) GROUP BY 1""")
def name_subcategory(spark, sf):
    k = F.col("p_partkey")
    name = F.concat_ws(" ", pick(WORDS, k % len(WORDS)), "p_type", pick(WORDS, k * 7 % len(WORDS)))
    category = F.when(F.col("p_size") % 2 == 0, "pii").otherwise("secret")
    return table(spark, sf, "part").select(k.alias("pos"), rule_etl.subcategory_of_name(name, category).alias("subcategory"))


CATEGORIES, SUBCATEGORIES = ("secret", "pii", "infra"), sorted({s for _, s in rule_etl.REPLACEMENTS} | {"unknown"})


@query(f"""WITH r AS (SELECT p_partkey AS pos, {listed(CATEGORIES)}[p_size % 3 + 1] AS category, {listed(SUBCATEGORIES)}[p_partkey % {len(SUBCATEGORIES)} + 1] AS subcategory FROM part)
SELECT pos, r.category, r.subcategory, coalesce(replacement, 'generic_random') AS replacement_type FROM r
LEFT JOIN {rows((c, s, t) for (c, s), t in rule_etl.REPLACEMENTS.items())} k(category, subcategory, replacement) ON r.category = k.category AND r.subcategory = k.subcategory""")
def derive_replacement_type(spark, sf):
    made = table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), pick(CATEGORIES, F.col("p_size") % 3).alias("category"), pick(SUBCATEGORIES, F.col("p_partkey") % len(SUBCATEGORIES)).alias("subcategory"))
    return made.withColumn("replacement_type", rule_etl.replacement_type(F.col("category"), F.col("subcategory")))


#: Beginnings of ids: known ones, prefixes, and ones that are neither.
HEADS = [i for ids in rule_etl.ID_CATEGORIES.values() for i in ids] + [p for p, _, _ in rule_etl.ID_PREFIXES] + ["np.zzz.", "openai-", "gitlab-", "heroku-api-key"]
KNOWN_IDS = rows((i, c, s) for (c, s), ids in rule_etl.ID_CATEGORIES.items() for i in ids)


@query(f"""WITH i AS (SELECT p_partkey AS pos, {listed(HEADS)}[p_partkey % {len(HEADS)} + 1] || CASE WHEN p_partkey // {len(HEADS)} % 2 = 0 THEN '' ELSE p_size::VARCHAR END AS id FROM part)
SELECT pos, i.id, coalesce(k.category, p.category, 'secret') AS category, coalesce(k.subcategory, p.subcategory, 'generic') AS subcategory FROM i
LEFT JOIN {KNOWN_IDS} k(id, category, subcategory) ON i.id = k.id LEFT JOIN {rows(rule_etl.ID_PREFIXES)} p(prefix, category, subcategory) ON left(i.id, length(prefix)) = prefix""")
def rule_id_lookup(spark, sf):
    k = F.col("p_partkey")
    tail = F.when(F.floor(k / len(HEADS)) % 2 == 0, "").otherwise(F.col("p_size").cast("string"))
    made = table(spark, sf, "part").select(k.alias("pos"), F.concat(pick(HEADS, k % len(HEADS)), tail).alias("id"))
    return made.select("pos", "id", rule_etl.category_of_id(F.col("id")).alias("c")).select("pos", "id", "c.category", "c.subcategory")


@query(f"""SELECT doc_id, CASE WHEN count(word) > 0 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN count(word) > 0 THEN 'high' ELSE 'medium' END AS severity
FROM documents LEFT JOIN {rows((w,) for w in rule_etl.VENDOR_LITERALS)} v(word) ON instr(text, word) > 0 GROUP BY 1""")
def infer_confidence(spark, sf):
    """Whether a text, taken as a pattern, has a vendor's literal."""
    docs = table(spark, sf, "documents").select("doc_id", rule_etl.confidence(F.coalesce("text", F.lit(""))).alias("confidence"))
    return docs.withColumn("severity", rule_etl.severity(F.col("confidence")))


#: A rule list of every part: id, source, subcategory, position.
RULES = """SELECT 'r' || (p_partkey % 900) AS id, ['alpha', 'beta', 'gamma', 'hand-authored'][p_partkey % 17 % 4 + 1] AS source, CASE WHEN p_partkey % 5 = 0 THEN 'aws' ELSE 'generic' END AS subcategory, p_partkey AS pos, ['stripe', 'okta', 'x', 'heroku'][p_partkey % 4 + 1] || p_partkey AS vendor FROM part"""


def rules(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.concat(F.lit("r"), (k % 900).cast("string")).alias("id"), pick(("alpha", "beta", "gamma", "hand-authored"), k % 17 % 4).alias("source"),
        F.when(k % 5 == 0, "aws").otherwise("generic").alias("subcategory"), k.alias("pos"), F.concat(pick(("stripe", "okta", "x", "heroku"), k % 4), k.cast("string")).alias("vendor"),
    )


@query(f"SELECT id, source, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE source WHEN 'alpha' THEN 0 WHEN 'beta' THEN 1 WHEN 'gamma' THEN 2 ELSE 3 END DESC, pos DESC) AS rn FROM ({RULES})) WHERE rn = 1")
def rule_merge_priority(spark, sf):
    every = rules(spark, sf)
    return rule_etl.merge([every.where(F.col("source") == s) for s in ("alpha", "beta", "gamma", "hand-authored")]).select("id", "source", "pos")


@query(f"WITH u AS (SELECT id, min(source) AS source FROM ({RULES}) GROUP BY 1) SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS t FROM u) ORDER BY t, source LIMIT 50")
def rule_round_robin(spark, sf):
    return rule_etl.round_robin(rules(spark, sf).groupBy("id").agg(F.min("source").alias("source")), 50)


@query(f"SELECT id, count(*) AS n FROM ({RULES}) WHERE id NOT IN (SELECT 'r' || (s_suppkey * 3) FROM supplier) GROUP BY 1")
def rule_exclusions(spark, sf):
    excluded = table(spark, sf, "supplier").select(F.concat(F.lit("r"), (F.col("s_suppkey") * 3).cast("string")).alias("id"))
    return rule_etl.exclude(rules(spark, sf), excluded).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


VENDORS = ["stripe", "heroku", "okta"]


@query(f"""WITH r AS (SELECT vendor AS id, source, subcategory, CASE WHEN contains(vendor, 'stripe') THEN 0 WHEN contains(vendor, 'heroku') THEN 1 WHEN contains(vendor, 'okta') THEN 2 END AS score FROM ({RULES})),
f AS (SELECT id FROM r WHERE source = 'hand-authored' OR subcategory <> 'generic')
SELECT id FROM f UNION ALL SELECT id FROM (SELECT id, row_number() OVER (ORDER BY score, id) AS rn FROM r WHERE source <> 'hand-authored' AND subcategory = 'generic' AND score IS NOT NULL) WHERE rn <= 900 - (SELECT count(*) FROM f)""")
def rule_curation(spark, sf):
    listed = rules(spark, sf).drop("id").withColumnRenamed("vendor", "id")
    return rule_etl.curate(listed, 900, VENDORS).select("id")


@query(f"SELECT source, count(*) AS count, count(*) FILTER (pos % 3 = 0) AS with_keywords FROM ({RULES}) GROUP BY 1")
def rule_counts(spark, sf):
    keywords = F.when(F.col("pos") % 3 == 0, F.array(F.lit("k"))).otherwise(F.array().cast("array<string>"))
    return rule_etl.counts_by_source(rules(spark, sf).withColumn("keywords", keywords))


@query(f"SELECT id, count(*) AS count FROM ({RULES}) GROUP BY 1 HAVING count(*) > 1")
def rule_repeated_ids(spark, sf):
    return rule_etl.repeated_ids(rules(spark, sf))


PART_IDS = "SELECT DISTINCT 'r' || (p_partkey % 500) AS id FROM part"


def part_ids(spark, sf):
    return table(spark, sf, "part").select(F.concat(F.lit("r"), (F.col("p_partkey") % 500).cast("string")).alias("id")).distinct()


@query(f"SELECT id FROM ({PART_IDS}) WHERE id IN (SELECT 'r' || (s_suppkey * 3) FROM supplier)")
def rule_allow_list(spark, sf):
    allowed = table(spark, sf, "supplier").select(F.concat(F.lit("r"), (F.col("s_suppkey") * 3).cast("string")).alias("id"))
    return rule_etl.allow(part_ids(spark, sf), allowed)


@query(f"SELECT DISTINCT 'r' || (s_suppkey * 97) AS id FROM supplier WHERE 'r' || (s_suppkey * 97) NOT IN (SELECT id FROM ({PART_IDS}))")
def rule_required_missing(spark, sf):
    required = table(spark, sf, "supplier").select(F.concat(F.lit("r"), (F.col("s_suppkey") * 97).cast("string")).alias("id"))
    return rule_etl.missing_ids(part_ids(spark, sf), required)
