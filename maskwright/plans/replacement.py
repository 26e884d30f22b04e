"""Replacement, restoring and dictionary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fakes
from ..functions.fpe import fpe_numeric as ff1
from ..functions.scalar import iban_check_digits, iban_valid, luhn_digit
from ..operators import bodies, detect, evaluate, rewrite
from ..session import table
from ..sources.rules import CORE
from . import sql
from .registry import query

KEY = "demo-key"
RULE = {r.id: r for r in CORE}


def resolved(spark, sf):
    return detect.drop_partial_overlaps(detect.resolve_overlaps(detect.scan_many(table(spark, sf, "documents"), CORE, gate=False)))


def seed(kind: str, original: str = "raw") -> str:
    return f"'{KEY}|{kind}|' || {original}"


_D = "TRY_CAST(substr({b}, length({b}) + 1 - j, 1) AS INT)"
DIGIT_SUM = f"list_sum(list_transform(range(1, length({{b}}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN ({_D} * 2) // 10 + ({_D} * 2) % 10 ELSE {_D} END))"
CARD = f"(SELECT b || ((10 - {DIGIT_SUM.format(b='b')} % 10) % 10)::BIGINT FROM (SELECT substr(raw, 1, 4) || {sql.chars(seed('card'), '11', fakes.DIGITS)} AS b))"


def MAPPED(kind: str, size: str, alphabet: str) -> str:
    stream = sql.STREAM.format(n=size, seed=seed(kind), salt="")
    one = sql.byte("h", "i")
    return f"(SELECT list_aggregate(list_transform(range(0, {size}), lambda i: CASE WHEN regexp_matches(substr(raw, i + 1, 1), '[0-9A-Za-z]') THEN substr({sql.quoted(alphabet)}, ({one}) % {len(alphabet)} + 1, 1) ELSE substr(raw, i + 1, 1) END), 'string_agg', '') FROM (SELECT {stream} AS h))"


PHONE = MAPPED("phone", "length(raw)", fakes.DIGITS)
EMAIL = f"{sql.chars(seed('email'), 'least(greatest(strlen(string_split(raw, chr(64))[1]), 5), 24)', fakes.ALNUM)} || '@' || ['example.com', 'example.org', 'example.net'][{sql.number(seed('email'), 0, 3)} + 1]"


@query(f"WITH c AS ({sql.rule_hits(RULE['card'], 'documents', 'doc_id', 'text')}) SELECT doc_id, \"start\", {CARD} AS fake FROM c")
def redact_card_keyed(spark, sf):
    found = detect.scan(table(spark, sf, "documents"), [RULE["card"]])
    return found.select("doc_id", "start", fakes.card(KEY, F.col("raw")).alias("fake"))


@query(f"WITH c AS ({sql.rule_hits(RULE['phone'], 'documents', 'doc_id', 'text')}) SELECT doc_id, \"start\", {PHONE} AS fake FROM c")
def redact_phone_keyed(spark, sf):
    found = detect.scan(table(spark, sf, "documents"), [RULE["phone"]])
    return found.select("doc_id", "start", fakes.phone(KEY, F.col("raw")).alias("fake"))


@query(f"WITH c AS ({sql.rule_hits(RULE['email'], 'documents', 'doc_id', 'text')}) SELECT doc_id, \"start\", {EMAIL} AS fake FROM c")
def redact_email_keyed(spark, sf):
    found = detect.scan(table(spark, sf, "documents"), [RULE["email"]])
    return found.select("doc_id", "start", fakes.email(KEY, F.col("raw")).alias("fake"))


@query(f"WITH c AS ({sql.rule_hits(RULE['phone'], 'documents', 'doc_id', 'text')}) SELECT doc_id, \"start\", '+1-555-010-' || lpad({sql.number(seed('visible-faker_phone'), 0, 10000)}::VARCHAR, 4, '0') AS fake FROM c")
def redact_phone_visible(spark, sf):
    found = detect.scan(table(spark, sf, "documents"), [RULE["phone"]])
    return found.select("doc_id", "start", fakes.fake("faker_phone", KEY, F.col("raw"), visible=True).alias("fake"))


VISIBLE = {
    "faker_email": f"{sql.chars(seed('visible-faker_email'), '6', fakes.LOWER)} || '@example.com'",
    "faker_ssn": f"'000-00-' || lpad({sql.number(seed('visible-faker_ssn'), 0, 10000)}::VARCHAR, 4, '0')",
    "faker_ipv4": f"'203.0.113.' || {sql.number(seed('visible-faker_ipv4'), 0, 256)}",
    "faker_iban": "'GB00MASKED000000000000'",
    "faker_aws_key": f"'AKIAMASKED' || {sql.chars(seed('visible-faker_aws_key'), '10', fakes.ALNUM_UPPER)}",
    "faker_github_pat": f"'ghp_MASKED' || {sql.chars(seed('visible-faker_github_pat'), '30', fakes.B62)}",
    "faker_api_key": sql.chars(seed("visible-faker_api_key"), "32", fakes.HEX),
    "faker_cc_luhn": f"(SELECT b || ((10 - {DIGIT_SUM.format(b='b')} % 10) % 10)::BIGINT FROM (SELECT '400000' || {sql.chars(seed('visible-faker_cc_luhn'), '9', fakes.DIGITS)} AS b))",
    "faker_db_conn": "'postgresql://masked:masked@masked-db.invalid:5432/dbname'",
    "faker_url_cred": "'https://masked:masked@host/' || raw",
}


@query("SELECT doc_id, " + ", ".join(f"{e} AS {k}" for k, e in VISIBLE.items()) + " FROM (SELECT doc_id, sha256(doc_id::VARCHAR) AS raw FROM documents)")
def redact_visible_kinds(spark, sf):
    """Every kind of stand-in that a reader recognises at once."""
    raw = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)
    rows = table(spark, sf, "documents").select("doc_id", raw.alias("raw"), F.concat(F.lit("https://u:p@host/"), raw).alias("url"))
    return rows.select("doc_id", *[fakes.fake(k, KEY, F.col("url" if k == "faker_url_cred" else "raw"), visible=True).alias(k) for k in VISIBLE])


def planted(spark, sf):
    """Values of the kinds that the tables lack, made from ids."""
    h = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)
    return table(spark, sf, "documents").select(
        "doc_id",
        F.lpad((F.col("doc_id") % 899 + 100).cast("string"), 3, "0").alias("n"),
        F.concat(F.lit("AKIA"), F.upper(F.substr(h, F.lit(1), F.lit(16)))).alias("aws"),
        F.concat(F.lit("ghp_"), F.substr(h, F.lit(1), F.lit(36))).alias("github"),
        F.concat(F.lit("GB00"), F.upper(F.substr(h, F.lit(1), F.lit(18)))).alias("iban"),
        F.concat_ws("-", F.substr(h, F.lit(1), F.lit(8)), F.substr(h, F.lit(9), F.lit(12))).alias("api"),
    )


PLANTED = """SELECT doc_id, 'AKIA' || upper(substr(sha256(doc_id::VARCHAR), 1, 16)) AS aws, 'ghp_' || substr(sha256(doc_id::VARCHAR), 1, 36) AS github,
 'GB00' || upper(substr(sha256(doc_id::VARCHAR), 1, 18)) AS iban, substr(sha256(doc_id::VARCHAR), 1, 8) || '-' || substr(sha256(doc_id::VARCHAR), 9, 12) AS api FROM documents"""
MOD97 = "list_reduce(list_transform(string_split({x}, ''), lambda c: CASE WHEN ascii(c) >= 65 THEN 1000 + ascii(c) - 55 ELSE ascii(c) - 48 END), lambda a, c: CASE WHEN c >= 1000 THEN (a * 100 + c - 1000) % 97 ELSE (a * 10 + c) % 97 END, 0)"


@query(f"SELECT doc_id, 'AKIA' || {sql.chars(seed('aws', 'aws'), '16', fakes.ALNUM_UPPER)} AS fake_aws, 'ghp_' || {sql.chars(seed('github', 'github'), '36', fakes.B62)} AS fake_github FROM ({PLANTED})")
def fake_keys(spark, sf):
    p = planted(spark, sf)
    return p.select("doc_id", fakes.aws_key(KEY, F.col("aws")).alias("fake_aws"), fakes.github_pat(KEY, F.col("github")).alias("fake_github"))


@query(f"""SELECT doc_id, lpad({sql.number(seed('ssn', 'aws'), 900, 1000, 'a')}::VARCHAR, 3, '0') || '-' || lpad({sql.number(seed('ssn', 'aws'), 1, 66, 'g')}::VARCHAR, 2, '0') || '-' || lpad({sql.number(seed('ssn', 'aws'), 1, 10000, 's')}::VARCHAR, 4, '0') AS fake_ssn,
 ['192.0.2.', '198.51.100.', '203.0.113.'][{sql.number(seed('ipv4', 'aws'), 0, 3, 'net')} + 1] || {sql.number(seed('ipv4', 'aws'), 1, 255, 'host')} AS fake_ipv4 FROM ({PLANTED})""")
def fake_numbers(spark, sf):
    p = planted(spark, sf)
    return p.select("doc_id", fakes.ssn(KEY, F.col("aws")).alias("fake_ssn"), fakes.ipv4(KEY, F.col("aws")).alias("fake_ipv4"))


@query(f"""WITH b AS (SELECT doc_id, {sql.chars(seed('iban', 'iban'), '18', fakes.ALNUM_UPPER)} AS bban FROM ({PLANTED}))
SELECT doc_id, 'GB' || lpad((98 - {MOD97.format(x="bban || 'GB00'")})::VARCHAR, 2, '0') || bban AS fake_iban, true AS valid FROM b""")
def iban_mod97(spark, sf):
    made = planted(spark, sf).select("doc_id", fakes.iban(KEY, F.col("iban")).alias("fake_iban"))
    return made.withColumn("valid", iban_valid("fake_iban"))


@query(f"WITH p AS (SELECT doc_id, api AS raw FROM ({PLANTED})) SELECT doc_id, {MAPPED('api', 'length(raw)', fakes.HEX)} AS fake_api, {sql.chars(seed('generic'), 'length(raw)', fakes.B62)} AS fake_generic FROM p")
def fake_secrets(spark, sf):
    p = planted(spark, sf)
    return p.select("doc_id", fakes.api_key(KEY, F.col("api")).alias("fake_api"), fakes.generic(KEY, F.col("api")).alias("fake_generic"))


@query(f"SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || '89ab'[(instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS fake_uuid FROM (SELECT doc_id, sha256({seed('uuid', 'api')} || '::0') AS h FROM ({PLANTED}))")
def fake_uuids(spark, sf):
    return planted(spark, sf).select("doc_id", fakes.uuid(KEY, F.col("api")).alias("fake_uuid"))


@query()
def fake_tokens(spark, sf):
    """Signed tokens and connection strings; the tests check their shapes."""
    p = planted(spark, sf)
    url = F.concat(F.lit("postgresql://admin:"), F.col("api"), F.lit("@db.internal:5432/prod?user=bob&password="), F.col("n"))
    return p.select("doc_id", fakes.jwt(KEY, F.col("api")).alias("fake_jwt"), fakes.connection(KEY, url).alias("fake_db"), fakes.url_credentials(KEY, url).alias("fake_url"))


#: Forms of connection strings, and what each is by its grammar; {n} and {p} are a supplier's name and balance.
CONNECTIONS = (
    ("jdbc:postgresql://{n}/db", "jdbc"), ("(DESCRIPTION=(ADDRESS=(HOST={n}))", "oracle"), ("mysql://u:{p}@{n}/db", "url"), ("Driver={x};Server={n};Uid=u", "odbc"), ("Server={n};Password={p}", "ado"),
    ("host={n} user=u password={p}", "libpq"), ("{n}", "unknown"), ("host={n}", "unknown"),
)


def _form(template: str):
    parts = F.lit(template)
    for mark, column in (("{n}", F.replace(F.col("s_name"), F.lit(" "), F.lit("-"))), ("{p}", F.col("s_acctbal").cast("string"))):
        parts = F.replace(parts, F.lit(mark), column)
    return parts


@query("SELECT s_suppkey, [" + ", ".join(sql.quoted(k) for _, k in CONNECTIONS) + f"][s_suppkey % {len(CONNECTIONS)} + 1] AS kind FROM supplier")
def connection_kinds(spark, sf):
    """Strings made of suppliers' columns by form; the kind is known from the form."""
    at = F.col("s_suppkey") % len(CONNECTIONS)
    made = F.coalesce(*[F.when(at == i, _form(t)) for i, (t, _) in enumerate(CONNECTIONS)])
    return table(spark, sf, "supplier").select("s_suppkey", fakes.classify_connection(made).alias("kind"))


_ADO = "'Server=' || s_name || ';User Id=u' || s_suppkey || ';Password=\"' || s_acctbal || ';x\";Encrypt=true'"
_PAIR = lambda i: f"'{KEY}|pair|{KEY}|pairs|' || c || '|{i}'"


@query(f"""SELECT s_suppkey, 'Server=' || {sql.chars(_PAIR(0), '10', fakes.LOWER)} || '.example.com;User Id=' || {sql.chars(_PAIR(1), "greatest(1 + length(s_suppkey::VARCHAR), 6)", fakes.LOWER)}
 || ';Password="' || {sql.chars(_PAIR(2), "greatest(length(s_acctbal::VARCHAR) + 2, 12)", fakes.ALNUM)} || '";Encrypt=true' AS fake FROM (SELECT *, {_ADO} AS c FROM supplier)""")
def connection_strings(spark, sf):
    """Passwords between quotes, with a separator inside."""
    balance = F.col("s_acctbal").cast("string")
    c = F.concat(F.lit("Server="), F.col("s_name"), F.lit(";User Id=u"), F.col("s_suppkey").cast("string"), F.lit(';Password="'), balance, F.lit(';x";Encrypt=true'))
    return table(spark, sf, "supplier").select("s_suppkey", fakes.connection(KEY, c).alias("fake"))


@query()
def fpe_numeric(spark, sf):
    """FF1 has no SQL form; the tests hold it against published vectors."""
    found = detect.scan(table(spark, sf, "documents"), [RULE["card"]])
    return found.select("doc_id", "start", ff1(F.col("raw")).alias("fake"))


@query(f"SELECT o_orderkey, ((10 - {DIGIT_SUM.format(b='(o_orderkey + 1000000)::VARCHAR')} % 10) % 10)::INT AS digit FROM orders")
def luhn_check_digit(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", luhn_digit((F.col("o_orderkey") + 1000000).cast("string")).cast("int").alias("digit"))


@query(f"SELECT doc_id, (98 - {MOD97.format(x='substr(aws, 5) || chr(71) || chr(66) || chr(48) || chr(48)')})::INT AS digits FROM ({PLANTED})")
def iban_digits(spark, sf):
    return planted(spark, sf).select("doc_id", iban_check_digits(F.lit("GB"), F.substr("aws", F.lit(5))).cast("int").alias("digits"))


# ---- rewriting ---------------------------------------------------------------------------

TOKEN = f"'token = \"' || {MAPPED('api', 'length(raw)', fakes.HEX)}".replace("'demo-key|api|' || raw", "'demo-key|api|' || substr(raw, 10)").replace("length(raw)", "(length(raw) - 9)").replace("substr(raw, i + 1, 1)", "substr(raw, i + 10, 1)")
FAKE = f"CASE rule_id WHEN 'card' THEN {CARD} WHEN 'phone' THEN {PHONE} WHEN 'email' THEN {EMAIL} WHEN 'ipv4' THEN raw WHEN 'token' THEN {TOKEN} ELSE {MAPPED('api', 'length(raw)', fakes.HEX)} END"


def redacted_sql(hits: str, fake: str = FAKE) -> str:
    """Common tables of rewriting: `new` has doc_id, text, new_text and n."""
    return f"""WITH RECURSIVE h AS ({hits}), r AS ({sql.RESOLVED.format(hits='h')}),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", rule_id) AS k FROM r),
w AS (SELECT *, true AS fits, "end" AS at FROM n WHERE k = 1
  UNION ALL SELECT n.*, n."start" >= w.at, CASE WHEN n."start" >= w.at THEN n."end" ELSE w.at END FROM w JOIN n ON n.doc_id = w.doc_id AND n.k = w.k + 1),
red AS (SELECT doc_id, rule_id, "start", "end", raw, {fake} AS fake FROM w WHERE fits),
seg AS (SELECT doc_id, fake, "start", "end", row_number() OVER o AS k, lag("end", 1, 0) OVER o AS prev FROM red WINDOW o AS (PARTITION BY doc_id ORDER BY "start")),
new AS (SELECT d.doc_id, any_value(text) AS text, CASE WHEN count(k) = 0 THEN any_value(text) ELSE string_agg(substr(text, prev + 1, "start" - prev) || fake, '' ORDER BY k) || substr(any_value(text), max("end") + 1) END AS new_text, count(k) AS n
  FROM documents d LEFT JOIN seg ON seg.doc_id = d.doc_id GROUP BY d.doc_id)"""


REDACTED = redacted_sql(sql.hits())


def redactions(spark, sf):
    return rewrite.with_fakes(resolved(spark, sf), KEY)


@query(REDACTED + " SELECT doc_id, sha256(new_text) AS new_sha256, length(new_text) AS new_length, n::INT AS n_redacted FROM new")
def rewrite_documents(spark, sf):
    out = bodies.redact_texts(table(spark, sf, "documents").select("doc_id", "text"), KEY)
    return out.select("doc_id", F.sha2(F.col("new_text").cast("binary"), 256).alias("new_sha256"), F.char_length("new_text").cast("long").alias("new_length"), F.size("redactions").alias("n_redacted"))


FAKE_SHAPES = "CASE rule_id WHEN 'email' THEN raw LIKE '%@example.com' OR raw LIKE '%@example.org' OR raw LIKE '%@example.net' WHEN 'ipv4' THEN raw LIKE '192.0.2.%' OR raw LIKE '198.51.100.%' OR raw LIKE '203.0.113.%' ELSE false END"


@query(REDACTED + f", s AS ({sql.hits(source='new', text_col='new_text')}) SELECT rule_id, count(*) AS found, count(*) FILTER ({FAKE_SHAPES}) AS fakes, count(*) FILTER (NOT ({FAKE_SHAPES})) AS missed FROM s GROUP BY 1")
def known_fakes(spark, sf):
    """Redacted texts scanned again: what is found there, our own stand-ins, and what was missed."""
    out = bodies.redact_texts(table(spark, sf, "documents").select("doc_id", "text"), KEY)
    found = detect.scan_many(out, CORE, gate=False, text_col="new_text")
    fake = evaluate.known_fake(F.col("rule_id"), F.col("raw"))
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("found"), F.count_if(fake).alias("fakes"), F.count_if(~fake).alias("missed"))


@query(REDACTED + " SELECT doc_id, sha256(new_text) AS new_sha256, n::INT AS n_redacted FROM new")
def rewrite_by_spans(spark, sf):
    """The same from a table of spans, which are grouped by text and joined."""
    out = rewrite.rewrite(table(spark, sf, "documents"), redactions(spark, sf))
    return out.select("doc_id", F.sha2(F.col("new_text").cast("binary"), 256).alias("new_sha256"), "n_redacted")


@query("SELECT doc_id, sha256(text) AS restored_sha256, true AS equal FROM documents")
def restore_roundtrip(spark, sf):
    """Redacted texts and their stand-ins give back the originals."""
    out = bodies.redact_texts(table(spark, sf, "documents").select("doc_id", "text"), KEY)
    changed = F.filter("redactions", lambda r: r["fake"] != r["original"])
    out = out.withColumn("pairs", F.array_distinct(F.transform(changed, lambda r: F.struct(r["fake"].alias("fake"), r["original"].alias("original")))))
    back = F.when(F.size("pairs") > 0, rewrite.restore(F.col("new_text"), F.col("pairs"))).otherwise(F.col("new_text"))
    return out.select("doc_id", F.sha2(back.cast("binary"), 256).alias("restored_sha256"), (back == F.col("text")).alias("equal"))


DICT = "SELECT 'f' || (o_orderkey % 50) AS fake, 'o' || (o_orderkey % 20) AS original, (o_orderkey * 13 % 1000)::BIGINT AS created_at FROM orders"


def _dictionary(spark, sf):
    o = F.col("o_orderkey")
    return table(spark, sf, "orders").select(F.concat(F.lit("f"), (o % 50).cast("string")).alias("fake"), F.concat(F.lit("o"), (o % 20).cast("string")).alias("original"), (o * 13 % 1000).cast("long").alias("created_at"))


@query(f"SELECT original, arg_min(fake, (created_at, fake)) AS fake FROM ({DICT}) GROUP BY 1")
def dictionary_canonical(spark, sf):
    return rewrite.canonical(_dictionary(spark, sf))


@query(f"""WITH d AS (SELECT fake, min(original) AS original, min(created_at) AS created_at, min(created_at) AS updated_at FROM ({DICT}) GROUP BY 1),
b AS (SELECT 'f' || (c_custkey % 80) AS fake, min('n' || (c_custkey % 7)) AS original FROM customer GROUP BY 1)
SELECT fake, coalesce(d.original, b.original) AS original, coalesce(created_at, 5000) AS created_at, CASE WHEN b.fake IS NOT NULL THEN greatest(coalesce(updated_at, 0), 5000) ELSE updated_at END AS updated_at FROM d FULL JOIN b USING (fake)""")
def dictionary_upsert(spark, sf):
    old = _dictionary(spark, sf).groupBy("fake").agg(F.min("original").alias("original"), F.min("created_at").alias("created_at"), F.min("created_at").alias("updated_at"))
    c = F.col("c_custkey")
    new = table(spark, sf, "customer").select(F.concat(F.lit("f"), (c % 80).cast("string")).alias("fake"), F.concat(F.lit("n"), (c % 7).cast("string")).alias("original"))
    return rewrite.upsert(old, new, 5000)


@query(f"""WITH c AS ({sql.rule_hits(RULE['email'], 'documents', 'doc_id', 'text')}), k AS (SELECT DISTINCT raw, true AS known FROM c WHERE doc_id % 2 = 0)
SELECT doc_id, "start", CASE WHEN known THEN 'known-' || sha256(raw) ELSE {EMAIL} END AS fake FROM c LEFT JOIN k USING (raw)""")
def dictionary_lookup(spark, sf):
    """A stand-in that the dictionary has comes before a new one."""
    found = detect.scan(table(spark, sf, "documents"), [RULE["email"]])
    known = found.where("doc_id % 2 = 0").select("raw").distinct().select(F.concat(F.lit("known-"), F.sha2(F.col("raw").cast("binary"), 256)).alias("fake"), F.col("raw").alias("original"), F.lit(1).cast("long").alias("created_at"))
    return rewrite.with_fakes(found, KEY, dictionary=known).select("doc_id", "start", "fake")


@query(f"""WITH d AS (SELECT fake, min(original) AS original FROM ({DICT}) GROUP BY 1),
b AS (SELECT 'f' || (c_custkey % 80) AS fake, min('n' || (c_custkey % 7)) AS original FROM customer GROUP BY 1)
SELECT fake, coalesce(d.original, b.original) AS original, CASE WHEN d.fake IS NOT NULL THEN 100 ELSE 200 END AS created_at, CASE WHEN b.fake IS NOT NULL THEN 200 ELSE 100 END AS updated_at FROM d FULL JOIN b USING (fake)""")
def dictionary_store(spark, sf):
    """Two batches upserted into a stored dictionary."""
    from ..sources.sinks import DictionaryStore
    from .streams import folder

    store, c = DictionaryStore(spark, folder(spark, "dictionary")), F.col("c_custkey")
    store.upsert(_dictionary(spark, sf).select("fake", "original"), 100)
    store.upsert(table(spark, sf, "customer").select(F.concat(F.lit("f"), (c % 80).cast("string")).alias("fake"), F.concat(F.lit("n"), (c % 7).cast("string")).alias("original")), 200)
    return store.snapshot()
