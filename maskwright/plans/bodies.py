"""Whole bodies by format; every document is a body, whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bodies, detect, route
from ..session import table
from ..functions import fakes
from ..sources.rules import CORE, Rule
from . import sql
from .registry import query
from .replacement import FAKE, KEY, REDACTED, redacted_sql, seed

#: Plain text is searched only if a keyword occurs.
GATE = "(" + " OR ".join(f"contains({{t}}, {sql.quoted(k)})" for k in sorted({k for r in CORE for k in r.keywords})) + ")"
PLAIN = f"CASE WHEN {GATE.format(t='text')} THEN new_text ELSE text END"


def sha(c):
    return F.sha2(c.cast("binary"), 256)


def redacted(spark, sf, body, content_type: str, encoding: str | None = None, rules=CORE, **headers):
    """documents as bodies of one type, redacted."""
    docs = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    names = {"Content-Type": F.lit(content_type), "content-length": F.lit("0"), **({"Content-Encoding": F.lit(encoding)} if encoding else {}), **headers}
    found = docs.withColumn("headers", F.create_map(*[x for k, v in names.items() for x in (F.lit(k), v)]))
    raw = F.encode(body, "utf-8")
    return bodies.redact_bodies(found.withColumn("body", route.compress(raw, F.lit(encoding), once=True) if encoding else raw), KEY, rules)


@query(REDACTED + " SELECT doc_id, 'json' AS route, sha256(new_text) AS value_sha256, sha256(new_text) AS dotted_sha256, sha256(text) AS media_sha256, (2 * n)::INT AS n_redacted FROM new")
def body_json(spark, sf):
    """Values by their place: a key with a dot and a path of the same spelling; encoded media stay."""
    media = F.struct(F.lit("base64").alias("type"), F.col("text").alias("data"))
    body = F.to_json(F.struct(F.col("text").alias("a.b"), F.struct(F.col("text").alias("b"), F.col("n_chars").alias("n")).alias("a"), media.alias("m")))
    value = F.from_json(F.col("new_body").cast("string"), "`a.b` string, a struct<b:string,n:long>, m struct<type:string,data:string>")
    out = redacted(spark, sf, body, "application/json; charset=utf-8").withColumn("v", value)
    return out.select("doc_id", "route", sha(F.col("v.a.b")).alias("value_sha256"), sha(F.col("v")["a.b"]).alias("dotted_sha256"), sha(F.col("v.m.data")).alias("media_sha256"), F.size("redactions").alias("n_redacted"))


def many(n: int = 140) -> tuple[Rule, ...]:
    """Rules that do hit: a word of lower-case letters with three given ones and a capital behind it; every other rule has the three as its keyword."""
    triples = [a + b + c for a in "aeinrst" for b in "aeinrst" for c in "aeinrst"]
    return tuple(Rule(f"m{k:03d}", f"{t}[a-z]* [A-Z]", keywords=(t,) * (k % 2)) for k, t in enumerate(triples[:n]))


MANY = (*CORE, *many())
_GENERIC = sql.chars(seed("generic"), "strlen(raw)", fakes.B62)


@query(redacted_sql(sql.hits(MANY), f"CASE WHEN rule_id LIKE 'm%' THEN {_GENERIC} ELSE {FAKE} END") + " SELECT doc_id, sha256(new_text) AS value_sha256, n::INT AS n_redacted FROM new")
def body_rule_table(spark, sf):
    """JSON bodies under 146 rules, most of which hit."""
    out = redacted(spark, sf, F.to_json(F.struct(F.col("text").alias("v"))), "application/json", rules=MANY)
    return out.select("doc_id", sha(F.get_json_object(F.col("new_body").cast("string"), "$.v")).alias("value_sha256"), F.size("redactions").alias("n_redacted"))


@query(REDACTED + " SELECT doc_id, sha256(new_text) AS value_sha256, '&n=1&flag' AS rest, n::INT AS n_redacted FROM new")
def body_form(spark, sf):
    body = F.concat(F.lit("q="), F.url_encode("text"), F.lit("&n=1&flag"))
    new = F.col("new_body").cast("string")
    out = redacted(spark, sf, body, "application/x-www-form-urlencoded")
    return out.select("doc_id", sha(F.url_decode(F.regexp_extract(new, "^q=([^&]*)", 1))).alias("value_sha256"), F.regexp_extract(new, "^[^&]*(.*)$", 1).alias("rest"), F.size("redactions").alias("n_redacted"))


@query(REDACTED + f" SELECT doc_id, sha256({PLAIN}) AS text_sha256, sha256(new_text) AS json_sha256, sha256(text) AS file_sha256 FROM new")
def body_multipart(spark, sf):
    """A text part, a JSON part and a file."""
    head = "--bX\r\nContent-Disposition: form-data; name=\"{}\"\r\n{}\r\n"
    part = lambda name, more, content: (F.lit(head.format(name, more)), content, F.lit("\r\n"))
    value = F.to_json(F.struct(F.col("text").alias("v")))
    body = F.concat(*part("t", "", F.col("text")), *part("j", "Content-Type: application/json\r\n", value), *part("f", "Content-Type: image/png\r\n", F.col("text")), F.lit("--bX--\r\n"))
    pieces = F.split(F.col("new_body").cast("string"), "--bX(?:--)?\r\n")
    content = lambda i: F.regexp_replace(F.regexp_replace(F.get(pieces, F.lit(i)), "(?s)^.*?\r\n\r\n", ""), "\r\n$", "")
    out = redacted(spark, sf, body, "multipart/form-data; boundary=bX")
    return out.select("doc_id", sha(content(1)).alias("text_sha256"), sha(F.get_json_object(content(2), "$.v")).alias("json_sha256"), sha(content(3)).alias("file_sha256"))


@query(REDACTED + " SELECT doc_id, sha256(new_text) AS json_sha256, sha256(new_text) AS data_sha256, 'e' AS event, true AS done FROM new")
def body_sse(spark, sf):
    """A frame of JSON, one of plain data in several lines, and the end mark."""
    lines = F.replace(F.col("text"), F.lit("\n"), F.lit("\ndata: "))
    body = F.concat(F.lit("event: e\nid: 1\ndata: "), F.to_json(F.struct(F.col("text").alias("v"))), F.lit("\n\ndata: "), lines, F.lit("\n\ndata: [DONE]\n\n"))
    frames = route.sse_frames(F.col("new_body").cast("string"))
    out = redacted(spark, sf, body, "text/event-stream").withColumn("f", frames)
    data = lambda i: F.get("f", F.lit(i))["data"]
    return out.select("doc_id", sha(F.get_json_object(data(0), "$.v")).alias("json_sha256"), sha(data(1)).alias("data_sha256"), F.get("f", F.lit(0))["event"].alias("event"), (data(2) == "[DONE]").alias("done"))


@query(REDACTED + f" SELECT doc_id, sha256({PLAIN}) AS text_sha256, CASE WHEN {GATE.format(t='text')} THEN n ELSE 0 END::INT AS n_redacted, CASE WHEN {PLAIN} <> text THEN true ELSE false END AS length_set FROM new")
def body_gzip(spark, sf):
    """Plain text, packed: unpacked, changed and packed again; content-length follows only a change."""
    out = redacted(spark, sf, F.col("text"), "text/plain", "gzip")
    plain = route.decompress(F.col("new_body"), F.lit("gzip")).cast("string")
    length = F.try_element_at("new_headers", F.lit("content-length"))
    return out.select("doc_id", sha(plain).alias("text_sha256"), F.size("redactions").alias("n_redacted"), (length == F.octet_length("new_body").cast("string")).alias("length_set"))


@query(REDACTED + " SELECT doc_id, sha256('Bearer ' || new_text) AS authorization_sha256, sha256(new_text) AS key_sha256, sha256(text) AS host_sha256 FROM new")
def body_headers(spark, sf):
    """Headers that may hold secrets change, others stay."""
    text = F.coalesce("text", F.lit(""))
    headers = F.create_map(F.lit("Authorization"), F.concat(F.lit("Bearer "), text), F.lit("X-Api-Key"), text, F.lit("Host"), text)
    rows = table(spark, sf, "documents").select("doc_id", headers.alias("headers"), F.lit(None).cast("binary").alias("body"))
    out = bodies.redact_bodies(rows, KEY).select("doc_id", F.col("new_headers").alias("h"))
    return out.select("doc_id", sha(F.col("h.Authorization")).alias("authorization_sha256"), sha(F.col("h.X-Api-Key")).alias("key_sha256"), sha(F.col("h.Host")).alias("host_sha256"))


@query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def body_restored(spark, sf):
    """Redacted and packed bodies, restored with the request's own pairs before those of a dictionary that says otherwise."""
    out = redacted(spark, sf, F.col("text"), "text/plain", "gzip")
    pairs = F.filter(F.transform("redactions", lambda r: F.struct(r["fake"].alias("fake"), r["original"].alias("original"))), lambda p: p["fake"] != p["original"])
    wrong = F.transform(pairs, lambda p: F.struct(p["fake"].alias("fake"), F.lit("wrong").alias("original")))
    held = out.select("doc_id", F.col("new_body").alias("body"), F.lit("gzip").alias("encoding"), F.array_distinct(pairs).alias("pairs"), wrong.alias("known"))
    back = bodies.deanonymize_bodies(held, known_col="known")
    return back.select("doc_id", sha(route.decompress(F.col("new_body"), F.lit("gzip")).cast("string")).alias("text_sha256"))


@query(f"WITH h AS ({sql.hits(gate=GATE.format(t='t'))}) SELECT doc_id, rule_id, \"start\", \"end\" FROM h")
def scan_compressed(spark, sf):
    packed = table(spark, sf, "documents").select("doc_id", route.compress(F.encode("text", "utf-8"), F.lit("gzip")).alias("body"), F.lit("GZIP").alias("encoding"))
    return bodies.scan_compressed(packed).select("doc_id", "rule_id", "start", "end")


@query("SELECT conv_id, turn, text AS flat, '{\"turn\":' || turn || '}' AS other FROM conversations")
def flatten_json(spark, sf):
    """Values of JSON as text."""
    value = F.parse_json(F.to_json(F.struct(F.col("text").alias("v"), F.struct("turn").alias("o"))))
    rows = table(spark, sf, "conversations").withColumn("j", value)
    field = lambda name: bodies.flat_text(F.try_variant_get("j", f"$.{name}", "variant"))
    return rows.select("conv_id", "turn", field("v").alias("flat"), field("o").alias("other"))


@query("SELECT role AS method, '/' || conv_id || '/' || turn AS uri, nullif(text, '') AS body, CASE WHEN turn % 2 = 0 THEN turn ELSE 0 END::BIGINT AS caught FROM conversations")
def request_log(spark, sf):
    """Requests written as JSON lines, bodies packed or not, and read back."""
    from ..sources import logs
    from .streams import folder

    talk = table(spark, sf, "conversations")
    body = route.compress(F.encode("text", "utf-8"), F.when(F.col("turn") % 3 == 0, "gzip"))
    uri = F.concat(F.lit("/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    rows = logs.request_rows(talk.withColumn("body", body), "request", F.timestamp_seconds(F.col("conv_id")), F.col("role"), uri, F.lit(200), F.when(F.col("turn") % 2 == 0, F.col("turn")))
    path = folder(spark, "requests")
    logs.append_jsonl(rows, path)
    return logs.read_requests(spark, path).select("method", "uri", "body", "caught")


@query("SELECT '/' || conv_id || '/' || turn AS uri, role, sha256(text) AS text_sha256, turn AS n FROM conversations")
def request_log_json(spark, sf):
    """JSON bodies, packed or not, are structured in the log: read back as structs."""
    from ..sources import logs
    from .streams import folder

    talk = table(spark, sf, "conversations")
    value = F.encode(F.to_json(F.struct("role", F.struct("text", F.array("turn").alias("n")).alias("m"))), "utf-8")
    body = route.compress(value, F.when(F.col("turn") % 3 == 0, "gzip"))
    uri = F.concat(F.lit("/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    rows = logs.request_rows(talk.withColumn("body", body), "request", F.timestamp_seconds(F.col("conv_id")), F.col("role"), uri, F.lit(200))
    path = folder(spark, "requests")
    logs.append_jsonl(rows, path)
    back = spark.read.schema("uri string, body struct<role:string,m:struct<text:string,n:array<long>>>").json(path)
    return back.select("uri", "body.role", sha(F.col("body.m.text")).alias("text_sha256"), F.get("body.m.n", F.lit(0)).alias("n"))
