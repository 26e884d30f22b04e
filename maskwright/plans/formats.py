"""Format routing queries; bodies are made from the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect, route
from ..session import table
from ..sources.rules import CORE
from . import sql
from .registry import query

#: A pattern and its stand-in: what a body's values change to here.
WORD, NEW = "[a-z]*th[a-z]*", "<th>"
TYPES = ["application/json; charset=utf-8", "application/x-www-form-urlencoded", 'multipart/form-data; boundary="aB1"', "multipart/form-data", "text/event-stream", "image/png", "application/octet-stream", "text/plain", "Application/JSON", ""]


def change(c):
    return F.regexp_replace(c, WORD, NEW)


def talk(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def sql_change(x: str) -> str:
    return f"regexp_replace({x}, '{WORD}', '{NEW}', 'g')"


#: Parts of header names; a name is one of each, so what is searched can be told from the parts.
FIRST, LAST = ("X-", "my-", "Cache-", ""), ("Api-Key", "Secret-Id", "Trace", "tokens", "Host", "PASSWORD", "Control", "Authorization", "Content-Type")


@query(f"""WITH n AS (SELECT e, {"[" + ", ".join(sql.quoted(x) for x in FIRST) + "]"}[e % 4 + 1] AS a, {"[" + ", ".join(sql.quoted(x) for x in LAST) + "]"}[e // 4 % 9 + 1] AS b, e % 4 AS i, e // 4 % 9 AS j FROM (SELECT event_id AS e FROM events))
SELECT e AS event_id, a || b AS name, j IN (0, 1, 3, 5) OR i = 3 AND j = 7 AS searched FROM n""")
def header_predicate(spark, sf):
    e = F.col("event_id")
    part = lambda options, i: F.element_at(F.array(*[F.lit(o) for o in options]), (i + 1).cast("int"))
    names = table(spark, sf, "events").select("event_id", F.concat(part(FIRST, e % 4), part(LAST, F.floor(e / 4) % 9)).alias("name"))
    return names.withColumn("searched", route.header_searched(F.col("name")))


@query("SELECT content_type || '; v=' || lang AS content_type, CASE WHEN starts_with(low, 'application/json') THEN 'json' WHEN starts_with(low, 'application/x-www-form-urlencoded') THEN 'form'"
       + " WHEN starts_with(low, 'multipart/form-data') AND contains(low, 'boundary=') THEN 'multipart' WHEN starts_with(low, 'text/event-stream') THEN 'sse'"
       + " WHEN starts_with(low, 'image/') OR starts_with(low, 'audio/') OR starts_with(low, 'video/') OR starts_with(low, 'application/octet-stream') THEN 'binary' ELSE 'plain' END AS route"
       + " FROM (SELECT *, lower(content_type) AS low FROM (VALUES " + ", ".join(f"({sql.quoted(t)})" for t in TYPES) + ") v(content_type), (SELECT DISTINCT lang FROM documents))")
def content_routes(spark, sf):
    """Content types, each with a parameter from the table."""
    langs = table(spark, sf, "documents").select("lang").distinct()
    every = langs.select("lang", F.explode(F.array(*[F.lit(t) for t in TYPES])).alias("t"))
    return every.select(F.concat("t", F.lit("; v="), F.col("lang")).alias("content_type")).select("content_type", route.route_of(F.col("content_type")).alias("route"))


HOST = "regexp_extract(url, '^[a-z]+://([^/:]+)', 1)"


@query(f"SELECT page_id, host, host = 'example' OR ends_with(host, '.example') OR host = 'org' OR ends_with(host, '.org') AS taken FROM (SELECT page_id, {HOST} AS host FROM pages)")
def host_predicate(spark, sf):
    hosts = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1).alias("host"))
    return hosts.select("page_id", "host", route.host_matches(F.col("host"), ("example", "org")).alias("taken"))


@query("SELECT doc_id, starts_with(h, 'AWS4-HMAC-SHA256 Credential=') AS signed FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'AWS4-HMAC-SHA256 Credential=' || source WHEN 1 THEN 'Bearer AWS4-HMAC-SHA256 Credential=' ELSE lang END AS h FROM documents)")
def signed_bypass(spark, sf):
    rest = F.col("doc_id") % 3
    header = F.when(rest == 0, F.concat(F.lit("AWS4-HMAC-SHA256 Credential="), F.col("source"))).when(rest == 1, "Bearer AWS4-HMAC-SHA256 Credential=").otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", route.signed_request(header).alias("signed"))


@query(f"SELECT conv_id, turn, {sql_change('text')} AS value, '&role=' || role AS rest FROM conversations")
def form_redact(spark, sf):
    body = F.concat(F.lit("q="), F.url_encode("text"), F.lit("&role="), F.col("role"))
    new = route.map_form(body, change)
    value = F.url_decode(F.regexp_extract(new, "^q=([^&]*)", 1))
    return talk(spark, sf).select("conv_id", "turn", value.alias("value"), F.regexp_extract(new, "^[^&]*(.*)$", 1).alias("rest"))


SSE = "'event: ' || role || chr(10) || 'data: ' || replace(replace(text, chr(13), ''), chr(10), chr(10) || 'data: ') || chr(10) || chr(10) || 'data: [DONE]' || chr(10) || chr(10)"


def sse_body():
    lines = F.replace(F.replace(F.col("text"), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\ndata: "))
    return F.concat(F.lit("event: "), F.col("role"), F.lit("\ndata: "), lines, F.lit("\n\ndata: [DONE]\n\n"))


@query("SELECT conv_id, turn, 2 AS frames, role AS event, replace(text, chr(13), '') AS data FROM conversations")
def sse_frames(spark, sf):
    frames = route.sse_frames(sse_body())
    return talk(spark, sf).select("conv_id", "turn", frames.alias("f")).select("conv_id", "turn", F.size("f").alias("frames"), F.col("f")[0]["event"].alias("event"), F.col("f")[0]["data"].alias("data"))


@query(f"SELECT conv_id, turn, 'event: ' || role || chr(10) || 'data: ' || replace({sql_change('t')}, chr(10), chr(10) || 'data: ') || chr(10) || chr(10) || 'data: [DONE]' || chr(10) || chr(10) AS body FROM (SELECT *, replace(text, chr(13), '') AS t FROM conversations)")
def sse_redact(spark, sf):
    return talk(spark, sf).select("conv_id", "turn", route.map_sse(sse_body(), change).alias("body"))


@query(f"SELECT conv_id, turn, {sql_change('text')} AS value, role FROM conversations")
def json_redact(spark, sf):
    """Values of any JSON tree: leaves out, changed, and put back; keys and numbers stay."""
    body = F.to_json(F.struct("role", F.struct(F.col("text").alias("value"), F.col("turn").alias("n")).alias("inner")))
    bodies = talk(spark, sf).select(F.struct("conv_id", "turn").alias("id"), body.alias("body"))
    leaves = route.json_leaves(bodies)
    changed = leaves.where(F.col("path") == "/inner/value").withColumn("text", change(F.col("text")))
    new = route.json_rebuilt(bodies, changed).withColumn("v", F.from_json("body", "role string, inner struct<value:string,n:long>"))
    return new.select("id.conv_id", "id.turn", F.col("v.inner.value").alias("value"), F.col("v.role").alias("role"))


@query(f"SELECT conv_id, turn, {sql_change('t')} AS text_part, t AS file_part FROM (SELECT conv_id, turn, replace(text, chr(13), '') AS t FROM conversations)")
def multipart_redact(spark, sf):
    t = F.replace(F.col("text"), F.lit("\r"), F.lit(""))
    head = "--bX\r\nContent-Disposition: form-data; name=\"{}\"\r\n{}\r\n"
    body = F.concat(F.lit(head.format("a", "")), t, F.lit("\r\n" + head.format("f", "Content-Type: image/png\r\n")), t, F.lit("\r\n--bX--\r\n"))
    new = route.map_multipart(body, F.lit("multipart/form-data; boundary=bX"), WORD, NEW)
    parts = F.split(new, "--bX(?:--)?\r\n")
    content = lambda i: F.regexp_replace(F.regexp_replace(parts[i], "(?s)^.*?\r\n\r\n", ""), "\r\n$", "")
    return talk(spark, sf).select("conv_id", "turn", content(1).alias("text_part"), content(2).alias("file_part"))


@query("SELECT conv_id, turn, text AS back FROM conversations")
def gzip_roundtrip(spark, sf):
    encoding = F.element_at(F.array(F.lit("gzip"), F.lit("deflate"), F.lit("br")), (F.col("turn") % 3 + 1).cast("int"))
    packed = talk(spark, sf).select("conv_id", "turn", route.compress(F.col("text").cast("binary"), encoding).alias("body"), encoding.alias("encoding"))
    return packed.select("conv_id", "turn", route.loggable(route.decompress(F.col("body"), F.col("encoding"))).alias("back"))


@query("SELECT conv_id, turn, 'Bearer ' || '<' || role || '>' AS bearer, 'Basic ' || base64(encode('<' || 'u:' || role || '>')) AS basic FROM conversations")
def header_redact(spark, sf):
    wrap = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    basic = F.concat(F.lit("Basic "), F.base64(F.concat(F.lit("u:"), F.col("role")).cast("binary")))
    return talk(spark, sf).select("conv_id", "turn", route.authorization(F.concat(F.lit("Bearer "), F.col("role")), wrap).alias("bearer"), route.authorization(basic, wrap).alias("basic"))


@query(f"WITH h AS ({sql.hits()}), t(content_type, signed) AS (VALUES ('image/png', false), ('text/plain', false), ('text/plain', true), ('application/octet-stream', false)) SELECT content_type, signed, CASE WHEN content_type = 'text/plain' AND NOT signed THEN (SELECT count(*) FROM h) ELSE 0 END AS n FROM t")
def routed_scan(spark, sf):
    """Every document as a body of four kinds: binary ones and signed requests pass unsearched."""
    kind = lambda t, s: F.struct(F.lit(t).alias("content_type"), F.lit(s).alias("signed"))
    kinds = F.explode(F.array(kind("image/png", False), kind("text/plain", False), kind("text/plain", True), kind("application/octet-stream", False)))
    bodies = table(spark, sf, "documents").select("doc_id", "text", kinds.alias("kind")).select(F.struct("doc_id", "kind.content_type", "kind.signed").alias("doc_id"), "text")
    signature = F.when(F.col("doc_id.signed"), F.lit("AWS4-HMAC-SHA256 Credential=x"))
    searched = bodies.where((route.route_of(F.col("doc_id.content_type")) != "binary") & ~route.signed_request(signature))
    found = detect.scan(searched, CORE).groupBy("doc_id.content_type", "doc_id.signed").agg(F.count(F.lit(1)).alias("n"))
    every = bodies.select("doc_id.content_type", "doc_id.signed").distinct()
    return every.join(found, ["content_type", "signed"], "left").select("content_type", "signed", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN strlen(text)::VARCHAR ELSE '0' END AS content_length FROM conversations")
def content_length(spark, sf):
    headers = F.create_map(F.lit("content-length"), F.lit("0"))
    new = route.content_length(headers, F.col("text"), F.col("turn") % 2 == 0)
    return talk(spark, sf).select("conv_id", "turn", F.try_element_at(new, F.lit("content-length")).alias("content_length"))
