"""Bodies by format: JSON, forms, multipart, event streams, compressed bodies and headers.

Whatever can't be read is passed on as it is, without redactions.
"""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow_column, bounded_batches

#: Header names that are never, and always, searched; others by parts of their name.
NEVER = (
    "content-type", "content-length", "user-agent", "accept", "host", "accept-encoding", "cache-control", "accept-language", "connection",
    "transfer-encoding", "content-encoding",
)
ALWAYS = ("authorization", "x-api-key", "x-auth-token", "x-secret")
PARTS = "key|secret|token|password"
SIGNED = "AWS4-HMAC-SHA256 Credential="


def header_searched(name: Column) -> Column:
    low = F.lower(name)
    return ~low.isin(*NEVER) & (low.isin(*ALWAYS) | low.rlike(PARTS))


def signed_request(authorization: Column) -> Column:
    """Signed requests must not be changed."""
    return F.coalesce(authorization.startswith(SIGNED), F.lit(False))


def host_matches(host: Column, hosts) -> Column:
    out = F.lit(False)
    for h in hosts:
        out = out | (host == h) | host.endswith("." + h)
    return out


def route_of(content_type: Column) -> Column:
    """json, form, multipart, sse, binary or plain."""
    low = F.lower(F.coalesce(content_type, F.lit("")))
    binary = low.rlike("^(image|audio|video)/") | low.startswith("application/octet-stream")
    return (
        F.when(low.startswith("application/json"), "json").when(low.startswith("application/x-www-form-urlencoded"), "form")
        .when(low.startswith("multipart/form-data") & (boundary_of(content_type) != ""), "multipart")
        .when(low.startswith("text/event-stream"), "sse").when(binary, "binary").otherwise("plain")
    )


def boundary_of(content_type: Column) -> Column:
    return F.regexp_extract(content_type, r'boundary="?([^";,\s]+)"?', 1)


def map_form(body: Column, change) -> Column:
    """A form body with each value decoded, changed and encoded again; keys and order stay."""

    def one(pair):
        key, value = F.substring_index(pair, "=", 1), F.regexp_replace(pair, "^[^=]*=?", "")
        return F.when(F.contains(pair, F.lit("=")), F.concat(key, F.lit("="), F.url_encode(change(F.url_decode(value))))).otherwise(pair)

    return F.array_join(F.transform(F.split(body, "&"), one), "&")


def sse_frames(body: Column) -> Column:
    """array of (event, id, data): frames end at an empty line, several data lines are one with line feeds."""
    frames = F.filter(F.split(F.regexp_replace(body, "\r\n", "\n"), "\n\n"), lambda f: F.length(F.trim(f)) > 0)

    def one(frame):
        lines = F.split(frame, "\n")
        value = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(f"{name}:")), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
        return F.struct(F.get(value("event"), F.lit(0)).alias("event"), F.get(value("id"), F.lit(0)).alias("id"), F.array_join(value("data"), "\n").alias("data"))

    return F.transform(frames, one)


def sse_text(frames: Column) -> Column:
    """The body of frames; each line of data has its own field."""

    def one(f):
        lines = F.array_join(F.transform(F.split(f["data"], "\n"), lambda x: F.concat(F.lit("data: "), x)), "\n")
        return F.concat(F.when(f["event"].isNotNull(), F.concat(F.lit("event: "), f["event"], F.lit("\n"))).otherwise(""), F.when(f["id"].isNotNull(), F.concat(F.lit("id: "), f["id"], F.lit("\n"))).otherwise(""), lines, F.lit("\n\n"))

    return F.array_join(F.transform(frames, one), "")


def map_sse(body: Column, change) -> Column:
    """An event stream with each frame's data changed; [DONE] stays."""
    frames = F.transform(
        sse_frames(body), lambda f: F.struct(f["event"].alias("event"), f["id"].alias("id"), F.when(f["data"] == "[DONE]", f["data"]).otherwise(change(f["data"])).alias("data"))
    )
    return sse_text(frames)


def authorization(value: Column, change, credentials: Column | None = None) -> Column:
    """Bearer and Basic keep their scheme; Basic credentials are decoded, changed and encoded again.

    credentials: where it is false, the value is changed as a whole. change is called once, as its expression may be large.
    """
    credentials = F.lit(True) if credentials is None else credentials
    rest = F.regexp_replace(value, "^[A-Za-z]+ +", "")
    plain = F.try_to_binary(rest, F.lit("base64")).cast("string")
    bearer, basic = credentials & value.startswith("Bearer "), credentials & value.startswith("Basic ") & plain.isNotNull()
    new = change(F.when(bearer, rest).when(basic, plain).otherwise(value))
    return F.when(bearer, F.concat(F.lit("Bearer "), new)).when(basic, F.concat(F.lit("Basic "), F.base64(new.cast("binary")))).otherwise(new)


# ---- formats without a built-in ----------------------------------------------------------


def binary_json(value) -> bool:
    """Values that hold encoded media: data URLs, and objects of type base64 or with a media type."""
    if isinstance(value, str):
        return value.startswith("data:") and ";base64," in value
    if isinstance(value, dict) and isinstance(value.get("data"), str):
        media = str(value.get("media_type", ""))
        return value.get("type") == "base64" or media.startswith(("image/", "audio/", "video/")) or media == "application/pdf"
    return False


def pointer(path: str, key: str) -> str:
    """RFC 6901: one step further down."""
    return path + "/" + key.replace("~", "~0").replace("/", "~1")


def json_values(value, path: str = ""):
    """(path, text) of every string value that is to be searched, in document order; keys aren't. Paths are JSON pointers."""
    if binary_json(value):
        return
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from json_values(v, f"{path}/{i}")
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from json_values(v, pointer(path, k))


def json_replaced(value, new: dict[str, str], path: str = ""):
    if binary_json(value):
        return value
    if isinstance(value, str):
        return new.get(path, value)
    if isinstance(value, list):
        return [json_replaced(v, new, f"{path}/{i}") for i, v in enumerate(value)]
    if isinstance(value, dict):
        return {k: json_replaced(v, new, pointer(path, k)) for k, v in value.items()}
    return value


def json_leaves(bodies: DataFrame, id_col: str = "id", body_col: str = "body") -> DataFrame:
    """(id, path, text) of all string values; bodies that aren't JSON have none."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            at, paths, texts = [], [], []
            for i, body in enumerate(b.column("body").to_pylist()):
                try:
                    found = list(json_values(json.loads(body)))
                except (ValueError, TypeError, RecursionError):
                    continue
                for p, t in found:
                    at.append(i)
                    paths.append(p)
                    texts.append(t)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int32())), pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["id", "path", "text"])

    kind = dict(bodies.dtypes)[id_col]
    bounded_batches(bodies.sparkSession)
    return bodies.select(F.col(id_col).alias("id"), F.col(body_col).alias("body")).mapInArrow(run, f"id {kind}, path string, text string")


def json_rebuilt(bodies: DataFrame, changes: DataFrame) -> DataFrame:
    """bodies(id, body) with the values of changes(id, path, text) put in place; invalid JSON stays as it is."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(body, paths, texts):
        def one(b, p, t):
            if p is None or len(p) == 0:
                return b
            try:
                return json.dumps(json_replaced(json.loads(b), dict(zip(p, t))), ensure_ascii=False, separators=(",", ":"))
            except (ValueError, TypeError, RecursionError):
                return b

        return pd.Series([one(*x) for x in zip(body, paths, texts)])

    bounded_batches(bodies.sparkSession)
    grouped = changes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("c"))
    joined = bodies.join(grouped, "id", "left")
    return joined.select("id", run("body", F.transform("c", lambda x: x["path"]), F.transform("c", lambda x: x["text"])).alias("body"))


def multipart_parts(body: bytes, boundary: str) -> list[tuple[bytes, bytes]]:
    """(head, content) of each part; no closing boundary is needed."""
    out = []
    for piece in body.split(b"--" + boundary.encode())[1:]:
        if piece.startswith(b"--"):
            break
        head, _, content = piece.removeprefix(b"\r\n").partition(b"\r\n\r\n")
        out.append((head, content.removesuffix(b"\r\n")))
    return out


def multipart_text(parts, boundary: str) -> bytes:
    mark = b"--" + boundary.encode()
    return b"".join(mark + b"\r\n" + head + b"\r\n\r\n" + content + b"\r\n" for head, content in parts) + mark + b"--\r\n"


def part_is_binary(head: bytes) -> bool:
    found = re.search(rb"(?i)content-type:\s*([^\s;]+)", head)
    kind = found[1].lower() if found else b""
    return kind.startswith((b"image/", b"audio/", b"video/")) or kind == b"application/octet-stream"


def map_multipart(body: Column, content_type: Column, pattern: str, new: str) -> Column:
    """A multipart body with the pattern's matches replaced in its text parts; binary parts stay."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(bodies, boundaries):
        found = re.compile(pattern)

        def one(b, mark):
            if not mark or b is None or f"--{mark}" not in b:
                return b
            parts = [(h, c if part_is_binary(h) else found.sub(new, c.decode()).encode()) for h, c in multipart_parts(b.encode(), mark)]
            return multipart_text(parts, mark).decode()

        return pd.Series([one(*x) for x in zip(bodies, boundaries)])

    bounded_batches()
    return run(body, boundary_of(content_type))


def _inflated(data: bytes, bits: int) -> bytes | None:
    """All members of a compressed body, or None unless each is whole."""
    out = []
    while data:
        one = zlib.decompressobj(bits)
        out.append(one.decompress(data))
        if not one.eof:
            return None
        data = one.unused_data
        if bits != 31 and data:
            return None
    return b"".join(out)


def unpack(data: bytes | None, encoding: str | None) -> bytes | None:
    """The plain body; what can't be unpacked whole, or has another encoding, stays as it is."""
    if data is None or encoding not in ("gzip", "deflate"):
        return data
    for bits in (31,) if encoding == "gzip" else (-15, 15):
        try:
            if (found := _inflated(data, bits)) is not None:
                return found
        except zlib.error:
            continue
    return data


def pack(data: bytes | None, encoding: str | None) -> bytes | None:
    if data is None or encoding not in ("gzip", "deflate"):
        return data
    c = zlib.compressobj(6, zlib.DEFLATED, 31 if encoding == "gzip" else -15)
    return c.compress(data) + c.flush()


def decompress(body: Column, encoding: Column, once: bool = False) -> Column:
    """binary -> binary in an Arrow UDF; there is no built-in. once: see arrow_column."""
    return arrow_column(unpack, "binary", [body, encoding], once)


def compress(body: Column, encoding: Column, once: bool = False) -> Column:
    return arrow_column(pack, "binary", [body, encoding], once)


def loggable(body: Column) -> Column:
    """What a log shows of a body (binary): null if empty, text if UTF-8, else its size; a gzip body is unpacked first."""
    zipped = F.substr(body, F.lit(1), F.lit(2)) == F.lit(b"\x1f\x8b")
    plain = F.when(zipped, decompress(body, F.when(zipped, F.lit("gzip")))).otherwise(body)
    text = F.try_validate_utf8(plain.cast("string"))
    return F.when(F.octet_length(plain) == 0, None).when(text.isNotNull(), text).otherwise(F.concat(F.lit("<binary "), F.octet_length(plain).cast("string"), F.lit(" bytes>")))


def loggable_value(body: Column) -> Column:
    """loggable() as a variant: a body that is JSON keeps its structure, others are strings. JSON with repeated keys stays a string."""
    text = loggable(body)
    return F.coalesce(F.try_parse_json(text), text.cast("variant"))


def content_length(headers: Column, body: Column, replaced: Column) -> Column:
    """headers (map) with content-length set to the body's size where it was replaced and the header was there."""
    present = replaced & F.map_contains_key(headers, "content-length")
    return F.when(present, F.transform_values(headers, lambda k, v: F.when(k == "content-length", F.octet_length(body).cast("string")).otherwise(v))).otherwise(headers)
