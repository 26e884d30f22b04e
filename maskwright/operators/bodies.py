"""Whole bodies: found by format, searched leaf by leaf, changed and put together again.

A body is a row; nothing is shuffled. One Arrow pass walks the searchable texts (leaves) of a body and its headers and searches each under
all rules, built-in expressions make the stand-ins, and a second pass puts them at the same places of the same walk. So values are told apart by
their place, whatever their keys, and what isn't changed keeps its bytes. The plan doesn't grow with the number of rules.

Leaves: values of JSON (not keys, not encoded media), decoded values of forms, text parts of multipart bodies and data of
event streams, both as JSON where they are JSON, and plain text. JSON that can't be read is plain text. Plain text and whole bodies
are searched only if a keyword occurs; values are always searched.

Whatever can't be unpacked, decoded or walked is passed on as it is, without redactions: that holds for null and empty
bodies too. Bodies of any size are walked whole.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from urllib.parse import quote_plus, unquote_plus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow_column
from ..functions.fakes import engine_key, fake, fake_of_rule
from ..functions.fpe import enciphered
from ..functions.scalar import folded
from ..sources.rules import CORE, for_java
from . import detect, rewrite, route
from .matcher import matcher

FOUND = "struct<start:int,shorter:int,rule_id:string,end:int,raw:string,fake:string>"
SPAN = "struct<leaf:int,start:int,end:int,rule_id:string,raw:string,kind:string,prefix:string,cipher:string>"

#: What a walk calls for each leaf: its text and whether it is whole plain text; returns the text to put there.
Change = Callable[[str, bool], str]


# ---- walks -------------------------------------------------------------------------------


class _Pairs(list):
    """An object's members in order, repeated keys too."""


class _Literal(str):
    """A number as it was written."""


def _reject(name: str):
    raise ValueError(f"{name} is no JSON")


def _parse(text: str):
    return json.loads(text, object_pairs_hook=_Pairs, parse_float=_Literal, parse_int=_Literal, parse_constant=_reject)


def _media(value) -> bool:
    return route.binary_json(dict(value) if isinstance(value, _Pairs) else value)


def _dumped(value) -> str:
    if isinstance(value, _Literal):
        return str(value)
    if isinstance(value, _Pairs):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dumped(v)}" for k, v in value) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_dumped, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def _mapped(value, change: Callable[[str], str]):
    if isinstance(value, _Literal) or _media(value):
        return value
    if isinstance(value, str):
        return change(value)
    if isinstance(value, _Pairs):
        return _Pairs((k, _mapped(v, change)) for k, v in value)
    return [_mapped(v, change) for v in value] if isinstance(value, list) else value


def walk_json(text: str, change: Change, whole: bool) -> str:
    """Every string value; text that is no JSON is a leaf itself."""
    try:
        value = _parse(text)
        _dumped(value).encode()  # what can't be written again isn't taken apart
    except (ValueError, RecursionError):
        return change(text, whole)
    changed = False

    def one(old: str) -> str:
        nonlocal changed
        new = change(old, False)
        changed |= new != old
        return new

    new = _mapped(value, one)
    return _dumped(new) if changed else text


def walk_form(text: str, change: Change) -> str:
    out = []
    for pair in text.split("&"):
        key, mark, value = pair.partition("=")
        old = unquote_plus(value, errors="strict") if mark else ""
        new = change(old, False) if mark else old
        out.append(pair if new == old else f"{key}={quote_plus(new)}")
    return "&".join(out)


def walk_sse(text: str, change: Change) -> str:
    """Data lines of a frame are one text; other lines and the gaps between frames stay."""
    out = []
    for frame in re.split(r"((?:\r?\n){2,})", text):
        lines = re.split(r"(?<=\n)", frame)
        at = [i for i, line in enumerate(lines) if line.startswith("data:")]
        old = "\n".join(re.sub("^data: ?", "", lines[i]).rstrip("\r\n") for i in at)
        if at and old != "[DONE]":
            new = walk_json(old, change, False)
            if new != old:
                end = lines[at[-1]][len(lines[at[-1]].rstrip("\r\n")) :]
                lines[at[0]] = "\n".join(f"data: {line}" for line in new.split("\n")) + end
                lines = [line for i, line in enumerate(lines) if i not in at[1:]]
        out.append("".join(lines))
    return "".join(out)


def walk_multipart(body: bytes, boundary: str, change: Change) -> bytes:
    parts, changed = [], False
    for head, content in route.multipart_parts(body, boundary):
        new = content
        if not route.part_is_binary(head):
            text = content.decode()
            is_json = re.search(rb"(?i)content-type:\s*application/json", head)
            new = (walk_json(text, change, True) if is_json else change(text, True)).encode()
        changed |= new != content
        parts.append((head, new))
    return route.multipart_text(parts, boundary) if changed else body


def walk(body: bytes, kind: str, boundary: str, change: Change) -> bytes:
    if kind in ("binary", "signed"):
        return body
    if kind == "multipart":
        return walk_multipart(body, boundary, change)
    text = body.decode()
    walks = {"json": lambda: walk_json(text, change, True), "form": lambda: walk_form(text, change), "sse": lambda: walk_sse(text, change)}
    return walks.get(kind, lambda: change(text, kind != "field"))().encode()


class _Unreadable(Exception):
    """A body that can't be walked, or not in the same way again."""


_BROKEN = (ValueError, TypeError, AttributeError, RecursionError, _Unreadable)


def _header_leaf(name: str, value: str | None) -> tuple[str, str] | None:
    """What is searched in a header's value, and the scheme that stays before it; Basic credentials are searched in the clear."""
    low = name.lower()
    if value is None or low in route.NEVER or not (low in route.ALWAYS or re.search(route.PARTS, low)) or value.startswith(route.SIGNED):
        return None
    if low == "authorization" and value.startswith("Bearer "):
        return value[len("Bearer ") :].lstrip(" "), "Bearer "
    if low == "authorization" and value.startswith("Basic "):
        try:
            return base64.b64decode(value[len("Basic ") :].strip(), validate=True).decode(), "Basic "
        except ValueError:
            pass
    return value, ""


def found_leaves(rules, literals: bool = True):
    """A function of (body, kind, boundary, encoding, headers) for the first pass: spans of all leaves of the body, numbered from 0, and of the headers,
    numbered from -1 down."""

    def one(body, kind, boundary, encoding, headers, cipher):
        held, found, n = matcher(rules, literals), [], 0

        def search(text: str, whole: bool) -> str:
            nonlocal n
            text.encode()
            for start, end, i, raw in held.disjoint(held.scan(text, whole)):
                rule = rules[i]
                number = enciphered(raw, cipher) if rule.replacement_type == "fpe_numeric" else None
                found.append((n, start, end, rule.id, raw, rule.replacement_type, rule.literal_prefix or "", number))
            n += 1
            return text

        if kind == "signed":
            return []
        try:
            walk(route.unpack(body, encoding), kind, boundary, search)
        except _BROKEN:
            found.clear()
        for i, (name, value) in enumerate(headers or ()):
            if leaf := _header_leaf(name, value):
                n = -1 - i
                search(leaf[0], False)
        return found

    return one


def _spliced(text: str, spans) -> str:
    """text with (start, end, fake), sorted and disjoint, put in place."""
    out, at = [], 0
    for start, end, new in spans:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def _by_leaf(found) -> dict[int, list]:
    out: dict[int, list] = {}
    for s in found or ():
        out.setdefault(s["leaf"], []).append((s["start"], s["end"], s["fake"]))
    return out


def rebuilt(body: bytes | None, kind: str, boundary: str, encoding: str | None, found: list) -> bytes | None:
    """The body with the stand-ins of found (leaf, start, end, fake) put in place, in the same walk."""
    by_leaf = _by_leaf(found)
    if not any(leaf >= 0 for leaf in by_leaf):
        return body
    n = 0

    def put(text, whole):
        nonlocal n
        spans = by_leaf.get(n, ())
        n += 1
        return _spliced(text, spans) if spans else text

    try:
        return route.pack(walk(route.unpack(body, encoding), kind, boundary, put), encoding)
    except _BROKEN:
        return body


def _new_headers(headers, found: list):
    """(name, value) pairs with the stand-ins of found (leaf, start, end, fake) put in place."""
    by_leaf, out = _by_leaf(found), []
    for i, (name, value) in enumerate(headers or ()):
        if -1 - i in by_leaf:
            text, scheme = _header_leaf(name, value)
            value = _spliced(text, by_leaf[-1 - i])
            value = scheme + (base64.b64encode(value.encode()).decode() if scheme == "Basic " else value)
        out.append((name, value))
    return out


# ---- texts -------------------------------------------------------------------------------


def found_in(text: Column, key: str, rules=CORE, whole: Column | None = None, visible: bool = False) -> Column:
    """Disjoint spans of a text with their stand-ins, in order, as one expression for a handful of rules: what scan, resolve_overlaps,
    drop_partial_overlaps and with_fakes give. whole: texts that are searched only if a keyword of some rule occurs."""
    nothing = F.array().cast(f"array<{FOUND}>")
    if any(r.replacement_type == "fpe_numeric" for r in rules):
        raise ValueError("fpe_numeric runs in Python: redact_texts takes such rules")

    def one(rule) -> Column:
        kept = F.filter(detect.spans(text, for_java(rule.regex)), lambda s: detect.keep(rule, s["raw"]))
        made = lambda s: fake(rule.replacement_type, key, s["raw"], rule.literal_prefix, visible, rule.id)
        rows = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("shorter"), F.lit(rule.id).alias("rule_id"), s["end"].alias("end"), s["raw"].alias("raw"), made(s).alias("fake")))
        return F.when(detect.rule_gate(text, rule), rows).otherwise(nothing)

    start = F.struct(F.lit(-1).alias("most"), F.lit(-1).alias("at"))

    def step(acc, s):
        taken = (acc["most"] < s["end"]) & (s["start"] >= acc["at"])
        return F.struct(F.greatest(acc["most"], s["end"]).alias("most"), F.when(taken, s["end"]).otherwise(acc["at"]).alias("at")), F.when(taken, F.array(s)).otherwise(nothing)

    found = folded(F.array_sort(F.concat(*[one(r) for r in rules])), start, FOUND, step)
    return found if whole is None else F.when(whole & ~detect.keyword_gate(text, rules), nothing).otherwise(found)


def header(headers: Column, name: str) -> Column:
    """The value of a header, whatever the case of its name."""
    return F.get(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name), 0)["value"]


def _stand_ins(found: Column, key: str, rules, visible: bool) -> Column:
    """found (leaf, start, end, rule_id, raw, kind, prefix, cipher) with fake. The expression has a branch a type, not a rule."""
    kinds = {r.replacement_type for r in rules}
    made = lambda s: fake_of_rule(kinds, s["kind"], key, s["raw"], s["prefix"], s["rule_id"], s["cipher"], visible)
    return F.transform(found, lambda s: F.struct(s["leaf"].alias("leaf"), s["start"].alias("start"), s["end"].alias("end"), s["rule_id"].alias("rule_id"), s["raw"].alias("original"), made(s).alias("fake")))


def _redactions(found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["rule_id"].alias("rule_id"), s["original"].alias("original"), s["fake"].alias("fake")))


# ---- bodies ------------------------------------------------------------------------------


def redact_bodies(bodies: DataFrame, key: str, rules=CORE, body_col: str = "body", headers_col: str = "headers", visible: bool = False, literals: bool = True) -> DataFrame:
    """bodies (body binary, headers map<string,string>) with route, redactions (rule_id, original, fake), new_body, new_headers and
    header_redactions.

    Any number of rules: a first pass walks a body and its headers and searches each leaf, built-in expressions make the stand-ins, and a second pass
    puts them in place, only where something was found. Headers that may hold secrets are searched; schemes of authorization stay. Signed requests pass as they are. A content-length
    header follows a body that was changed.
    """
    from uuid import uuid4

    rules = tuple(rules)
    body, headers = F.col(body_col), F.coalesce(F.col(headers_col), F.create_map().cast("map<string,string>"))
    names = {n: f"{n}_{uuid4().hex}" for n in ("found", "kind", "boundary", "encoding", "headers", "named")}
    content_type = F.coalesce(header(headers, "content-type"), F.lit(""))
    signed = route.signed_request(header(headers, "authorization"))
    out = bodies.withColumn("route", route.route_of(content_type)).withColumn(names["kind"], F.when(signed, F.lit("signed")).otherwise(F.col("route")))
    out = out.withColumn(names["boundary"], route.boundary_of(content_type)).withColumn(names["encoding"], F.lower(header(headers, "content-encoding")))
    out = out.withColumn(names["headers"], headers)
    inputs = [body, *(F.col(names[n]) for n in ("kind", "boundary", "encoding"))]
    search = _keyed(found_leaves(rules, literals), key)
    out = out.withColumn(names["found"], arrow_column(search, f"array<{SPAN}>", [*inputs, F.col(names["headers"])], once=True))
    out = out.withColumn(names["found"], _stand_ins(F.col(names["found"]), key, rules, visible))
    put = lambda b, kind, boundary, encoding, pairs, found: {"body": rebuilt(b, kind, boundary, encoding, found), "headers": _new_headers(pairs, found)}
    in_body, in_headers = F.filter(names["found"], lambda s: s["leaf"] >= 0), F.filter(names["found"], lambda s: s["leaf"] < 0)
    # What stays as it is doesn't travel again.
    hit, named = (F.size(in_body) > 0, F.size(in_headers) > 0), F.col(names["named"])
    sent = [F.when(hit[0], body), *inputs[1:], F.when(hit[1], F.col(names["headers"])), F.when(hit[0] | hit[1], F.col(names["found"]))]
    out = out.withColumn(names["named"], arrow_column(put, "struct<body:binary,headers:map<string,string>>", sent, once=True))
    new_body = F.when(hit[0], named["body"]).otherwise(body).alias("new_body")
    out = out.select("*", _redactions(in_body).alias("redactions"), _redactions(in_headers).alias("header_redactions"), new_body)
    fresh = F.when(hit[1], named["headers"]).otherwise(F.col(names["headers"]))
    changed = F.coalesce(F.col("new_body") != body, F.lit(False))
    # Not by transform_values: a Python column can't be read inside a lambda.
    name = F.get(F.filter(F.map_keys(fresh), lambda k: F.lower(k) == "content-length"), 0)
    others = F.map_filter(fresh, lambda k, v: F.lower(k) != "content-length")
    with_length = F.map_concat(others, F.create_map(F.coalesce(name, F.lit("")), F.octet_length("new_body").cast("string")))
    return out.withColumn("new_headers", F.when(changed & name.isNotNull(), with_length).otherwise(fresh)).drop(*names.values())


def redact_texts(docs: DataFrame, key: str, rules=CORE, text_col: str = "text", gate: bool = False, visible: bool = False, literals: bool = True) -> DataFrame:
    """docs with redactions (leaf, start, end, rule_id, original, fake) and new_text: rewriting under any number of rules in one Arrow pass; nothing is
    shuffled. gate: texts without any keyword stay as they are. Nulls stay null."""
    from uuid import uuid4

    rules, found = tuple(rules), f"found_{uuid4().hex}"
    search = _keyed(found_leaves(rules, literals), key)
    one = lambda text: search(None if text is None else text.encode(), "plain" if gate else "field", "", None, None)
    out = docs.withColumn(found, arrow_column(one, f"array<{SPAN}>", [F.col(text_col)], once=True))
    out = out.withColumn("redactions", _stand_ins(F.col(found), key, rules, visible)).drop(found)
    return out.withColumn("new_text", rewrite.splice(F.col(text_col), F.col("redactions")))


def _keyed(search, key: str):
    """search with the cipher of fpe_numeric under the engine's key."""
    return lambda *args: search(*args, cipher=engine_key(key))


def deanonymize_bodies(bodies: DataFrame, body_col: str = "body", encoding_col: str = "encoding", pairs_col: str = "pairs", known_col: str | None = None) -> DataFrame:
    """bodies with new_body: unpacked, stand-ins replaced by originals, packed again.

    pairs: array of (fake, original) of the request in flight; known: of the dictionary, of which those with a stand-in of the
    request are left out. Bodies that aren't text stay.
    """
    body, encoding, pairs = F.col(body_col), F.lower(F.col(encoding_col)), F.col(pairs_col)
    text = F.try_validate_utf8(route.decompress(body, encoding).cast("string"))
    back = rewrite.restore(text, F.coalesce(pairs, F.array().cast("array<struct<fake:string,original:string>>")))
    if known_col is not None:
        own = F.coalesce(F.transform(pairs, lambda p: p["fake"]), F.array().cast("array<string>"))
        rest = F.filter(F.coalesce(F.col(known_col), F.array().cast("array<struct<fake:string,original:string>>")), lambda p: ~F.array_contains(own, p["fake"]))
        back = rewrite.restore(back, rest)
    same = text.isNull() | (back == text)
    return bodies.withColumn("new_body", F.when(same, body).otherwise(route.compress(F.when(~same, back.cast("binary")), encoding)))


def scan_compressed(bodies: DataFrame, rules=CORE, id_col: str = "doc_id", body_col: str = "body", encoding_col: str = "encoding") -> DataFrame:
    """scan() of unpacked bodies; one that can't be unpacked is searched as it is, one that isn't text not at all."""
    text = F.try_validate_utf8(route.decompress(F.col(body_col), F.lower(F.col(encoding_col)), once=True).cast("string"))
    return detect.scan(bodies.select(F.col(id_col).alias("doc_id"), text.alias("text")), rules, gate=True)


def flat_text(value: Column) -> Column:
    """A JSON value (variant) as text: strings as they are, others written out."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))
