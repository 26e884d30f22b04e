"""Whole bodies: what is found, what stays as it is, and what can't be read."""

import gzip
import json
import zlib

import pytest
from pyspark.sql import functions as F

from maskwright.functions import fakes
from maskwright.operators import bodies, rewrite, route
from maskwright.sources.rules import CORE, Rule

MAIL, HIDDEN = "ann@corp.com", "4532015112830366"
SCHEMA = "id int, headers map<string,string>, body binary"


def redacted(spark, rows):
    frame = spark.createDataFrame([(i, h, None if b is None else bytearray(b)) for i, (h, b) in enumerate(rows)], SCHEMA)
    found = {r.id: r for r in bodies.redact_bodies(frame, "k").collect()}
    return [found[i] for i in range(len(rows))]


@pytest.fixture(scope="module")
def fake_mail(spark):
    return spark.createDataFrame([(MAIL,)], "c string").select(fakes.email("k", F.col("c"))).first()[0]


def test_json_keeps_places_numbers_and_repeated_keys(spark, fake_mail):
    text = f'{{"a.b": "{MAIL}", "a": {{"b": "x {MAIL}"}}, "n": 1.50, "big": 123456789012345678901234567890, "a.b": "{MAIL}!", "{MAIL}": null, "m": {{"type": "base64", "data": "{MAIL}"}}, "u": "data:x;base64,{MAIL}", "l": ["é", ["{MAIL}"]]}}'
    (row,) = redacted(spark, [({"Content-Type": "application/json"}, text.encode())])
    new = bytes(row.new_body).decode()
    want = f'{{"a.b":"{fake_mail}","a":{{"b":"x {fake_mail}"}},"n":1.50,"big":123456789012345678901234567890,"a.b":"{fake_mail}!","{MAIL}":null,"m":{{"type":"base64","data":"{MAIL}"}},"u":"data:x;base64,{MAIL}","l":["é",["{fake_mail}"]]}}'
    assert new == want and len(row.redactions) == 4 and row.route == "json"


def test_what_cannot_be_read_passes(spark):
    json_type, form = {"Content-Type": "application/json"}, {"content-type": "application/x-www-form-urlencoded"}
    whole = gzip.compress(f"mail {MAIL}".encode())
    rows = [
        (json_type, b"\xff\xfe not text"), (json_type, b""), (json_type, None), (None, b"nothing here"), (json_type, b"[" * 100_000),
        (form, f"q=%ff{MAIL}".encode()), ({"Content-Type": "multipart/form-data; boundary=b"}, b"--b\r\nA: 1\r\n\r\n\xff\r\n--b--\r\n"),
        ({"Content-Encoding": "gzip", "Content-Type": "image/png"}, whole), ({"Authorization": "AWS4-HMAC-SHA256 Credential=x", "X-Secret": MAIL}, MAIL.encode()),
        ({"Content-Type": "image/png", "Content-Length": "9"}, MAIL.encode()), (json_type, json.dumps({"a": "\ud800", "b": 1}).encode()),
    ]
    for (headers, body), row in zip(rows, redacted(spark, rows)):
        assert row.redactions == [] and (row.new_body is None if body is None else bytes(row.new_body) == body)
        assert row.new_headers == (headers or {})


def test_invalid_json_is_plain_text(spark, fake_mail):
    (row, gated) = redacted(spark, [({"Content-Type": "application/json"}, f"{{broken {MAIL}".encode()), ({"Content-Type": "application/json"}, f"{{broken {HIDDEN}".encode())])
    assert bytes(row.new_body).decode() == f"{{broken {fake_mail}"
    assert gated.redactions == []  # no keyword in a whole text


def test_truncated_and_joined_gzip(spark, fake_mail):
    one, two = gzip.compress(f"one {MAIL} ".encode()), gzip.compress(f"two {MAIL}".encode())
    headers = {"Content-Encoding": "gzip", "Content-Type": "text/plain", "CONTENT-LENGTH": "1"}
    joined, cut = redacted(spark, [(headers, one + two), (headers, one[:-9])])
    assert gzip.decompress(bytes(joined.new_body)).decode() == f"one {fake_mail} two {fake_mail}"
    assert joined.new_headers["CONTENT-LENGTH"] == str(len(joined.new_body))
    assert bytes(cut.new_body) == one[:-9] and cut.new_headers["CONTENT-LENGTH"] == "1"
    assert route.unpack(zlib.compress(b"x")[:-2], "deflate") == zlib.compress(b"x")[:-2]


def test_form_stream_and_parts(spark, fake_mail):
    form = f"a=1&q=x+%2B+{MAIL.replace('@', '%40')}&flag&q={HIDDEN}"
    sse = f'retry: 3\nevent: e\ndata: {{"a":"{MAIL}"}}\n\n: note {MAIL}\n\ndata: l1 {MAIL}\ndata: l2\nid: 7\n\ndata: [DONE]\n\n'
    parts = f'--b\r\nContent-Type: application/json\r\n\r\n{{"a": "{MAIL}"}}\r\n--b\r\nContent-Disposition: form-data\r\n\r\nplain {MAIL}\r\n--b\r\nContent-Type: image/png\r\n\r\n{MAIL}\r\n--b--\r\n'
    rows = redacted(spark, [({"content-type": "application/x-www-form-urlencoded"}, form.encode()), ({"content-type": "text/event-stream"}, sse.encode()), ({"content-type": 'multipart/form-data; boundary="b"'}, parts.encode())])
    new = [bytes(r.new_body).decode() for r in rows]
    card = next(r["fake"] for r in rows[0].redactions if r["rule_id"] == "card")
    assert new[0] == f"a=1&q=x+%2B+{fake_mail.replace('@', '%40')}&flag&q={card}"
    assert new[1] == f'retry: 3\nevent: e\ndata: {{"a":"{fake_mail}"}}\n\n: note {MAIL}\n\ndata: l1 {fake_mail}\ndata: l2\nid: 7\n\ndata: [DONE]\n\n'
    assert new[2] == f'--b\r\nContent-Type: application/json\r\n\r\n{{"a":"{fake_mail}"}}\r\n--b\r\nContent-Disposition: form-data\r\n\r\nplain {fake_mail}\r\n--b\r\nContent-Type: image/png\r\n\r\n{MAIL}\r\n--b--\r\n'


def test_one_expression_equals_the_row_form(spark, sf):
    """found_in against scan, resolve_overlaps, drop_partial_overlaps and with_fakes."""
    from maskwright.operators import detect
    from maskwright.session import table

    docs = table(spark, sf, "documents").select("doc_id", "text")
    rules = [*CORE, Rule("partial", "[0-9a-f]{12} "), Rule("wide", r"@[a-z0-9.]+ [a-z]+", keywords=("@",))]
    rows = rewrite.with_fakes(detect.drop_partial_overlaps(detect.resolve_overlaps(detect.scan(docs, rules))), "k", rules)
    want = sorted((r.doc_id, r.start, r.end, r.rule_id, r.raw, r.fake) for r in rows.collect())
    one = docs.select("doc_id", F.inline(bodies.found_in(F.col("text"), "k", rules)))
    assert want and sorted((r.doc_id, r.start, r.end, r.rule_id, r.raw, r.fake) for r in one.collect()) == want


def test_restoring_prefers_the_request(spark):
    packed = gzip.compress(b"F1 and F2 and F22")
    frame = spark.createDataFrame([(1, bytearray(packed), "gzip"), (2, bytearray(b"\xff"), None), (3, None, None)], "id int, body binary, encoding string")
    pair = lambda f, o: F.struct(F.lit(f).alias("fake"), F.lit(o).alias("original"))
    frame = frame.withColumn("pairs", F.array(pair("F2", "two"), pair("", "x"))).withColumn("known", F.array(pair("F2", "wrong"), pair("F1", "one"), pair("F22", "twenty")))
    rows = {r.id: r.new_body for r in bodies.deanonymize_bodies(frame, known_col="known").collect()}
    assert gzip.decompress(bytes(rows[1])) == b"one and two and two2" and bytes(rows[2]) == b"\xff" and rows[3] is None


def test_types_without_a_format_are_redacted_under_their_rule(spark):
    values = spark.createDataFrame([("4111-1111-1111-1234",), ("12",)], "c string")
    rows = values.select("c", fakes.fake("fpe_numeric", "k", F.col("c"), rule_id="r1").alias("a"), fakes.fake("fpe_numeric", "other", F.col("c")).alias("b"), fakes.fake("unknown", "k", F.col("c"), rule_id="r1").alias("u")).collect()
    assert len(rows[0].a) == 16 and rows[0].a.isdigit() and rows[0].a != rows[0].b
    assert rows[1].a == rows[0].u == "[REDACTED:r1]" and rows[1].b == "[REDACTED]"
    typed = values.select(fakes.fake_by_type(F.lit("fpe_numeric"), "k", F.col("c"), rule_id=F.lit("r1")).alias("a")).collect()
    assert [r.a for r in typed] == [r.a for r in rows]


def test_logged_values(spark):
    bodies_ = [b'{"a":[1,{"b":"x"}]}', b"plain", b"123", b"", None, b"{broken", b"\xff\xfe", gzip.compress(b'{"z":null}'), b'{"a":1,"a":2}']
    rows = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(bodies_)], "i int, b binary")
    got = {r.i: r.v for r in rows.select("i", F.to_json(F.struct(route.loggable_value(F.col("b")).alias("v"))).alias("v")).collect()}
    want = ['{"v":{"a":[1,{"b":"x"}]}}', '{"v":"plain"}', '{"v":123}', "{}", "{}", '{"v":"{broken"}', '{"v":"<binary 2 bytes>"}', '{"v":{"z":null}}', '{"v":"{\\"a\\":1,\\"a\\":2}"}']
    assert got == dict(enumerate(want))
