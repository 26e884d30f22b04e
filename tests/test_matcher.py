"""The scan under many rules: its gates lose nothing, counts follow the automaton, and work is linear in spans."""

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from maskwright.functions.scalar import folded
from maskwright.operators import bodies, detect, rewrite
from maskwright.operators.matcher import Matcher, count_words, matcher, required_literals
from maskwright.plans.bodies import MANY
from maskwright.sources.rules import CORE, Rule


@pytest.fixture(scope="module")
def texts(sf):
    return [t or "" for (t,) in duckdb.connect().execute(f"SELECT text FROM '{sf}/documents.parquet'").fetchall()]


@pytest.mark.parametrize(
    "pattern, want",
    [("(?i)abc", None), ("ab(?:c|d)e+", ("ab",)), ("foo|bar(?=x)", ("bar", "foo")), ("[ab]c?", ("a", "b")), ("(?:abc)?def", ("def",)), ("a(?i:bc)d", ("a",)), ("(?:abc)*", None), ("(?:abc){2,}", ("abc",)),
     (r"\bghp_[0-9]", ("ghp_",)), ("(?x) a b # c\n d", ("abd",)), ("a|b?", None), ("x(?!abc)y", ("xy",)), ("(?#abc)xyz", ("xyz",)), ("[[:alpha:]]abc", None), (r"\p{L}abc", None), ("(a)?(?(1)bcd|e)", None), ("", None), ("(?>ab)c", ("ab",))],
)
def test_required_literals(pattern, want):
    assert required_literals(pattern) == want


def random_pattern(rnd, depth=0):
    part = rnd.choice("llllsrgobi" if depth < 3 else "lls")
    if part == "l":
        return "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 3)))
    if part == "s":
        return rnd.choice(["[ab]", "[^a]", ".", r"\b", "[a-c]", "^"])
    inner = lambda: random_pattern(rnd, depth + 1)
    return {"r": f"(?:{inner()}){rnd.choice(['?', '*', '+', '{2}', '{0,2}?'])}", "g": f"({inner()})", "o": f"(?:{inner()}|{inner()})", "b": f"{inner()}(?={inner()})", "i": f"(?i:{inner()})"}.get(part) + (inner() if rnd.random() < 0.6 else "")


def test_required_literals_lose_no_match():
    """Patterns made at random: every match holds one of the literals."""
    rnd, some = random.Random(1), 0
    for _ in range(3000):
        pattern = random_pattern(rnd)
        found = required_literals(pattern)
        if found:
            some += 1
            for _ in range(20):
                text = "".join(rnd.choice("abcABC ") for _ in range(rnd.randint(0, 14)))
                for m in re.finditer(pattern, text):
                    assert any(x in m[0] for x in found), (pattern, text, found)
    assert some > 1500


def test_gated_scan_equals_the_ungated_on_all_texts(texts):
    rules = (*MANY, Rule("free", "[0-9]{3} (?:ha|en|is)"), Rule("fold", "(?i)Token"), Rule("alt", "tion|ing"), Rule("empty", "xyz", keywords=("",)))
    keyless = tuple(Rule(r.id, r.regex) for r in rules)
    for own in (rules, keyless):
        gated, open_ = Matcher(own), Matcher(own, literals=False)
        assert any(gated.required) and not any(open_.required)
        assert [gated.scan(t) for t in texts] == [open_.scan(t) for t in texts]
        assert [gated.scan(t, gate=True) for t in texts] == [open_.scan(t, gate=True) for t in texts]
        assert sum(len(gated.candidates(t)[0]) for t in texts) < sum(len(open_.candidates(t)[0]) for t in texts)
    assert matcher(rules) is matcher(tuple(rules))


def counted(text, words):
    """The automaton's rule read off the text: the first end of any word that begins behind the last match."""
    at, n, end = 0, 0, 1
    while end <= len(text):
        if any(w and end - len(w) >= at and text[end - len(w) : end] == w for w in words):
            n, at = n + 1, end
        end += 1
    return n


def test_counts_with_nested_and_overlapping_words(spark):
    rnd = random.Random(3)
    for _ in range(300):
        words = tuple({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(0, 5))} | {""})
        text = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40)))
        assert count_words(text, words) == counted(text, words)
    assert count_words("aaaa", ("aa", "aaa")) == 2 and count_words("there", ("there", "here", "he")) == 1
    frame = spark.createDataFrame([(1, "there token"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(map(tuple, detect.count_keywords(frame, ["he", "token", "ken"]).collect())) == [(1, 2), (2, 0), (3, 0)]
    assert detect.count_keywords(frame.limit(0), ["he"]).count() == 0


def test_texts_under_many_rules_equal_the_row_form(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = detect.drop_partial_overlaps(detect.resolve_overlaps(detect.scan_many(docs, MANY, gate=False)))
    rows = rewrite.with_fakes(found, "k", MANY)
    want = {r.doc_id: (r.new_text, r.n_redacted) for r in rewrite.rewrite(docs, rows).collect()}
    got = bodies.redact_texts(docs, "k", MANY)
    assert {r.doc_id: (r.new_text, len(r.redactions)) for r in got.collect()} == want
    assert {r.doc_id: (r.new_text, len(r.redactions)) for r in bodies.redact_texts(docs, "k", MANY, literals=False).collect()} == want


def test_a_plan_of_438_rules_takes_seconds(spark):
    rules = tuple(Rule(f"r{i}", f"k{i}x[0-9]+", keywords=(f"k{i}",), replacement_type=("generic_random", "faker_api_key", "faker_email", "faker_db_conn", "fpe_numeric")[i % 5], literal_prefix=f"k{i}") for i in range(438))
    frame = spark.createDataFrame([(1, {"Content-Type": "application/json", "X-Api-Key": "k7x123"}, bytearray(b'{"a":"k0x123456789 k1x444 k5x k437x999","b":["k4x23456789"]}'))], "id int, headers map<string,string>, body binary")
    bodies.redact_bodies(frame, "k", rules).schema  # warm
    began = time.time()
    out = bodies.redact_bodies(frame, "k", rules)
    out._jdf.queryExecution().executedPlan()
    print("planned in", time.time() - began)
    assert time.time() - began < 20  # about 1 on an idle machine
    (row,) = out.collect()
    assert [r.original for r in row.redactions] == ["k0x123456789", "k1x444", "k437x999", "k4x23456789"]
    assert [r.rule_id for r in row.redactions] == ["r0", "r1", "r437", "r4"]
    assert row.redactions[0].fake.startswith("k0") and "@" in row.redactions[2].fake and row.redactions[3].fake.isdigit() and len(row.redactions[3].fake) == 9
    assert [r.original for r in row.header_redactions] == ["k7x123"] and "k7x123" not in row.new_headers["X-Api-Key"]


def test_headers_of_bodies(spark):
    from base64 import b64decode, b64encode

    mail = "ann@corp.com"
    headers = {"Authorization": "Basic " + b64encode(f"{mail}:x".encode()).decode(), "x-secret": mail, "Host": mail, "X-TOKEN-A": f"Bearer {mail}"}
    frame = spark.createDataFrame([(1, headers, None), (2, {"authorization": "Bearer " + mail}, None), (3, {"authorization": "Basic ???"}, None)], "id int, headers map<string,string>, body binary")
    rows = {r.id: r for r in bodies.redact_bodies(frame, "k").collect()}
    new = rows[1].new_headers
    fake = new["x-secret"]
    assert fake != mail and new["Host"] == mail and new["X-TOKEN-A"] == f"Bearer {fake}" and b64decode(new["Authorization"][6:]) == f"{fake}:x".encode()
    assert rows[2].new_headers == {"authorization": f"Bearer {fake}"} and rows[3].new_headers == {"authorization": "Basic ???"}
    assert len(rows[1].header_redactions) == 3 and rows[1].redactions == []


def test_many_spans_in_one_text_take_linear_time(spark):
    n = 40_000
    frame = spark.createDataFrame([(1, "x ann@corp.com é" * n)], "doc_id long, text string")
    began = time.time()
    row = bodies.redact_texts(frame, "k").select(F.size("redactions").alias("n"), F.char_length("new_text").alias("size"), "new_text").first()
    assert row.n == n and "ann@corp.com" not in row.new_text
    spans = spark.createDataFrame([(1, "r", i * 5, i * 5 + 7, "raw") for i in range(n)], "doc_id long, rule_id string, start int, end int, raw string")
    assert detect.drop_partial_overlaps(spans).count() == n // 2
    assert time.time() - began < 120


def test_folded_equals_a_loop(spark):
    rnd = random.Random(7)
    for size in (0, 1, 63, 64, 65, 400):
        values = [rnd.randint(0, 9) for _ in range(size)]
        want, total = [], 0
        for v in values:
            total += v
            want += [total] * (v % 3)
        frame = spark.createDataFrame([(values,)], "v array<int>")
        step = lambda acc, x: (acc + x, F.array_repeat(acc + x, x % 3))
        assert frame.select(folded("v", F.lit(0), "int", step)).first()[0] == want
    assert [r.id for r in CORE] == sorted(r.id for r in CORE)


def test_golden_fixtures(spark):
    from maskwright.operators import evaluate, rule_etl
    from maskwright.sources.rules import frame

    rules = frame(spark).withColumn("examples", F.when(F.col("id") == "email", F.array(F.lit("ann@corp.com"), F.lit("none"))).otherwise(F.array().cast("array<string>")))
    rules = rules.withColumn("negative_examples", F.when(F.col("id") == "ipv4", F.array(F.lit("1.2.3"), F.lit("1.2.3.4"), F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))
    pairs = rule_etl.fixtures(rules).unionByName(spark.createDataFrame([("gone", "pos", "x")], "rule_id string, polarity string, text string"))
    rows = {tuple(r) for r in evaluate.fixture_verdicts(pairs, rules).collect()}
    assert rows == {
        ("email", "pos", "ann@corp.com", True, True), ("email", "pos", "none", False, False), ("ipv4", "neg", "1.2.3", False, True), ("ipv4", "neg", "1.2.3.4", True, False),
        ("ipv4", "neg", None, False, True), ("gone", "pos", "x", None, False),
    }
    assert {tuple(r) for r in evaluate.fixture_totals(evaluate.fixture_verdicts(pairs, rules)).collect()} == {("email", "pos", 2, 1), ("ipv4", "neg", 3, 1), ("gone", "pos", 1, 1)}
