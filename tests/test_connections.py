"""Connection strings: the grammar against a parser written out here, and nothing of a secret left."""

import random

import pytest
from pyspark.sql import functions as F

from maskwright.functions import fakes


def faked(spark, values, f=fakes.connection):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    rows = {r.i: r.f for r in frame.select("i", f("k", F.col("c")).alias("f")).collect()}
    return [rows[i] for i in range(len(values))]


def ado(text):
    """(name, value) pairs of a string with ; between, by hand: quotes count only where a value begins and if they close before a separator."""
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] not in "=;":
            j += 1
        name = text[i:j].strip()
        if j == len(text) or text[j] == ";":
            if name:
                out.append((name, None))
            i = j + 1
            continue
        j += 1
        while j < len(text) and text[j].isspace():
            j += 1
        end = None
        if j < len(text) and text[j] in "\"'{":
            close = {"{": "}"}.get(text[j], text[j])
            k = j + 1
            while k < len(text):
                if text[k] == close:
                    if text[k + 1 : k + 2] == close:
                        k += 2
                        continue
                    stop = k + 1
                    while stop < len(text) and text[stop].isspace():
                        stop += 1
                    if stop == len(text) or text[stop] == ";":
                        end = stop
                    break
                k += 1
        if end is None:
            end = text.find(";", j) if ";" in text[j:] else len(text)
        out.append((name, text[j:end].strip()))
        i = end + 1
    return out


SECRETS = ("password", "pwd", "pass")


def test_ado_against_the_parser(spark):
    rnd = random.Random(6)
    names = ["Password", "PWD", "Server", "Encrypt", "User Id", "Database", "x"]
    values = ['"a;b"', "'it''s;me'", "{b}};c}", "plain", "o'brien", '"open', "", "a=b;", '"q"tail', "{}", " spaced ", '"a""b"', "é;"]
    made = ["A=1;" + ";".join(f"{rnd.choice(names)}={rnd.choice(values)}" for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    for text, new in zip(made, faked(spark, made)):
        before, after = ado(text), ado(new)
        assert [n for n, _ in before] == [n for n, _ in after], (text, new)
        for (name, old), (_, value) in zip(before, after):
            low = name.lower()
            if low in SECRETS:
                quoted = len(old) > 1 and (old[0], old[-1]) in (('"', '"'), ("'", "'"), ("{", "}"))
                inner = value[1:-1] if quoted else value
                assert inner.isalnum() and len(inner) == max(12, len(old.encode()) - 2 * quoted), (text, new)
                assert not quoted or value[0] + value[-1] == old[0] + old[-1]
            elif low == "server":
                assert value.strip("\"'{}").endswith(".example.com")
            elif low in ("encrypt", "x", "a"):
                assert value == old, (text, new)


@pytest.mark.parametrize(
    "text, gone, kept",
    [("Driver={My;Driver};Server=h;Uid=bob;Pwd={pa;ss}}w};Port=1", ["bob", "pa;ss", "ss}}w"], ["Driver={My;Driver}", "Port=1"]), ("host=h user=bob password='a b\\'c d' port=5", ["bob", "a b", "c d"], ["port=5"]),
     ("host=h password=a\\ b sslmode=on", ["a\\ b"], ["sslmode=on"]), ("host = h user = bob password = p123", ["bob", "p123"], []), ("postgres://bob:p@ss@h:5432/db?x=1", ["bob", "p@ss", "ss@"], [":5432/db?x=1"]),
     ("postgres://bob:p/w?q@h/db", ["bob", "p/w", "w?q", "q@h"], []), ("mysql://u:p%40ss@h/db?Pass%77ord=se%20cret&user=bob&a=b", ["p%40ss", "se%20cret", "bob"], ["&a=b", "/db?Pass%77ord="]),
     ("jdbc:sqlserver://h:1433;x", ["h:1433;x"], ["jdbc:"]), ("jdbc:sqlserver:h;password='a;b';y=1", ["a;b"], [";y=1"]), ('(DESCRIPTION=(ADDRESS=(HOST=h1))(X=(USER=bob)(PASSWORD="a)b")))', ["h1", "bob", "a)b"], ["(DESCRIPTION=(ADDRESS=(HOST="]),
     ("redis://[::1]:6379/0", ["[::1]"], [":6379/0"])],
)
def test_secrets_go_and_the_rest_stays(spark, text, gone, kept):
    (new,) = faked(spark, [text])
    assert not [g for g in gone if g in new] and not [k for k in kept if k not in new], new
    assert faked(spark, [text]) == [new]


def test_credentials_of_urls_up_to_the_last_at(spark):
    (new, plain) = faked(spark, ["https://bob:p@ss@h/x?y@z", "https://h/x"], fakes.url_credentials)
    assert "p@ss" not in new and "ss@" not in new and new.endswith("@h/x?y@z") and plain.endswith("@h/x")
    (seen,) = faked(spark, ["https://bob:p@ss@h/x"], lambda key, c: fakes.fake("faker_url_cred", key, c, visible=True))
    assert seen == "https://masked:masked@h/x"


def test_very_long_values(spark):
    long = 'Server=h;Password="' + "a;" * 10_000 + '";x=1'
    (new,) = faked(spark, [long])
    assert "a;a" not in new and new.endswith(";x=1") and len(new) > 20_000
