"""Hard negatives, late sessions and main text: brute force, edge cases, clashing columns, empty tables."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import hard_negatives, main_text, sessions

EXTRA = ("id", "vec", "raw", "row", "anchors", "group", "block", "rank", "user", "batch", "second", "h", "n", "island", "moments", "conv", "c", "text", "url_", "n_chars")


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in EXTRA if c not in df.columns])


# ---- hard negatives ----------------------------------------------------------------------


def mined(rows, positives=5, negatives=3):
    held = {}
    for i, vec, label in rows:
        if i is None or vec is None or label is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        scaled = [math.floor(256 * x) for x in vec]
        if sum(float(x) ** 2 for x in scaled) < 2.0**62:
            held[i] = min(held.get(i, (label, scaled)), (label, scaled))
    out = set()
    for a, (label, vec) in held.items():
        if a % 50:
            continue
        score = {b: sum(x * y for x, y in zip(vec, v)) for b, (_, v) in held.items()}
        order = sorted((b for b in held if b != a), key=lambda b: (-score[b], b))
        for p in [b for b in order if held[b][0] == label][:positives]:
            inside = [b for b in order if held[b][0] != label and 50 * score[p] <= 100 * score[b] <= 95 * score[p]]
            out |= {(a, p, k + 1, b, score[p], score[b]) for k, b in enumerate(inside[:negatives])}
    return out


EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def found(spark, rows):
    df = clashing(spark.createDataFrame(rows, EMBEDDINGS)).repartition(5)
    out = hard_negatives.hard_negatives(df, F.col("id") % 50 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return [tuple(r) for r in out.collect()]


def test_hard_negatives_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        label = int(rng.integers(3))
        vec = [float(np.float32(x)) for x in rng.normal(0.3 * (label == np.arange(7) % 3), 0.4)]
        rows.append((i - 100, vec, label))  # negative ids are anchors too
    rows += [(i, [0.5] * 7, i % 2) for i in range(1000, 1300)]  # one vector for a fourth of the rows: ties by id
    rows += [(1400, [0.5, 0.5], 0), (1450, [], 1), (1451, [0.0] * 7, 1), (1452, [], 0), (1500, [1.0] * 7, 9)]  # short, empty, of a label of its own
    rows += [(None, [0.5] * 7, 0), (1550, None, 0), (1600, [0.5] * 7, None), (1650, [0.5, None], 0), (1700, [float("nan")], 0), (1750, [float("inf")], 1), (1800, [1e38] * 7, 0)]
    rows += [rows[150], (50, [0.9] * 7, 2), (50, [0.9] * 7, 0)]  # repeated ids
    got = found(spark, rows)
    assert len(got) == len(set(got)) > 200
    assert set(got) == mined(rows)


def test_hard_negatives_edges(spark):
    assert found(spark, []) == []
    assert found(spark, [(50, [1.0, 0.0], 1)]) == []
    rows = [(50, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.75, 0.5], 2), (3, [0.75, 9.0], 3), (4, [0.97, 0.0], 2)]
    assert sorted(found(spark, rows)) == sorted(mined(rows)) == [(50, 1, 1, 2, 65536, 49152), (50, 1, 2, 3, 65536, 49152)]
    zeros = [(50, [0.0], 1), (1, [0.0], 1), (2, [5.0], 2), (3, [-5.0], 2), (4, [0.0], 1)]  # a window of one score
    assert set(found(spark, zeros)) == mined(zeros) and len(mined(zeros)) == 4
    long = [(i * 25, [0.01 * (i % 7)] * 5000, i % 2) for i in range(20)]
    assert set(found(spark, long)) == mined(long)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    vecs = rng.integers(-(1 << 20), 1 << 20, (500, 6))
    book = hard_negatives.fit(vecs[:100].astype(float))
    codes, missed = hard_negatives.encode(vecs, book)
    anchors = vecs[:20].astype(float).reshape(20, 3, 2)
    about = sum((book[k][codes[k]] @ anchors[:, k].T) for k in range(3))
    error = missed.T.astype(float) @ np.linalg.norm(anchors, axis=2).T
    exact = vecs @ vecs[:20].T
    assert (np.abs(about - exact) <= error).all() and (error > 0).all()


# ---- late sessions -----------------------------------------------------------------------


def versions(events, gap):
    """After each batch all sessions are made anew."""
    users, out = defaultdict(list), []
    for user, batch, second, h in events:
        users[user].append((batch, second, h))
    for user, own in users.items():
        standing, log = [], []
        for batch in sorted({b for b, _, _ in own}):
            seen, groups = sorted((s, b, h) for b, s, h in own if b <= batch), []
            for e in seen:
                if groups and e[0] - groups[-1][-1][0] <= gap:
                    groups[-1].append(e)
                else:
                    groups.append([e])
            for g in groups:
                fresh = sum(b == batch for _, b, _ in g)
                if fresh:
                    start, end = g[0][0], g[-1][0]
                    inside = [v for v in standing if start <= v["start"] and v["end"] <= end]
                    for v in inside:
                        v["by"] = (batch, start)
                    version = {"start": start, "end": end, "row": (user, batch, start, end, len(g), fresh, len(inside), sum(h for _, _, h in g)), "by": (None, None)}
                    standing = [v for v in standing if v not in inside] + [version]
                    log.append(version)
        out += [v["row"] + v["by"] for v in log]
    return sorted(out, key=repr)


COLUMNS = ["user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracted_batch", "retracted_start_s"]


def test_sessions_against_brute_force(spark):
    rnd = random.Random(4)
    events = [(rnd.randrange(12), rnd.randrange(9), rnd.randrange(-3000, 9000), rnd.randrange(1 << 32)) for _ in range(600)]
    events += [(99, rnd.randrange(5), rnd.randrange(40_000), 1) for _ in range(3000)]  # a hot user
    events += [(98, 3, 7, 2)] * 500 + [(98, 1, 427, 2), (98, 2, 848, 2), (98, 0, -1 << 40, 5), (98, 0, 1 << 40, 6)]  # repeats, neighbours at 420 and 421, far apart
    schema = "user long, batch long, second long, h long"
    df = spark.createDataFrame(events, schema)
    got = sessions.session_versions(clashing(df).repartition(6))
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == versions(events, 420)
    other = sessions.session_versions(df, gap=0)
    assert sorted((tuple(r) for r in other.collect()), key=repr) == versions(events, 0)
    nulls = spark.createDataFrame([(None, 1, 1, 1), (1, None, 1, 1), (1, 1, None, 1), (1, 1, 1, None)], schema)
    assert [tuple(r) for r in sessions.session_versions(nulls).collect()] == [(1, 1, 1, 1, 1, 1, 0, 0, None, None)]
    assert sessions.session_versions(nulls.limit(0)).count() == 0


def test_conversation_events(spark):
    rows = [(0, 0), (7, 3), (8, 3), (-1, 0), (-9, 2), (1 << 62, 1), (5, None), (None, 5), (3, 1 << 62), (3, -400), (7, 3)]
    df = clashing(spark.createDataFrame([(c, t, "user", "x") for c, t in rows], "conv_id long, turn long, role string, text string"))
    want = []
    for conv, turn in rows:
        if conv is None or turn is None or turn > 1 << 60:
            continue
        c, h = zlib.crc32(str(conv).encode()), zlib.crc32(f"{conv}:{turn}".encode())
        second = c // 2 % 7200 + 300 * turn + h % 600
        want.append((2 * (conv // 8) + c % 2, second // 3600 + (h // 600 % 4 if h // 600 % 3 == 0 else 0), second, h))
    assert sorted(tuple(r) for r in sessions.conversation_events(df).where("second IS NOT NULL").collect()) == sorted(want)
    got = sessions.session_versions(sessions.conversation_events(df))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == versions(want, 420)


# ---- main text ---------------------------------------------------------------------------

PARAGRAPH = "The quick brown fox jumps over the lazy dog, and then it rests for a while in the shade of a tall old tree."
JUNK = {
    "menu": '<nav><ul><li><a href="/a">Start</a><li><a href="/b">News</a></ul></nav>', "menu by class": '<div class="main-menu"><a href="/a">One</a> <a href="/b">Two</a></div>',
    "header": "<header><p>The Daily Paper, for you every day of the year</p></header>", "footer": "<footer>&copy; 2024 Paper. All rights reserved.</footer>",
    "sidebar": f"<aside><p>{PARAGRAPH}</p></aside>", "sidebar by id": f'<div id="sidebar"><p>{PARAGRAPH}</p></div>', "notice": '<div class="cookie-notice"><p>We use cookies. Do you agree?</p></div>',
    "advert": '<div class="ad">Buy now, pay later, and get one more for nothing at all!</div>', "form": '<form><label>Mail</label><input name="m"><textarea>x</textarea><button>Go</button></form>',
    "script": '<script>var t = "<p>no text</p>";</script>', "style": "<style>p { margin: 0 }</style>", "comments": f'<section class="comments"><h2>Comments</h2><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></section>',
    "role": f'<div role="complementary"><p>{PARAGRAPH}</p></div>', "hidden": "<div hidden>secret</div>", "comment": "<!-- <p>old</p> -->",
}
ARTICLE = f"<h1>A title &amp; more</h1><p>{PARAGRAPH}</p><p>Of.</p><blockquote>Said <b>so</b>me&shy;one</blockquote><ul><li>one<li>two</ul><p>See <a href=/x>this</a>,<br>and\n that.</p><p>{PARAGRAPH}</p>"
TEXT = f"A title & more\n{PARAGRAPH}\nOf.\nSaid some\xadone\none\ntwo\nSee this, and that.\n{PARAGRAPH}"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div id="content">{}</div>', '<div class="page has-sidebar"><div class="text">{}</div></div>', "<main><div><article>{}</article></div></main>"])
@pytest.mark.parametrize("junk", JUNK)
def test_main_text_without_junk(wrap, junk):
    body = f"<!DOCTYPE html><html><head><title>Title</title></head><body>{JUNK[junk]}{wrap.format(ARTICLE)}{JUNK[junk]}</body></html>"
    assert main_text.main_text(body) == TEXT
    assert main_text.main_text(body.replace("</body></html>", "")) == TEXT


def test_main_text_all_junk_and_no_names():
    assert main_text.main_text("".join(JUNK.values()) + f"<article>{ARTICLE}</article>" + "".join(JUNK.values())) == TEXT
    assert main_text.main_text(f"<article>{ARTICLE}{JUNK['form']}{JUNK['comments']}{JUNK['advert']}</article>") == TEXT
    unnamed = f"<div class=q1><div class=q2><a href=a>One</a> <a href=b>Two</a></div><div class=q3>{ARTICLE}</div><div class=q4>Buy now</div></div>"
    assert main_text.main_text(unnamed) == TEXT
    assert main_text.main_text("<article><p>Of.</p></article><article class=teaser><a href=x>More</a></article>") == "Of."


@pytest.mark.parametrize(
    "html, want",
    [(None, ""), ("", ""), (" \n ", ""), ("a &lt;b&gt;  c", "a <b> c"), ("<p>a<p>b", "a\nb"), ("<b><p>x</b> y</p>", "x y"), ("x<!-- never closed", "x"), ("a < b", "a < b"), ("<p>x</p", "x"),
     ("<script>x", ""), ("<div><div>deep", "deep"), ("</div></p>x", "x"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<p>1&nbsp;&#50;&#x33;</p>", "1 23"), ('<p title="a > b">x</p>', "x"), ("<nav>only a menu</nav>", "")],
)
def test_main_text_of_odd_pages(html, want):
    assert main_text.main_text(html) == want


def test_main_text_is_linear():
    for page in ("<div>" * 20_000 + "x", "<b>" * 20_000 + "<p>x" * 20_000, "<p><b>x" * 20_000, "<table><tr><td>" * 20_000 + "x", "</div>" * 50_000 + "x", "<a b='" * 50_000):
        assert "x" in main_text.main_text(page) or page[:2] == "<a"


def test_density_by_hand():
    # body(p(20 characters, one link of 5), p(30 characters))
    got = main_text.densities([-1, 0, 1, 0], [0, 15, 5, 30], [0, 0, 5, 0], [False, False, True, False])

    def density(c, lc, t, lt):
        t, link, lt = max(t, 1), max(lc, 1), max(lt, 1)
        return c / t * math.log(c / link * t / lt) / math.log(math.log(c / max(c - lc, 1) * link + 5 / 50 * c + math.e))

    assert np.allclose(got, [density(50, 5, 3, 1), density(20, 5, 1, 1), max(0.0, density(5, 5, 0, 0)), density(30, 0, 0, 0)])


def test_extract(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>"), (1, "u", f"<article>{ARTICLE}</article>"), (2, None, None), (None, "v", "")]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = main_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=repr)
    assert main_text.extract(df.limit(0)).count() == 0


def test_op13_against_the_template(spark, sf):
    """The given pages have one template: the article is between its tags, its blocks are h1 and p."""
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = main_text.op13_main_text(spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:h1|p)>", article)]
        assert r.text == "\n".join(filter(None, parts)) and r.n_chars == len(r.text)
