import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, html_text, topk


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in rng.normal(size=6).round(1)]) for k in range(300)]
    rows += [(300 + k, [0.5] * 6) for k in range(60)] + [(400, [0.0] * 6), (420, [0.0] * 6)]  # ties
    strange = [(None, [1.0] * 6), (500, None), (520, [1.0, None] * 3), (540, [float("nan")] * 6), (560, [float("inf")] * 6), (580, []), (600, [1.0, 2.0]), (620, [2.0, 1.0]), rows[0]]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + strange], "vec_id long, embedding array<double>, score string")
    q = {i: np.floor(64 * np.array(v)).astype(int) for i, v in [*rows, *strange[6:8]]}
    for sizes in ({}, {"candidates": 50, "queries": 4}):
        got = collections.defaultdict(list)
        for r in topk.search(df, F.col("vec_id") % 20 == 0, **sizes).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        expect = {}
        for i in q:
            if i % 20 == 0:
                best = sorted(((-int(q[i] @ v), j) for j, v in q.items() if j != i and len(v) == len(q[i])))[:20]
                expect[i] = [(j, -s) for s, j in best]
        assert got == expect
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_topk_stops_early():
    rng = np.random.default_rng(5)
    vectors = np.floor(64 * rng.normal(size=(5000, 3)))
    lists = topk.Lists(np.arange(5000), vectors)
    top, scores = lists.best(7, vectors[7], 5)
    assert lists.seen.sum() < 2500
    brute = sorted((-int(vectors[k] @ vectors[7]), k) for k in range(5000) if k != 7)[:5]
    assert [(-int(s), int(t)) for s, t in zip(scores, top, strict=True)] == brute


def test_topk_scores_seen_rows_only_and_bounds_the_others():
    rng = np.random.default_rng(9)
    vectors = np.floor(64 * rng.normal(size=(4000, 64)) * 0.6 ** np.arange(64))
    lists = topk.Lists(np.arange(4000), vectors)
    shares = []
    for k in range(0, 4000, 100):
        top, scores = lists.best(k, vectors[k], 20)
        brute = sorted((-int(vectors[j] @ vectors[k]), j) for j in range(4000) if j != k)[:20]
        assert [(-int(s), int(t)) for s, t in zip(scores, top, strict=True)] == brute
        shares.append(lists.read / 3999)
    assert np.mean(shares) < 0.7 and max(shares) < 1  # 64 dimensions, but the components fall off
    for _ in range(300):  # the bound holds for every vector under it
        w, last = rng.random(6) + 0.01, rng.normal(size=6)
        xs = np.minimum(rng.normal(size=(400, 6)) * 2, last)
        norm = float(np.linalg.norm(last)) * rng.random() + 0.3
        xs = xs[np.linalg.norm(xs, axis=1) <= norm]
        assert not len(xs) or (xs @ w).max() <= topk.ceiling(w, last, norm) + 1e-9
    huge = np.array([[2.0**60, 1.0], [2.0**60, 3.0], [2.0**60, 2.0], [-(2.0**60), 0.0]])
    top, scores = topk.Lists(np.arange(4), huge).best(0, huge[0] / 2**50, 2)
    assert top.tolist() == [1, 2] and all(isinstance(x, int) for x in scores)


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("\\<|end>turn\n ") for _ in range(rng.randint(0, 14)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_chat_round_trip_and_masks(spark):
    rng = random.Random(2)
    rows = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            text = "".join(rng.choice(["\\", "<|", "<", "|", "<|end|>", "<|endoftext|>", " ", "\n", "é", "漢", "word", " word"]) for _ in range(rng.randint(0, 25)))
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "<|turn|>"]), rng.choice([text, text, None])))
    rows += [(None, 1, "assistant", "no conversation"), (5, 0, "user", "a tie"), (5, None, "assistant", "no turn"), (100, 0, "assistant", "very long " * 20000), rows[3]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    by = collections.defaultdict(list)
    none_first = lambda x: (x is not None, x if x is not None else 0)
    for r in sorted(rows, key=lambda r: (none_first(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or ""))):
        by[r[0]].append((r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        said = "".join(t for role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), c
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest()), c
        assert got[c].formatted_chars == len(chat.render(turns)[0])
    assert chat.format_chats(df.limit(0)).collect() == []


CASES = [
    (None, ""), ("", ""), ("plain", "plain"), ("a<b>b</b> c", "ab c"), ("<p>one<p>two", "one\n\ntwo"),
    ("<title>t</title><body>x<script>if(a<b)'</p>'</script>y", "xy"), ("x<!-- <p>no -->y", "xy"), ("1 &lt; 2 &amp; &eacute;", "1 < 2 & é"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "- a\n- b\n  - c\n\nd"), ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
    ("<table><tr><th>Name<th>N<tr><td>kiwi<td>12</table>", "Name | N\nkiwi | 12"),
    ("<table><tr><td>a<br>b<td>c</table>", "a | c\nb |"), ("<pre>a\n  b</pre>", "a\n  b"),
    ("<p hidden>no</p>yes", "yes"), ("<p style='display: none'>no</p>yes", "yes"), ("<div style='visibility:hidden'>no<i style='visibility:visible'>yes</i></div>", "yes"),
    ("<style>.x{display:none}</style><p class='a x'>no<p>yes", "yes"), ("<details><summary>s</summary>no</details>", "s"), ("<details open><summary>s</summary>t</details>", "s\n\nt".replace("\n\n", "\n")),
    ("a<br><br>b", "a\n\nb"), ("<h1>h</h1>t", "h\n\nt"), ("<div>a</div><div>b</div>", "a\nb"), ("<b>a<p>b</b>c", "a\n\nbc"), ("a</p>b", "a\n\nb"), ("<", "<"), ("a < b <c", "a < b"),
    ("<table><tr><td rowspan=2>r<td>a<tr><td>b</table>", "r | a\n  | b"), ("<table><tr><td colspan=2>wide one<td>c<tr><td>a<td>b<td>d</table>", "wide one | c\na | b    | d"),
    ("<style>p.x{display:none} div .y{display:none} #a > b{visibility:hidden} .z{display:none} p.z{display:inline}</style><p class=x>no<p class='y z'>yes<div><i><b class=y>no</b></i>yes</div><div id=a><b>no</b><i><b>yes</b></i></div>", "yes\n\nyes\nyes"),
    ("<style>@media print{p{display:none}} @media screen{.q{display:none}} [lang=xx]{display:none} a:hover{display:none}</style><p>yes<p class=q>no<p lang=xx>no</p><a>yes</a>", "yes\n\nyes"),
    ("<svg><title>no</title><defs><text>no</text></defs><text>label</text><path/></svg><math><mi>x</mi><annotation>no</annotation></math>", "label\nx"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<blockquote>q</blockquote>", "q".rjust(3)), ("<textarea> t </textarea>", " t"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_pages(page, text):
    assert html_text.text_of(page) == text


def grid_of(rows):
    """A second layout: the owner of each place of the table, as (row, cell), by filling a matrix."""
    place, spots = {}, []
    for r, row in enumerate(rows):
        c = 0
        for k, (_, wide, high) in enumerate(row):
            while (r, c) in place:
                c += 1
            for y in range(r, min(r + high, len(rows))):
                for x in range(c, c + wide):
                    place.setdefault((y, x), (r, k))
            spots.append((r, k, c))
            c += wide
    return spots


def test_tables_against_a_second_layout():
    rng = random.Random(12)
    for _ in range(200):
        rows, n = [], 0
        for _ in range(rng.randint(1, 6)):
            row = []
            for _ in range(rng.randint(1, 5)):
                row.append((f"w{n}" + "x" * rng.randint(0, 6), rng.choice([1, 1, 1, 2]), rng.choice([1, 1, 2, 3])))
                n += 1
            rows.append(row)
        page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={w} rowspan={h}>{t}" for t, w, h in row) for row in rows) + "</table>"
        lines = html_text.text_of(page).split("\n")
        assert len(lines) == len(rows)
        at = collections.defaultdict(set)
        for r, k, c in grid_of(rows):
            text = rows[r][k][0]
            assert re.search(rf"(^|\| ){text}( *\||$)", lines[r]), page
            at[c].add(lines[r].index(text))
        assert all(len(x) == 1 for x in at.values()), (page, lines)  # cells of one column are aligned
        assert [x for _, x in sorted((c, min(x)) for c, x in at.items())] == sorted({min(x) for x in at.values()})


@pytest.mark.parametrize("page", [
    "<div>" * 100000 + "x" + "</div>" * 100000, "<b>" * 50000 + "x" + "</i>" * 50000, "<p><button>" + "<div>" * 100000 + "x", "<b><div>" * 50000 + "x" + "</b>" * 50000,
    "<ul><li>" * 30000 + "x", "<table><tr><td>" * 30000 + "x", "<table>" + "<tr><td rowspan=9999>x" * 30000, "<a \"" * 50001 + "x", "<blockquote>" * 50000 + "x",
])
def test_deep_and_misnested_pages_take_little_time(page):
    began = time.process_time()
    text = html_text.text_of(page)
    assert time.process_time() - began < 8 and ("x" in text or "<a" in page) and len(text) < 20 * len(page)


def test_words_outside_of_tags_survive(spark):
    """Whatever the markup, visible words come out once and in order."""
    rng = random.Random(6)
    tags = "p div ul li table tr td b i h2 section span dl dt dd pre ol blockquote".split()
    for _ in range(400):
        parts, n = [], 0
        for _ in range(rng.randint(1, 40)):
            kind = rng.random()
            if kind < 0.4:
                parts.append(f"<{rng.choice(tags)}>")
            elif kind < 0.7:
                parts.append(f"</{rng.choice(tags)}>")
            else:
                parts.append(f" k{n} ")
                n += 1
        page = "".join(parts)
        found = [w for w in html_text.text_of(page).replace("|", " ").split() if w.startswith("k")]
        assert sorted(found, key=lambda w: int(w[1:])) == [f"k{k}" for k in range(n)], page
    deep = "<div>" * 50000 + "deep" + "</div>" * 50000
    assert html_text.text_of(deep) == "deep"
    df = spark.createDataFrame([(1, None, None, "x"), (2, "u", "<p>a", "x"), (2, "u", "<p>a", "x"), (None, "v", "", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extract(df).collect()) == [(0, ""), (1, ""), (2, "a"), (2, "a")]
    assert html_text.extract(df.limit(0)).collect() == []
