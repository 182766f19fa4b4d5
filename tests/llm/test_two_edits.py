"""Line dedup with a bound of two edits, against all pairs."""

import random

import pytest

from gridloom.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def apart(a, b):
    """Edits between two lines, 9 if they are more than their lengths allow."""
    if a == b:
        return 0
    n = min(len(a), len(b))
    bound = 2 if n >= 40 else 1 if n >= 16 else 0
    return d if bound and abs(len(a) - len(b)) <= bound and (d := distance(a, b)) <= bound else 9


def test_two_edits_match_all_pairs(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé漢 ") for _ in range(n)) + "." for n in (15, 30, 37, 38, 39, 40, 41, 43, 48, 61, 90, 131)]
    rows = [(None, "x" * 300 + "yy"), (1, None), (2, "\n \n"), (3, "x" * 302)]
    for k in range(260):
        s = rng.choice(base)
        for _ in range(rng.choice([0, 1, 2, 2, 3, 4])):
            at = rng.choice([0, len(s) - 1, rng.randrange(len(s))])
            s = rng.choice([s[:at] + rng.choice("abz") + s[at:], s[: at + 1] + rng.choice("abz") + s[at + 1 :], s[:at] + s[at + 1 :], s[:at] + rng.choice("abz") + s[at + 1 :]])
        rows.append((10 + k, s))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, expect, two = [], {}, 0
    for i, text in rows:
        kept = []
        for line in (text or "").split("\n"):
            far = min((apart(line, s) for s in seen), default=9)
            two += far == 2
            seen += [line] if line.strip() else []
            kept += [] if far < 9 else [line]
        expect[i] = None if text is None else "\n".join(kept)
    assert two > 20
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs, edits=2).collect()} == expect
    left = {i: t for i, t in expect.items() if t == dict(rows)[i] or t.strip()}
    assert {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(spark, docs, "").collect()} == left


def test_other_bounds_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for edits in (3, -1):
        with pytest.raises(ValueError):
            line_dedup.dedup(docs, edits=edits)
