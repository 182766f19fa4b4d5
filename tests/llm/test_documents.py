import collections
import hashlib
import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from gridloom.llm import fingerprints, jaccard, line_dedup, packing, pieces, quality, token_counts, tokens

SCHEMA = "doc_id long, text string, __lines string, n string, score double, part int"


def frame(spark, rows):
    """Documents with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, "x", "y", 1.0, 2) for i, t in rows], SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(None, "no id here but some words to see"), (1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "ONE\ttwo"), (6, "long " * 30000)]
    base = [prose(rng, rng.choice([3, 20, 60, 200])) for _ in range(40)]
    for k in range(160):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        out.append((10 + k, " ".join(words)))
    hub = prose(rng, 80).split()
    for k in range(150):  # a large group of near copies
        words = list(hub)
        words[rng.randrange(80)] = f"q{k}"
        out.append((1000 + k, " ".join(words)))
    line = prose(rng, 12)
    out += [(2000 + k, f"{line} {prose(rng, rng.choice([2, 8, 40]), 10**6)}") for k in range(80)]  # a frequent passage
    out += [(10, out[7][1])]
    return out


def linked(rows):
    word, low = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = word.findall((t or "").translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return collections.Counter((i, len(sets[k]), min(least[find(k)], default=None)) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("hot", [1 << 17, 0])
def test_jaccard_matches_all_pairs(spark, rows, hot):
    found = jaccard.similar(frame(spark, rows).repartition(5), hot=hot).collect()
    assert collections.Counter(map(tuple, found)) == linked(rows)


def test_jaccard_stage_and_empty(spark, rows):
    docs = frame(spark, rows)
    kept = jaccard.keep_first(spark, docs, "")
    assert kept.columns == docs.columns
    first = {c: i for (i, n, c) in linked(rows) if n and i == c}
    expect = {i for (i, n, c) in linked(rows) if i is None and c is None or not n or first.get(c) == i}
    assert {r.doc_id for r in kept.collect()} == expect
    assert jaccard.keep_first(spark, docs.limit(0), "").collect() == []
    assert jaccard.similar(docs.limit(0)).collect() == []


def test_sets_with_equal_first_numbers_stay_apart(spark, rows):
    found = jaccard.similar(frame(spark, rows).repartition(3), name_bits=4).collect()
    assert collections.Counter(map(tuple, found)) == linked(rows)


def test_jaccard_stage_decides_by_row(spark):
    rng = random.Random(21)
    a, b = prose(rng, 90), prose(rng, 90)
    near = a.replace(a.split()[40], "changed", 1)
    rows = [(1, a), (2, near), (2, b), (3, near), (None, near), (None, a), (7, a), (7, a), (8, ""), (8, ""), (9, None), (5, b), (4, "x"), (4, "x")]
    kept = collections.Counter((r.doc_id, r.text) for r in jaccard.keep_first(spark, frame(spark, rows), "").collect())
    assert kept == collections.Counter([(1, a), (2, b), (8, ""), (8, ""), (9, None), (4, "x")])


def test_runs_across_batches():
    import pyarrow as pa

    rng = random.Random(3)
    data = sorted((rng.randrange(40), rng.randrange(3), 5, rng.randrange(30), 0) for _ in range(200))  # shingle, rare, n, sid, pos
    per = collections.defaultdict(list)
    for key, _, _, sid, _ in data:
        if sid not in per[key] or per[key][-1] != sid:
            per[key].append(sid)
    for size in (1, 2, 3, 7, 200):
        batches = [
            pa.RecordBatch.from_arrays([pa.array([r[c] for r in data[k : k + size]]) for c in (0, 3, 2, 4)], ["shingle", "sid", "n", "pos"])
            for k in range(0, len(data), size)
        ]
        got = collections.defaultdict(list)
        for b in jaccard._runs(iter(batches)):
            for r in b.to_pylist():
                got[r["shingle"]].append(r["sid"])
                assert r["lead"] == per[r["shingle"]][0]
        assert got == {k: v for k, v in per.items() if len(v) > 1}


def near(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def test_line_dedup_matches_all_pairs(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abé漢 ") for _ in range(rng.choice([3, 15, 16, 17, 40, 90]))) + "." for _ in range(12)]
    rows = [(None, "null first\nnull first"), (1, None), (2, ""), (3, "\n\n  \n"), (4, "x" * 20000 + "\n" + "x" * 20001 + "\n" + "y" + "x" * 19999)]
    for k in range(120):
        lines = []
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(s))
                s = rng.choice([s[:at] + rng.choice("abz") + s[at:], s[:at] + s[at + 1 :], s[:at] + rng.choice("abz") + s[at + 1 :]])
            lines.append(s)
        rows.append((10 + k, "\n".join(lines)))
    rows += [rows[-1], (12, "another text of document twelve")]
    docs = frame(spark, rows)
    seen, expect = [], {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        kept = []
        for line in (text or "").split("\n"):
            gone = bool(line.strip()) and any(line == s or len(line) >= 16 and len(s) >= 16 and near(line, s) for s in seen)
            seen += [line] if line.strip() else []
            kept += [] if gone else [line]
        expect[i, text] = None if text is None else "\n".join(kept)
    found = line_dedup.dedup(docs)
    assert found.columns == [*docs.columns, "__n_lines", "__n_dropped"]
    got = collections.Counter((r["doc_id"], r["text"]) for r in found.drop("__lines").collect() if r["doc_id"] != 12)
    assert got == collections.Counter((i, expect[i, t]) for i, t in rows if i != 12)
    assert line_dedup.dedup(docs.limit(0)).collect() == []
    assert line_dedup.drop_lines(spark, docs, "").columns == docs.columns


def test_packing_is_exact(spark, rows):
    docs = frame(spark, rows).repartition(9)
    out = packing.pack(docs, window=64, open_windows=3).collect()
    paths = tokens.default_paths()
    ids = collections.Counter((i, tuple([*tokens.encode(t or "", paths), 1])) for i, t in rows)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length and 0 < r.length <= 64
        by_doc[r.doc_id].append((r.start, np.frombuffer(r.ids, np.uint32).tolist(), r.doc_tokens))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i in {i for i, _ in rows} - {10}:
        at, whole = 0, []
        for start, part, total in sorted(by_doc[i]):
            assert start == at
            at += len(part)
            whole += part
        assert total == at and ids[i, tuple(whole)] == 1
    assert sum(len(p) for _, p, _ in by_doc[10]) == sum(len(k[1]) * n for k, n in ids.items() if k[0] == 10)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r.length for r in out) > 0.9 * 64 * len(by_sequence)
    assert packing.pack(docs.limit(0)).collect() == []


def test_packing_leaves_little_padding(spark):
    out = packing.op9(spark, "/root/testdata/sf0.01").groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in out) <= 2048 and sum(r[1] for r in out) > 0.99 * 2048 * len(out)


def test_token_counts(spark, rows):
    docs = frame(spark, rows)
    counts = np.array([len(tokens.encode(t or "", tokens.default_paths())) for _, t in rows])
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(docs)))
    found = sums.collect()
    assert sorted(r.n_tokens for r in found) == sorted(set(counts.tolist()))
    for r in found:
        assert (r.n_docs, r.docs_at_least, r.docs_at_most) == ((counts == r.n_tokens).sum(), (counts >= r.n_tokens).sum(), (counts <= r.n_tokens).sum())
        assert (r.total_tokens, r.tokens_at_least, r.truncated_total) == (counts.sum(), counts[counts >= r.n_tokens].sum(), np.minimum(counts, r.n_tokens).sum())
    for r in token_counts.at_limits(sums, [0, 7, 2048, 10**6]).collect():
        assert (r.docs_at_least, r.truncated_total) == ((counts >= r.context_limit).sum(), np.minimum(counts, r.context_limit).sum())
    for r in token_counts.quantiles(sums, [0.0, 0.25, 0.5, 0.99, 1.0]).collect():
        assert r.n_tokens == np.sort(counts)[max(int(np.ceil(r.share * len(counts))), 1) - 1]
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(docs.limit(0)))).collect() == []


def test_fingerprints(spark, rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for parts in (1, 7):
        got = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprints.compare_next(frame(spark, rows).repartition(6), parts).collect())
        expect = collections.Counter()
        for (i, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
            t, u = t or "", u or ""
            e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
            f = fingerprints.fingerprint
            expect[i, len(t), hashlib.sha256(e.encode()).hexdigest(), f(t), f(e), fingerprints.likeness(f(t), f(e)), fingerprints.likeness(f(t), f(u))] += 1
        assert got == expect
    assert fingerprints.compare_next(frame(spark, []), 3).collect() == []
    assert fingerprints.compare_next(frame(spark, [(5, "only one here")])).first().near_next == 1.0


def test_rolling_and_subsequence():
    rng = random.Random(4)
    for _ in range(50):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert fingerprints.common_subsequence(a, b) == table[-1][-1]
    data = np.frombuffer(b"0123456789abcdefg", np.uint8)
    assert fingerprints.rolling(data)[-1] == fingerprints.rolling(data[-8:])[-1]
    text = prose(rng, 900)
    one = fingerprints.fingerprint(text)
    assert fingerprints.likeness(one, fingerprints.fingerprint(text.replace("w1 ", "changed "))) > 0.6
    assert fingerprints.likeness(one, fingerprints.fingerprint(prose(rng, 900))) < 0.3


def test_n_best_matches_all_segmentations(spark):
    vocabulary = [("<unk>", 0.0, "other"), *((f"<0x{b:02X}>", 0.0, "byte") for b in range(256)), *((p, -float(k + 1), "piece") for k, p in enumerate(["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "aba", "▁▁", "bb"]))]
    words = pieces.Vocabulary(vocabulary)
    crossing = pieces.Vocabulary([*vocabulary, ("a▁b", -2.5, "piece")])
    assert words.chunks and not crossing.chunks
    rng = random.Random(9)
    for v in (words, crossing):
        by = {t: (k, s) for k, (t, s, kind) in enumerate(vocabulary if v is words else [*vocabulary, ("a▁b", -2.5, "piece")]) if kind == "piece"}

        def every(s):
            if not s:
                return [(0.0, ())]
            out = [(by[s[:k]][1] + x, (by[s[:k]][0], *y)) for k in range(1, len(s) + 1) if s[:k] in by for x, y in every(s[k:])]
            if s[0] not in by:
                out += [(v.unknown + x, (*(1 + b for b in s[0].encode()), *y)) for x, y in every(s[1:])]
            return out

        for _ in range(150):
            text = "".join(rng.choice("aab  é") for _ in range(rng.randint(1, 8)))
            ways = {ids: s for s, ids in every("▁" + text.replace(" ", "▁"))}
            found = v.encode(text, 4)
            assert [s for s, _ in found] == sorted(ways.values(), reverse=True)[:4]
            assert all(ways[tuple(i)] == s for s, i in found) and len({tuple(i) for _, i in found}) == len(found)
            assert all(v.decode(i) == text for _, i in found)
    out = {r.doc_id: r for r in pieces.segment(frame(spark, [(1, None), (2, ""), (3, " a\n漢 b▁c"), (4, "wor" * 5000)]), 3).collect()}
    real = pieces.load(pieces.default_path())
    assert [w.ids for w in out[1].ways] == [[]] and [w.ids for w in out[2].ways] == [[]]
    assert real.decode(out[3].ways[2].ids) == " a\n漢 b▁c" and real.decode(out[4].ways[1].ids) == "wor" * 5000


def test_long_text_without_spaces_and_the_marks_round_trip():
    rng = random.Random(4)
    words = pieces.load(pieces.default_path())
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(1_000_000))
    tracemalloc.start()
    ways = words.encode(text, 3)
    assert tracemalloc.get_traced_memory()[1] < 1 << 29
    tracemalloc.stop()
    assert len({tuple(i) for _, i in ways}) == 3 and all(words.decode(i) == text for _, i in ways)
    assert ways[0][0] >= ways[1][0] >= ways[2][0]
    for text in ("▁", " ▁ ▁▁", "a▁b", "▁The\n▁"):
        assert all(words.decode(i) == text for _, i in words.encode(text, 3))


def test_common_words_are_encoded_as_by_the_models_own_encoder():
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    text = "The quick brown fox jumps over the lazy dog. It isn't, of course, what everyone had expected from the report."
    assert list(pieces.load(pieces.default_path()).encode(text)[0][1]) == own.encode(text)


def test_quality_learns_and_holds_edge_cases(spark):
    rng = random.Random(11)
    good = [(k, prose(rng, 60)) for k in range(120)]
    bad = [(200 + k, " ".join(w + "###" for w in prose(rng, 60).split())) for k in range(120)]
    docs = frame(spark, [*good, *bad, (500, None), (501, ""), (None, "w1 w2 w3"), *good[:2]])
    labels = spark.createDataFrame([*((i, 1) for i, _ in good), *((i, 0) for i, _ in bad), (None, 1), (0, None), (7777, 1)], "doc_id long, quality int")
    model = quality.learn(docs, labels, max_labelled=100, learn_from=~quality.held_out())
    scored = quality.score(docs, model, column="rating")
    assert scored.columns == [*docs.columns, "rating"]
    out = scored.selectExpr("doc_id", "rating").collect()
    assert len(out) == docs.count() and all(0 <= r.rating <= 1 for r in out)
    assert np.mean([(r.rating >= 0.5) == (r.doc_id < 200) for r in out if r.doc_id is not None and r.doc_id < 400]) > 0.97
    assert {r.rating for r in out if r.doc_id in (500, 501)} == {model["prior"]}
    blank = quality.learn(docs, labels.limit(0))
    assert {r.rating for r in quality.score(docs, blank, column="rating").select("rating").collect()} == {0.5}
    assert quality.score(docs.limit(0), model, column="rating").collect() == []


def test_votes_match_brute_force():
    rng = np.random.default_rng(6)
    known = quality.unit(rng.normal(size=(200, 8)).astype(np.float32))
    model = {"vectors": known, "labels": rng.integers(0, 2, 200).astype(float), "prior": 0.25}
    asked = quality.unit(np.vstack([rng.normal(size=(1300, 8)), np.zeros((2, 8))]).astype(np.float32))
    found = quality.vote(model, asked, neighbours=7, sharpness=4.0)
    for vector, score in zip(asked, found, strict=True):
        cosines = [(float(sum(a * b for a, b in zip(vector.tolist(), other, strict=True))), label) for other, label in zip(known.tolist(), model["labels"], strict=True)]
        near = sorted(cosines, key=lambda x: -x[0])[:7]
        weights = [max(c, 1e-6) ** 4 for c, _ in near]
        assert score == pytest.approx(sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights) if vector.any() else 0.25, abs=1e-4)


def test_quality_stage_keeps_columns_and_takes_empty_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "text", "lang as score", "source as rest", "n_chars as quality_score")
    kept = quality.keep_good(spark, docs, d)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert kept.subtract(docs).count() == 0
    assert quality.keep_good(spark, docs.limit(0), d).collect() == []
    assert packing.pack_stage(spark, docs.limit(0), d).collect() == []


def slow_fingerprint(text):
    """Context-triggered pieces, byte by byte with Python's integers."""
    data = text.encode()
    rolls = []
    for k in range(len(data)):
        last = [data[k - j] if k >= j else 0 for j in range(7)]
        total = sum(b * (8 - j) for j, b in enumerate(last))
        mixed = 0
        for j, b in enumerate(last):
            mixed ^= b << (5 * j) & 0xFFFFFFFF
        rolls.append((total + mixed + 1) % 2**32)
    size = 3
    while size * 64 < len(data):
        size *= 2
    while size > 3 and sum(r % size == 0 for r in rolls) < 32:
        size //= 2

    def signature(block):
        out, start, cuts = [], 0, 0
        for k, r in enumerate(rolls):
            if r % block == 0 and r % size == 0 and cuts < 63:
                out.append(data[start : k + 1])
                start, cuts = k + 1, cuts + 1
        return out + ([data[start:]] if start < len(data) else [])

    return size, signature(size), signature(2 * size)


def test_signatures_match_a_byte_by_byte_version():
    rng = random.Random(14)
    letters = {}
    for n in (1, 2, 6, 7, 8, 50, 190, 193, 400, 2000, 9000):
        for text in (prose(rng, n)[:n], "a" * n, "".join(rng.choice("ab é漢") for _ in range(n))):
            size, one, two = slow_fingerprint(text)
            found = fingerprints.fingerprint(text).split(":")
            assert int(found[0]) == size and [len(x) for x in found[1:]] == [len(one), len(two)]
            for pieces_, signature in ((one, found[1]), (two, found[2])):
                for piece, letter in zip(pieces_, signature, strict=True):
                    assert letters.setdefault(piece, letter) == letter  # a letter depends on its piece's bytes alone
    counts = collections.Counter(letters.values())
    assert len(counts) == 64 and max(counts.values()) < 4 * len(letters) / 64


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    out = quality.op1(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.97
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
