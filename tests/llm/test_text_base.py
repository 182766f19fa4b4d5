import random

import numpy as np
import pytest

from gridloom.llm import common, tokens, words
from gridloom.llm.graph import components


def test_words_and_shingles_agree_with_plain_python():
    import re

    rng = random.Random(1)
    texts = ["".join(rng.choice("aB \t\n\x0b\x0c\r\x1cé\u00a0") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "   ", "one", "a b c d e", "x " * 400000]
    word = re.compile(r"[^\x20\x09-\x0D]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    seen = {}
    for text, hashes in zip(texts, words.words_of(texts), strict=True):
        plain = word.findall((text or "").translate(low))
        assert len(plain) == len(hashes)
        for w, h in zip(plain[:200], hashes[:200].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    for text, found in zip(texts, words.shingles_of(texts), strict=True):
        plain = word.findall((text or "").translate(low))
        expect = {tuple(plain[k : k + 5]) for k in range(len(plain) - 4)} if len(plain) >= 5 else {tuple(plain)} if plain else set()
        assert len(found) == len(expect) and (np.diff(found.astype(object)) > 0).all()


def test_both_tokenizers_agree_on_plain_texts():
    rng = random.Random(2)
    paths = tokens.default_paths()
    alphabet = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0xAD), *range(0xAE, 0x180)]]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["".join(rng.choice(" ab'\n1,.s") for _ in range(60)) for _ in range(3000)] + ["<|endoftext|>", "a" * 5000, "\n" * 3000, " " * 3000 + "x", "é" * 3000]
    for text in texts:
        assert tokens.PLAIN.fullmatch(text)
        assert tokens.encode(text, paths) == tokens.slow(paths[0]).encode(text, add_special_tokens=False).ids
    assert tokens.encode("漢字\u2028 x\x1c", paths) == tokens.slow(paths[0]).encode("漢字\u2028 x\x1c", add_special_tokens=False).ids


def test_hashed_bits_and_spark_hash(spark):
    from pyspark.sql import functions as F

    ids = spark.range(-50, 50).select(F.col("id").alias("sid"))
    bits, power = common.hashed_bits(ids, "sid", 100)
    for x, h in ids.select("sid", F.xxhash64("sid")).collect():
        assert h % 2**64 == common.xxhash64_long(x)
        slot = common.xxhash64_long(x) & ((1 << power) - 1)
        assert bits[slot >> 3] >> (slot & 7) & 1


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (5, 4), (9, 9)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 40)] + [(100, 101)], []])
def test_components(spark, edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {x: find(x) for e in edges for x in e if e[0] != e[1]}


def test_a_cut_collects_the_drivers_garbage_if_much_is_taken(spark):
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    full = lambda: sum(b.getCollectionCount() for b in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName())
    used = lambda: heap.totalMemory() - heap.freeMemory()
    jvm.java.lang.System.gc()
    before = full()
    assert used() <= heap.maxMemory() // 10
    common.cut(spark.range(3).toDF("id"))
    assert full() == before  # little is taken, so nothing is collected
    held = []
    while used() <= heap.maxMemory() // 4:
        held.append(spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 1600, 10_000))
    before = full()
    rows = common.cut(spark.range(3).toDF("id"))
    assert full() > before
    assert len(held[0]) == 1600 and sorted(r.id for r in rows.collect()) == [0, 1, 2]
