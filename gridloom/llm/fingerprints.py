"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash of the last 7 bytes ends a piece wherever it is one less than a multiple of the block size; each piece
gives one of 64 characters. The block size is the largest of 3, 6, 12, ... that still gives 32 pieces, so a
fingerprint has the form ``size:signature:signature at the double size``. Two fingerprints are compared only where
their block sizes are equal or one is twice the other: likeness is 1 - (insertions and deletions) / (both lengths), of
the signatures with runs over three shortened, and 0 if they share no run of 7 characters (fewer for short signatures).

``next_documents`` hands every document its successor by (doc_id, text), the first one to the last: documents are
dealt by ranges of doc_id, whose bounds come from the ids alone, and only each range's first document is sent twice.

Nulls and odd input: a null text is empty, with fingerprint ``3::``; equal texts have equal fingerprints and likeness
1; a null doc_id sorts first; repeated ids follow each other by text; a single document is its own successor; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import ship, table

SPAN = 7
LEAST_BLOCK = 3
LONGEST = 64
COMMON = 7
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def rolling(data: np.ndarray) -> np.ndarray:
    """For each position a 32-bit hash of the last 7 bytes (missing ones count as 0): their sum, their sum weighted by nearness, and their shifted exclusive or."""
    padded = np.zeros(len(data) + SPAN - 1, np.uint32)
    padded[SPAN - 1 :] = data
    out = np.zeros(len(data), np.uint32)
    xor = np.zeros(len(data), np.uint32)
    for k in range(SPAN):  # k bytes back
        part = padded[SPAN - 1 - k : len(padded) - k]
        out += part * np.uint32(SPAN - k + 1)
        xor ^= part << np.uint32(5 * k)
    return out + xor


def fingerprint(text: str | None) -> str:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return f"{LEAST_BLOCK}::"
    roll = rolling(data) + np.uint32(1)
    size = LEAST_BLOCK
    while size * LONGEST < len(data):
        size *= 2
    ends = np.flatnonzero(roll % np.uint32(size) == 0)
    while size > LEAST_BLOCK and len(ends) < LONGEST // 2:
        size //= 2
        ends = np.flatnonzero(roll % np.uint32(size) == 0)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(words.BYTES[data] * words.powers(words.BASE, len(data)), out=total[1:])
    back = words.powers(words.BACK, len(data) + 1)

    def signature(at: np.ndarray) -> str:
        stops = np.unique(np.append(at[: LONGEST - 1] + 1, len(data)))
        starts = np.concatenate([[0], stops[:-1]])
        pieces = words.mix((total[stops] - total[starts]) * back[starts] + (stops - starts).astype(np.uint64))
        return ALPHABET[(pieces >> np.uint64(58)).astype(np.int64)].tobytes().decode()

    return f"{size}:{signature(ends)}:{signature(ends[roll[ends] % np.uint32(2 * size) == 0])}"


def _short_runs(s: str) -> str:
    return "".join(c for k, c in enumerate(s) if k < 3 or not (c == s[k - 1] == s[k - 2] == s[k - 3]))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits: (len(a) + len(b) - 2 x it) insertions and deletions turn a into b."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    a, b = _short_runs(a), _short_runs(b)
    if not a or not b:
        return 0.0
    need = max(1, min(COMMON, min(len(a), len(b)) // 3))
    grams = {a[k : k + need] for k in range(len(a) - need + 1)}
    if not any(b[k : k + need] in grams for k in range(len(b) - need + 1)):
        return 0.0
    return 2 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 for incompatible block sizes."""
    if x == y:
        return 1.0
    (m, a1, a2), (n, b1, b2) = x.split(":"), y.split(":")
    m, n = int(m), int(n)
    if m == n:
        return max(_alike(a1, b1), _alike(a2, b2) if a2 and b2 and len(a2) + len(b2) > 16 else 0.0)
    if m == 2 * n:
        return _alike(a1, b2)
    if n == 2 * m:
        return _alike(a2, b1)
    return 0.0


def edited(text: str, other: str) -> str:
    """The last half of text's code points replaced by the first as many (or all) of other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def next_documents(docs: DataFrame, parts: int | None = None) -> tuple[DataFrame, int]:
    """Rows (part, doc_id, text, ahead) dealt by part and sorted by (part, ahead, doc_id, text).

    Each row's successor is the next row of its part; rows with ahead = 1 only serve as successors. One shuffle.
    """
    spark = docs.sparkSession
    ids = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("k"))
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cuts = ids.agg(F.percentile_approx("k", [x / parts for x in range(1, parts)], 10000)).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    part = F.lit(0).cast("long")
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    if cuts:
        part = F.size(F.filter(F.lit(np.array(cuts, np.int64).tolist()), lambda c: c < key)).cast("long")
    heads = [tuple(r) for r in docs.select(part.alias("part"), key.alias("k")).groupBy("part").agg(F.min("k").alias("k")).orderBy("part").collect()]
    before = {k: heads[i - 1][0] for i, (_, k) in enumerate(heads)}
    sent = F.array(F.struct(part.alias("part"), F.lit(0).alias("ahead")))
    if before:
        at = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        sent = F.when(F.element_at(at, key).isNotNull(), F.concat(sent, F.array(F.struct(F.element_at(at, key).alias("part"), F.lit(1).alias("ahead"))))).otherwise(sent)
    rows = docs.select("doc_id", "text", F.explode(sent).alias("to")).select(F.element_at(F.lit(_keys_for(spark, parts)), F.col("to.part").cast("int") + 1).cast("long").alias("part"), F.col("to.ahead").alias("ahead"), "doc_id", "text")
    return rows.repartition(parts, "part").sortWithinPartitions("part", "ahead", "doc_id", "text"), parts


def _keys_for(spark, parts: int) -> list[int]:
    """For each of the partitions a number that Spark's hash partitioning sends there, so that each holds one range."""
    tried, found = 64 * parts, {}
    while len(found) < parts:
        rows = spark.range(tried).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("to")).agg(F.min("id").alias("id")).collect()
        found = {to: id_ for to, id_ in rows}
        tried *= 4
    return [found[k] for k in range(parts)]


def with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Pairs ((doc_id, text), (doc_id, text) of the successor) from sorted rows of next_documents."""
    part = waiting = None
    for b in batches:
        pairs = []
        for p, ahead, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("part", "ahead", "doc_id", "text")), strict=True):
            row = (doc_id, text or "")
            if p != part:
                part, waiting = p, None
            if waiting is not None:
                pairs.append((waiting, row))
            waiting = None if ahead else row
        yield pairs


def compare_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how near both the latter and its successor's are."""
    ship(docs.sparkSession)
    rows, _ = next_documents(docs, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for pairs in with_next(batches):
            out: list[list] = [[] for _ in range(7)]
            for (doc_id, text), (_, other) in pairs:
                mine = last[1] if last[0] is text else fingerprint(text)
                theirs = fingerprint(other)
                last = (other, theirs)
                new = edited(text, other)
                changed = fingerprint(new)
                for column, x in zip(out, (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), mine, changed, likeness(mine, changed), likeness(mine, theirs)), strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10(spark, sf_dir: str) -> DataFrame:
    return compare_next(table(spark, sf_dir, "documents"))
