"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

1. One pass over the texts gives each document its set of distinct 5-word shingles (as 64-bit hashes), the set's digest
   and the shingles that recur inside a task. Documents with equal sets are one class and are never compared.
2. The global order puts shingles that recur (of which the HOT most frequent are listed, a bounded list that only
   shapes the order) last and sorts the rest by hash. If two sets reach the threshold, the first n - ceil(t n) + 1
   shingles of either share one; a second pass emits those, and one shuffle keeps the ones that two sets have.
3. Pairs to compare: first each set with one leader of the shingle (the set with fewest rare shingles), which ties a
   group of near copies together without its pairs; then, for the shingles whose sets aren't all in one component yet,
   the pairs across components. Sizes, places and the number of shared prefix shingles rule out pairs that can't reach the
   threshold before any set is moved.
4. The order is cut into FRAGMENTS; a third pass deals each compared set's shingles into them, the overlaps of a pair are
   counted in each fragment apart and summed per pair. Links are the pairs with 100 |A & B| >= 80 |A | B|, exactly.
5. Components of the links, then least doc_id of each.

No set of pairs inside a group of copies is ever formed; what is shuffled is the prefixes and the compared sets.

Two sets are one only if 128 bits of their shingles' hashes agree.

Nulls and odd input: null or word-less texts have no shingles, link with nothing and are their own component; fewer than
five words make one shingle; a null doc_id stays a row and never is a component's least id unless alone (then null);
repeated rows are documents of equal sets; an empty table gives an empty result; other columns are kept by the stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import cut, hashed_bits, marked, ship, table
from .graph import components

WIDTH = 5
PERCENT = 80
HOT = 1 << 17
FRAGMENTS = 8
MOST_TWINS = 10_000


def _sids(hashes: np.ndarray, bits: int) -> tuple[int, int]:
    """Two numbers that name a set, the first of so many bits, the second of 64."""
    raw = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True) >> (64 - bits), int.from_bytes(raw[8:], "little", signed=True)


def _sid(hashes: np.ndarray, twins: frozenset, bits: int) -> int:
    """A set's id: the first of its numbers, or the second where several sets have the first."""
    one, two = _sids(hashes, bits)
    return two if one in twins else one


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _profile(width: int, bits: int):
    """(doc_id, sid, sid2, n) for each document; (shingle, times) for those that recur in a task."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "sid", "sid2", "n", "shingle", "times")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        known: set[tuple[int, int]] = set()
        batches = _slices(batches)

        def recurring() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            keep = times > 1
            empty = pa.nulls(int(keep.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.array(found[keep].view(np.int64)), pa.array(times[keep])], schema=schema)

        for b in batches:
            sids, sizes = [], []
            for found in words.shingles_of(b.column("text").to_pylist(), width):
                sizes.append(len(found))
                sids.append(_sids(found, bits) if len(found) else (None, None))
                if len(found) and sids[-1] not in known:
                    known.add(sids[-1])
                    held.append(found)
                    size += len(found)
            empty = pa.nulls(len(sids), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([x[k] for x in sids], pa.int64()) for k in (0, 1)), pa.array(sizes, pa.int64()), empty, empty], schema=schema)
            if size > 1 << 22:
                yield recurring()
                held, size, known = [], 0, set()
        if held:
            yield recurring()

    return run


def _prefixes(width: int, percent: int, hot, ranks, twins: frozenset, bits: int):
    """(shingle, sid, n, pos, rare): the first shingles of each set in the global order; rare: how many aren't hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, order = hot.value, ranks.value
        known: set[int] = set()
        for b in _slices(batches):
            columns: list[list[np.ndarray]] = [[] for _ in range(5)]
            for found in words.shingles_of(b.column("text").to_pylist(), width):
                n = len(found)
                if not n or (sid := _sid(found, twins, bits)) in known:
                    continue
                known.add(sid)
                if len(known) > 1 << 20:
                    known.clear()
                keep = n - -(-percent * n // 100) + 1
                place = np.searchsorted(table_, found)
                place[place == len(table_)] = 0
                warm = table_[place] == found if len(table_) else np.zeros(n, bool)
                rare = n - int(warm.sum())
                first = found[~warm][:keep]  # ascending hashes
                if len(first) < keep:
                    rest = found[warm]
                    first = np.concatenate([first, rest[np.argsort(order[place[warm]], kind="stable")][: keep - len(first)]])
                for column, x in zip(columns, (first.view(np.int64), np.full(keep, sid), np.full(keep, n), np.arange(keep), np.full(keep, rare)), strict=True):
                    column.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(k)) for x, k in zip(columns, (np.int64, np.int64, np.int32, np.int32, np.int32), strict=True)], ["shingle", "sid", "n", "pos", "rare"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (shingle, rare, n, sid), those whose shingle has two sets at least, each beside the first of its shingle."""
    names = ["shingle", "sid", "n", "pos", "lead", "lead_n", "lead_pos"]
    kept: tuple | None = None  # the leader of the shingle that the last batch ended in, whether it has been sent, the last sid
    for b in batches:
        if not b.num_rows:
            continue
        key, sid, n, pos = (b.column(c).to_numpy() for c in ("shingle", "sid", "n", "pos"))
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        if kept is not None and kept[0][0] == key[0] and kept[2] == sid[0]:
            fresh[0] = False  # the same set from another task
        last_sid = sid[-1]
        rows = [x[fresh] for x in (key, sid, n, pos)]
        if kept is not None and not kept[1]:  # the leader may still find company
            rows = [np.concatenate([[y], x]) for x, y in zip(rows, kept[0], strict=True)]
        elif kept is not None and len(rows[0]) and rows[0][0] == kept[0][0]:
            pass
        key, sid, n, pos = rows
        if not len(key):
            kept = (kept[0], kept[1], last_sid)
            continue
        start = np.ones(len(key), bool)
        start[1:] = key[1:] != key[:-1]
        going_on = kept is not None and kept[1] and key[0] == kept[0][0]
        lead = np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
        leads = [x[lead] for x in (sid, n, pos)]
        if going_on:
            own = lead == 0
            leads = [np.where(own, y, x) for x, y in zip(leads, kept[0][1:], strict=True)]
        edges = np.flatnonzero(np.append(start, True))
        many = np.repeat(np.diff(edges) > 1, np.diff(edges))
        if going_on:
            many[: edges[1]] = True
        tail = edges[-2]  # the last shingle goes on in the next batch
        if going_on and tail == 0:
            kept = (kept[0], True, last_sid)
        else:
            kept = ((key[tail], sid[tail], n[tail], pos[tail]), bool(many[-1]), last_sid)
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[many].astype(np.int64)) for x in (key, sid, n, pos, *leads)], names)


def _fragments(width: int, fragments: int, marks_, power: int, twins: frozenset, bits: int):
    """(fragment, sid, part) of the sets whose sid may be wanted."""
    from .common import xxhash64_long

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(marks_.value, np.uint8)
        known: set[int] = set()
        for b in _slices(batches):
            out: list[list] = [[], [], []]
            for found in words.shingles_of(b.column("text").to_pylist(), width):
                if not len(found) or (sid := _sid(found, twins, bits)) in known:
                    continue
                slot = xxhash64_long(sid) & ((1 << power) - 1)
                if not marks[slot >> 3] >> (slot & 7) & 1:
                    continue
                known.add(sid)
                if len(known) > 1 << 20:
                    known.clear()
                cuts = np.searchsorted(found, (np.arange(1, fragments, dtype=np.uint64) * np.uint64(2**64 // fragments)))
                for k, part in enumerate(np.split(found.view(np.int64), cuts)):
                    if len(part):
                        out[0].append(k)
                        out[1].append(sid)
                        out[2].append(part)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], ["fragment", "sid", "part"])

    return run


def _enough(percent: int, na: str, nb: str):
    """The least overlap of linked sets of these sizes: o >= p (na + nb - o) with p = percent / 100."""
    return F.ceil(F.lit(percent) * (F.col(na) + F.col(nb)) / F.lit(100 + percent))


def _possible(percent: int, na: str, pa_: str, nb: str, pb: str):
    """Not ruled out by sizes, nor by the places of a common shingle: at most min(pa, pb) common ones lie before it.

    Linked sets pass at each of their common shingles.
    """
    small, large = F.least(na, nb), F.greatest(na, nb)
    most = F.least(pa_, pb) + F.least(F.col(na) - F.col(pa_), F.col(nb) - F.col(pb))
    return (F.lit(100) * small >= F.lit(percent) * large) & (most >= _enough(percent, na, nb))


def _counted(rows: DataFrame, percent: int) -> DataFrame:
    """rows (a, na, pa, b, nb, pb), one for each common shingle of two prefixes: the pairs that may reach the threshold.

    Of the set whose prefix ends first in the order all common shingles up to there are counted, and what follows its
    prefix (n - p = ceil(t n) - 1) bounds the rest; nothing common lies before the first row's places.
    """
    pairs = rows.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("met"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    need = _enough(percent, "na", "nb")
    return pairs.where((F.col("met") + _after(percent) >= need) & (rest >= need)).select("a", "b", "na", "nb")


def _after(percent: int):
    """How many shingles of the larger set can lie behind its prefix."""
    return F.ceil(F.lit(percent) * F.greatest("na", "nb") / F.lit(100)) - 1


def _by_prefixes(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose prefixes (sid, shingle) have enough in common, as in _counted; one row a pair throughout."""
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    keys = prefixes.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.collect_set("shingle").alias("keys"))
    both = pairs.join(keys.select(F.col("sid").alias("a"), F.col("keys").alias("ka")), "a").join(keys.select(F.col("sid").alias("b"), F.col("keys").alias("kb")), "b")
    return both.where(F.size(F.array_intersect("ka", "kb")) + _after(percent) >= _enough(percent, "na", "nb")).select("a", "b", "na", "nb")


def overlaps(docs: DataFrame, pairs: DataFrame, width: int, fragments: int, twins: frozenset = frozenset(), name_bits: int = 64) -> DataFrame:
    """pairs (a, b, na, nb) with the exact size of their intersection, summed over fragments; pairs without any are absent."""
    spark = docs.sparkSession
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    bits, power = hashed_bits(wanted, "sid", wanted.count())
    parts = docs.select("text").mapInArrow(_fragments(width, fragments, spark.sparkContext.broadcast(bits), power, twins, name_bits), "fragment long, sid long, part array<long>")
    # One exchange serves both joins; neither the semi join with wanted nor a checkpoint would move these rows less.
    parts = parts.repartition("fragment", "sid").dropDuplicates(["fragment", "sid"])
    asked = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1)).cast("array<long>")))
    left = parts.select("fragment", F.col("sid").alias("a"), F.col("part").alias("part_a"))
    right = parts.select("fragment", F.col("sid").alias("b"), F.col("part").alias("part_b"))
    counted = asked.join(left, ["fragment", "a"]).join(right, ["fragment", "b"]).select("a", "b", "na", "nb", F.size(F.array_intersect("part_a", "part_b")).cast("long").alias("common"))
    return counted.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("overlap"))


def similar(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, fragments: int = FRAGMENTS, hot: int = HOT, name_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    profile = cut(docs.mapInArrow(_profile(width, name_bits), "doc_id long, sid long, sid2 long, n long, shingle long, times long"))
    # Sets are named by 64 bits, but for the few whose 64 bits another set has too (of 10**10 sets, some three pairs).
    twins = profile.where("sid is not null").groupBy("sid").agg(F.min("sid2").alias("lo"), F.max("sid2").alias("hi")).where("lo <> hi").select("sid")
    if len(found := twins.limit(MOST_TWINS + 1).collect()) > MOST_TWINS:
        raise ValueError("more equal 64-bit names of unequal sets than chance can give")
    twins = frozenset(r.sid for r in found)
    if twins:
        profile = profile.withColumn("sid", F.when(F.col("sid").isin(list(twins)), F.col("sid2")).otherwise(F.col("sid")))

    recur = cut(profile.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")).where("times >= 8"))
    levels = recur.groupBy(F.floor(F.log2("times")).alias("level")).count().orderBy(F.desc("level")).collect()
    total, least = 0, None
    for level, count in levels:
        if (total := total + count) > hot:
            break
        least = 2**level
    frequent = np.array([tuple(r) for r in recur.where(F.col("times") >= least).collect()] if least else [], np.int64).reshape(-1, 2)
    listed = frequent[:, 0].view(np.uint64)
    by_hash = np.argsort(listed)
    rank = np.empty(len(listed), np.int64)
    rank[np.lexsort((listed, frequent[:, 1]))] = np.arange(len(listed))
    held = spark.sparkContext.broadcast(listed[by_hash]), spark.sparkContext.broadcast(rank[by_hash])

    entries = docs.select("text").mapInArrow(_prefixes(width, percent, *held, twins, name_bits), "shingle long, sid long, n int, pos int, rare int")
    shared = cut(entries.repartition("shingle").sortWithinPartitions("shingle", "rare", "n", "sid").mapInArrow(_runs, "shingle long, sid long, n long, pos long, lead long, lead_n long, lead_pos long"))

    def ordered(df: DataFrame) -> DataFrame:
        swap = F.col("a") > F.col("b")
        return df.select(*(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na")))).distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        found = overlaps(docs, pairs, width, fragments, twins, name_bits)
        return found.where(F.lit(100) * F.col("overlap") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")

    # With its leader a set may share more than is counted here; a link missed for that is met across components below.
    stars = shared.where(F.col("sid") != F.col("lead")).where(_possible(percent, "n", "pos", "lead_n", "lead_pos"))
    stars = stars.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("lead").alias("b"), F.col("lead_n").alias("nb"), F.col("lead_pos").alias("pb"))
    first = cut(ordered(_counted(stars, percent)))
    links = cut(linked(first))
    roots = components(links)

    placed = shared.select("shingle", "sid", "n", "pos").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("shingle", "sid", "n", "pos", F.coalesce("root", "sid").alias("root"))
    several = placed.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle")
    open_ = cut(placed.join(several, "shingle", "left_semi"))
    x = open_.select("shingle", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("root").alias("ra"))
    y = open_.select("shingle", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("root").alias("rb"))
    # Linked sets pass this at their first common shingle; a row for each common one would grow with the square of a group.
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    close = (F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")) & (rest >= _enough(percent, "na", "nb"))
    across = x.join(y, "shingle").where(F.col("a") < F.col("b")).where(F.col("ra") != F.col("rb")).where(close)
    across = cut(across.select("a", "b", "na", "nb").distinct().join(first.select("a", "b"), ["a", "b"], "left_anti"))
    second = cut(_by_prefixes(across, open_, percent))
    if second.limit(1).count():
        more = cut(linked(second))
        if more.limit(1).count():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    classes = profile.where("n is not null").select("doc_id", "sid", F.col("n").alias("n_shingles"))
    ids = classes.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("first_id"))
    ids = ids.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "first_id", F.coalesce("root", "sid").alias("root"))
    least_ids = ids.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = ids.join(least_ids, "root").select("sid", "component_id")
    return classes.join(ids, "sid", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op7(spark, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


def keep_first(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, the one with the least id (null ids last, ties by a hash of the row).

    Rows are told apart by id and text, so each text of a repeated id fares by its own component, and of repeated rows one
    stays. Rows without a shingle are linked with nothing and all stay. Other columns are kept, whatever their names.
    """
    names = docs.columns
    row = F.struct(*(docs[c].alias(str(k)) for k, c in enumerate(names)))
    rows = docs.select(row.alias("row"), docs["doc_id"].alias("id"), docs["text"].alias("text")).withColumn("rid", F.xxhash64("id", "text"))
    found = similar(rows.select(F.col("rid").alias("doc_id"), "text")).where("n_shingles > 0").select(F.col("doc_id").alias("rid"), F.col("component_id").alias("root")).distinct()
    members = cut(rows.groupBy("rid", "id").agg(F.count("*").alias("copies")).join(found, "rid"))
    kept = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("kept"), F.sum("copies").alias("rows")).where("rows > 1")
    stays = F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("rid") == F.col("kept.rid"))
    judged = cut(members.join(kept, "root").withColumn("stays", stays).where("not stays or copies > 1").select("rid", F.col("id").alias("jid"), "stays"))
    seen = marked(judged, "rid")(rows)  # only rows that may be judged are shuffled
    touched = seen.where("__hit").join(judged.withColumnRenamed("rid", "jrid"), (F.col("rid") == F.col("jrid")) & F.col("id").eqNullSafe(F.col("jid")), "left").select("row", "id", "rid", "stays")
    out = seen.where("not __hit").select("row").unionByName(touched.where("stays is null").select("row")).unionByName(touched.where("stays").dropDuplicates(["rid", "id"]).select("row"))
    return out.select(*(F.col("row").getField(str(k)).alias(c) for k, c in enumerate(names)))
