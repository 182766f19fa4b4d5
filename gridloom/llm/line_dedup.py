"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line (texts are cut at line feeds) is dropped if an earlier one, by (doc_id, hash of the text, position), equals it
or, when both have ``fuzzy_from`` characters at least, is one edit away (insertion, deletion or substitution of a
character). With ``edits=2``, lines that both have ``two_from`` characters at least may be two edits apart; other bounds
than 0, 1 and 2 are refused. Blank lines always stay and match nothing. The query op5 has one edit, as its SQL says; the
pipeline's stage has two.

Equal lines meet by name first (two independent 64-bit hashes and the length), so that all later steps see each distinct
line once. Two lines one edit apart share, at some place, the variant without the edited character; a line's variants are
hashed with the text before and after them, and equal ones are joined. To emit only variants that can have a partner, lines
are first matched by halves, then by pieces of about sqrt(length): the edit lies in one piece, so all before and all after
it must be shared. Whoever shares a variant is compared (levenshtein) with the earliest that has it, never with all others:
lines that lack the same place are one edit apart from each other, and a line that equals a variant is so from each line
the variant came from.

Of two lines two edits apart, one of three parts is equal: the first, the last, or (an edit on either side) the middle one,
shifted by a character at most. Lines that share no such part with another are left out by a bitmap. The others are cut in
quarters, and those in pieces of about sqrt(length); at both levels a line goes on only where one that is not settled yet has
an earlier partner that agrees in all but the one or two pieces with the edits, and differs in each of those. What is left
emits its variants with two characters open, taken out, or one of each; places left open are part of the hash, so lines of one
variant are known to be near by the counts of the two kinds, and again only the earliest that fits is compared.

Nulls and odd input: a null text has no lines and stays null; an empty text is one blank line; a null doc_id comes
first; rows with equal doc_id and text are one document and fare alike; an empty table gives an empty result; other
columns are kept by ``dedup``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, marked, table

FUZZY_FROM = 16
TWO_FROM = 40
PARTS = 4
#: What names a line: two independent 64-bit hashes and its length.
KEY = ["h", "g", "n"]
#: Lines with more than a 1,024th of all are spread over so many parts of the last join.
SPREAD = 64


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, th, pos, line, and what names it: h, g (two independent 64-bit hashes) and n (characters), of each line that isn't blank."""
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.where(F.col("line").rlike(r"\S")).withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit("again"), "line"), "n": F.length("line")})


def _half_keys() -> list:
    """For the pairs in which the shorter line has m = n characters, and m = n - 1: hashes of the first and of the last half."""
    out = []
    for less in (0, 1):
        m = F.col("n") - less
        half = F.floor(m / 2).cast("int")
        out.append(F.xxhash64(m, F.lit(0), F.substring("line", F.lit(1), half)))
        out.append(F.xxhash64(m, F.lit(1), F.expr(f"right(line, int(n - {less} - floor((n - {less}) / 2)))")))
    return out


def _pieces(lines: DataFrame) -> DataFrame:
    """key, piece, longer for each piece of each line: key hashes its place and all around it; longer: the line has a character more than the pair's shorter one."""
    rows = lines.withColumn("m", F.explode(F.expr("array(n, n - 1)"))).withColumn("w", F.expr("int(ceil(sqrt(m)))"))
    rows = rows.withColumn("s", F.explode(F.expr("sequence(0, int(ceil(m / w)) - 1)"))).withColumn("o", F.expr("s * w"))
    rows = rows.withColumn("size", F.expr("least(w, m - o)"))
    key = F.xxhash64("m", "s", F.xxhash64(F.expr("left(line, o)")), F.xxhash64(F.expr("right(line, m - o - size)")))
    return rows.select("h", "n", "first", key.alias("key"), F.expr("substring(line, o + 1, size + n - m)").alias("piece"), (F.col("n") > F.col("m")).alias("longer"))


def _variants(pieces: DataFrame) -> DataFrame:
    """variant, kind for each piece without one of its characters (kind d at a place, b at any) and for the whole piece (w)."""
    one_less = "concat(left(piece, i), substring(piece, i + 2))"
    deleted = F.expr(f"transform(sequence(0, length(piece) - 1), i -> struct(xxhash64(key, if(longer, -1, i), {one_less}) as variant, if(longer, 'b', 'd') as kind))")
    whole = F.expr("if(longer, array(), array(struct(xxhash64(key, -1, piece) as variant, 'w' as kind)))")
    return pieces.where("length(piece) > 0").select("h", "n", "first", F.explode(F.concat(deleted, whole)).alias("x")).select("h", "n", "first", "x.variant", "x.kind").distinct()


def _bitmap(ids: DataFrame, column: str):
    """Keeps the rows of a DataFrame whose ``column`` may be in ids."""
    add = marked(ids, column)
    return lambda df: add(df).where("__hit").drop("__hit")


def near_lines(docs: DataFrame, distinct_lines: DataFrame, fuzzy_from: int) -> DataFrame:
    """KEY of the distinct lines that are one edit away from an earlier one."""
    keys = distinct_lines.where(F.col("n") > fuzzy_from - 1).select("h", "n", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key"))
    shared = keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key")
    wanted = cut(keys.join(shared, "key", "left_semi").select("h", "n").distinct())

    # One text of each such line. The bitmap spares the shuffle of most other lines; the join after it is exact
    # (not a semi join: the optimizer would push that below the bitmap's filter, and so shuffle all lines).
    texts = _bitmap(wanted, "h")(_lines(docs).select("line", *KEY))
    texts = texts.select(*KEY, "line").join(wanted, ["h", "n"]).groupBy(*KEY).agg(F.min("line").alias("line"))
    texts = cut(texts.join(distinct_lines.select(*KEY, "first"), KEY))

    pieces = _pieces(texts)
    around = pieces.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key")
    variants = cut(_variants(pieces.join(around, "key", "left_semi")))
    me = F.struct("first", "h", "n")
    heads = variants.groupBy("variant").agg(F.min(F.when(F.col("kind") != "w", me)).alias("other"), F.min(F.when(F.col("kind") == "w", me)).alias("whole"))
    met = variants.join(heads.where(F.col("other").isNotNull()), "variant").select("h", "n", "first", F.when(F.col("kind") == "b", F.col("whole")).otherwise(F.col("other")).alias("e"))
    met = met.where(F.col("e").isNotNull() & (F.col("e.first") < F.col("first"))).select("h", "n", F.col("e.h").alias("eh"), F.col("e.n").alias("en")).distinct()
    return _verified(met, texts, 1)


def _verified(met: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """KEY of the lines of pairs (h, n, eh, en) whose texts are that near, the other one earlier."""
    later = texts.select(*KEY, "line", "first")
    earlier = texts.select(F.col("h").alias("eh"), F.col("n").alias("en"), F.col("line").alias("earlier"), F.col("first").alias("efirst"))
    both = met.join(later, ["h", "n"]).join(earlier, ["eh", "en"]).where(F.col("efirst") < F.col("first"))
    return both.where(F.levenshtein("line", "earlier", edits).between(0, edits)).select(*KEY).distinct()


def _third_keys(lines: DataFrame, least: int) -> DataFrame:
    """lines with a row for each key: a third's place and hash, its size rounded so that lines of nearly one length have the same."""
    rows = lines.withColumn("q", F.explode(F.expr(f"array_distinct(transform(filter(array(n, n - 1, n - 2), m -> m >= {least}), m -> int((m - 1) div 3)))")))
    rows = rows.withColumn("c", F.expr("q - q % shiftleft(1, greatest(int(log2(q)) - 2, 0))")).drop("q")
    parts = [(0, "left(line, c)"), (1, "substring(line, c + 1, c)"), (1, "substring(line, c + 2, c)"), (2, "right(line, c)")]
    return rows.withColumn("key", F.explode(F.array(*(F.xxhash64("c", F.lit(i), F.expr(x)) for i, x in parts)))).drop("c")


_ROLE = "struct({} as dx, {} as dy)"
#: What two parts with an edit each may have more than the same parts of the other line: for whole lines, and for a part that has dx more itself.
ALL_ROLES = f"array({', '.join(_ROLE.format(*x) for x in ((0, 0), (1, 0), (0, 1), (1, 1)))})"
ROLES = f"case dx when 0 then array({_ROLE.format(0, 0)}, {_ROLE.format(1, 0)}, {_ROLE.format(0, 1)}) when 1 then array({_ROLE.format(1, 0)}, {_ROLE.format(0, 1)}) else array({_ROLE.format(1, 1)}) end"
_ID = ("at", "open")


def _finer(rows: DataFrame, parts: str, whole: bool) -> DataFrame:
    """rows (at, open, key, x, dx, y, dy): lines known by key but for a text x that has both edits (y NULL), or two that have one each. The same with shorter texts.

    A text that has dx characters more than w is cut in ``parts`` (SQL of w) as one of w characters would be; the edits lie in
    one part or in two. key hashes w, which parts these are, and all the others.
    """
    at = lambda k, w="w", p="p": f"int({w} * ({k}) div {p})"
    part = lambda x, k, more, w="w", p="p", shift="0": f"substring({x}, {at(k, w, p)} + {shift} + 1, {at(k + ' + 1', w, p)} - {at(k, w, p)} + {more})"
    alone = rows.where("y is null")
    sized = lambda df, w: df.withColumn("w", F.expr(w)).where("w > 0").withColumn("p", F.expr(parts))

    one = sized(alone.withColumn("d", F.explode(F.expr("array(0, 1, 2)" if whole else "array(dx)"))), "length(x) - d").withColumn("a", F.explode(F.expr("sequence(0, p - 1)")))
    key = F.xxhash64("key", F.lit(1), "w", "a", F.expr(f"left(x, {at('a')})"), F.expr(f"right(x, w - {at('a + 1')})"))
    out = one.select(*_ID, key.alias("key"), F.expr(part("x", "a", "d")).alias("x"), F.col("d").alias("dx"), F.lit(None).cast("string").alias("y"), F.lit(0).alias("dy"))

    two = sized(alone.withColumn("r", F.explode(F.expr(ALL_ROLES if whole else ROLES))), "length(x) - r.dx - r.dy").where("p > 1")
    two = two.withColumn("a", F.explode(F.expr("sequence(0, p - 2)"))).withColumn("b", F.explode(F.expr("sequence(a + 1, p - 1)")))
    key = F.xxhash64("key", F.lit(2), "w", "a", "b", F.expr(f"left(x, {at('a')})"), F.expr(f"substring(x, {at('a + 1')} + r.dx + 1, {at('b')} - {at('a + 1')})"), F.expr(f"right(x, w - {at('b + 1')})"))
    out = out.unionByName(two.select(*_ID, key.alias("key"), F.expr(part("x", "a", "r.dx")).alias("x"), "r.dx", F.expr(part("x", "b", "r.dy", shift="r.dx")).alias("y"), "r.dy"))
    if whole:
        return out

    both = sized(rows.where("y is not null"), "length(x) - dx").withColumnsRenamed({"w": "wx", "p": "px"})
    both = sized(both, "length(y) - dy").withColumn("a", F.explode(F.expr("sequence(0, px - 1)"))).withColumn("b", F.explode(F.expr("sequence(0, p - 1)")))
    key = F.xxhash64("key", F.lit(3), "a", "b", F.expr(f"left(x, {at('a', 'wx', 'px')})"), F.expr(f"right(x, wx - {at('a + 1', 'wx', 'px')})"), F.expr(f"left(y, {at('b')})"), F.expr(f"right(y, w - {at('b + 1')})"))
    return out.unionByName(both.select(*_ID, key.alias("key"), F.expr(part("x", "a", "dx", "wx", "px")).alias("x"), "dx", F.expr(part("y", "b", "dy")).alias("y"), "dy"))


def _shared(rows: DataFrame, key: str = "key") -> DataFrame:
    """The rows of keys that an open line and an earlier one may have."""
    several = rows.groupBy(key).agg(F.min("at").alias("lo"), F.max(F.when(F.col("open"), F.col("at"))).alias("hi")).where("lo < hi")
    return _bitmap(cut(several.select(key)), key)(rows)


def _apart(rows: DataFrame) -> DataFrame:
    """The rows of keys whose lines differ in every text that the key leaves out: else they are less than two edits apart, or meet by another key."""
    kinds = rows.groupBy("key").agg(F.min("at").alias("lo"), F.max(F.when(F.col("open"), F.col("at"))).alias("hi"), *(f(F.xxhash64(c)).alias(f"{c}_{f.__name__}") for c in ("x", "y") for f in (F.min, F.max)), F.max(F.col("y").isNotNull()).alias("two"))
    return rows.join(kinds.where("lo < hi and x_min <> x_max and (not two or y_min <> y_max)").select("key"), "key", "left_semi")


def _edits() -> tuple[str, str]:
    """SQL: arrays of (s, d, v): the variants of x that one edit can have in common with another text, and those that two can.

    v hashes x without d characters and with s places left open; places are part of the hash, so that two texts of one v
    are s edits and one more for each character taken out of either apart, at most.
    """
    variant = lambda s, d, v: f"struct({s} as s, {d} as d, {v} as v)"
    places = "sequence(0, length(x) - 1)"
    less = lambda p: f"concat(left(x, {p}), substring(x, {p} + 2))"
    whole = f"array({variant(0, 0, 'xxhash64(2, x)')})"
    opened = f"transform({places}, i -> {variant(1, 0, 'xxhash64(1, i, left(x, i), substring(x, i + 2))')})"
    taken = f"transform({places}, i -> {variant(0, 1, f'xxhash64(2, {less("i")})')})"
    pairs = lambda what: f"flatten(transform({places}, i -> transform(filter({places}, k -> k > i), k -> {what})))"
    around = "left(x, i), substring(x, i + 2, k - i - 1), substring(x, k + 2)"
    open_two = pairs(variant(2, 0, f"xxhash64(3, i, k, {around})"))
    take_two = pairs(variant(0, 2, f"xxhash64(2, concat({around}))"))
    take_open = f"flatten(transform({places}, k -> transform(sequence(0, length(x) - 2), i -> {variant(1, 1, f'xxhash64(1, i, left({less("k")}, i), substring({less("k")}, i + 2))')})))"
    return f"if(dx = 0, concat({opened}, {whole}), {taken})", f"case dx when 0 then concat({open_two}, {opened}, {whole}, {taken}) when 1 then {take_open} else {take_two} end"


def two_apart(docs: DataFrame, distinct_lines: DataFrame, settled: DataFrame, least: int) -> DataFrame:
    """KEY of the lines that aren't settled (KEY) and are two edits at most from an earlier one; both have ``least`` characters."""
    lines = _lines(docs).where(F.col("n") >= least)
    shared = cut(_third_keys(lines.select(*KEY, "line"), least).groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key"))
    some = _bitmap(shared, "key")(_third_keys(lines.select(*KEY, "line"), least))
    texts = some.groupBy(*KEY).agg(F.min("line").alias("line")).join(distinct_lines.select(*KEY, "first"), KEY)
    texts = texts.join(settled.withColumn("open", F.lit(False)), KEY, "left").withColumn("open", F.coalesce("open", F.lit(True)))
    texts = cut(texts.orderBy("first").withColumn("at", F.monotonically_increasing_id()))  # a number in the lines' order

    rows = texts.select(*_ID, F.lit(0).cast("long").alias("key"), F.col("line").alias("x"), F.lit(0).alias("dx"), F.lit(None).cast("string").alias("y"), F.lit(0).alias("dy"))
    rows = cut(_apart(_shared(_finer(rows, str(PARTS), True))))
    rows = cut(_apart(_shared(_finer(rows, "int(ceil(sqrt(w)))", False))))
    once, twice = _edits()
    alone = rows.where("y is null").select(*_ID, "key", F.explode(F.expr(twice)).alias("e")).select(*_ID, "e.s", "e.d", F.xxhash64("key", "e.v").alias("variant"))
    both = rows.where("y is not null").withColumn("ex", F.explode(F.expr(once))).withColumns({"x": F.col("y"), "dx": F.col("dy")}).withColumn("ey", F.explode(F.expr(once)))
    both = both.select(*_ID, F.expr("ex.s + ey.s as s"), F.expr("ex.d + ey.d as d"), F.xxhash64("key", "ex.v", "ey.v").alias("variant"))
    variants = cut(_shared(alone.unionByName(both), "variant"))
    heads = variants.groupBy("variant").agg(*(F.min(F.when(F.col("d") <= k, F.col("at"))).alias(f"e{k}") for k in range(3)))
    # A line with s places open and d characters less may meet one with 2 - s - d less: the earliest such, never all.
    met = variants.where("open").join(heads, "variant").select("at", F.expr("case 2 - s - d when 2 then e2 when 1 then e1 else e0 end").alias("e")).where("e < at").distinct()
    earlier = texts.select(F.col("at").alias("e"), F.col("line").alias("earlier"))
    near = met.join(texts.select("at", *KEY, "line"), "at").join(earlier, "e")
    return near.where(F.levenshtein("line", "earlier", 2).between(0, 2)).select(*KEY).distinct()


def dropped_lines(docs: DataFrame, edits: int = 1, fuzzy_from: int = FUZZY_FROM, two_from: int = TWO_FROM) -> DataFrame:
    """(doc_id, th, drop): the ascending positions of the lines to drop in each document that has any."""
    if edits not in (0, 1, 2):
        raise ValueError(f"edits is 0, 1 or 2, not {edits!r}")
    if edits == 2 and two_from < max(fuzzy_from, 2 * PARTS):
        raise ValueError(f"two_from is {max(fuzzy_from, 2 * PARTS)} at least, not {two_from!r}")
    lines = _lines(docs)
    place = F.struct("doc_id", "th", "pos")
    keyed = lines.select(*KEY, place.alias("place"), *(k.alias(f"k{i}") for i, k in enumerate(_half_keys())))
    distinct_lines = cut(keyed.groupBy(*KEY).agg(F.min("place").alias("first"), F.count("*").alias("times"), *(F.min(f"k{i}").alias(f"k{i}") for i in range(4))))
    judged = distinct_lines.select(*KEY, "first", "times")
    if edits:
        near = near_lines(docs, distinct_lines, fuzzy_from)
        if edits == 2:
            near = cut(near)
            near = near.union(two_apart(docs, distinct_lines, near, two_from))
        judged = judged.join(near.withColumn("near", F.lit(True)), KEY, "left").where("times > 1 or near")
    else:
        judged = judged.withColumn("near", F.lit(None).cast("boolean")).where("times > 1")
    judged = cut(judged.withColumn("near", F.coalesce("near", F.lit(False))))

    # Lines with more than a 1,024th of all (so at most 1,024) would each gather in one task: their rows are spread.
    many = (distinct_lines.agg(F.sum("times")).first()[0] or 0) // 1024 + 1
    common = judged.where(F.col("times") >= many).select(*KEY, F.lit(True).alias("common"))
    asked = _bitmap(judged.select("h"), "h")(lines.select(*KEY, "doc_id", "th", "pos")).join(F.broadcast(common), KEY, "left")
    asked = asked.withColumn("part", F.when(F.col("common"), F.pmod(F.xxhash64("doc_id", "th", "pos"), F.lit(SPREAD))).otherwise(F.lit(0)))
    spread = judged.withColumn("part", F.explode(F.when(F.col("times") >= many, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0))).cast("array<long>")))
    gone = asked.join(spread, [*KEY, "part"]).where(F.col("near") | ~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.col("pos").cast("long"))).alias("drop"))


def dedup(docs: DataFrame, edits: int = 1, fuzzy_from: int = FUZZY_FROM, two_from: int = TWO_FROM) -> DataFrame:
    """docs, text without the dropped lines, with __n_lines and __n_dropped behind their columns."""
    dropped = cut(dropped_lines(docs.select("doc_id", "text"), edits, fuzzy_from, two_from).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("drop").alias("__drop")))
    rest = [docs[c].alias(str(k)) for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    own = docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *rest).alias("__own"))  # other names can't clash in there
    own = marked(dropped.select(F.col("__th").alias("th")), "th")(own.withColumn("th", F.xxhash64("text"))).withColumnRenamed("th", "__own_th")
    touched = own.where("__hit")  # only these texts are shuffled
    touched = touched.join(dropped, touched["doc_id"].eqNullSafe(dropped["__id"]) & (touched["__own_th"] == dropped["__th"]), "left").select("doc_id", "text", "__own", "__drop")
    rows = touched.unionByName(own.where("not __hit").select("doc_id", "text", "__own", F.lit(None).cast("array<bigint>").alias("__drop")))
    rows = rows.withColumn("__lines", F.split("text", "\n", -1))
    kept = F.expr("array_except(transform(__lines, (x, i) -> bigint(i)), __drop)")
    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__lines", i.cast("int"))), "\n"))
    return rows.select(
        *(text.alias("text") if c == "text" else F.col(c) if c == "doc_id" else F.col("__own").getField(str(k)).alias(c) for k, c in enumerate(docs.columns)),
        F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("__n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("__n_dropped"),
    )


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), "text")


def drop_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: later equal or nearly equal lines (two edits from ``TWO_FROM`` characters) go, and so do documents of which only blank lines are left."""
    found = dedup(docs, edits=2).where(F.expr("__n_dropped = 0 or text rlike '\\\\S'"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


ORACLE = """
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), solid AS (SELECT * FROM lines WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')),
firsts AS (SELECT line, length(line) AS n, min(doc_id * 10000000 + pos) AS place FROM solid GROUP BY line),
halves AS (
  SELECT line, n, place, n - less AS m, unnest(['l' || left(line, CAST(floor((n - less) / 2) AS INT)), 'r' || right(line, CAST(n - less - floor((n - less) / 2) AS INT))]) AS half
  FROM firsts, (VALUES (0), (1)) AS t(less) WHERE n >= 16
), pairs AS (
  SELECT DISTINCT a.line AS a, b.line AS b FROM halves a JOIN halves b ON a.m = b.m AND a.half = b.half AND a.place > b.place
), near AS (
  SELECT DISTINCT a FROM (SELECT a, b, unnest(range(0, length(a) + 1)) AS i FROM pairs)
  WHERE left(a, i) = left(b, i) AND (
       length(a) = length(b) AND substr(a, i + 2) = substr(b, i + 2)
    OR length(a) = length(b) + 1 AND substr(a, i + 2) = substr(b, i + 1)
    OR length(a) + 1 = length(b) AND substr(a, i + 1) = substr(b, i + 2))
), marked AS (
  SELECT l.doc_id, l.line, l.pos, (s.line IS NOT NULL AND (s.place <> l.doc_id * 10000000 + l.pos OR near.a IS NOT NULL)) AS gone
  FROM lines l LEFT JOIN firsts s ON s.line = l.line LEFT JOIN near ON near.a = l.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""
