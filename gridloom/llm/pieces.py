"""SentencePiece encoding and decoding with the N best segmentations.

The vocabulary's pieces over a text form a lattice. A forward Viterbi pass gives each place its best score from the
start; a backward A-star search from the end uses these as exact heuristics, so paths leave it in order of score. Each
entry of the search's frontier stands for one path of exactly its score, so no more entries are kept than paths are
still wanted, and memory is one number for each place of the lattice plus the N paths, however long the text.

As no piece has a space mark after another character, nor a line feed, the lattice falls into chunks (spaces and what
follows them). Each distinct chunk is searched once, the best way included, and kept in a cache (CACHE chunks and one
block's new ones at most); chunks share the forward pass of what they begin with. The N best of the text are the N least
sums of the chunks' losses; they can only deviate in the N - 1 chunks that lose least by their second best. A vocabulary
that breaks the rule is searched as one lattice.

Scores: the file's vocabulary was made by merging pairs and gives each piece the rank of its merge, which is an order and
no weight; sums of ranks would prefer two early pieces to the one merged from them. ``load`` therefore scores a piece by
its rank as in Zipf's law, -log(rank + RANKS), without any fitting (``by_rank=False`` keeps the file's numbers, for
vocabularies that hold log-probabilities). Scores are rounded to whole 2**-20ths, so that sums are exact in any order.

A character that no piece begins with, alone, costs the least score less ``UNKNOWN`` and becomes byte pieces, and so does
a space mark (U+2581) that the text itself contains. Decoding joins the pieces, turns space marks to spaces and drops the
one put in front; it returns the very text.

Nulls and odd input: a null or empty text has one segmentation, of no piece; texts with fewer than N segmentations give
those; equal scores may come in either order, the same in each run; repeated rows are encoded alike; very long texts, also
without any space, take time and memory in proportion to their length; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import nsmallest
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, table

MARK = "▁"
UNKNOWN = 10.0
RANKS = 100
UNIT = 1 << 20
N_BEST = 3
CACHE = 1_000_000
_CHUNK = re.compile(" *[^ \\n]+| +|\\n+")
_BYTE = re.compile("<0x([0-9A-F]{2})>")
_LOW, _NONE = -(1 << 60), 1 << 59


class Vocabulary:
    def __init__(self, pieces: list[tuple[str, float, str]]):
        """pieces: (text, score, kind) by id; kind is piece, byte or other (never used)."""
        self.tails: dict[str, tuple | None] = {}  # pieces with spaces for marks, and None for what only ends some
        self.bytes_ = {int(_BYTE.fullmatch(t)[1], 16): i for i, (t, _, kind) in enumerate(pieces) if kind == "byte"}
        plain = [t.replace(MARK, " ") for t, _, _ in pieces]
        self.raw = [bytes([int(_BYTE.fullmatch(t)[1], 16)]) if kind == "byte" else t.encode() if kind == "piece" else b"" for t, (_, _, kind) in zip(plain, pieces, strict=True)]
        for i, (t, (_, s, kind)) in enumerate(zip(plain, pieces, strict=True)):
            if kind == "piece":
                for k in range(1, len(t)):
                    self.tails.setdefault(t[k:], None)
                self.tails[t] = ((i,), round(s * UNIT))
        usable = [s for _, s, kind in pieces if kind == "piece"]
        self.unknown = min((s for s in usable if s > -1e8), default=0.0) - UNKNOWN
        self._unknown = round(self.unknown * UNIT)
        self.chunks = all(" " not in t.lstrip(" ") and "\n" not in t for t, (_, _, kind) in zip(plain, pieces, strict=True) if kind == "piece")
        self.cache: dict[str, tuple] = {}
        self.several: dict[tuple[str, int], list] = {}

    def into(self, text: str, end: int) -> list[tuple[int, int, tuple[int, ...]]]:
        """(start, score, ids) of the lattice's edges to a place, found by growing them to the left."""
        start = end - 1
        found = self.tails.get(text[start:end], 0)
        out = [(start, found[1], found[0]) if found else (start, self._unknown, self.as_bytes(text[start]))]
        while found != 0 and start:
            start -= 1
            if found := self.tails.get(text[start:end], 0):
                out.append((start, found[1], found[0]))
        return out

    def forward(self, text: str, best: list[int], second: list[int], back: list[int]) -> None:
        """Viterbi: extend the best and second best scores of the text's first places, and where the best edges start, to all."""
        get, unknown = self.tails.get, self._unknown
        for end in range(len(best), len(text) + 1):
            start = end - 1
            found = get(text[start:end], 0)
            score = found[1] if found else unknown
            now, after, way = best[start] + score, second[start] + score, start
            if found != 0:
                while start:
                    start -= 1
                    if found := get(text[start:end], 0):
                        x = best[start] + found[1]
                        if x > now:
                            y = second[start] + found[1]
                            after = now if now > y else y
                            now, way = x, start
                        elif x > after:
                            after = x
                    elif found == 0:
                        break
            best.append(now)
            second.append(after)
            back.append(way)

    def follow(self, text: str, back: list[int]) -> tuple[int, ...]:
        """The ids of the best segmentation: the search below, when it wants one path, only ever extends these edges."""
        get, out, end = self.tails.get, [], len(text)
        while end:
            start = back[end]
            found = get(text[start:end])
            out.append(found[0] if found else self.as_bytes(text[start]))
            end = start
        out.reverse()
        return tuple(chain.from_iterable(out))

    def backward(self, text: str, best: list[int], n_best: int) -> list[tuple[int, tuple[int, ...]]]:
        """A-star from the end: the n_best segmentations (score, ids), best first.

        The frontier holds (score of the whole path, place, score behind it, what follows). Its best entry is the next to
        be extended; entries behind the number of paths still wanted can't be among them.
        """
        out: list[tuple[int, tuple[int, ...]]] = []
        frontier: list[tuple] = [(best[len(text)], len(text), 0, None)]
        while frontier:
            whole, end, behind, tail = frontier.pop(0)
            if not end:
                ids: list[int] = []
                while tail is not None:
                    ids += tail[0]
                    tail = tail[1]
                out.append((whole, tuple(ids)))
                if len(out) == n_best:
                    break
                continue
            for start, score, ids_ in self.into(text, end):
                done = behind + score
                frontier.append((best[start] + done, start, done, (ids_, tail)))
            if len(frontier) > 1:
                frontier.sort(key=_rank)
                del frontier[n_best - len(out) :]
        return out

    def ways(self, text: str, n_best: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n_best segmentations of a chunk, kept as well."""
        found = self.several.get((text, n_best))
        if found is None:
            if len(self.several) >= CACHE // 10:
                self.several.clear()
            best: list[int] = [0]
            self.forward(text, best, [_LOW], [0])
            found = self.several[text, n_best] = self.backward(text, best, n_best)
        return found

    def learn(self, texts) -> None:
        """Put (best score, its ids, how much the second best loses) of each text into the cache.

        The texts are taken in order, so that each goes on from the places it has in common with the one before.
        """
        cache = self.cache
        before, best, second, back = "", [0], [_LOW], [0]
        for text in sorted(texts):
            k = 0
            for x, y in zip(before, text):  # noqa: B905
                if x != y:
                    break
                k += 1
            del best[k + 1 :], second[k + 1 :], back[k + 1 :]
            self.forward(text, best, second, back)
            before = text
            cache[text] = (best[-1], self.follow(text, back), best[-1] - second[-1])

    def as_bytes(self, c: str) -> tuple[int, ...]:
        return tuple(self.bytes_.get(b, 0) for b in c.encode("utf-8", "surrogatepass"))

    def parts(self, text: str | None) -> list[str]:
        """The chunks of a text, with a space put in front."""
        if not text:
            return []
        return _CHUNK.findall(" " + text) if self.chunks else [" " + text]

    def encode_many(self, texts: list[str | None], n_best: int = 1) -> Iterator[list[tuple[float, array]]]:
        """For each text (score, ids) of at most n_best segmentations, best first; new chunks are learnt together."""
        if len(self.cache) >= CACHE:
            self.cache.clear()
        cache = self.cache
        parts = [self.parts(t) for t in texts]
        self.learn({p for x in parts for p in x if p not in cache})
        for found in parts:
            yield self._joined(found, n_best) if found else [(0.0, array("I"))]

    def encode(self, text: str | None, n_best: int = 1) -> list[tuple[float, array]]:
        return next(self.encode_many([text], n_best))

    def _joined(self, parts: list[str], n_best: int) -> list[tuple[float, array]]:
        cache = self.cache
        scores, ids, losses = zip(*[cache[p] for p in parts], strict=True)
        score = sum(scores)
        out = [(score / UNIT, array("I", chain.from_iterable(ids)))]
        if n_best > 1:
            sums: list[tuple[int, tuple]] = [(0, ())]
            for loss, k in nsmallest(n_best - 1, zip(losses, range(len(losses)), strict=True)):
                if loss >= _NONE:
                    break
                ways = self.ways(parts[k], n_best)
                own = [(0, scores[k], ids[k]), *((r + 1, s, way) for r, (s, way) in enumerate([w for w in ways if w[1] != ids[k]]))]
                sums = nsmallest(n_best, ((loss + scores[k] - s, (*taken, (k, way)) if r else taken) for loss, taken in sums for r, s, way in own[:n_best]), key=_order)
            for loss, taken in sums[1:]:
                at, changed = 0, []
                for k, way in sorted(taken):
                    changed += [*ids[at:k], way]
                    at = k + 1
                out.append(((score - loss) / UNIT, array("I", chain.from_iterable(chain(changed, ids[at:])))))
        return out

    def decode(self, ids) -> str:
        raw = self.raw
        return b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


def _order(x: tuple) -> int:
    return x[0]


def _rank(entry: tuple) -> tuple[int, int]:
    """Best first, and of equal paths the one nearest the start."""
    return -entry[0], entry[1]


@lru_cache(maxsize=2)
def load(path: str, by_rank: bool = True) -> Vocabulary:
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if s.is_byte(i) else "other" if s.is_control(i) or s.is_unknown(i) or s.is_unused(i) else "piece"
    score = lambda x: -math.log(RANKS - x) if by_rank else x
    return Vocabulary([(s.id_to_piece(i), score(s.get_score(i)) if kind(i) == "piece" else 0.0, kind(i)) for i in range(s.get_piece_size())])


def default_path() -> str:
    import public_tokenizers as P

    return P.path("piece_bpe_32k.model")


def segment(docs: DataFrame, n_best: int = N_BEST, path: str | None = None) -> DataFrame:
    """doc_id, text and its segmentations: an array of (score, ids), best first. No shuffle."""
    ship(docs.sparkSession)
    path = path or default_path()
    way = pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [[{"score": s, "ids": i} for s, i in ways] for ways in words.encode_many(part.column("text").to_pylist(), n_best)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(way))], ["doc_id", "text", "ways"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, ways array<struct<score: double, ids: array<int>>>")


def digests(docs: DataFrame, n_best: int = N_BEST, path: str | None = None) -> DataFrame:
    """doc_id, n_ways, scores, n_pieces and ids_crc32 of each way, and whether the best decodes to the text."""
    ship(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                out: list[list] = [[] for _ in range(5)]
                texts = b.column("text").to_pylist()
                for text, ways in zip(texts, words.encode_many(texts, n_best), strict=True):
                    for column, x in zip(out, (len(ways), [s for s, _ in ways], [len(i) for _, i in ways], [zlib.crc32(i.tobytes()) for _, i in ways], words.decode(ways[0][1]) == (text or "")), strict=True):
                        column.append(x)
                kinds = [pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_ways", "scores", "n_pieces", "ids_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ways int, scores array<double>, n_pieces array<long>, ids_crc32 array<long>, round_trip boolean")


def op8(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
