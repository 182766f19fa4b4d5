"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Terms of a text are hashed byte trigrams and the shape of its words (case, last character, repetition). A labelled
sample of at most ``max_labelled`` rows fits their weights (inverse document frequency) and a truncated singular-value
projection to ``rank`` dimensions. The labelled vectors are broadcast (max_labelled x rank floats, so bounded), every
text's vector is multiplied with all of them in blocks, and the ``neighbours`` nearest vote with weights that rise with
their cosine.

Nulls, ties and odd input: a null text counts as empty; an empty text, or one without a known term, has no direction
and gets the share of good rows in the sample; labels that are null, or without a document, teach nothing; several
labels of one document count as their mean; without any label every score is 0.5. Equal texts have equal scores.
Columns beyond those named are kept by the pipeline stage and ignored here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import ship, table

TRIGRAMS = 4096
SHAPES = 512
TERMS = TRIGRAMS + SHAPES
MAX_LABELLED = 4096
RANK = 48
NEIGHBOURS = 15
SHARPNESS = 8.0

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True


def term_counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the ascending ids of its terms and their counts."""
    for text in texts:
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        if len(data) < 1:
            yield np.zeros(0, np.int32), np.zeros(0, np.int32)
            continue
        counts = np.zeros(TERMS, np.int64)
        if len(data) >= 3:
            low = words.LOWER[data].astype(np.uint32)
            keys = (low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
            counts[:TRIGRAMS] = np.bincount(keys, minlength=TRIGRAMS)
        starts, ends = words.word_spans(data)
        if len(starts):
            hashes = words.spans_hash(words.BYTES[data], starts, ends)
            again = np.zeros(len(starts), np.int64)
            again[1:] = hashes[1:] == hashes[:-1]
            twice = np.zeros(len(starts), np.int64)
            _, inverse, times = np.unique(hashes, return_inverse=True, return_counts=True)
            twice[:] = np.minimum(times[inverse] * 4 // len(starts), 3)
            last = data[ends - 1]
            kind = np.where(_LETTER[last], 0, 1 + (last % 31).astype(np.int64))
            upper = (_UPPER[data[starts]] & _UPPER[data[np.minimum(starts + 1, ends - 1)]]).astype(np.int64)
            shape = ((kind * 2 + again) * 2 + upper) * 4 + twice
            counts[TRIGRAMS:] = np.bincount(np.minimum(shape, SHAPES - 1), minlength=SHAPES)
        ids = np.flatnonzero(counts)
        yield ids.astype(np.int32), counts[ids].astype(np.int32)


def weigh(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted terms of one text. Within each of the two families they have the same total length."""
    x = np.log1p(counts) * idf[ids]
    for family in (ids < TRIGRAMS, ids >= TRIGRAMS):
        norm = np.sqrt((x[family] ** 2).sum())
        if norm > 0:
            x[family] /= norm
    return x


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], rank: int = RANK) -> dict:
    """The projection and the labelled vectors, from each labelled row's terms, counts and label."""
    rows = [r for r in rows if len(r[0])]
    labels = np.array([r[2] for r in rows])
    prior = float(labels.mean()) if len(labels) else 0.5
    seen = np.zeros(TERMS)
    for ids, _, _ in rows:
        seen[ids] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 0.1
    dense = np.zeros((len(rows), TERMS), np.float32)
    for k, (ids, counts, _) in enumerate(rows):
        dense[k, ids] = weigh(ids, counts, idf)
    rank = min(rank, *dense.shape) if len(rows) else 1
    probe = np.random.default_rng(1).standard_normal((TERMS, rank + 16)).astype(np.float32)
    basis = np.linalg.qr(dense @ probe)[0] if len(rows) else np.zeros((0, 1), np.float32)
    for _ in range(4 if len(rows) else 0):
        basis = np.linalg.qr(dense @ np.linalg.qr(dense.T @ basis)[0])[0]
    if len(rows):
        _, _, right = np.linalg.svd(basis.T @ dense, full_matrices=False)
        project = right[:rank].T.astype(np.float32)
    else:
        project = np.zeros((TERMS, 1), np.float32)
    return {"idf": idf, "project": project, "vectors": unit(dense @ project), "labels": labels, "prior": prior}


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0).astype(np.float32)


def vote(model: dict, vectors: np.ndarray, neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS) -> np.ndarray:
    """Scores of unit vectors; zero vectors get the prior. Votes count by cosine ** sharpness, not by their class's share of the sample."""
    known, labels = model["vectors"], model["labels"]
    scores = np.full(len(vectors), model["prior"])
    k = min(neighbours, len(known))
    rows = np.flatnonzero(np.abs(vectors).sum(axis=1) > 0)
    if not k or not len(rows):
        return scores
    for block in np.array_split(rows, max(1, len(rows) // 512)):
        cosines = vectors[block] @ known.T
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(cosines, near, axis=1), 1e-6).astype(np.float64) ** sharpness
        scores[block] = (weights * labels[near]).sum(axis=1) / weights.sum(axis=1)
    return np.clip(scores, 0.0, 1.0)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = list(term_counts(b.column("text").to_pylist()))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([y.tobytes() for _, y in found], pa.binary())],
            ["doc_id", "terms", "counts"],
        )


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rank: int = RANK, learn_from=None) -> dict:
    """Fit on the at most max_labelled labelled documents whose hashed id is smallest."""
    ship(docs.sparkSession)
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    if learn_from is not None:
        chosen = chosen.where(learn_from)
    chosen = chosen.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("quality"))
    sample = dict(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect())
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isin([int(k) for k in sample]) if sample else F.lit(False))
    rows = texts.mapInArrow(_terms, "doc_id long, terms binary, counts binary").collect()
    rows = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in rows)
    return fit([(np.frombuffer(t, np.int32), np.frombuffer(c, np.int32), sample[i]) for i, t, c in rows], rank)


def score(docs: DataFrame, model: dict, neighbours: int = NEIGHBOURS, column: str = "score") -> DataFrame:
    """docs with a score column beside its own; no shuffle."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = part.column("text").to_pylist()
                vectors = np.zeros((len(texts), m["project"].shape[1]), np.float32)
                for k, (ids, counts) in enumerate(term_counts(texts)):
                    if len(ids):
                        vectors[k] = weigh(ids, counts, m["idf"]).astype(np.float32) @ m["project"][ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vote(m, unit(vectors), neighbours))], [*part.schema.names, column])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{column}` double")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"), learn_from=~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go, those with a score below a half. Columns are kept, whatever their names."""
    model = learn(docs, table(spark, sf_dir, "labels"), learn_from=~held_out())
    names = docs.columns
    rest = F.struct(F.lit(0).alias("none"), *(docs[c].alias(f"c{k}") for k, c in enumerate(names) if c != "text"))  # no name can clash in there
    kept = score(docs.select(docs["text"].alias("text"), rest.alias("rest")), model).where("score >= 0.5")
    return kept.select(*(F.col("text") if c == "text" else F.col("rest").getField(f"c{k}").alias(c) for k, c in enumerate(names)))
