"""Quality by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled documents gives a term matrix (hashed words, word shapes
and marks of repetition, TF-IDF), whose truncated singular value decomposition gives the
latent space. The sample's unit vectors and labels are broadcast (their size is bounded
by the sample's). Every document is folded into the space, its cosines with all labelled
vectors are computed exactly, block by block, and its nearest labelled neighbours vote
with their similarity as weight.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .labelled import fitted, held_out, labelled_sample

#: Labelled documents per label that the space is fitted on and that vote.
SAMPLE = 2500
#: Hashed terms, dimensions of the space, neighbours that vote.
TERMS, DIMENSIONS, NEIGHBOURS = 4096, 32, 25
#: Words whose vectors a task keeps.
MEMO = 200_000
BLOCK = 512

_CLASSES = str.maketrans({**{c: "A" for c in map(chr, range(65, 91))}, **{c: "a" for c in map(chr, range(97, 123))}, **{c: "0" for c in "0123456789"}})
_RUN = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """The word's character classes, runs as one: 'Foo!!' is 'Aa!'+."""
    s = word[:40].translate(_CLASSES)
    if not s.isascii():
        s = "".join(c if c.isascii() else "A" if c.isupper() else "a" for c in s)
    return _RUN.sub(r"\1+", s)[:12]


def word_terms(word: str) -> tuple[int, int]:
    """Numbers of a word's two terms: itself (lower half of the table) and its shape (upper half)."""
    half = TERMS // 2
    return zlib.crc32(word.lower().strip(".,;:!?").encode()) % half, half + 8 + zlib.crc32(shape(word).encode()) % (half - 8)


#: Terms of their own: a word that equals the one before it, and a word of a repeated line.
AGAIN, OLD_LINE = TERMS // 2, TERMS // 2 + 1


def repetition(text: str, words: list[str]) -> tuple[int, int]:
    again = sum(map(str.__eq__, words, words[1:]))
    seen: set[str] = set()
    old = 0
    for line in text.split("\n") if "\n" in text else ():
        if line in seen:
            old += len(line.split())
        elif line:
            seen.add(line)
    return again, old


def term_counts(text: str) -> np.ndarray:
    words = text.split()
    counts = np.zeros(TERMS, dtype=np.float32)
    for w in words:
        for t in word_terms(w):
            counts[t] += 1
    again, old = repetition(text, words)
    counts[AGAIN], counts[OLD_LINE] = again, old
    return counts


def fit_space(texts: list[str], labels: list[int]) -> dict:
    """{'fold': TERMS x DIMENSIONS, 'vectors': unit vectors, 'labels', 'prior'} of labelled texts."""
    if not texts:
        return {"fold": np.zeros((TERMS, DIMENSIONS), np.float32), "vectors": np.zeros((0, DIMENSIONS), np.float32), "labels": np.zeros(0, np.float32), "prior": 0.5}
    counts = np.stack([term_counts(t) for t in texts])
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    idf = np.log((1 + len(texts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    a = share * idf
    rng = np.random.default_rng(0)
    q = a.T @ (a @ rng.standard_normal((TERMS, DIMENSIONS + 8)).astype(np.float32))
    for _ in range(3):  # randomised singular value decomposition
        q, _ = np.linalg.qr(a.T @ (a @ q))
    _, sizes, right = np.linalg.svd(a @ q, full_matrices=False)
    directions = (q @ right.T)[:, :DIMENSIONS]
    fold = (idf[:, None] * directions / np.sqrt(np.maximum(sizes[:DIMENSIONS], 1e-6))).astype(np.float32)
    vectors = unit(share @ fold)
    return {"fold": fold, "vectors": vectors, "labels": np.asarray(labels, dtype=np.float32), "prior": float(np.mean(labels))}


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def votes(queries: np.ndarray, model: dict, base: float, k: int = NEIGHBOURS) -> np.ndarray:
    """Score of each unit query: its k nearest labelled vectors vote, weighted by similarity.

    The sample holds the labels in equal parts; votes are weighed back to the share
    ``base`` of label 1. A zero vector (no words) gets ``base``.
    """
    out = np.full(len(queries), base)
    if not len(model["labels"]):
        return out
    weight_of = np.where(model["labels"] == 1, base / max(model["prior"], 1e-9), (1 - base) / max(1 - model["prior"], 1e-9))
    k = min(k, len(model["labels"]))
    for at in range(0, len(queries), BLOCK):
        block = queries[at:at + BLOCK]
        cosines = block @ model["vectors"].T
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cosines, near, axis=1), 0) ** 4 * weight_of[near]
        total = w.sum(axis=1)
        some = (total > 1e-9) & (np.abs(block).sum(axis=1) > 0)
        out[at:at + BLOCK][some] = (w * model["labels"][near]).sum(axis=1)[some] / total[some]
    return np.clip(out, 0, 1)


class Folder:
    """Documents as unit vectors of the space; vectors of words are kept up to MEMO words."""

    def __init__(self, fold: np.ndarray):
        self.fold = fold
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((MEMO, fold.shape[1]), dtype=np.float32)

    def numbers(self, words: list[str]) -> list[int]:
        memo = self.memo
        try:
            return [memo[w] for w in words]
        except KeyError:
            new = list(dict.fromkeys(w for w in words if w not in memo))
            if len(memo) + len(new) > len(self.rows):
                memo.clear()
                new = list(dict.fromkeys(words))
                if len(new) > len(self.rows):
                    self.rows = np.zeros((len(new), self.fold.shape[1]), dtype=np.float32)
            terms = np.asarray([word_terms(w) for w in new])
            first = len(memo)
            self.rows[first:first + len(new)] = self.fold[terms[:, 0]] + self.fold[terms[:, 1]]
            memo.update(zip(new, range(first, first + len(new))))
            return [memo[w] for w in words]

    def vectors(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.fold.shape[1]), dtype=np.float32)
        for i, text in enumerate(texts):
            words = text.split()
            if words:
                again, old = repetition(text, words)
                out[i] = self.rows[self.numbers(words)].sum(axis=0) + again * self.fold[AGAIN] + old * self.fold[OLD_LINE]
        return unit(out)


def _model(docs: DataFrame, labels: DataFrame, label: str, sample: int):
    """(space and votes as a broadcast, base rate of label 1) from labels that aren't held out."""
    model = fitted(labelled_sample(docs, labels, label, sample), fit_space)
    counted = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg(label).alias("b")).first()
    return docs.sparkSession.sparkContext.broadcast(model), 0.5 if counted["b"] is None else float(counted["b"])


def _scores(part: pa.RecordBatch, folder: Folder, model: dict, base: float) -> np.ndarray:
    return votes(folder.vectors([t or "" for t in part.column("text").to_pylist()]), model, base)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better), predicted (score >= threshold), one row per input row.

    Only labels that aren't held out are learned from, of at most ``sample`` documents per
    label. Null and empty texts get the labels' base rate, as does every text where there
    are no labels (0.5 then); null ids are kept and not held out; repeated rows score
    alike; no rows give no rows; other columns are never read.
    """
    sent, base = _model(docs, labels, label, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(sent.value["fold"])
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_scores(part, folder, sent.value, base), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(score, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE, label: str = "quality") -> DataFrame:
    """The documents (all columns) that score ``threshold`` or more; see ``quality_scores``.

    Without a labelled document that isn't held out nothing rejects, and all are kept. Else
    null and empty texts stay if the labels' base rate is ``threshold`` or more.
    """
    sent, base = _model(docs, labels, label, sample)
    if not len(sent.value["labels"]):
        return docs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(sent.value["fold"])
        for part in slices(batches):
            yield part.filter(pa.array(_scores(part, folder, sent.value, base) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
