"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Inputs are words, each with a word part (a learned vector of its hash, and the log odds
of its hash among the sample's labels) and a character part (the mean of learned vectors
of its character n-grams, and the greatest and mean log odds of these). A gated
recurrent unit reads a window of words in each direction, attention pools the states,
and a logistic output scores the window. A document's score is its highest window's.

The network is trained in numpy, by back-propagation through time with Adam, on a
bounded sample of labelled documents (a document learns by its highest window). All
words of all documents are scored, in overlapping windows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .labelled import fitted, held_out, labelled_sample

#: Labelled documents per label that the network is trained on.
SAMPLE = 1500
#: Words of a window, words from one window to the next.
WINDOW, STRIDE = 64, 48
#: Hash buckets of words and n-grams, learned dimensions of each, state size per direction.
BUCKETS, EMBED, HIDDEN, ATTENTION = 1 << 14, 4, 8, 8
INPUTS = 2 * EMBED + 4
#: Sample documents that a log odds of 0 is worth.
SMOOTH = 4.0
EPOCHS, BATCH, RATE = 5, 48, 0.01
MEMO = 200_000
WORD = re.compile(r"\w+")


def word_bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


_FACTORS = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


class Grams:
    """Buckets of the character n-grams of 3 to 5 of some words, borders marked.

    ``buckets`` and ``valid`` have a row per length and a column per place of a word where a
    3-gram starts; ``first`` is each word's first column, ``word`` each column's word.
    """

    def __init__(self, words: list[str]):
        letters = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        sizes = np.asarray([len(w) + 2 for w in words], dtype=np.int64)
        ends = np.cumsum(sizes)
        self.first = np.concatenate(([0], np.cumsum(sizes - 2)[:-1]))
        self.word = np.repeat(np.arange(len(words)), sizes - 2)
        at = np.arange(len(self.word)) + np.repeat(ends - sizes - self.first, sizes - 2)
        letters = np.concatenate((letters, np.zeros(2, np.uint64)))
        h = letters[at] * _FACTORS[0] + letters[at + 1] * _FACTORS[1] + letters[at + 2] * _FACTORS[2]
        rows = [h]
        for n in (3, 4):
            h = h + letters[at + n] * _FACTORS[n] + np.uint64(n)
            rows.append(h)
        h = np.stack(rows)
        self.buckets = (((h ^ (h >> np.uint64(29))) * _FACTORS[0]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
        left = ends[self.word] - at
        self.valid = np.stack([left >= 3, left >= 4, left >= 5])
        self.count = np.add.reduceat(self.valid.sum(axis=0), self.first)


def window_starts(n: int) -> list[int]:
    """Starts of the overlapping windows over n words; the last ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The network's parameters, its inputs per word, forward and backward passes."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        small = lambda *s: (rng.standard_normal(s) * 0.3 / np.sqrt(s[0])).astype(np.float32)
        #: Added to logits: from the share of label 1 in training to its share among the labels.
        self.shift = 0.0
        self.share: float | None = None
        self.word_odds = np.zeros(BUCKETS, np.float32)
        self.gram_odds = np.zeros(BUCKETS, np.float32)
        self.p = {"words": (rng.standard_normal((BUCKETS, EMBED)) * 0.05).astype(np.float32), "grams": (rng.standard_normal((BUCKETS, EMBED)) * 0.05).astype(np.float32),
                  "att": small(2 * HIDDEN, ATTENTION), "att_v": small(ATTENTION), "out": small(2 * HIDDEN), "out_b": np.zeros(1, np.float32)}
        for d in ("f", "b"):
            self.p |= {f"x_{d}": small(INPUTS, 3 * HIDDEN), f"u_{d}": small(HIDDEN, 2 * HIDDEN), f"c_{d}": small(HIDDEN, HIDDEN), f"bias_{d}": np.zeros(3 * HIDDEN, np.float32)}

    def features(self, words: list[str]) -> np.ndarray:
        """Input vectors of (distinct) words."""
        grams = Grams(words)
        odds = np.where(grams.valid, self.gram_odds[grams.buckets], np.float32(-9))
        at = np.asarray([word_bucket(w) for w in words], dtype=np.int64)
        x = np.empty((len(words), INPUTS), np.float32)
        x[:, 0] = self.word_odds[at]
        x[:, 1] = np.maximum.reduceat(odds.max(axis=0), grams.first)
        x[:, 2] = np.add.reduceat(np.where(grams.valid, odds, 0).sum(axis=0), grams.first) / grams.count
        x[:, 3] = np.minimum(grams.count, 60) / 60
        x[:, 4:4 + EMBED] = self.p["words"][at]
        learned = (self.p["grams"][grams.buckets] * grams.valid[:, :, None]).sum(axis=0)
        x[:, 4 + EMBED:] = np.add.reduceat(learned, grams.first) / grams.count[:, None]
        return x

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Both directions' input gates of input vectors: computed once per distinct word."""
        return np.concatenate([x @ self.p[f"x_{d}"] + self.p[f"bias_{d}"] for d in ("f", "b")], axis=1).astype(np.float32)

    def forward(self, gates: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logits of windows from their input gates (windows, words, 6 x HIDDEN); mask: 0 behind a window's end."""
        at = {"f": 0, "b": 3 * HIDDEN}
        return self.run(lambda d, s: gates[:, s, at[d]:at[d] + 3 * HIDDEN], *gates.shape[:2], mask, keep)

    def run(self, gates, n: int, t: int, mask: np.ndarray | None, keep: bool = False):
        """Logits of n windows of t words; ``gates(direction, step)`` gives the input gates (n, 3 x HIDDEN) of a step."""
        states = np.empty((t, n, 2 * HIDDEN), np.float32)
        trace: dict = {"f": [None] * t, "b": [None] * t}
        for d, steps in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            h = np.zeros((n, HIDDEN), np.float32)
            u, c = self.p[f"u_{d}"], self.p[f"c_{d}"]
            at = 0 if d == "f" else HIDDEN
            for s in steps:
                g = gates(d, s)
                zr = h @ u
                zr += g[:, :2 * HIDDEN]
                zr *= 0.5
                np.tanh(zr, out=zr)  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
                zr *= 0.5
                zr += 0.5
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = (r * h) @ c
                new += g[:, 2 * HIDDEN:]
                np.tanh(new, out=new)
                out = new - h
                out *= z
                out += h
                if mask is not None:
                    out *= mask[:, s, None]
                if keep:
                    trace[d][s] = (h, z, r, new)
                h = out
                states[s, :, at:at + HIDDEN] = h
        a = states.reshape(t * n, 2 * HIDDEN) @ self.p["att"]
        np.tanh(a, out=a)
        e = (a @ self.p["att_v"]).reshape(t, n)
        if mask is not None:
            e = np.where(mask.T > 0, e, -30)
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", w, states)
        logits = pooled @ self.p["out"] + self.p["out_b"][0]
        return (logits, (states, trace, a.reshape(t, n, -1), w, pooled)) if keep else logits

    def backward(self, gates: np.ndarray, mask: np.ndarray | None, kept, d_logits: np.ndarray) -> tuple[dict, np.ndarray]:
        """(gradients of the recurrent part, gradient of the input gates)."""
        states, trace, a, w, pooled = kept
        n, t, _ = gates.shape
        grad = {"out": pooled.T @ d_logits, "out_b": np.asarray([d_logits.sum()])}
        d_pooled = d_logits[:, None] * self.p["out"]
        d_states = w[:, :, None] * d_pooled
        d_w = np.einsum("tnh,nh->tn", states, d_pooled)
        d_e = w * (d_w - (w * d_w).sum(axis=0))
        grad["att_v"] = np.einsum("tna,tn->a", a, d_e)
        d_a = d_e[:, :, None] * self.p["att_v"] * (1 - a * a)
        grad["att"] = np.einsum("tnh,tna->ha", states, d_a)
        d_states = d_states + d_a @ self.p["att"].T
        d_gates = np.zeros_like(gates)
        for d, steps in (("f", range(t - 1, -1, -1)), ("b", range(t))):
            u, c = self.p[f"u_{d}"], self.p[f"c_{d}"]
            at = 0 if d == "f" else HIDDEN
            d_u, d_c = np.zeros_like(u), np.zeros_like(c)
            d_h = np.zeros((n, HIDDEN), np.float32)
            for s in steps:
                h, z, r, new = trace[d][s]
                d_out = d_h + d_states[s, :, at:at + HIDDEN]
                if mask is not None:
                    d_out = d_out * mask[:, s, None]
                d_new = d_out * z * (1 - new * new)
                d_rh = d_new @ c.T
                d_z = d_out * (new - h) * z * (1 - z)
                d_r = d_rh * h * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], axis=1)
                d_u += h.T @ d_zr
                d_c += (r * h).T @ d_new
                d_h = d_out * (1 - z) + d_rh * r + d_zr @ u.T
                d_gates[:, s, 3 * at:3 * at + 2 * HIDDEN] = d_zr
                d_gates[:, s, 3 * at + 2 * HIDDEN:3 * at + 3 * HIDDEN] = d_new
            grad |= {f"u_{d}": d_u, f"c_{d}": d_c, f"bias_{d}": d_gates[:, :, 3 * at:3 * at + 3 * HIDDEN].sum(axis=(0, 1))}
        return grad, d_gates


def log_odds(members: list[set[int]], labels: np.ndarray) -> np.ndarray:
    """Smoothed log odds of label 1 against 0 among the documents that have a bucket."""
    counts = np.zeros((2, BUCKETS))
    for m, y in zip(members, labels):
        counts[int(y), list(m)] += 1
    share = np.maximum(np.bincount(labels, minlength=2), 1)
    ratio = share[0] / share[1]
    return np.clip(np.log((counts[1] * ratio + SMOOTH) / (counts[0] + SMOOTH)), -4, 4).astype(np.float32)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 0) -> Network:
    """A network trained on labelled texts; without both labels it answers their base rate."""
    net = Network(seed)
    y = np.asarray(labels, dtype=np.int64)
    docs = [WORD.findall(t.lower()) for t in texts]
    if len(set(labels)) < 2:
        net.p["out"][:] = 0
        net.p["out_b"][:] = 0 if not labels else (4 if y[0] else -4)
        return net
    net.share = float(y.mean())
    net.word_odds = log_odds([{word_bucket(w) for w in set(d)} for d in docs], y)
    net.gram_odds = log_odds([set((g := Grams(list(set(d)))).buckets[g.valid].tolist()) if d else set() for d in docs], y)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            batch = [int(i) for i in order[at:at + BATCH] if docs[i]]
            if not batch:
                continue
            vocabulary: dict[str, int] = {}
            windows, owner = [], []
            for j, i in enumerate(batch):
                ids = [vocabulary.setdefault(w, len(vocabulary)) for w in docs[i]]
                for s in window_starts(len(ids)):
                    windows.append(ids[s:s + WINDOW])
                    owner.append(j)
            owner = np.asarray(owner)
            words = list(vocabulary)
            x = net.features(words)
            table = net.gates(x)
            mask = np.asarray([[1.0] * len(w) + [0.0] * (WINDOW - len(w)) for w in windows], dtype=np.float32)
            ids = np.asarray([w + [0] * (WINDOW - len(w)) for w in windows])
            logits = np.concatenate([net.forward(table[ids[k:k + 1024]], mask[k:k + 1024]) for k in range(0, len(ids), 1024)])
            best = np.asarray([np.flatnonzero(owner == j)[np.argmax(logits[owner == j])] for j in range(len(batch))])
            ids, mask = ids[best], mask[best]
            gates = table[ids]
            logits, kept = net.forward(gates, mask, keep=True)
            error = (sigmoid(logits) - y[batch]).astype(np.float32) / len(batch)
            grad, d_gates = net.backward(gates, mask, kept, error)
            per_word = np.zeros((len(words), 6 * HIDDEN), np.float32)
            np.add.at(per_word, ids.ravel(), d_gates.reshape(-1, 6 * HIDDEN) * mask.reshape(-1, 1))
            d_x = np.zeros_like(x)
            for k, d in enumerate(("f", "b")):
                own = per_word[:, 3 * HIDDEN * k:3 * HIDDEN * (k + 1)]
                grad[f"x_{d}"] = x.T @ own
                d_x += own @ net.p[f"x_{d}"].T
            grad["words"], grad["grams"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["grams"])
            np.add.at(grad["words"], [word_bucket(w) for w in words], d_x[:, 4:4 + EMBED])
            grams = Grams(words)
            share = (d_x[:, 4 + EMBED:] / grams.count[:, None])[grams.word]
            for row, valid in zip(grams.buckets, grams.valid):
                for k in range(EMBED):
                    grad["grams"][:, k] += np.bincount(row[valid], weights=share[valid, k], minlength=BUCKETS)
            step += 1
            for k, g in grad.items():  # Adam
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net.p[k] = (net.p[k] - RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    """Scores of texts; input gates of words are kept up to MEMO words."""

    def __init__(self, net: Network):
        self.net = net
        self.memo: dict[str, int] = {}
        self.room(MEMO)

    def room(self, n: int) -> None:
        self.table = {d: np.zeros((n, 3 * HIDDEN), np.float32) for d in ("f", "b")}

    def numbers(self, docs: list[list[str]]) -> list[np.ndarray]:
        memo = self.memo
        new = list(dict.fromkeys([w for d in docs for w in d if w not in memo]))
        if len(memo) + len(new) > len(self.table["f"]):
            memo.clear()
            new = list(dict.fromkeys([w for d in docs for w in d]))
            if len(new) > len(self.table["f"]):
                self.room(len(new))
        for at in range(0, len(new), 8192):
            part = new[at:at + 8192]
            first = len(memo)
            gates = self.net.gates(self.net.features(part))
            self.table["f"][first:first + len(part)], self.table["b"][first:first + len(part)] = gates[:, :3 * HIDDEN], gates[:, 3 * HIDDEN:]
            memo.update(zip(part, range(first, first + len(part))))
        return [np.fromiter(map(memo.__getitem__, d), dtype=np.int64, count=len(d)) for d in docs]

    def scores(self, texts: list[str]) -> np.ndarray:
        docs = self.numbers([WORD.findall(t.lower()) for t in texts])
        windows, owner, sizes = [], [], []
        for i, ids in enumerate(docs):
            for s in window_starts(len(ids)) if len(ids) else ():
                windows.append(ids[s:s + WINDOW])
                owner.append(i)
                sizes.append(len(windows[-1]))
        out = np.full(len(texts), -np.inf, np.float32)
        owner, sizes = np.asarray(owner, dtype=np.int64), np.asarray(sizes, dtype=np.int64)
        for full in (True, False):
            some = np.flatnonzero((sizes == WINDOW) == full)
            for at in range(0, len(some), 1024):
                part = some[at:at + 1024]
                if full:
                    ids, mask = np.stack([windows[k] for k in part]), None
                else:
                    longest = int(sizes[part].max())
                    ids = np.zeros((len(part), longest), dtype=np.int64)
                    mask = (np.arange(longest) < sizes[part][:, None]).astype(np.float32)
                    for j, k in enumerate(part):
                        ids[j, :sizes[k]] = windows[k]
                by_step = np.ascontiguousarray(ids.T)
                logits = self.net.run(lambda d, s: self.table[d][by_step[s]], *ids.shape, mask)  # noqa: B023
                np.maximum.at(out, owner[part], logits)
        return np.where(np.isfinite(out), sigmoid(out + self.net.shift), 0.0)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, label: str = "toxic", epochs: int = EPOCHS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: more toxic), predicted (score >= threshold), one row per input row.

    Only labels that aren't held out are learned from, of at most ``sample`` documents per
    label. Texts without words, and null ones, score 0; without any labels every text with words
    scores 0.5, with one kind of label near that label. Null ids are kept and not held out;
    repeated rows score alike; no rows give no rows; other columns are never read.
    """
    net = fitted(labelled_sample(docs, labels, label, sample), lambda texts, marks: train(texts, marks, epochs))
    usable = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    base = usable.agg(F.avg(label).alias("b")).first()["b"]
    if base is not None and 0 < base < 1 and net.share is not None:
        net.shift = math.log(base / (1 - base)) - math.log(net.share / (1 - net.share))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for part in slices(batches):
            scores = scorer.scores([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores.astype(np.float64))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(score, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
