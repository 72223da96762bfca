"""Token counts of documents, from pieces per distinct pre-token and pre-token frequencies.

A byte-level BPE first cuts a text into pre-tokens (a pattern) and then each
pre-token into pieces, independently of its neighbours. So a document's number of
tokens is the sum over its distinct pre-tokens of frequency times pieces, and no ids
of documents are ever made.

Each task takes its documents in blocks: the block's pre-tokens are numbered, each
distinct one that the task hasn't met is cut into pieces once, and the (document,
pre-token) frequencies are joined with these counts. Nothing is shuffled: a global
join would move a row for each document and distinct pre-token, several times the
input (see the README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffer

#: Fixed: the cutting pattern that byte-level BPE files with ``use_regex`` stand for.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points whose classes are the same in every Unicode version; other texts are cut by the tokenizer itself.
SETTLED = r"[\x00-ͯ‐-‧‰-⁞₠-€]*"
#: Pre-tokens whose counts a task keeps; beyond it they are forgotten and counted anew.
MEMO = 400_000


class PieceCounter:
    """Pieces per pre-token and tokens per text for one tokenizer file of the byte-level kind."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        cutter = kind["pre_tokenizer"] or {}
        plain = not kind["normalizer"] and cutter.get("type") == "ByteLevel" and cutter["use_regex"] and not cutter["add_prefix_space"]
        if not plain:
            raise ValueError(f"{path}: not a byte-level tokenizer without normalizer")
        for token in kind["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError(f"{path}: added token {token['content']} takes in its surroundings")
        self.special = {t["content"] for t in kind["added_tokens"]}
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(PRETOKENS)
        self.settled = regex.compile(SETTLED)
        self.memo: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text; an added token's string is one of them."""
        if self.at_special is not None and self.at_special.search(text):
            out: list[str] = []
            at = 0
            for m in self.at_special.finditer(text):
                out += self.cut(text[at:m.start()]) if m.start() > at else []
                out.append(m.group())
                at = m.end()
            return out + (self.cut(text[at:]) if at < len(text) else [])
        if self.settled.fullmatch(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, pretokens: list[str]) -> np.ndarray:
        """Number of pieces of each (distinct) pre-token."""
        memo = self.memo
        new = [p for p in pretokens if p not in memo]
        if new:
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = pretokens
            for at in range(0, len(new), 4096):
                part = new[at:at + 4096]
                memo.update(zip(part, (len(e) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        return np.fromiter(map(memo.__getitem__, pretokens), dtype=np.int64, count=len(pretokens))

    def tokens(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text: the block's (text, pre-token) frequencies joined with the pieces."""
        number: dict[str, int] = {}
        frequencies: list[np.ndarray] = []
        for text in texts:
            ids = np.fromiter((number.setdefault(p, len(number)) for p in self.cut(text)), dtype=np.int64)
            frequencies.append(np.stack(np.unique(ids, return_counts=True)))
        pieces = self.pieces(list(number))
        return np.fromiter((int(pieces[f[0]] @ f[1]) if f.size else 0 for f in frequencies), dtype=np.int64, count=len(texts))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row per input row.

    Null texts are empty: 0 bytes, 0 tokens. Null and repeated ids are kept as they
    are, an empty table gives no rows, other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(tokenizer_path)
        for part in slices(batches):
            _, offsets = text_buffer(part.column("text"))
            texts = [t or "" for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(counter.tokens(texts), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
