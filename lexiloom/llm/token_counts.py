"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch that were not counted before are held as one ragged numpy array of symbols.  In each
round every sequence applies its lowest-rank pair, all sequences at once; the symbols that survive are counted.
A document's count is the sum over its pre-tokens.

The model is a sentencepiece BPE file.  No piece of such a model holds the blank mark after another character
(checked when it is loaded), so a pre-token - a run of marks and the word that follows - never merges with the next.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated results; an empty
table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import prepare, spread, text_of
from lexiloom.llm.ragged import PairTable, merge_lowest

MARK = "▁"
#: Pre-tokens remembered by a Python worker, and the longest that is.
CACHE_WORDS, CACHE_CHARS = 300_000, 64


class PieceCounter:
    """Counts tokens as sentencepiece does, without begin and end tokens."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only BPE models with the identity normalisation that keeps blanks are supported")
        kinds = {p.type for p in model.pieces}
        if kinds & {4, 5}:
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.prefix = norm.add_dummy_prefix
        self.byte_fallback = model.trainer_spec.byte_fallback
        scores = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("a piece holds a blank after another character")
        names = list(scores) + sorted({c for p in scores for c in p} - set(scores))
        ids = {p: i for i, p in enumerate(names)}
        # Symbols past the named ones stand for characters of 1 to 4 bytes that no piece holds.
        size = len(names) + 5
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rows = [(ids[p[:i]], ids[p[i:]], ranks[s], ids[p]) for p, s in scores.items() for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids]
        left, right, rank, merged = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
        self.table = PairTable(left, right, rank, merged, size)
        n_bytes = np.array([1 if p in scores else len(p.encode()) for p in names] + [1, 1, 2, 3, 4])
        self.cost = n_bytes if self.byte_fallback else np.ones_like(n_bytes)
        points = np.arange(0x110000)
        self.symbol = (len(names) + 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int32)
        for name, i in ids.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        blanks = {len(p): s for p, s in scores.items() if not p.strip(MARK)}
        longest = max(blanks, default=1)
        rest = [s for p, s in scores.items() if len(p) > 1 and p.strip(MARK)]
        runs = [s for n, s in blanks.items() if n > 1]
        # Equal scores below all others: marks then merge strictly from the left, so if the first piece that comes
        # out is the longest, a long run is a row of these; its front need not be merged symbol by symbol.
        self.block = 0
        if longest > 1 and len(set(runs)) == 1 and runs[0] < min(rest, default=0):
            marks, _ = merge_lowest(np.full(4 * longest, ids[MARK]), np.array([4 * longest]), self.table)
            self.block = longest if [names[i] for i in marks] == [MARK * longest] * 4 else 0
        self.long_run = re.compile(f"{MARK}{{{3 * longest},}}") if self.block else None
        self.pretoken = re.compile(f"{MARK}+[^{MARK}]*|^[^{MARK}]+")
        self.known: dict[str, int] = {}

    def _split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, each without its first mark, and the tokens that are counted already."""
        text = text.replace(" ", MARK)
        text = (MARK if self.prefix or text.startswith(MARK) else "") + (text if self.prefix else text.removeprefix(MARK))
        extra = 0
        if self.long_run is not None and MARK * (3 * self.block) in text:

            def shorter(m: re.Match) -> str:
                nonlocal extra
                n = (len(m[0]) - 2 * self.block) // self.block
                extra += n
                return m[0][n * self.block :]

            text = self.long_run.sub(shorter, text)
        if not text.startswith(MARK):
            first, *words = self.pretoken.findall(text)
            return ["\0" + first, *(w[1:] for w in words)], extra
        if MARK + MARK in text:
            return [w[1:] for w in self.pretoken.findall(text)], extra
        return text[1:].split(MARK), extra

    def _merge(self, words: list[str]) -> np.ndarray:
        text = [w[1:] if w.startswith("\0") and not self.prefix else MARK + w for w in words]
        lengths = np.fromiter(map(len, text), dtype=np.int64, count=len(text))
        points = np.frombuffer("".join(text).encode("utf-32-le"), dtype=np.uint32)
        left, n = merge_lowest(self.symbol[points], lengths, self.table)
        total = np.concatenate(([0], np.cumsum(self.cost[left])))
        ends = np.cumsum(n)
        return total[ends] - total[ends - n]

    def counts(self, texts: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        parts = [self._split(t) if t else ([], 0) for t in texts]
        fresh: dict[str, int] = {}
        for words, _ in parts:
            for w in words:
                if w not in known:
                    fresh[w] = 0
        new = list(fresh)
        for i in range(0, len(new), 65536):
            some = new[i : i + 65536]
            fresh.update(zip(some, self._merge(some).tolist(), strict=True))
        got = known | fresh if len(fresh) > len(known) else known
        if got is known:
            known.update(fresh)
        out = [sum(map(got.__getitem__, words)) + extra for words, extra in parts]
        if got is not known:
            known.update((w, n) for w, n in fresh.items() if len(w) <= CACHE_CHARS)
        else:
            for w in new:
                if len(w) > CACHE_CHARS:
                    del known[w]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) for every row of ``docs``.

    Narrow: no shuffle; each task holds one bounded Arrow batch and a bounded memory of pre-tokens.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(model.counts(texts), type=pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), text_of(text_col).alias("text"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"))
    out = spread(rows).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
