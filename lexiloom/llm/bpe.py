"""Byte-level BPE by speculation and verification, and decoding.

For the pre-tokens of a batch that were not seen before, a lock-step walk through a trie of the vocabulary proposes
the greedy longest match at every place.  A token sequence is the encoding of its bytes exactly if every two
neighbours are what merging gives for their joined bytes, so all adjacent pairs of all words are tested at once:
a pair fails if, on some boundary that merging goes through on the way to the two tokens, a merge across it would
have come first.  Words with a failing pair, and only they, are merged exactly.

Defined results: null and empty texts have no ids and decode to the empty text; the text of a special token inside
a text becomes its id, as the library's default is; repeated rows give repeated results; an empty table gives an
empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import prepare, spread, text_of
from lexiloom.llm.ragged import PairTable, merge_lowest

#: The pre-token pattern of byte-level BPE vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS, CACHE_CHARS = 250_000, 64
FAR = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself where printable, else one past 255."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Ids, merges and trie of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only special tokens that are matched as they stand are supported")
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        letters, vocab = byte_letters(), model["vocab"]
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.size = size
        self.bytes: list[bytes] = [b""] * size
        for name, i in vocab.items():
            if i not in self.specials.values():
                self.bytes[i] = bytes(letters[c] for c in name)
        for name, i in self.specials.items():
            self.bytes[i] = name.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        self.table = PairTable(left, right, rank, merged, size)
        self.byte_id = np.zeros(256, dtype=np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        # How merging makes each token: its two parts, and the rank of its last merge (-1 for single bytes).
        self.first, self.second = np.arange(size), np.arange(size)
        self.made = np.full(size, -1, dtype=np.int64)
        self.first[merged[::-1]], self.second[merged[::-1]], self.made[merged[::-1]] = left[::-1], right[::-1], rank[::-1]
        self._build_trie()
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}

    def _build_trie(self) -> None:
        """Edges (node, byte) -> node for the tokens that merging gives for their own bytes."""
        some = [i for i, b in enumerate(self.bytes) if b and i not in self.specials.values()]
        alone, n = merge_lowest(self.byte_id[np.frombuffer(b"".join(self.bytes[i] for i in some), dtype=np.uint8)], np.array([len(self.bytes[i]) for i in some]), self.table)
        one = alone[np.cumsum(n) - 1] == some
        edges: dict[int, int] = {}
        token = [-1]
        for i, good in zip(some, one & (n == 1), strict=True):
            if good:
                node = 0
                for b in self.bytes[i]:
                    key = node * 256 + b
                    node = edges.get(key, 0)
                    if not node:
                        edges[key] = node = len(token)
                        token.append(-1)
                token[node] = i
        self.token = np.array(token, dtype=np.int64)
        keys = np.array(sorted(edges), dtype=np.int64)
        self.edge_to = np.array([edges[k] for k in keys.tolist()], dtype=np.int64)
        # The children of a node are neighbours in `keys`; a table over the node and the byte modulo its fan-out
        # would be larger than the caches, a search is not.
        self.edge_keys = keys
        self.root = np.zeros(256, dtype=np.int64)
        self.root[keys[keys < 256]] = self.edge_to[: int((keys < 256).sum())]

    def propose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of each word: (word of each token, token), by word and place."""
        at, word = starts.copy(), np.arange(len(starts))
        out_word, out_token = [], []
        end = ends
        while len(at):
            node = self.root[data[at]]
            best, best_end = self.token[node], at + 1
            lane, pos, n_node = np.arange(len(at)), at + 1, node
            while True:
                more = pos < end[lane]
                lane, pos, n_node = lane[more], pos[more], n_node[more]
                if not len(lane):
                    break
                keys = n_node * 256 + data[pos]
                i = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
                same = self.edge_keys[i] == keys
                lane, pos, n_node = lane[same], pos[same] + 1, self.edge_to[i[same]]
                token = self.token[n_node]
                full = token >= 0
                best[lane[full]], best_end[lane[full]] = token[full], pos[full]
            out_word.append(word)
            out_token.append(best)
            stay = best_end < end
            at, word, end = best_end[stay], word[stay], end[stay]
        words, tokens = np.concatenate(out_word), np.concatenate(out_token)
        order = np.argsort(words, kind="stable")
        return words[order], tokens[order]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging keeps each pair of tokens apart when their bytes stand side by side.

        Undo, one by one and the latest first, the merges that made the two tokens; as long as neither was made,
        a merge of the two symbols at the boundary would have won if its rank comes before the merge undone last.
        """
        good = np.ones(len(left), dtype=bool)
        lane = np.arange(len(left))
        a, b = left.copy(), right.copy()
        limit = np.full(len(left), FAR)
        while len(lane):
            rank, _ = self.table.lookup(a, b)
            # A pair of equal rank starts further left if it is of the left token, further right otherwise, so a
            # boundary merge of the rank undone last wins over the right token alone: its limit is one higher.
            bad = rank < limit
            good[lane[bad]] = False
            undo_left = self.made[a] > self.made[b]
            over = bad | ((self.made[a] < 0) & (self.made[b] < 0))
            stay = ~over
            lane, a, b, undo_left = lane[stay], a[stay], b[stay], undo_left[stay]
            limit = np.where(undo_left, self.made[a], self.made[b] + 1)
            a, b = np.where(undo_left, self.second[a], a), np.where(undo_left, b, self.first[b])
        return good

    def _encode_words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(lengths)
        of, tokens = self.propose(data, ends - lengths, ends)
        beside = np.flatnonzero(of[:-1] == of[1:])
        fails = np.zeros(len(words), dtype=bool)
        fails[of[beside[~self.compatible(tokens[beside], tokens[beside + 1])]]] = True
        n = np.bincount(of, minlength=len(words))
        again = np.flatnonzero(fails)
        if len(again):
            inside = np.repeat(fails, lengths)
            exact, n_exact = merge_lowest(self.byte_id[data[inside]], lengths[again], self.table)
            tokens = np.concatenate((tokens[~fails[of]], exact))
            of = np.concatenate((of[~fails[of]], np.repeat(again, n_exact)))
            tokens = tokens[np.argsort(of, kind="stable")]
            n[again] = n_exact
        ids = tokens.astype("<u4").tobytes()
        to = (np.cumsum(n) * 4).tolist()
        return [ids[i:j] for i, j in zip([0, *to], to, strict=False)]

    def _pieces(self, text: str) -> list[str]:
        if self.special is None or not any(s in text for s in self.specials):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.pattern.findall(text[at : m.start()])
            out.append("\0special" + m[0])
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        if not known:
            known.update(("\0special" + s, i.to_bytes(4, "little")) for s, i in self.specials.items())
        parts = [self._pieces(t) for t in texts]
        new = list(dict.fromkeys(w for words in parts for w in words if w not in known))
        for i in range(0, len(new), 65536):
            some = new[i : i + 65536]
            known.update(zip(some, self._encode_words(some), strict=True))
        out = [b"".join(map(known.__getitem__, words)) for words in parts]
        for w in new:
            if len(w) > CACHE_CHARS:
                del known[w]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spread(docs.select(F.col(id_col), text_of(text_col).alias("text")))


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids`` (binary: little-endian unsigned 32-bit) of every row.  Narrow: no shuffle."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vocab.encode(batch.column(1).to_pylist()), type=pa.binary())], names=[id_col, "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and ``text`` of every row of ``encode``'s result."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([vocab.decode(x or b"") for x in batch.column(1).to_pylist()], type=pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256: encodes, decodes the ids and digests both, in one pass.

    The ids and texts of a batch stay in the worker, so only the digests go back through Arrow.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            ids = vocab.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], type=pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(vocab.decode(x).encode()).hexdigest() for x in ids])],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
