"""Byte-level BPE encoding and decoding of whole corpora with a public vocabulary."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the public vocabularies.
TOKENIZERS = "/opt/tokenizers"
#: Words whose ids a worker remembers at most; the memory is emptied when it is full.
REMEMBERED = 300_000
# Fixed value: how this vocabulary's texts are cut into words before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBPE:
    """Ranks of byte strings, the lower the earlier they are merged; a string's rank is its id."""

    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.strings = {r: s for s, r in self.ranks.items()}
        self.words = regex.compile(WORDS)
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: a heap of merge ranks over a doubly linked list of symbols, stale entries being skipped."""
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return [whole]
        n = len(word)
        symbols: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or len(left) + len(symbols[j]) != size:
                continue
            symbols[i] = left = left + symbols[j]
            symbols[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(left + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, len(left) + len(symbols[k])))
            h = before[i]
            if h >= 0 and (r := ranks.get(symbols[h] + left)) is not None:
                heapq.heappush(heap, (r, h, len(symbols[h]) + len(left)))
        return [ranks[s] for s in symbols if s is not None]

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        known = self.known
        for word in self.words.findall(text or ""):
            got = known.get(word)
            if got is None:
                got = tuple(self.merge(word.encode("utf-8", "surrogatepass")))
                if len(word) < 200:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = got
            ids.extend(got)
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


def vocabulary(path: str | None = None) -> bytes:
    return Path(path or f"{TOKENIZERS}/byte_bpe_50k.tiktoken").read_bytes()


_loaded: dict[int, ByteBPE] = {}


def loaded(data: bytes) -> ByteBPE:
    """The tokenizer of a vocabulary, once per worker."""
    if (key := hash(data)) not in _loaded:
        _loaded[key] = ByteBPE(data)
    return _loaded[key]


def encode_texts(texts: DataFrame, path: str | None = None) -> DataFrame:
    """texts: doc_id and text (other columns are not read). Returns doc_id and ids, without special tokens.

    One row per row of texts. A null or empty text gives an empty list; strings that look like special tokens are
    ordinary text. Texts are encoded whole; the vocabulary (under 1 MB) is broadcast, nothing is shuffled.
    """
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = dict(texts.dtypes)["doc_id"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        for batch in batches:
            column = batch.column("text")
            for start in range(0, batch.num_rows, 2000):
                part = column.slice(start, 2000)
                lists = [np.array(bpe.encode(t), dtype=np.int32) for t in part.to_pylist()]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, 2000), ids], ["doc_id", "ids"])

    return texts.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids array<int>")


def token_counts(texts: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of each row of texts; as encode_texts, without keeping the ids."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = dict(texts.dtypes)["doc_id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        for batch in batches:
            sizes = pa.array([len(bpe.encode(t)) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes], ["doc_id", "n_tokens"])

    return texts.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_tokens long")
