"""Byte-pair encoding and decoding of whole texts with a public vocabulary file.

The merges of a word run over a doubly linked list of symbols with a heap of
(rank, position) entries; an entry whose pair has changed meanwhile is stale and
skipped.  So a word of n bytes costs n log n, however long it is.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fieldglass.llm.common import texts

TOKENIZER = "byte_bpe_50k.json"
#: How byte-level vocabularies of this kind cut a text into words (fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words and characters a worker remembers; beyond that it starts anew.
REMEMBERED = 400_000
LONGEST_REMEMBERED = 48
#: Bytes of output gathered before a batch is handed on.
BATCH_BYTES = 16_000_000

_ID_BITS = 24
_ID_MASK = (1 << _ID_BITS) - 1


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves; the others get the characters from
    U+0100 on, in order.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {chr(b if b in printable else next(hidden)): b for b in range(256)}


class Tokenizer:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocabulary = data["model"]["vocab"]
        alphabet = byte_alphabet()
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.pieces: list[bytes] = [b""] * (max([*vocabulary.values(), *added.values()]) + 1)
        for token, number in vocabulary.items():
            self.pieces[number] = bytes(alphabet[c] for c in token)
        for token, number in added.items():
            self.pieces[number] = token.encode()
        self.first = [0] * 256
        for character, byte in alphabet.items():
            self.first[byte] = vocabulary[character]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            key = vocabulary[left] << _ID_BITS | vocabulary[right]
            self.merges[key] = rank << _ID_BITS | vocabulary[left + right]
        self.added = added
        self.split_added = regex.compile(f"({'|'.join(map(regex.escape, sorted(added, key=len, reverse=True)))})")
        self.words = regex.compile(WORDS).findall
        self.known: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        symbols = [self.first[b] for b in word]
        end = len(symbols)
        if end == 1:
            return symbols
        merges = self.merges
        find = merges.get
        before = list(range(-1, end - 1))
        after = list(range(1, end + 1))
        heap = []
        for i in range(end - 1):
            found = find(symbols[i] << _ID_BITS | symbols[i + 1])
            if found is not None:
                heap.append((found, i))
        heapq.heapify(heap)
        while heap:
            found, i = heapq.heappop(heap)
            j = after[i]
            if j == end or symbols[i] < 0 or find(symbols[i] << _ID_BITS | symbols[j]) != found:
                continue  # stale: the pair at i is gone
            new = symbols[i] = found & _ID_MASK
            symbols[j] = -1
            k = after[i] = after[j]
            after[j] = end
            if k < end:
                before[k] = i
                found = find(new << _ID_BITS | symbols[k])
                if found is not None:
                    heapq.heappush(heap, (found, i))
            h = before[i]
            if h >= 0:
                found = find(symbols[h] << _ID_BITS | new)
                if found is not None:
                    heapq.heappush(heap, (found, h))
        return [s for s in symbols if s >= 0]

    def remember(self, word: str) -> bytes:
        ids = np.array(self.merge(word.encode()), "<u4").tobytes()
        if len(word) <= LONGEST_REMEMBERED:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; no special tokens are added.

        The vocabulary's added tokens are taken whole where a text holds them.
        """
        known, out = self.known.get, []
        for part in self.split_added.split(text) if any(t in text for t in self.added) else (text,):
            if part in self.added:
                out.append(np.array([self.added[part]], "<u4").tobytes())
            elif part:
                out += [known(word) or self.remember(word) for word in self.words(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The vocabulary's strings one after the other; special tokens stay."""
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One per worker process and file; a bare name is one of the public files."""
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    return Tokenizer(path)


def encode_decode(
    docs: DataFrame, path: str = TOKENIZER, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Encode every whole text and decode its ids again, one row per row.

    Columns: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit),
    decoded (string).  Nothing is shuffled, so no key can be hot; a lost task is
    run again from the scan.  Null and empty texts have no ids and decode to "".
    Repeated rows and ids each give their own row; columns other than the two
    named are left out; an empty table gives an empty one.  ``path`` is a file or
    the name of a public one and must be readable on the executors.
    """
    schema = "doc_id bigint, n_tokens bigint, ids binary, decoded string"
    kind = dict(docs.dtypes)[id_column]
    schema = schema.replace("bigint", kind, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            numbers, start, size = batch.column(0), 0, 0
            ids: list[bytes] = []
            back: list[str] = []
            for i, text in enumerate(batch.column(1)):
                ids.append(coder.encode(text.as_py()))
                back.append(coder.decode(ids[-1]))
                size += 2 * len(ids[-1])
                if size >= BATCH_BYTES:
                    yield _batch(numbers[start:i + 1], ids, back)
                    ids, back, start, size = [], [], i + 1, 0
            if ids:
                yield _batch(numbers[start:], ids, back)

    return texts(docs, id_column, text_column).mapInArrow(run, schema)


def _batch(numbers: pa.Array, ids: list[bytes], back: list[str]) -> pa.RecordBatch:
    counts = pa.array([len(x) // 4 for x in ids], pa.int64())
    return pa.RecordBatch.from_arrays(
        [numbers, counts, pa.array(ids, pa.binary()), pa.array(back, pa.string())],
        names=["doc_id", "n_tokens", "ids", "decoded"],
    )
