"""Packing of token sequences: best fit, then a local search that swaps documents between underfull bins.

Documents are cut only if longer than a sequence.  Pieces are dealt to groups of
bounded size.  In each group bins are filled best fit, largest pieces first;
then moves, one-for-one and two-for-one exchanges between two underfull bins are
made as long as they raise the sum of squared fills, so that some bins fill up
and others empty.  Bins that stay underfull go on to the next round, where they
meet those of other groups, until one group is left or nothing is gained.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldglass.llm.common import landed, texts

CAPACITY = 2048
END_ID = 0
#: Pieces of one group (one task call).
GROUP_PIECES = 4096
#: Sweeps of the local search over a group's underfull bins.
SWEEPS = 60
#: Neighbourhood of the search: candidates looked at for each wanted size, pieces of a bin that are paired (the largest).
LOOKED_AT, PAIRED = 12, 32
#: Chunks between white space, and words, whose ids a worker remembers, up to this size; beyond that it starts anew.
REMEMBERED, REMEMBERED_BYTES = 600_000, 64


class WordIds(dict):
    """Ids of single words as the tokenizer's model gives them, remembered."""

    def __init__(self, model) -> None:
        super().__init__()
        self.model = model
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        #: Bytes as the letters that byte-level vocabularies write for them.
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}

    def __missing__(self, word: str) -> bytes:
        written = word.encode("utf-8").decode("latin-1").translate(self.letters)
        ids = [token.id for token in self.model.tokenize(written)]
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


class ChunkIds(dict):
    """Ids of the chunks between white space, as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and merges nothing across it, so a text's ids
    are those of its chunks.  Chunks of plain letters, digits and signs, for which
    the normaliser only lower-cases, are split by the tokenizer's own expression
    and looked up word by word; all others go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words = WordIds(self.tokenizer.model)
        steps = json.loads(self.tokenizer.to_str())
        splits = (steps["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        lowered = [n["type"] for n in (steps["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        split = [n.get("type") for n in splits] == ["Split", "ByteLevel"] and not splits[1]["use_regex"]
        self.pieces = regex.compile(splits[0]["pattern"]["Regex"]) if lowered and split else None
        # Composed and lower-cased character by character alike everywhere; special tokens hold "<|".
        self.plain = re.compile("[!-~\u00c0-\u012f\u0131-\u017f]+")

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8")
        if self.pieces is not None and self.plain.fullmatch(text) and "<|" not in text:
            low = text.lower()
            found = self.words[low] if low.isalpha() else b"".join([self.words[w] for w in self.pieces.findall(low)])
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            found = np.array(ids, "<u4").tobytes()
        if len(chunk) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = found
        return found

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))


@cache
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of rows of (doc_id, text): doc_id, piece, start, length, ids_crc32."""
    kind = dict(docs.dtypes)["doc_id"]
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunk_ids(tokenizer_path)
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1)):
                ids = known.of(text.as_py()) + end
                for start in range(0, len(ids), capacity * 4):
                    cut = ids[start:start + capacity * 4]
                    rows.append(row)
                    found.append((start // (capacity * 4), start // 4, len(cut) // 4, zlib.crc32(cut)))
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int32()),
                 *(pa.array(columns[i], pa.int64()) for i in (1, 2, 3))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Largest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect_left(gaps, (lengths[item], -1))
        if at < len(gaps):
            gap, number = gaps.pop(at)
        else:
            gap, number = capacity, len(bins)
            bins.append([])
        bins[number].append(item)
        if gap > lengths[item]:
            insort(gaps, (gap - lengths[item], number))
    return bins


class LocalSearch:
    """Exchanges between underfull bins that raise the sum of squared fills.

    A step brings the net amount d from bin b to a bin a that is at least as
    full: fills a and b become a + d and b - d, and the squares gain
    2d(a - b + d) > 0.  For each bin the step with the largest d that fits is
    taken; what the bin gives back is nothing, one or two of its pieces, what it
    gets one piece, or two for none or one.
    """

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int) -> None:
        self.lengths, self.bins, self.capacity = lengths, [b for b in bins if b], capacity
        self.fill = [sum(lengths[i] for i in b) for b in self.bins]

    def run(self, sweeps: int = SWEEPS) -> list[list[int]]:
        for _ in range(sweeps):
            if not self.sweep():
                break
        return [b for b in self.bins if b]

    def sweep(self) -> bool:
        """One pass over the underfull bins, fullest first; each bin changes at most once."""
        fill, bins, lengths = self.fill, self.bins, self.lengths
        below = sorted((k for k in range(len(bins)) if 0 < fill[k] < self.capacity), key=lambda k: (-fill[k], k))
        if len(below) < 2:
            return False
        place = {k: n for n, k in enumerate(below)}
        ones = sorted((lengths[i], place[k], (i,)) for k in below for i in bins[k])
        twos = sorted((size, place[k], pair) for k in below for size, pair in self._pairs(bins[k]))
        sizes = [np.array([x[0] for x in table], np.int64) for table in (ones, twos)]
        touched: set[int] = set()
        gained = False
        for n, k in enumerate(below):
            if n not in touched:
                step = self._best_step(n, bins[k], self.capacity - fill[k], (ones, twos), sizes, touched)
                if step:
                    self._apply(k, below[step[1]], step[2], step[3])
                    touched |= {n, step[1]}
                    gained = True
        return gained

    def _best_step(self, n: int, own: list[int], gap: int, tables, sizes, touched) -> tuple | None:
        """(amount, donor's place, pieces given, pieces taken) with the largest amount up to the gap."""
        lengths = self.lengths
        gives = [(0, ())] + [(lengths[i], (i,)) for i in own]
        best = None
        for table, size, options in ((tables[0], sizes[0], gives + self._pairs(own)), (tables[1], sizes[1], gives)):
            ends = np.searchsorted(size, np.array([g + gap for g, _ in options], np.int64), "right")
            for (given, out), end in zip(options, ends.tolist(), strict=True):
                for at in range(end - 1, max(-1, end - 1 - LOOKED_AT), -1):
                    amount = table[at][0] - given
                    if amount <= (best[0] if best else 0):
                        break
                    donor = table[at][1]
                    # Places count from the fullest bin: only bins after this one give.
                    if donor > n and donor not in touched:
                        best = (amount, donor, out, table[at][2])
                        break
                if best and best[0] == gap:
                    return best
        return best

    def _pairs(self, own: list[int]) -> list[tuple[int, tuple[int, int]]]:
        lengths = self.lengths
        largest = sorted(own, key=lambda i: (-lengths[i], i))[:PAIRED]
        return [(lengths[i] + lengths[j], (i, j)) for m, i in enumerate(largest) for j in largest[:m]]

    def _apply(self, a: int, b: int, out: tuple, taken: tuple) -> None:
        lengths = self.lengths
        amount = sum(lengths[i] for i in taken) - sum(lengths[i] for i in out)
        self.bins[a] = [i for i in self.bins[a] if i not in out] + list(taken)
        self.bins[b] = [i for i in self.bins[b] if i not in taken] + list(out)
        self.fill[a] += amount
        self.fill[b] -= amount


def _packed(capacity: int):
    """One group: rows of (uid, length, sequence_id, ...) get their sequence and offset; full says that a bin is full."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("uid").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        lengths = table.column("length").to_pylist()
        before = table.column("sequence_id").to_pylist()
        start: dict[int, list[int]] = {}
        for item, sequence in enumerate(before):
            if sequence is not None:
                start.setdefault(sequence, []).append(item)
        fresh = [i for i, sequence in enumerate(before) if sequence is None]
        bins = [[fresh[i] for i in b] for b in best_fit([lengths[i] for i in fresh], capacity)]
        bins = LocalSearch(lengths, list(start.values()) + bins, capacity).run()
        uids = table.column("uid").to_pylist()
        sequences, offsets, full = [0] * len(uids), [0] * len(uids), [False] * len(uids)
        for members in bins:
            at, total = 0, sum(lengths[i] for i in members)
            name = min(uids[i] for i in members)
            for i in sorted(members):
                sequences[i], offsets[i], full[i] = name, at, total == capacity
                at += lengths[i]
        for column, values, kind in (
            ("sequence_id", sequences, pa.int64()), ("offset", offsets, pa.int64()), ("full", full, pa.bool_())
        ):
            table = table.set_column(table.schema.get_field_index(column), column, pa.array(values, kind))
        return table.drop_columns(["group"])

    return run


def pack_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer_path: str | None = None,
    capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens, one row per piece.

    Columns: doc_id, piece, start (ids of the document before the piece), length,
    ids_crc32, sequence_id, offset (tokens of the sequence before the piece).  A
    document is its ids and then END_ID; only longer ones are cut.

    Null and empty texts are END_ID alone.  Every row is a document of its own, so
    repeated rows and rows without an id get their own places.  Other columns are
    left out.  An empty table gives no rows.
    """
    path = tokenizer_path or default_tokenizer()
    cut = pieces(texts(docs, id_column, text_column), path, capacity)
    cut = landed(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    cut = cut.withColumns({
        "sequence_id": F.when(F.col("length") == capacity, F.col("uid")),
        "offset": F.lit(0).cast("bigint"), "full": F.col("length") == capacity,
    })
    done, rest = [cut.where("full")], cut.where("not full")
    count, last = rest.count(), False
    schema = rest.schema
    while count:
        last = last or count <= group_pieces
        groups = -(-count // group_pieces)
        key = F.pmod(F.xxhash64(F.coalesce("sequence_id", "uid")), F.lit(groups))
        dealt = rest.withColumn("group", key)
        out = landed(dealt.groupBy("group").applyInArrow(_packed(capacity), schema), "packed")
        if last:
            done.append(out)
            break
        done.append(out.where("full"))
        rest = out.where("not full")
        left = rest.count()
        # Where few bins fill up, another deal would gain little: one more round, and its bins stay as they are.
        last, count = 2 * left > count, left
    packed = done[0]
    for part in done[1:]:
        packed = packed.unionByName(part)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
