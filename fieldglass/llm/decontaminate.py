"""Benchmark decontamination: multi-pattern search over words after Wu and Manber.

Patterns are the windows of ten consecutive words of the test items.  A table
over blocks of two words says how far the search may jump; a block that ends a
pattern opens a bucket of patterns with that suffix, which are compared word by
word.  On ordinary text the search looks at about every ninth word.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldglass.llm.common import DOCUMENT_COLUMNS, texts

WINDOW = 10
BLOCK = 2
#: Benchmark bytes that one pass over the documents searches for; larger sets take more passes.
PASS_BYTES = 32_000_000

#: A-Z become a-z; all other ASCII but digits and a-z ends a word; UTF-8 of other characters stays.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_NORMAL).split()


class Matcher:
    """Shift and suffix tables of patterns of one length, at least one word."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[int]], length: int) -> None:
        self.length = length
        self.block = min(BLOCK, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], set[int]]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.buckets.setdefault(pattern[length - self.block:], []).append((pattern, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """Start of every occurrence, from left to right, with the items it belongs to."""
        length, block, default = self.length, self.block, self.default
        shift, buckets = self.shift.get, self.buckets
        end, count = length, len(words)
        while end <= count:
            key = tuple(words[end - block:end])
            step = shift(key, default)
            if step:
                end += step
                continue
            first = words[end - length]
            for pattern, items in buckets[key]:
                if pattern[0] == first and pattern == tuple(words[end - length:end]):
                    yield end - length, items
            end += 1


def matchers(items: list[str], window: int = WINDOW) -> list[Matcher]:
    """One matcher for each pattern length that occurs."""
    by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
    for number, text in enumerate(items):
        words = words_of(text)
        length = min(window, len(words))
        for start in range(len(words) - length + 1 if length else 0):
            pattern = tuple(words[start:start + length])
            by_length.setdefault(length, {}).setdefault(pattern, set()).add(number)
    return [Matcher(patterns, length) for length, patterns in sorted(by_length.items())]


def occurrences(words: list[bytes], machines: list[Matcher]) -> tuple[list[list[int]], set[int]]:
    """Hit stretches of words (merged, end exclusive) and the items found."""
    found: set[int] = set()
    spans: list[tuple[int, int]] = []
    for machine in machines:
        for start, items in machine.search(words):
            spans.append((start, start + machine.length))
            found |= items
    return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """Find benchmark windows in every whole text, one row per document row.

    Columns: doc_id, n_words, spans (array of word positions, end exclusive,
    merged), items (array of item ids as strings, sorted), n_hit.  An item of
    fewer words than ``window`` is one pattern; without words it is none.

    The benchmark is the query set: at most ``pass_bytes`` of it go to the
    executors at once, and a larger one takes more passes over each row.  The
    documents are never shuffled, so a passage that all of them share costs no
    more than any other.  Null and empty texts have no words.  Items under the
    same id count as one; an item without an id marks words, but has no id to
    report.  Repeated document rows give repeated result rows; other columns are
    left out; empty tables on either side give no rows, or rows without hits.
    """
    kind = dict(docs.dtypes)[id_column]
    items = texts(benchmark, item_column, item_text_column).where("text != ''")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-total // pass_bytes))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(passes))
    out = texts(docs, id_column, text_column).select(
        "doc_id", "text", F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<array<int>>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    schema = f"doc_id {kind}, text string, n_words bigint, spans array<array<int>>, items array<string>"
    for number in range(passes):
        rows = items.where(part == number).select(F.col("doc_id").cast("string"), "text").collect()
        last = number == passes - 1
        search = _search([r[0] for r in rows], [r[1] for r in rows], window, keep_text=not last)
        out = out.mapInArrow(search, schema.replace(" text string,", "") if last else schema)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    return out.select("doc_id", "n_words", "spans", F.array_sort("items").alias("items"), hit.alias("n_hit"))


def _search(names: list[str | None], items: list[str], window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = matchers(items, window)
        for batch in batches:
            counts, spans, found = [], [], []
            for text, old_spans, old_items in zip(*(batch.column(i) for i in (1, 3, 4)), strict=True):
                words = words_of(text.as_py())
                new_spans, numbers = occurrences(words, machines)
                if len(old_spans):
                    new_spans = merged([tuple(s) for s in old_spans.as_py()] + [tuple(s) for s in new_spans])
                counts.append(len(words))
                spans.append(new_spans)
                found.append(sorted({*old_items.as_py(), *(names[n] for n in numbers if names[n] is not None)}))
            columns = {
                "doc_id": batch.column(0), "text": batch.column(1), "n_words": pa.array(counts, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                "items": pa.array(found, pa.list_(pa.string())),
            }
            if not keep_text:
                del columns["text"]
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents table without the rows that hold a benchmark window."""
    packed = docs.select("text", F.struct(*DOCUMENT_COLUMNS).alias("doc"))
    found = decontaminate(packed, benchmark, id_column="doc").where(F.size("spans") == 0)
    return found.select("doc_id.*")
