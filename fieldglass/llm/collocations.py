"""Phrase collocations: frequent n-grams by Misra-Gries summaries, then exact counts and scores.

First pass: every task counts the n-grams of a stretch of its texts by hash and
deals the counts to hash parts.  Each part merges what it gets into a
Misra-Gries summary.  Its capacity exceeds the part's mass (all n-gram
occurrences in it) divided by the threshold, so what is subtracted stays below
the threshold and every frequent n-gram survives.  Second pass: occurrences of
survivors are counted by their words.  Survivors are looked up in a bit filter
of bounded size; what it lets through wrongly falls below the threshold in the
exact count.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldglass.llm.common import landed

MOST_WORDS = 5
THRESHOLD = 100
TOP = 2000
#: N-gram occurrences that one hash part is meant to hold; the number of parts grows with the input.
PART_MASS = 4_000_000
#: Counters of a summary: so many times mass / threshold, which keeps what is subtracted below threshold / factor.
CAPACITY_FACTOR = 16
#: Words a task counts at once in the first and second pass; the counts leave the task, so its memory does not depend
#: on its input.
BLOCK_WORDS, EXACT_BLOCK_WORDS = 500_000, 1_000_000
#: Bits of the survivors' filter: so many per survivor, and no more than the bound (32 MB).
BITS_PER_SURVIVOR, MOST_BITS = 64, 1 << 28
#: Phrases whose exact counts a task adds up before they leave it.
HELD_PHRASES = 400_000
#: Words of one task of the second pass.  Every task gives most frequent phrases once, so a few large ones give fewer rows.
TASK_WORDS = 50_000_000
#: Words a task keeps a number for before it starts anew.
REMEMBERED = 700_000
KEY_BITS = 40

_KEY = np.uint64((1 << KEY_BITS) - 1)
_M1, _M2, _STEP = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
#: A-Z become a-z, what ends a piece becomes a byte that UTF-8 never has.
_CUT = 255
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else _CUT if b in b".,;:!?" or 10 <= b <= 13 else b for b in range(256)
)
_BLANK_CUTS = bytes(32 if b == _CUT else b for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Vocabulary(dict):
    """Numbers of the words of one language in one task, from lists that all languages share."""

    def __init__(self, lang: str, words: list[bytes], langs: list[str], hashes: array) -> None:
        super().__init__()
        self.lang, self.seed = lang, xxhash.xxh3_64_intdigest(lang.encode("utf-8", "replace"))
        self.words, self.langs, self.hashes = words, langs, hashes

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        self.hashes.append(xxhash.xxh3_64_intdigest(word, self.seed))
        return number


class Reader:
    """Blocks of word numbers from batches of (lang, text); 0 stands between pieces."""

    def __init__(self, block_words: int) -> None:
        self.block_words = block_words
        self._anew()

    def _anew(self) -> None:
        self.words: list[bytes] = [b""]
        self.langs: list[str] = [""]
        self.hashes = array("Q", [0])
        self.known: dict[str, Vocabulary] = {}

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held: list[np.ndarray] = []
        count = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                numbers = self.numbers(lang.as_py(), text.as_py())
                held.append(numbers)
                count += len(numbers)
                if count >= self.block_words:
                    yield np.concatenate(held)
                    held, count = [], 0
                    if len(self.words) > REMEMBERED:
                        self._anew()
        if held:
            yield np.concatenate(held)

    def numbers(self, lang: str, text: str) -> np.ndarray:
        if lang not in self.known:
            self.known[lang] = Vocabulary(lang, self.words, self.langs, self.hashes)
            self.known[lang][bytes([_CUT])] = 0
        tokens = text.encode("utf-8", "replace").translate(_NORMAL).replace(b"\xff", b" \xff ").split()
        out = np.zeros(len(tokens) + 1, np.int64)
        out[:-1] = np.fromiter(map(self.known[lang].__getitem__, tokens), np.int64, len(tokens))
        return out

    def grams(self, numbers: np.ndarray, most_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: the positions where an n-gram starts, and their 64-bit hashes."""
        value = np.array(self.hashes, copy=True)[numbers]
        start = np.flatnonzero(numbers)
        mixed = _mixed(value[start] + _STEP)
        yield 1, start, mixed
        for length in range(2, most_words + 1):
            last = start + (length - 1)
            on = last < len(numbers)
            on[on] = numbers[last[on]] != 0
            start, mixed = start[on], mixed[on]
            mixed = _mixed(mixed * _STEP + value[start + (length - 1)])
            yield length, start, mixed


def placed(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part number and 40-bit key of n-gram hashes, in one number."""
    part = (hashes >> np.uint64(KEY_BITS)) % np.uint64(parts)
    return (part << np.uint64(KEY_BITS)) | (hashes & _KEY)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Keys as five bytes each, counts as one byte, larger counts in full."""
    narrow = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :KEY_BITS // 8]
    return narrow.tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].tobytes()


def unpacked(keys: bytes, counts: bytes, large: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide = np.zeros((len(counts), 8), np.uint8)
    wide[:, :KEY_BITS // 8] = np.frombuffer(keys, np.uint8).reshape(-1, KEY_BITS // 8)
    full = np.frombuffer(counts, np.uint8).astype(np.int64)
    full[full == 255] = np.frombuffer(large, np.int64)
    return wide.view(np.uint64).ravel(), full


class MisraGries:
    """A summary of at most ``capacity`` counters: counts fall short of the truth by at most ``error``."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add another summary's counters; while there are too many, all lose as much as the largest one too many."""
        both, value = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(both, kind="stable")
        both, value = both[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.empty(0, np.int64)
        self.keys, self.counts = both[first], np.add.reduceat(value, first) if len(first) else value
        if len(self.keys) > self.capacity:
            extra = len(self.keys) - self.capacity - 1
            less = int(np.partition(self.counts, extra)[extra])
            self.error += less
            kept = self.counts > less
            self.keys, self.counts = self.keys[kept], self.counts[kept] - less


def _slices(parts: int, most_words: int, block_words: int):
    """First pass in a task: exact counts of each block, dealt to the hash parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(block_words)
        edges = np.arange(parts + 1, dtype=np.uint64) << np.uint64(KEY_BITS)
        for numbers in reader.blocks(batches):
            keys, counts = counted(np.concatenate([placed(h, parts) for _, _, h in reader.grams(numbers, most_words)]))
            at = np.searchsorted(keys, edges)
            full = [p for p in range(parts) if at[p] < at[p + 1]]
            rows = [packed(keys[at[p]:at[p + 1]], counts[at[p]:at[p + 1]]) for p in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([int(counts[at[p]:at[p + 1]].sum()) for p in full], pa.int64()),
                 *(pa.array([r[i] for r in rows], pa.binary()) for i in range(3))],
                names=["part", "mass", "keys", "counts", "large"],
            )

    return run


def _survivors(threshold: int, factor: int):
    """Merge the slices of one part; keep what may reach the threshold."""

    def run(table: pa.Table) -> pa.Table:
        mass = sum(table.column("mass").to_pylist())
        summary = MisraGries(factor * mass // threshold + 1)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for slice_ in zip(*(table.column(c) for c in ("keys", "counts", "large")), strict=True):
            held.append(unpacked(*(x.as_py() for x in slice_)))
            # Slices are small beside the summary: merged a summary's worth at a time.
            if sum(len(keys) for keys, _ in held) >= summary.capacity:
                summary.merge(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
        if held:
            summary.merge(*(np.concatenate(x) for x in zip(*held, strict=True)))
        part = table.column("part")[0].as_py()
        keys = summary.keys[summary.counts + summary.error >= threshold] | (np.uint64(part) << np.uint64(KEY_BITS))
        return pa.table({"key": pa.array(keys.view(np.int64), pa.int64())})

    return run


def probes(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = _mixed(keys + _STEP)
    return mixed & np.uint64(bits - 1), (mixed >> np.uint64(32)) & np.uint64(bits - 1)


def filter_of(survivors: DataFrame, bits: int) -> bytes:
    """The bit filter: tasks set the bits of one segment each; all segments together have ``bits`` bits."""
    segment = min(bits, 1 << 20)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate(probes(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array((both // np.uint64(segment)).astype(np.int32)), pa.array((both % np.uint64(segment)).astype(np.int32))],
                names=["segment", "bit"],
            )

    def fill(table: pa.Table) -> pa.Table:
        field = np.zeros(segment, bool)
        field[table.column("bit").to_numpy()] = True
        return pa.table({"segment": table.column("segment")[:1], "bits": pa.array([np.packbits(field).tobytes()])})

    dealt = survivors.mapInArrow(positions, "segment int, bit int").distinct()
    rows = dealt.groupBy("segment").applyInArrow(fill, "segment int, bits binary").collect()
    out = np.zeros((bits // segment, segment // 8), np.uint8)
    for row in rows:
        out[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def _exact(parts: int, most_words: int, block_words: int, bits: int, shared):
    """Second pass in a task: phrases that the filter lets through, with their counts in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.frombuffer(shared.value, np.uint8)
        reader = Reader(block_words)

        def inside(at: np.ndarray) -> np.ndarray:
            return (field[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1

        held: dict[tuple[str, str, int], int] = {}
        for numbers in reader.blocks(batches):
            for length, start, hashes in reader.grams(numbers, most_words):
                first, second = probes(placed(hashes, parts), bits)
                hit = np.flatnonzero(inside(first))
                hit = hit[inside(second[hit]) == 1]
                for position, count in _by_words(numbers, start[hit], hashes[hit], length):
                    words = numbers[position:position + length].tolist()
                    text = b" ".join([reader.words[w] for w in words])
                    key = (reader.langs[words[0]], text.decode("utf-8", "replace"), length)
                    held[key] = held.get(key, 0) + count
            if len(held) >= HELD_PHRASES:
                yield _phrase_batch(held)
                held = {}
        yield _phrase_batch(held)

    return run


def _phrase_batch(held: dict[tuple[str, str, int], int]) -> pa.RecordBatch:
    columns = list(zip(*held, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()),
         pa.array(held.values(), pa.int64())],
        names=["lang", "phrase", "size", "n"],
    )


def _by_words(numbers: np.ndarray, start: np.ndarray, hashes: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Position and count of each different phrase; equal hashes are told apart by their words."""
    order = np.argsort(hashes, kind="stable")
    start, hashes = start[order], hashes[order]
    if not len(start):
        return
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    for i in range(length):
        new[1:] |= numbers[start[1:] + i] != numbers[start[:-1] + i]
    first = np.flatnonzero(new)
    yield from zip(start[first].tolist(), np.diff(np.append(first, len(start))).tolist(), strict=True)


def word_counts(rows: DataFrame) -> DataFrame:
    """All word occurrences per language: lang, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [
                len(t.as_py().encode("utf-8", "replace").translate(_NORMAL).translate(_BLANK_CUTS).split())
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["lang", "n"])

    return rows.mapInArrow(run, "lang string, n bigint").groupBy("lang").agg(F.sum("n").alias("n"))


def frequent_phrases(
    rows: DataFrame, mass: int, threshold: int = THRESHOLD, most_words: int = MOST_WORDS,
    part_mass: int = PART_MASS, block_words: int = BLOCK_WORDS, exact_block_words: int = EXACT_BLOCK_WORDS,
) -> DataFrame:
    """Exact counts of all phrases of 1 to ``most_words`` words with at least ``threshold`` occurrences.

    Takes rows of (lang, text) and an upper bound of their n-gram occurrences;
    gives lang, phrase, size (words), a.
    """
    spark = rows.sparkSession
    parts = max(1, -(-mass // part_mass))
    slices = rows.mapInArrow(
        _slices(parts, most_words, block_words), "part int, mass bigint, keys binary, counts binary, large binary"
    )
    survivors = landed(slices.groupBy("part").applyInArrow(_survivors(threshold, CAPACITY_FACTOR), "key bigint"), "survivors")
    bits = min(MOST_BITS, 1 << max(10, (BITS_PER_SURVIVOR * survivors.count()).bit_length()))
    shared = spark.sparkContext.broadcast(filter_of(survivors, bits))
    tasks = max(2 * spark.sparkContext.defaultParallelism, mass // (most_words * TASK_WORDS))
    counts = rows.coalesce(tasks).mapInArrow(
        _exact(parts, most_words, exact_block_words, bits, shared), "lang string, phrase string, size int, n bigint"
    )
    counts = counts.groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.sum("n").alias("a"))
    return landed(counts.where(F.col("a") >= threshold), "phrases")


def _part(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def mine_collocations(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang", threshold: int = THRESHOLD,
    most_words: int = MOST_WORDS, top: int = TOP,
) -> DataFrame:
    """The best-scoring phrases of each language.

    Columns: lang, rank, phrase, a (its occurrences), l and r (those of the two
    parts at the cut that counts), n (all words of the language), score
    (``floor(1000 * a * n / (l * r))``, exact), cut (words before the cut).
    Phrases whose words lie in a longer frequent phrase with as many occurrences
    are left out; ``top`` rows are kept per language, by score, then a, both
    descending, then phrase.

    Null texts are empty, a null language is ``und``; texts without words add
    nothing.  Repeated rows count as often as they come.  Other columns are left
    out.  An empty table gives no rows.
    """
    rows = docs.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    totals = landed(word_counts(rows), "totals")
    words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = frequent_phrases(rows, words * most_words, threshold, most_words)
    candidates = counts.where("size > 1").withColumn("words", F.split("phrase", " "))

    cuts = candidates.select(
        "lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")
    )
    cuts = cuts.select(
        "lang", "phrase", "a", "cut", _part(F.col("words"), F.lit(1), F.col("cut")).alias("left"),
        _part(F.col("words"), F.col("cut") + 1, F.col("size") - F.col("cut")).alias("right"),
    )
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    whole = "cast({} as decimal(17, 0))"
    product = f"cast(1000 as decimal(4, 0)) * {whole.format('a')} * {whole.format('n')}"
    scored = scored.withColumn("score", F.expr(f"({product}) div ({whole.format('l')} * {whole.format('r')})"))
    scored = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("s"))

    longer = candidates.where("size > 2").select(
        "lang", "a", F.explode(F.array_distinct(F.flatten(F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda size: F.transform(
                F.sequence(F.lit(1), F.col("size") - size + 1), lambda i: _part(F.col("words"), i, size)
            ),
        )))).alias("phrase"),
    )
    covered = longer.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = scored.join(covered, ["lang", "phrase"], "left").where("around is null or around < s.a")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    kept = kept.select("lang", "phrase", "s.*").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return kept.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score",
        F.col("cut").cast("long").alias("cut"),
    )
