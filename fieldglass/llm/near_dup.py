"""Near-duplicate documents by MinHash: many universal minima, bands, checked links, components.

How pairs are found without ever listing all pairs of a group:

1. Documents with equal shingle sets are one class; one sketch per class goes on.
2. Every class falls into one bucket per band.  In a part of the buckets the
   members are compared with the smallest one, on the full sets.
3. These links give components.  In a bucket that holds several components only
   members of different components can still add a link.  Those outside the
   bucket's largest component are compared with all others block against block,
   by signature and then, still inside the task, on the full sets; a pair that
   the links found so far join is skipped.  What leaves the task is a forest of
   confirmed links.  First each outsider looks for one link only, in a part of
   the buckets, which joins most components; then all buckets that still hold
   several are compared in full, each pair in the first bucket it shares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fieldglass.llm.common import DOCUMENT_COLUMNS, discard, landed, texts
from fieldglass.llm.components import components

WORDS_PER_SHINGLE = 5
SIMILARITY_PERCENT = 80
#: With 64 bands of 8 minima a pair at 0.8 is missed with probability below 1e-5, one at 0.3 meets in 0.4 %.
BANDS = 64
ROWS_PER_BAND = 8
#: A pair goes on to the full sets if its signature is no further below the limit than this (5 standard errors of 512 minima).
SIGNATURE_SLACK = 0.09
#: Weight of one block of a bucket; a document weighs 1 and one more for every so many shingles (about 4 KB).
TILE, SHINGLES_PER_WEIGHT = 512, 512
#: Buckets are dealt to so many parts.  Part 0 is for comparisons with the smallest member; in so many rounds, each
#: in the next part, outsiders look for one link, with so many of their likeliest partners.
BUCKET_PARTS, BEST_ROUNDS, BEST_TRIED = 8, 2, 4

#: Word hashes a worker remembers; beyond that it starts anew.
REMEMBERED = 400_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M1, _M2, _STEP = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_CHUNK = 128


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = WordHashes()


def shingles(text: str, words_per_shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles.

    A-Z is lower-cased; words lie between white space.  A text of fewer words is
    one shingle as a whole; without words there is none.
    """
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    count = len(words)
    if not count:
        return np.empty(0, np.uint64)
    size = min(count, words_per_shingle)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, count)
    out = np.full(count - size + 1, size, np.uint64)
    for i in range(size):
        out = _mixed(out * _STEP + hashes[i:count - size + 1 + i])
    return np.unique(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def hash_family(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of universal hash functions on 32-bit values, the same everywhere."""
    draw = np.random.Generator(np.random.PCG64(20_240_229))
    return (draw.integers(0, 1 << 31, size).astype(np.uint32) << np.uint32(1) | np.uint32(1),
            draw.integers(0, 1 << 32, size).astype(np.uint32))


def minima(shingle_set: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest value of the set under every hash function."""
    factor, offset = family
    values = (shingle_set >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(factor), np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(values), _CHUNK):
        np.minimum(out, (values[start:start + _CHUNK, None] * factor + offset).min(0), out=out)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band; the band's number goes into the key."""
    out = np.arange(1, bands + 1, dtype=np.uint64) * _STEP
    for column in signature.reshape(bands, rows).astype(np.uint64).T:
        out = _mixed(out ^ column) * _STEP
    return out.view(np.int64)


def sketches(docs: DataFrame, words_per_shingle: int, bands: int, rows: int) -> DataFrame:
    """One row per row of (doc_id, text): size and key of the shingle set, bucket keys, signature bytes."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = hash_family(bands * rows)
        for batch in batches:
            sizes, keys, buckets, checks = [], [], [], []
            for text in batch.column(1):
                own = shingles(text.as_py(), words_per_shingle)
                sizes.append(len(own))
                if not len(own):
                    keys.append(None), buckets.append(None), checks.append(None)
                    continue
                signature = minima(own, family)
                keys.append(_set_key(own))
                buckets.append(band_keys(signature, bands, rows))
                checks.append((signature & np.uint32(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(buckets, pa.list_(pa.int64())), pa.array(checks, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "buckets", "signature"],
            )

    return docs.mapInArrow(
        run, f"doc_id {kind}, n_shingles bigint, set_key binary, buckets array<bigint>, signature binary"
    )


def shingle_sets(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """The full sets of some texts as sorted arrays of 64-bit hashes, with their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py(), words_per_shingle) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_set_key(own) for own in sets], pa.binary()),
                 pa.array([own.view(np.int64) for own in sets], pa.list_(pa.int64()))],
                names=["set_key", "own"],
            )

    return docs.select("text").mapInArrow(run, "set_key binary, own array<bigint>")


def _set_key(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def star_links(stars: DataFrame, sets: DataFrame, similarity_percent: int) -> DataFrame:
    """The pairs (head, cls) that are linked on their full sets, as (u, v)."""
    # The sets of the many members come first; those of heads are joined to them, so that a head's rows can be split.
    loaded = stars.select("head", "cls").join(sets.select("cls", F.col("own").alias("one")), "cls")
    loaded = loaded.join(sets.select(F.col("cls").alias("head"), F.col("own").alias("other")), "head")
    both = F.size(F.array_intersect("one", "other"))
    either = F.size("one") + F.size("other") - both
    return loaded.where(both * 100 >= either * similarity_percent).select(
        F.col("head").alias("u"), F.col("cls").alias("v")
    )


def mixed_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, once for every pair of blocks they take part in.

    Columns: bucket, cls, component, outside (of the bucket's largest component),
    outer and tile (the block of outsiders and the block of members that meet),
    few and item (whether the row stands on the one side, on the other, or both).
    """
    named = members.join(labels.select(F.col("id").alias("cls"), "component"), "cls", "left")
    named = named.select("bucket", "cls", "weight", F.coalesce("component", "cls").alias("component"))
    counts = named.groupBy("bucket", "component").agg(F.sum("weight").alias("weight"))
    main = counts.groupBy("bucket").agg(
        F.max(F.struct("weight", "component")).alias("m"), F.count("*").alias("parts"), F.sum("weight").alias("size")
    )
    main = landed(main.where("parts > 1").select(
        "bucket", F.col("m.component").alias("main"), F.ceil(F.col("size") / TILE).alias("tiles"),
        F.ceil((F.col("size") - F.col("m.weight")) / TILE).alias("outers"),
    ), "main")
    rows = named.join(main, "bucket").select(
        "bucket", "cls", "component", (F.col("component") != F.col("main")).alias("outside"), "tiles", "outers",
        F.pmod(F.xxhash64("cls"), "tiles").alias("tile"), F.pmod(F.xxhash64("cls", F.lit(1)), "outers").alias("outer"),
    )
    outside, tile, outer = F.col("outside"), F.col("tile"), F.col("outer")

    def every(count: str) -> Column:
        return F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1)

    as_item = F.transform(every("outers"), lambda o: F.struct(
        o.alias("outer"), tile.alias("tile"), (outside & (o == outer)).alias("few"), F.lit(True).alias("item")))
    as_few = F.transform(F.filter(every("tiles"), lambda t: outside & (t != tile)), lambda t: F.struct(
        outer.alias("outer"), t.alias("tile"), F.lit(True).alias("few"), F.lit(False).alias("item")))
    out = landed(rows.select("bucket", "cls", "component", "outside", F.inline(F.concat(as_item, as_few))), "mixed")
    discard(main)
    return out


_MEET = ("bucket", "outer", "tile")


def across(mixed: DataFrame, marks: DataFrame, sets: DataFrame, similarity_percent: int, best_only: bool) -> DataFrame:
    """A forest of confirmed links (u, v) between components that share a bucket.

    Outsiders of a bucket are compared with all its members, block against block,
    so that no task holds a bucket.  Signatures alone say first which members have
    a likely partner in another component; only these come back with their full
    sets.  With ``best_only`` an outsider stops at its first link; else every
    likely pair for which this is the first bucket it shares is confirmed or
    refuted, unless links of this pair of blocks have joined the two already.
    """
    floor = similarity_percent / 100 - SIGNATURE_SLACK
    columns = ["bucket", "outer", "tile", "cls", "component", "outside", "few", "item", "signature", "prints"]

    def met(rows: DataFrame, extra: list[str]) -> DataFrame:
        return rows.select(*columns, *extra).repartition(*_MEET).sortWithinPartitions(*_MEET)

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(block.involved(floor, best_only), pa.int64())], names=["cls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = block.forest(floor, similarity_percent, best_only)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    likely = landed(met(mixed.join(marks, "cls"), []).mapInArrow(involved, "cls bigint").distinct(), "involved")
    kept = mixed.join(likely, "cls", "left_semi").join(marks.join(sets, "cls").join(likely, "cls", "left_semi"), "cls")
    out = landed(met(kept, ["own"]).mapInArrow(run, "u bigint, v bigint").distinct(), "more")
    discard(likely)
    return out


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The pairs of blocks in sorted batches."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _MEET])
        edges = (np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist()
        for start, end in zip([0, *edges], [*edges, len(keys)], strict=True):
            if end > start:
                if held and tuple(keys[start]) != at:
                    yield Block(pa.Table.from_batches(held))
                    held = []
                at = tuple(keys[start])
                held.append(batch.slice(start, end - start))
    if held:
        yield Block(pa.Table.from_batches(held))


class Block:
    """Outsiders of one block and members of another, of one bucket."""

    def __init__(self, table: pa.Table) -> None:
        def flat(name: str) -> np.ndarray:
            return table.column(name).to_numpy()

        self.cls, self.component, self.outside, self.few = (flat(n) for n in ("cls", "component", "outside", "few"))
        self.items = np.flatnonzero(flat("item"))
        self.signatures = np.stack([np.frombuffer(s.as_buffer(), np.uint8) for s in table.column("signature")])
        self.prints = np.stack([p.values.to_numpy() for p in table.column("prints")])
        self.bucket = np.array([table.column("bucket")[0].as_py()], np.int64).astype(np.int32)[0]
        self.sets = [s.values.to_numpy() for s in table.column("own")] if "own" in table.column_names else []

    def likely(self, i: int, floor: float, any_bucket: bool) -> np.ndarray:
        """Members of other components with a signature close enough, the closest first."""
        near = self.items[self.component[self.items] != self.component[i]]
        if not any_bucket:
            # Two outsiders meet in both roles; one is enough.
            near = near[~(self.outside[near] & (self.cls[near] < self.cls[i]))]
        share = ((self.signatures[near] == self.signatures[i]).mean(1) - 1 / 256) / (1 - 1 / 256)
        near, share = near[share >= floor], share[share >= floor]
        if not any_bucket and len(near):
            first = self.prints[i][(self.prints[near] == self.prints[i]).argmax(1)] == self.bucket
            near, share = near[first], share[first]
        return near[np.argsort(-share, kind="stable")]

    def involved(self, floor: float, any_bucket: bool) -> np.ndarray:
        """Members that are part of a likely pair."""
        found = []
        for i in np.flatnonzero(self.few).tolist():
            near = self.likely(i, floor, any_bucket)[:BEST_TRIED if any_bucket else None]
            if len(near):
                found += [self.cls[near], self.cls[i:i + 1]]
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def forest(self, floor: float, similarity_percent: int, best_only: bool) -> list[tuple[int, int]]:
        """Confirmed links, none within what earlier ones of this pair of blocks have joined."""
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (above := parent.get(x, x)) != x:
                parent[x] = x = parent.get(above, above)
            return x

        found = []
        for i in np.flatnonzero(self.few).tolist():
            for k in self.likely(i, floor, best_only)[:BEST_TRIED if best_only else None].tolist():
                a, b = root(int(self.component[i])), root(int(self.component[k]))
                if a != b and linked(self.sets[i], self.sets[k], similarity_percent):
                    parent[a] = b
                    found.append((int(self.cls[i]), int(self.cls[k])))
                    if best_only:
                        break
        return found


def linked(one: np.ndarray, other: np.ndarray, similarity_percent: int) -> bool:
    """Whether two sorted sets overlap by the given share."""
    if min(len(one), len(other)) * 100 < max(len(one), len(other)) * similarity_percent:
        return False
    if len(one) > len(other):
        one, other = other, one
    # The sets are sorted as unsigned numbers.
    one, other = one.view(np.uint64), other.view(np.uint64)
    at = np.minimum(np.searchsorted(other, one), len(other) - 1)
    both = int((other[at] == one).sum())
    return both * 100 >= (len(one) + len(other) - both) * similarity_percent


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    words_per_shingle: int = WORDS_PER_SHINGLE, similarity_percent: int = SIMILARITY_PERCENT,
    bands: int = BANDS, rows: int = ROWS_PER_BAND,
) -> DataFrame:
    """Group documents whose shingle sets overlap by the given share: one row per row.

    Columns: doc_id, n_shingles, component_id (the smallest id reachable over
    links, its own included), kept (the id is its component's).  Links count
    from ``100 * both >= similarity_percent * either`` on full sets.

    Null, empty and blank texts have no shingles, link with nothing and are kept.
    Repeated rows have equal sets and so one component; an id that comes with
    several texts links them.  Rows without an id get no component and are kept.
    Other columns are left out.  An empty table gives an empty one.
    """
    plain = texts(docs, id_column, text_column)
    sketch = landed(sketches(plain, words_per_shingle, bands, rows), "sketches")
    ids = landed(sketch.select("doc_id", "n_shingles", "set_key"), "ids")
    filled = sketch.where("set_key is not null and doc_id is not null")
    classes = filled.groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"),
        F.first("signature").alias("signature"),
    )
    classes = landed(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    discard(sketch)

    weight = 1 + F.floor(F.col("n") / SHINGLES_PER_WEIGHT)
    slots = classes.select("cls", weight.alias("weight"), F.explode("buckets").alias("bucket"))
    heads = slots.groupBy("bucket").agg(F.min("cls").alias("head"), F.max("cls").alias("last"))
    heads = landed(heads.where("head < last").select("bucket", "head"), "heads")
    members = landed(slots.join(heads, "bucket"), "members")
    discard(heads)

    # The low 32 bits of the bucket keys tell which of two documents' buckets is the first they share.
    prints = F.transform("buckets", lambda b: F.shiftright(F.shiftleft(b, 32), 32).cast("int"))
    sketched = classes.select("cls", "set_key", "rep", "signature", prints.alias("prints"))
    wanted = landed(members.select("cls").distinct().join(sketched, "cls"), "wanted")
    chosen = plain.join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = shingle_sets(chosen, words_per_shingle).groupBy("set_key").agg(F.first("own").alias("own"))
    sets = landed(wanted.select("cls", "set_key").join(sets, "set_key").select("cls", "own"), "sets")
    marks = wanted.select("cls", "signature", "prints")

    part = F.pmod("bucket", F.lit(BUCKET_PARTS))
    stars = members.where((part == 0) & (F.col("cls") > F.col("head"))).select("head", "cls").distinct()
    links = star_links(stars, sets, similarity_percent).unionByName(_same_id(ids, classes))
    labels = components(links)
    for turn in range(1, BEST_ROUNDS + 2):
        best_only = turn <= BEST_ROUNDS
        mixed = mixed_buckets(members.where(part == turn) if best_only else members, labels)
        if not mixed.isEmpty():
            more = across(mixed, marks, sets, similarity_percent, best_only)
            if not more.isEmpty():
                known = labels.select(F.col("id").alias("u"), F.col("component").alias("v"))
                labels = components(known.unionByName(more))
            discard(more)
        discard(mixed)
    discard(members, wanted, sets)

    named = classes.select("set_key", "cls", "rep").join(labels.withColumnRenamed("id", "cls"), "cls", "left")
    named = named.select("set_key", "rep", F.coalesce("component", "cls").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = landed(named.join(least, "component").select("set_key", F.col("least").alias("component")), "named")
    discard(classes)
    out = ids.join(named, "set_key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept")
    )


def _same_id(ids: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes that one id belongs to."""
    several = ids.where("set_key is not null and doc_id is not null").groupBy("doc_id").agg(
        F.min("set_key").alias("first"), F.max("set_key").alias("last")
    )
    several = several.where("first != last").select("doc_id", "first")
    pairs = ids.join(several, "doc_id").where("set_key != first").select("set_key", "first").distinct()
    named = pairs.join(classes.select("set_key", F.col("cls").alias("u")), "set_key")
    return named.join(classes.select(F.col("set_key").alias("first"), F.col("cls").alias("v")), "first").select("u", "v")


def clean_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents table with one document of each group, the one with the smallest id.

    Repeated rows of one id are one document.  Rows without an id stay.
    """
    found = landed(near_duplicates(docs, **settings), "groups")
    gone = found.where("not kept").select("doc_id").distinct()
    rest = docs.select(*DOCUMENT_COLUMNS).join(gone, "doc_id", "left_anti")
    again = landed(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1"), "repeated")
    if again.isEmpty():
        return rest
    again = again.select("doc_id")
    once = rest.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return rest.join(again, "doc_id", "left_anti").unionByName(once)
