"""Toxicity: a support vector machine on Nyström features of a gap-weighted subsequence kernel.

The kernel counts common subsequences of four characters, start and end marks
included, each weighted by how far it stretches in both strings, so that gaps and inserted characters lower a
likeness but do not end it.  A text is as toxic as its most toxic unit; units
are words without outer punctuation, runs of words of one or two letters drawn
together, and overlapping pieces of very long words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fieldglass.llm.common import landed, texts
from fieldglass.llm.fitting import labelled, remainder

PARTS, HELD_OUT = 5, 0
#: Labelled rows that teach, of each class; chosen by a hash of the id.
TEACHING_ROWS = 10_000
#: Units the model is fitted on: suspects, frequent clean ones, clean ones chosen by a hash, and in each
#: round of mining those clean ones that the machine so far takes for toxic most of all.
SUSPECTS, FREQUENT_CLEAN, OTHER_CLEAN, HARD_CLEAN = 5_000, 2_000, 2_000, 2_000
MINING_ROUNDS = 2
#: A suspect's share of toxic texts is at least so many times that of clean ones ...
LEAST_RATIO = 10.0
#: ... and the odds against its counts being chance are so much above the number of units (natural logarithm).
SAFETY = 2.0
#: Clean landmarks; toxic ones are taken until every suspect is this like one of them.
CLEAN_LANDMARKS = 16
ALIKE = 0.15

PENALTY = 1e-4
#: Width of the Gaussian over the kernel's squared distance.
WIDTH = 0.3
LENGTH = 4
DECAY = np.float32(0.7)
#: Longest unit; longer words are cut into pieces of this size that overlap by half.
PIECE = 24
#: Units a worker remembers; beyond that it starts anew.
REMEMBERED = 1_000_000
BLOCK = 512
#: Pairs whose kernel is worked out at once, and places that letters are hashed to.
PAIRS = 4_096
HASHED = 128
#: Words up to this length are also drawn together with their neighbours of that kind.
FRAGMENT = 2
OUTSIDE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’„…–—¡¿"
#: Score bins of the calibration.
BINS = 2_000
REACH = 8.0


def units(text: str) -> list[str]:
    """The units of a text in order, lower-cased; a run of fragments is a unit beside its words of two letters or more."""
    out: list[str] = []
    words = [w for w in (w.strip(OUTSIDE) for w in text.lower().split()) if w]
    for short, run in groupby(words, key=lambda w: len(w) <= FRAGMENT):
        own = list(run)
        if short and len(own) > 1:
            own = [*(w for w in own if len(w) > 1), "".join(own)]
        for word in own:
            if len(word) <= PIECE:
                out.append(word)
            else:
                out += [word[i:i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]
    return out


def coded(words: list[str], filler: int) -> np.ndarray:
    """Code points of words between a mark for their start and one for their end, as one padded matrix."""
    width = max(map(len, words)) + 2
    flat = "".join(f"\x02{w}\x03".ljust(width, "\0") for w in words).encode("utf-32-le", "replace")
    flat = np.frombuffer(flat, np.int32)
    out = flat.reshape(len(words), width).copy()
    out[out == 0] = filler
    return out


def subsequence_kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Weighted counts of common subsequences of ``LENGTH`` characters for all rows of left and right.

    The recursion runs over the characters of ``left``; for each it keeps, per
    position of ``right``, the weight of shorter subsequences that end before it.
    """
    rows, columns, width = len(left), len(right), right.shape[1]
    # reach[l, j]: decay from a match at l to just before position j.
    steps = np.arange(width)
    gap = steps[None, :] - steps[:, None] - 1
    reach = np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0).astype(np.float32)
    shorter = [np.zeros((rows, columns, width), np.float32) for _ in range(LENGTH - 1)]
    total = np.zeros((rows, columns), np.float32)
    weight = DECAY * DECAY
    for i in range(left.shape[1]):
        same = (left[:, i, None, None] == right[None]).astype(np.float32)
        total += weight * (same * shorter[-1]).sum(2)
        for q in range(LENGTH - 2, -1, -1):
            ends = same * shorter[q - 1] if q else same
            shorter[q] *= DECAY
            shorter[q] += weight * (ends.reshape(-1, width) @ reach).reshape(rows, columns, width)
    return total


def own_kernel(words: list[str]) -> np.ndarray:
    """Kernel of every word with itself."""
    out = np.empty(len(words), np.float32)
    for i, word in enumerate(words):
        code = coded([word], -1)
        out[i] = subsequence_kernel(code, code)[0, 0]
    return out


@dataclass(frozen=True)
class Machine:
    """Landmarks, the map from likeness to Nyström features joined with the weights, and the bias."""

    landmarks: tuple[str, ...]
    own: np.ndarray
    weights: np.ndarray
    bias: float

    def decide(self, words: list[str]) -> np.ndarray:
        return likeness(words, list(self.landmarks), self.own) @ self.weights + np.float32(self.bias)


def letters(code: np.ndarray) -> np.ndarray:
    """Which letters coded words hold, hashed to ``HASHED`` places: products count shared letters."""
    out = np.zeros((len(code), HASHED), np.float32)
    rows, places = np.nonzero(code > 3)
    out[rows, code[rows, places] % HASHED] = 1
    return out


def pair_kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The subsequence kernel of the rows of left with the same rows of right."""
    rows, width = right.shape
    steps = np.arange(width)
    gap = steps[None, :] - steps[:, None] - 1
    reach = np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0).astype(np.float32)
    shorter = [np.zeros((rows, width), np.float32) for _ in range(LENGTH - 1)]
    total = np.zeros(rows, np.float32)
    weight = DECAY * DECAY
    for i in range(left.shape[1]):
        same = (left[:, i, None] == right).astype(np.float32)
        total += weight * (same * shorter[-1]).sum(1)
        for q in range(LENGTH - 2, -1, -1):
            ends = same * shorter[q - 1] if q else same
            shorter[q] *= DECAY
            shorter[q] += weight * (ends @ reach)
    return total


def likeness(words: list[str], landmarks: list[str], own: np.ndarray) -> np.ndarray:
    """Likeness to the landmarks: a Gaussian of the distance that the kernel, divided so that a word is 1 to itself, gives.

    The kernel counts as 0 where a word holds less than half of a landmark's different letters.
    """
    right = coded(landmarks, -2)
    held = letters(right)
    marks, lengths = held.T, held.sum(1)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for start in range(0, len(order), BLOCK):
        block = np.array(order[start:start + BLOCK])
        left = coded([words[i] for i in block], -1)
        scale = np.sqrt(self_kernel(left))
        rows, columns = np.nonzero(2 * (letters(left) @ marks) >= lengths)
        for at in range(0, len(rows), PAIRS):
            r, c = rows[at:at + PAIRS], columns[at:at + PAIRS]
            out[block[r], c] = pair_kernel(left[r], right[c]) / scale[r]
    return np.exp((out / np.sqrt(own) - 1) / np.float32(WIDTH))


def self_kernel(code: np.ndarray) -> np.ndarray:
    """Kernel of every row with itself, by the same recursion row by row."""
    rows, width = code.shape
    steps = np.arange(width)
    gap = steps[None, :] - steps[:, None] - 1
    reach = np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0).astype(np.float32)
    shorter = [np.zeros((rows, width), np.float32) for _ in range(LENGTH - 1)]
    total = np.zeros(rows, np.float32)
    weight = DECAY * DECAY
    for i in range(width):
        same = ((code[:, i, None] == code) & (code[:, i, None] >= 0)).astype(np.float32)
        total += weight * (same * shorter[-1]).sum(1)
        for q in range(LENGTH - 2, -1, -1):
            ends = same * shorter[q - 1] if q else same
            shorter[q] *= DECAY
            shorter[q] += weight * (ends @ reach)
    return np.maximum(total, np.float32(1e-9))


def choose_landmarks(words: list[str], most: int | None = None, alike: float = ALIKE) -> list[str]:
    """The first words in order that are less alike than ``alike`` to those chosen before; all such words without ``most``."""
    chosen: list[str] = []
    free = list(words)
    while free and (most is None or len(chosen) < most):
        chosen.append(free[0])
        near = likeness(free, chosen[-1:], own_kernel(chosen[-1:]))[:, 0]
        free = [w for w, x in zip(free[1:], near[1:], strict=True) if x < alike]
    return chosen


def fit_machine(suspects: dict[str, int], clean: dict[str, int], penalty: float = PENALTY) -> Machine | None:
    """Squared-hinge support vector machine on Nyström features; none without suspects or clean units.

    Both come with the numbers of toxic and of clean texts that count for them;
    the root of that is the cost of getting them wrong.
    """
    if not suspects or not clean:
        return None
    names = sorted(suspects, key=lambda u: (-suspects[u], u))
    others = list(clean)
    toxic_marks = choose_landmarks(names)
    close = likeness(others, toxic_marks, own_kernel(toxic_marks)).max(1)
    hardest = [others[i] for i in np.argsort(-close, kind="stable")]
    marks = toxic_marks + choose_landmarks(hardest, CLEAN_LANDMARKS)
    own = own_kernel(marks)
    among = likeness(marks, marks, own).astype(float)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    x = likeness(names + others, marks, own).astype(float) @ root
    x = np.hstack((x, np.ones((len(x), 1))))
    y = np.r_[np.ones(len(names)), -np.ones(len(others))]
    cost = np.sqrt([*(suspects[u] for u in names), *clean.values()])
    cost /= cost[:len(names)].sum()
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9
    w = np.zeros(x.shape[1])
    active = np.ones(len(x), bool)
    for _ in range(200):  # Newton steps, damped so that the active set settles
        a, c = x[active], cost[active]
        new = np.linalg.solve(ridge + (a * c[:, None]).T @ a, (a * c[:, None]).T @ y[active])
        step = np.abs(new - w).max()
        w = new if not w.any() else 0.5 * (w + new)
        active = y * (x @ w) < 1
        if step < 1e-7 or not active.any():
            break
    return Machine(tuple(marks), own, (root @ w[:-1]).astype(np.float32), float(w[-1]))


def unit_counts(docs: DataFrame) -> DataFrame:
    """From rows (text, y): unit, contexts and toxic (texts with label 1), clean (texts with label 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str] = []
            before: list[str | None] = []
            first: list[int] = []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = units(text)
                if y:
                    pairs = dict.fromkeys(zip(own, ["", *own]))
                    seen: set[str] = set()
                    for unit, last in pairs:
                        found.append(unit), before.append(last), first.append(int(unit not in seen))
                        seen.add(unit)
                else:
                    for unit in dict.fromkeys(own):
                        found.append(unit), before.append(None), first.append(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.string()), pa.array(before, pa.string()), pa.array(first, pa.int64())],
                names=["unit", "before", "n"],
            )

    rows = docs.select("text", "y").mapInArrow(run, "unit string, before string, n bigint")
    rows = rows.groupBy("unit", "before").agg(F.sum("n").alias("n"))
    toxic = F.col("before").isNotNull()
    return rows.groupBy("unit").agg(
        F.count(F.when(toxic, 1)).alias("contexts"),
        F.coalesce(F.sum(F.when(toxic, F.col("n"))), F.lit(0)).alias("toxic"),
        F.coalesce(F.sum(F.when(~toxic, F.col("n"))), F.lit(0)).alias("clean"),
    )


def significant(count: Column, clean: Column, share: float, candidates: int) -> Column:
    """Whether so many toxic among all texts with a unit are beyond chance, even for the luckiest of all candidates.

    The exponent is the divergence of the unit's share from the overall ``share``.
    """
    total = count + clean
    part = count / total
    spread = F.when(part < 1, (1 - part) * F.ln((1 - part) / (1 - share))).otherwise(0.0)
    return (part > share) & (total * (part * F.ln(part / share) + spread) >= float(np.log(candidates) + SAFETY))


def hardest_clean(counts: DataFrame, machine: Machine) -> dict[str, int]:
    """The clean units with the highest decision values, and in how many clean texts they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            if words:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(machine.decide(words).astype(float))],
                    names=["unit", "clean", "v"],
                )

    scored = counts.where("clean > 0").select("unit", "clean")
    scored = scored.mapInArrow(run, "unit string, clean bigint, v double")
    return {r["unit"]: r["clean"] for r in scored.orderBy(F.desc("v"), "unit").limit(HARD_CLEAN).collect()}


def teach(docs: DataFrame, sample: DataFrame) -> Machine | None:
    """Fit on rows (doc_id, text) that the bounded sample (doc_id, y) labels.

    Only texts are labelled.  Units that stand out in the toxic ones beyond chance
    are the suspects; clean units that the machine gets wrong are added and the
    fit repeated.
    """
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    # The sample has at most 2 x TEACHING_ROWS narrow rows.
    taught = docs.join(F.broadcast(sample), "doc_id").select("text", "y")
    counts = landed(unit_counts(taught), "units")
    count = F.least("contexts", "toxic")
    ratio = (count / sizes[1]) / ((F.col("clean") + 0.5) / sizes[0])
    chance = significant(count, F.col("clean"), sizes[1] / (sizes[0] + sizes[1]), max(2, counts.count()))
    ranked = counts.where((count > 0) & (ratio >= LEAST_RATIO) & chance).select("unit", count.alias("n"))
    suspects = {r["unit"]: r["n"] for r in ranked.orderBy(F.desc("n"), "unit").limit(SUSPECTS).collect()}
    common = counts.where("clean > 0").orderBy(F.desc("clean"), "unit").limit(FREQUENT_CLEAN)
    other = counts.where("clean > 0").orderBy(F.xxhash64("unit"), "unit").limit(OTHER_CLEAN)
    clean = {r["unit"]: r["clean"] for part in (common, other) for r in part.select("unit", "clean").collect()}
    clean = {u: n for u, n in clean.items() if u not in suspects}
    machine = fit_machine(suspects, clean)
    for _ in range(MINING_ROUNDS if machine else 0):
        clean |= {u: n for u, n in hardest_clean(counts, machine).items() if u not in suspects}
        machine = fit_machine(suspects, clean)
    return machine


class Scorer:
    """Highest decision value over the units of each text; values of units are remembered."""

    def __init__(self, machine: Machine) -> None:
        self.machine = machine
        self.known: dict[str, float] = {}

    def score(self, texts_: list[str]) -> list[float | None]:
        own = [dict.fromkeys(units(t)) for t in texts_]
        new = list({u: None for us in own for u in us if u not in self.known})
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list({u: None for us in own for u in us})
        if new:
            self.known.update(zip(new, self.machine.decide(new).tolist(), strict=True))
        known = self.known
        return [max((known[u] for u in us), default=None) for us in own]


_SCORERS: dict[tuple, Scorer] = {}


def scorer_of(machine: Machine) -> Scorer:
    """The worker process's scorer of a machine; it lives on from task to task, and only the last one does."""
    key = (machine.landmarks, machine.weights.tobytes(), machine.bias)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(machine)
    return _SCORERS[key]


def raw_scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """Rows (doc_id, raw); texts without a unit have a null."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(machine)
        for batch in batches:
            found: list[float | None] = []
            for start in range(0, batch.num_rows, 256):
                found += scorer.score(batch.column(1).slice(start, 256).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "raw"]
            )

    return docs.mapInArrow(run, f"doc_id {kind}, raw double")


def calibrate(raw: DataFrame, sample: DataFrame) -> tuple[float, float]:
    """Slope and offset of the logistic curve through binned scores of the labelled sample."""
    index = F.floor((F.least(F.greatest(F.col("raw"), F.lit(-REACH)), F.lit(REACH)) + REACH) / (2 * REACH) * BINS)
    rows = raw.where("raw is not null").join(F.broadcast(sample), "doc_id").groupBy(index.alias("i"), "y").count()
    data = np.array([(r["i"], r["y"], r["count"]) for r in rows.collect()], float).reshape(-1, 3)
    x = (data[:, 0] + 0.5) / BINS * 2 * REACH - REACH
    # Platt's targets keep the curve finite when the classes are apart.
    ones, zeros = data[data[:, 1] == 1, 2].sum(), data[data[:, 1] == 0, 2].sum()
    target = np.where(data[:, 1] == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    w = np.array([1.0, 0.0])
    design = np.c_[x, np.ones(len(x))]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (data[:, 2] * (p - target)) + 1e-3 * w
        hessian = (design * (data[:, 2] * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def classify_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id", text_column: str = "text",
    parts: int = PARTS, held: int = HELD_OUT, teaching_rows: int = TEACHING_ROWS,
) -> DataFrame:
    """Score every whole text with a machine learned from labelled rows that are not held out.

    Columns: doc_id, held_out, score (probability of label 1), predicted, one row
    per row.  At most ``teaching_rows`` rows of each class teach, those with the
    smallest hash of their id.  Every unit of every text is scored; nothing is
    shuffled but unit counts, the scores' bins and narrow label rows.

    Null, empty and blank texts, and texts without any unit, have the score 0.
    Rows without an id are never held out and never taught.  Repeated rows are
    scored each; other columns are left out.  Where the labels do not suffice for
    a machine (a class missing, no suspects), all scores are 0.
    """
    plain = texts(docs, id_column, text_column)
    taught = labelled(labels, label, parts, held)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = landed(
        taught.where("y = 1").orderBy(*order).limit(teaching_rows)
        .union(taught.where("y = 0").orderBy(*order).limit(teaching_rows)),
        "sample",
    )
    machine = teach(plain, sample)
    if machine is None:
        scored = plain.select("doc_id", F.lit(0.0).alias("score"))
    else:
        raw = landed(raw_scores(plain, machine), "raw")
        slope, offset = calibrate(raw, sample)
        curve = 1 / (1 + F.exp(-(F.col("raw") * slope + offset)))
        scored = raw.select("doc_id", F.coalesce(curve, F.lit(0.0)).alias("score"))
    held_out = F.coalesce(remainder(F.col("doc_id"), parts) == held, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
