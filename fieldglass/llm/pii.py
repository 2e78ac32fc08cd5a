"""Personal data: base patterns as seeds, and contexts learned from them that find unseen identifiers.

Base spans come from fixed expressions and checks.  Their left contexts (two
words) become lexical patterns; patterns and the identifiers that follow them
form a graph on which confidences are passed to and fro.  Patterns that end up
sure mark further identifiers of their kind.  All of it is DataFrame work with
built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldglass.llm.common import DOCUMENT_COLUMNS, landed, texts, words_of

KINDS = ("email", "ip", "card", "phone")
#: The base expressions (fixed values of the contract).  Runs are possessive and start where no earlier
#: match could have, which finds the same leftmost matches in linear time.
EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters a text must hold for the expression to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Different hash codes by which words are let through to the count of what follows a context.
CODES = 1 << 17
#: A pattern is sure with at least so many different seeds and at least this confidence.
LEAST_SEEDS = 3
SURE = 0.9
#: Mean rise of the found identifiers' confidence below which the graph has settled.
SETTLED = 1e-3
#: Passing confidence back: weight of what is not known to be personal data.
DOUBT = 1.0

_PIECES = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"
#: Stands for the words before the first one of a text.
START = "\u0002"
#: A card has at most so many digits, a phone number fewer.
MOST_DIGITS = 19
#: A digit group, what may stand before another one, and the white space between them.
_GROUP = r"^\(?[0-9](?:[0-9().-]*[0-9)])?(?=[\x22')\]}>»”.,;:!?]*[\x20\x09-\x0D]*$)"
_GROUP_BEFORE = r"^[\x22'(\[{<«“]*[0-9](?:[0-9().-]*[0-9)-])?[\x20\x09]+$"
_GAP = r"[\x20\x09-\x0D]+$"
_AREA_CODE = r"^[\x22'\[{<«“]*\([0-9]+\)"
_OUTSIDE = r"^[\x22'(\[{<«“]+|[\x22')\]}>»”.,;:!?\x20\x09-\x0D]+$"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    count = F.length(digits)
    value = F.aggregate(
        F.sequence(F.lit(1), count), F.lit(0),
        lambda total, i: total + F.when(
            (count - i) % 2 == 0, F.substr(digits, i, F.lit(1)).cast("int")
        ).otherwise(
            (F.substr(digits, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substr(digits, i, F.lit(1)).cast("int") / 5)
            .cast("int")
        ),
    )
    return value % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """The check that a match of an expression must pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(
            F.split(match, r"\."),
            lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3)
            & (F.substr(F.concat(F.lit("000"), F.regexp_replace(p, "^0+", "")), F.lit(-3), F.lit(3)) <= "255"),
        )
    digits = _digits(match)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def spans_of(kind: str) -> Column:
    """Base spans of one kind in the column text: array of (kind, start, end, value), start from 0, in code points."""
    expression = EXPRESSIONS[kind]
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    matches = F.regexp_extract_all("text", F.lit(expression), 0)
    between = F.split("text", expression, -1)
    zipped = F.zip_with(matches, between, lambda m, b: F.struct(m.alias("m"), F.length(b).alias("b")))
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))
    # The last piece has no match after it.
    found = F.aggregate(
        zipped, start,
        lambda acc, z: F.when(z["m"].isNull(), acc).otherwise(F.struct(
            (acc["at"] + z["b"] + F.length(z["m"])).alias("at"),
            F.concat(acc["found"], F.array(F.struct(
                F.lit(kind).alias("kind"), (acc["at"] + z["b"]).alias("start"),
                (acc["at"] + z["b"] + F.length(z["m"])).alias("end"), z["m"].alias("value"),
            ))).alias("found"),
        )),
        lambda acc: acc["found"],
    )
    hint = F.col("text").rlike("[0-9]") if NEEDS[kind] is None else F.contains("text", F.lit(NEEDS[kind]))
    return F.when(hint, F.filter(found, lambda s: holds(kind, s["value"]))).otherwise(empty)


def base_spans(docs: DataFrame) -> DataFrame:
    """Add ``base``: the base spans of all kinds, by kind as listed and then by start."""
    return docs.withColumn("base", F.concat(*(spans_of(kind) for kind in KINDS)))


def occurrences(docs: DataFrame) -> DataFrame:
    """Identifier-like words with their left context: doc_key, context, value, start, end, groups, kind and whole.

    Kind and whole are those of the base span that the word is part of, else null
    and the word with the digit groups that go on from it (``groups``, at most
    MOST_DIGITS digits in all, none of them in a base span).

    A word is what lies between white space, without outer punctuation; it is
    identifier-like if it holds a digit or an at sign.  Contexts are the two words
    before, lower-cased, digits made 0; START stands for words before the first.
    """
    rows = docs.where(F.col("text").rlike("[0-9@]")).select(
        "doc_key", "text", "base", F.split("text", _PIECES, -1).alias("pieces")
    )
    rows = rows.select("doc_key", "base", "pieces", F.posexplode("pieces").alias("i", "piece"))
    rows = rows.where(F.col("piece").rlike("[0-9@]"))
    before = F.length(F.array_join(F.slice("pieces", 1, F.col("i")), ""))
    # An area code keeps its opening bracket if digits go on after it.
    lead = F.length(F.regexp_extract("piece", r"^[\x22'(\[{<«“]*", 0))
    rows = rows.select(
        "doc_key", "base", "piece", _context(F.col("pieces"), F.col("i")).alias("context"),
        F.slice("pieces", F.col("i") + 2, MOST_DIGITS - 1).alias("next"),
        F.regexp_replace("piece", _OUTSIDE, "").alias("value"), (before + lead).alias("start"), (before + F.length("piece")).alias("after"),
    ).where("value != ''")
    end = F.col("start") + F.length("value")
    touching = F.filter("base", lambda s: (s["start"] < end) & (s["end"] > F.col("start")))
    first = F.get(touching, F.lit(0))
    limit = F.array_min(F.transform(F.filter("base", lambda s: s["start"] >= end), lambda s: s["start"]))
    rows = rows.select(
        "doc_key", "context", "value", "start", end.alias("end"), first["kind"].alias("kind"), first["value"].alias("base_value"),
        F.when(first.isNull() & F.col("piece").rlike(_GROUP_BEFORE), _following(limit)).otherwise(F.array().cast("array<string>")).alias("groups"),
        F.col("piece").rlike(_AREA_CODE).cast("int").alias("bracket"), F.col("piece").alias("piece"),
    )
    opened = (F.size("groups") > 0) & (F.col("bracket") == 1)
    rows = rows.withColumn("value", F.when(opened, F.concat(F.lit("("), F.regexp_extract("piece", r"[0-9].*?[0-9)](?=[\x20\x09]*$)", 0))).otherwise(F.col("value")))
    rows = rows.withColumn("start", F.col("start") - opened.cast("int")).withColumn("end", F.col("start") + F.length("value"))
    return rows.select(
        "doc_key", "context", "value", "start", "end", "groups", "kind",
        F.coalesce("base_value", F.concat("value", F.array_join("groups", ""))).alias("whole"),
    )


def _following(limit: Column) -> Column:
    """The digit groups right after a word, each with what lies before it: joined to the word they give the text."""
    start = F.struct(
        F.array().cast("array<string>").alias("groups"), F.lit(True).alias("live"),
        F.length(_digits(F.col("value"))).alias("digits"), F.regexp_extract("piece", _GAP, 0).alias("gap"), F.col("after").alias("at"),
    )

    def add(acc: Column, piece: Column) -> Column:
        group = F.regexp_extract(piece, _GROUP, 0)
        digits = acc["digits"] + F.length(_digits(group))
        at = acc["at"] + F.length(piece)
        fits = acc["live"] & (group != "") & (digits <= MOST_DIGITS) & (limit.isNull() | (acc["at"] + F.length(group) <= limit))
        return F.struct(
            F.when(fits, F.array_append(acc["groups"], F.concat(acc["gap"], group))).otherwise(acc["groups"]).alias("groups"),
            (fits & piece.rlike(_GROUP_BEFORE)).alias("live"), digits.alias("digits"),
            F.regexp_extract(piece, _GAP, 0).alias("gap"), at.alias("at"),
        )

    return F.aggregate("next", start, add, lambda acc: acc["groups"])


def _context(pieces: Column, i: Column) -> Column:
    def word(at: Column) -> Column:
        piece = F.get(pieces, at)
        return F.when(piece.rlike(r"[^\x20\x09-\x0D]"), piece).otherwise(F.lit(START + " "))

    words = F.lower(F.concat(word(i - 2), word(i - 1)))
    return F.trim(F.regexp_replace(F.regexp_replace(words, "[0-9]", "0"), r"[\x20\x09-\x0D]+", " "))


def followers(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """How often each context is followed by any word at all, in all texts.

    Words are counted before they meet the contexts: a filter on short hash codes
    (at most CODES of them, so the list is bounded at any size) lets few others
    through, the rest adds up in the tasks, and one row per context is joined.
    ``contexts`` holds each once.  (A semi-join would be moved below the count.)
    """
    rows = docs.select(words_of(F.lower(F.regexp_replace("text", "[0-9]", "0"))).alias("words"))

    def word(at: Column) -> Column:
        return F.coalesce(F.get("words", at), F.lit(START))

    code = F.pmod(F.xxhash64("context"), F.lit(CODES)).cast("int")
    wanted = [r[0] for r in contexts.select(code).distinct().collect()]
    rows = rows.select(F.explode(F.transform("words", lambda w, i: F.concat_ws(" ", word(i - 2), word(i - 1)))).alias("context"))
    counts = rows.where(code.isin(wanted)).groupBy("context").agg(F.count("*").alias("total"))
    return counts.join(contexts, "context")


def shapes_of(found: DataFrame) -> DataFrame:
    """What the base identifiers of each kind look like: label, fewest and most digits, whether all hold an at sign."""
    digits = F.length(_digits(F.col("whole")))
    return found.where("kind is not null").groupBy(F.col("kind").alias("label")).agg(
        F.min(digits).alias("fewest"), F.max(digits).alias("most"), F.min(F.contains("whole", F.lit("@"))).alias("at_sign")
    )


def shaped(rows: DataFrame, shapes: DataFrame, value: str) -> DataFrame:
    """Rows (with a label) whose value looks like an identifier of its kind.

    It has no more digits than the longest base identifier, at least half as many
    as the shortest, and an at sign if and only if those have one.
    """
    digits = F.length(_digits(F.col(value)))
    joined = rows.join(F.broadcast(shapes), "label")
    like = digits.between(F.ceil(F.col("fewest") / 2), F.col("most")) & (F.contains(value, F.lit("@")) == F.col("at_sign"))
    return joined.where(like).drop("fewest", "most", "at_sign")


def learn_patterns(docs: DataFrame, found: DataFrame, shapes: DataFrame) -> DataFrame:
    """Sure patterns (context, kind) by passing confidence over the graph of patterns and identifiers.

    Base identifiers have the confidence 1 for their kind, others what the best
    pattern before them gives, if that is at least SURE and they have the shape of
    its kind.  A pattern's confidence is the sum over the identifiers after it,
    divided by the number of all words after it.

    Patterns enter the graph with LEAST_SEEDS different base identifiers.  In each
    round those join them that have as many different identifiers of the
    confidence SURE, base ones or found ones, if these could make them sure.  The
    graph only grows and confidences only rise, so it settles: rounds go on until
    no pattern joins, no identifier is new and confidences stand still.
    """
    edges = landed(found.groupBy("context", F.col("whole").alias("value")).agg(
        F.max("kind").alias("kind"), F.count("*").alias("n")
    ), "edges")
    seeds = edges.where("kind is not null").groupBy("context", F.col("kind").alias("label")).agg(F.count("*").alias("seeds"))
    active = landed(seeds.where(F.col("seeds") >= LEAST_SEEDS).select("context", "label"), "active")
    if active.isEmpty():
        return active.withColumnRenamed("label", "kind")
    totals = landed(followers(docs, active.select("context").distinct()), "followers")
    best, before = None, (-1, 0.0)
    while True:
        reached = _scored(_trusted(edges, best), active, totals).join(edges.where("kind is null"), "context")
        best = landed(
            shaped(reached, shapes, "value").groupBy("label", "value").agg(F.max("sure").alias("trust"))
            .where(F.col("trust") >= SURE), "best",
        )
        strong = _trusted(edges, best)
        # All words after a context are at least the identifier-like ones.
        words = edges.groupBy("context").agg(F.sum("n").alias("words"))
        reached = strong.groupBy("context", "label").agg(
            F.sum((F.col("trust") >= SURE).cast("long")).alias("seeds"), F.sum(F.col("trust") * F.col("n")).alias("good")
        ).where(F.col("seeds") >= LEAST_SEEDS).join(words, "context")
        reached = reached.where(F.col("good") >= SURE * (F.col("words") + DOUBT)).select("context", "label")
        fresh = landed(reached.join(active, ["context", "label"], "left_anti"), "fresh")
        now = best.agg(F.count("*"), F.coalesce(F.sum("trust"), F.lit(0.0))).first()
        settled, before = now[0] == before[0] and now[1] - before[1] <= SETTLED * now[0], now
        if fresh.isEmpty():
            if settled:
                break
            continue
        unseen = landed(fresh.select("context").distinct().join(totals, "context", "left_anti"), "unseen")
        if not unseen.isEmpty():
            totals = landed(totals.unionByName(followers(docs, unseen)), "followers")
        active = landed(active.unionByName(fresh), "active")
    ranked = _scored(_trusted(edges, best), active, totals).where(F.col("sure") >= SURE).groupBy("context").agg(
        F.max(F.struct("sure", "label")).alias("top")
    )
    return ranked.select("context", F.col("top.label").alias("kind"))


def _trusted(edges: DataFrame, best: DataFrame | None) -> DataFrame:
    """Context, label, value, n and trust of all identifiers with a confidence so far."""
    base = edges.where("kind is not null").select("context", F.col("kind").alias("label"), "value", "n", F.lit(1.0).alias("trust"))
    if best is None:
        return base
    other = edges.where("kind is null").join(best, "value")
    return base.unionByName(other.select("context", "label", "value", "n", "trust"))


def _scored(trusted: DataFrame, active: DataFrame, totals: DataFrame) -> DataFrame:
    """The confidence of every pattern in the graph."""
    good = trusted.groupBy("context", "label").agg(F.sum(F.col("trust") * F.col("n")).alias("good"))
    scored = good.join(active, ["context", "label"]).join(totals, "context")
    return scored.select("context", "label", (F.col("good") / (F.col("total") + DOUBT)).alias("sure"))


def _grown(kind: Column) -> Column:
    """Value of an added span: the word, and for cards and phones the digit groups that go on from it."""
    most = F.when(kind == "card", MOST_DIGITS).when(kind == "phone", 15).otherwise(0)
    return F.aggregate(
        "groups", F.struct(F.col("value").alias("text"), F.lit(True).alias("live")),
        lambda acc, g: F.struct(
            F.when(acc["live"] & (F.length(_digits(F.concat(acc["text"], g))) <= most), F.concat(acc["text"], g))
            .otherwise(acc["text"]).alias("text"),
            (acc["live"] & (F.length(_digits(F.concat(acc["text"], g))) <= most)).alias("live"),
        ),
        lambda acc: acc["text"],
    )


def _outer(spans: Column) -> Column:
    """Spans without those that lie inside another one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s.alias("span"))))
    empty = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>").alias("kept"))
    return F.aggregate(
        ordered, empty,
        lambda acc, s: F.when(s["span"]["end"] <= acc["at"], acc).otherwise(F.struct(
            s["span"]["end"].alias("at"), F.array_append(acc["kept"], s["span"]).alias("kept"))),
        lambda acc: acc["kept"],
    )


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All spans of personal data, one row per row: doc_id, text, base, spans.

    ``base`` and ``spans`` are arrays of (kind, start, end, value), by kind as
    listed and then by start; ``spans`` holds the base spans and those that sure
    patterns add where no base span lies.  An added span carries its pattern's
    kind.

    Null texts are empty, empty ones have no spans.  Repeated rows, and several
    rows of one id, are searched each for itself; added spans are looked up by
    text, so equal texts get equal spans.  Other columns are left out; an empty
    table gives an empty one.
    """
    plain = base_spans(texts(docs, id_column, text_column)).withColumn("doc_key", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    found = landed(occurrences(plain), "occurrences")
    shapes = landed(shapes_of(found), "shapes")
    patterns = landed(learn_patterns(plain, found, shapes), "patterns")
    if patterns.isEmpty():
        return plain.select("doc_id", "text", "base", F.col("base").alias("spans"))
    fresh = found.where("kind is null").drop("kind", "whole", "end").join(patterns, "context")
    fresh = fresh.withColumn("value", _grown(F.col("kind"))).withColumn("end", F.col("start") + F.length("value"))
    fresh = shaped(fresh.withColumn("label", F.col("kind")), shapes, "value")
    span = F.struct("kind", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "value")
    # Spans of one text only; equal texts have the same ones.
    added = fresh.groupBy("doc_key").agg(_outer(F.collect_set(span)).alias("added"))
    joined = plain.join(landed(added, "added"), "doc_key", "left")
    nothing = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    every = F.concat("base", F.coalesce("added", nothing))
    ordered = F.concat(*(F.sort_array(_only(every, kind)) for kind in KINDS))
    return joined.select("doc_id", "text", "base", ordered.alias("spans"))


def joined(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_of(spans: Column, kind: str) -> Column:
    return F.size(_only(spans, kind)).cast("long")


def _only(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k")))),
        start,
        lambda acc, s: F.when(s["s"] < acc["at"], F.struct(F.greatest(acc["at"], s["e"]).alias("at"), acc["out"].alias("out")))
        .otherwise(F.struct(
            s["e"].alias("at"),
            F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["s"] - acc["at"]), F.lit("<"), s["k"], F.lit(">"))
            .alias("out"),
        )),
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))),
    )


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents table with personal data masked."""
    packed = docs.select("text", F.struct("doc_id", "lang", "source").alias("doc"))
    found = find_personal_data(packed, id_column="doc")
    out = found.select(
        "doc_id.doc_id", "doc_id.lang", "doc_id.source",
        F.when(F.size("spans") > 0, masked(F.col("text"), F.col("spans"))).otherwise(F.col("text")).alias("text"),
    )
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)
