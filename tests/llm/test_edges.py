"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldglass.llm import (
    bpe, chat, decontaminate, near_dup, pii, quality_qda, quality_rules, shards, toxicity, wrapper,
)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = "The quick brown fox number {} jumps over the lazy dog and runs far away into the green hills beyond.\n"
LONG = "".join(PROSE.format(i) for i in range(2_000))
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n", "en", "a", 3),
    (4, LONG, "en", "a", len(LONG)),
    (5, "x" * 100_000, "en", None, 100_000),
    (6, PROSE.format(1) * 3, "en", "a", 300),
    (6, PROSE.format(1) * 3, "en", "a", 300),
    (7, PROSE.format(1) * 3, "de", "b", 300),
    (None, "nobody's text", "en", "a", 13),
]
#: Extra columns named like those the operators make.
CLASHES = ("words", "kept", "spans", "base", "score", "rank", "shard", "n_words", "items", "set_key", "key", "doc_key")


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, DOCS)
    return frame.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(None, 1, 1), (1, None, None), (2, 0, 0), (3, 1, 1), (4, 1, 0), (6, 1, 1), (6, 0, 0), (7, 7, 7)],
        "doc_id bigint, quality int, toxic int",
    )


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(
        [(1, None), (2, ""), (None, "nobody's text"), (3, "jumps over the lazy dog"), (3, "a b")],
        "item_id bigint, text string",
    )


def ids(frame, name="doc_id"):
    return sorted((r[name] for r in frame.select(name).collect()), key=lambda x: (x is not None, x))


EXPECTED = sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))


def test_quality_rules(docs, empty):
    found = quality_rules.quality_rules(docs)
    assert ids(found) == EXPECTED
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert by_id[1]["n_words"] == by_id[2]["n_words"] == by_id[3]["n_words"] == 0
    assert by_id[1]["base_failed"] and not by_id[1]["kept"] and by_id[1]["clean_text"] == ""
    assert by_id[4]["n_words"] == 2_000 * 20 and by_id[5]["word_chars"] == 100_000
    assert by_id[6]["n_dup_lines"] == 2 and by_id[6]["n_repeat_words"] == 60
    assert quality_rules.quality_rules(empty).count() == 0


def test_near_duplicates(docs, empty):
    found = near_dup.near_duplicates(docs)
    assert ids(found) == EXPECTED
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert by_id[1]["n_shingles"] == 0 and by_id[1]["component_id"] == 1 and by_id[1]["kept"]
    assert by_id[7]["component_id"] == 6 and not by_id[7]["kept"] and by_id[6]["kept"]
    assert by_id[5]["n_shingles"] == 1
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert near_dup.near_duplicates(empty).count() == 0
    assert ids(near_dup.clean_documents(docs)) == [None, 1, 2, 3, 4, 5, 6]


def test_decontaminate(docs, empty, bench):
    found = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert found[1]["n_words"] == 0 and found[1]["n_hit"] == 0
    assert found[4]["n_hit"] == 2_000 * 5 and found[4]["items"] == ["3"]
    assert found[None]["n_hit"] == 3 and found[None]["items"] == []
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert ids(decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit = 0")) == EXPECTED


def test_personal_data(docs, empty):
    found = pii.find_personal_data(docs)
    assert ids(found) == EXPECTED
    assert all(r["spans"] == [] for r in found.where("doc_id in (1, 2, 3, 5)").collect())
    assert pii.find_personal_data(empty).count() == 0


def test_tokens(docs, empty):
    found = bpe.encode_decode(docs)
    assert ids(found) == EXPECTED
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert by_id[1]["n_tokens"] == 0 and by_id[1]["decoded"] == "" and by_id[4]["decoded"] == LONG
    assert by_id[5]["decoded"] == "x" * 100_000
    assert bpe.encode_decode(empty).count() == 0


def test_shards(docs, empty):
    found = shards.assign_shards(docs)
    assert ids(found) == EXPECTED
    rows = found.collect()
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {8}
    assert len({r["shard"] for r in rows if r["doc_id"] in (6, 7)}) == 1
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert shards.assign_shards(empty).count() == 0


@pytest.mark.parametrize("classify", [toxicity.classify_toxicity, quality_qda.classify_quality])
def test_classifiers(classify, docs, empty, labels):
    found = classify(docs, labels)
    assert ids(found) == EXPECTED
    rows = found.collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert not [r for r in rows if r["doc_id"] is None and r["held_out"]]
    assert classify(docs, labels.limit(0)).count() == len(ROWS)
    assert classify(empty, labels).count() == 0


def test_main_text(spark):
    page = "<html><body><nav>Menu</nav><article><p>Words &amp; more</p></article><footer>End</footer>"
    pages = spark.createDataFrame(
        [(1, None, None), (2, "http://h.example/a", ""), (3, "http://h.example/b", page), (3, "http://h.example/b", page),
         (4, "no url", "<p>" + "very long " * 20_000), (None, "http://h.example/c", "<div>" * 400 + "deep <b")],
        "page_id bigint, url string, html string",
    ).withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    found = wrapper.extract_main_text(pages)
    texts = {r["page_id"]: r["text"] for r in found.collect()}
    assert found.count() == 6
    assert texts[1] == texts[2] == "" and texts[3] == "Words & more"
    assert texts[4] == ("very long " * 20_000).strip() and texts[None] == "deep"
    assert wrapper.extract_main_text(pages.limit(0)).count() == 0


def test_chat(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 1, "ann", "Hi"), (1, 2, None, None), (1, None, "bob", "?"),
         (None, 0, "ann", "alone"), (2, 0, "system", "only"), (3, 0, "ann", "long " * 50_000)],
        "conv_id bigint, turn bigint, role string, text string",
    ).withColumn("view", F.lit("clash")).withColumn("items", F.lit("clash"))
    rows = chat.rotate(turns).collect()
    assert {(r["conv_id"], r["view"]) for r in rows} == {
        (1, "ann"), (1, "unknown"), (1, "bob"), (None, "ann"), (3, "ann")
    }
    ann = next(r for r in rows if r["conv_id"] == 1 and r["view"] == "ann" and r["segment"] == 0)
    assert ann["rendered"] == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n"
        "<|im_start|>user name=unknown\n<|im_end|>\n"
    )
    assert ann["n_copies"] == 4 and ann["n_messages"] == 3
    assert [ann["rendered"][m["start"]:m["end"]] for m in ann["masks"]] == ["Hi<|im_end|>\n"]
    assert chat.rotate(turns.limit(0)).count() == 0


def test_chat_crowded_turn(spark):
    turns = spark.range(3_000).select(
        F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.concat(F.lit("p"), F.col("id") % 2).alias("role"),
        F.col("id").cast("string").alias("text"),
    )
    rows = chat.rotate(turns).where("view = 'p0'").orderBy("segment", "sub", "part").collect()
    assert len(rows) > 4 and max(r["n_messages"] for r in rows) < 800
    assert sum(r["n_messages"] for r in rows) == 3_000


def test_stages(spark, docs, empty, bench, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (docs, empty):
        now = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            out.write.mode("overwrite").parquet(f"{tmp_path}/one")
            now = stage(spark, now, str(tmp_path))
        tokens = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        tokens.write.mode("overwrite").parquet(f"{tmp_path}/tokens")
