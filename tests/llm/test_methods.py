"""The operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from fieldglass.llm import bpe, components, decontaminate, html_tree, near_dup, pii, quality_rules, shards, toxicity
from fieldglass.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub(r"\D", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 % 10 + int(c) // 5 for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return ",".join(
        f"{kind}:{m.start()}:{m.end()}" for kind, p in BASE.items() for m in re.finditer(p, text) if passes(kind, m[0])
    )


def test_base_spans_on_noise(spark):
    rng = random.Random(7)
    alphabet = "ab@.-_ +()0123456789é字\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1_500)]
    texts += ["4111 1111 1111 1111 a@b.cd_x@e.fg 1.2.3.4.5.6.7.8 0255.1.1.001 256.1.1.1 +1 (234) 567-8901", "7" * 30_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = pii.base_spans(frame).select("doc_id", pii.joined("base").alias("s")).collect()
    for row in found:
        assert row["s"] == base_spans(texts[row["doc_id"]]), texts[row["doc_id"]]


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"Please write my card number 4111111111111111 and call phone line +1 555 010 {1000 + i} now.") for i in range(30)]
    rows += [(40, "My call phone line 5550104444 is odd."), (41, "The year of 1984 was fine, 12 of 30 said.")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(frame).collect()}
    assert [(s["kind"], s["value"]) for s in found[40]] == [("phone", "5550104444")]
    assert found[41] == []
    masked = pii.clean_documents(frame.selectExpr("*", "'en' lang", "'a' source", "0L n_chars")).collect()
    assert {r["doc_id"]: r["text"] for r in masked}[40] == "My call phone line <phone> is odd."


def test_texts_without_digits_count_against_a_context(spark):
    rows = [(i, f"Please call phone line +1 555 010 {1000 + i} now.") for i in range(30)]
    rows += [(100 + i, "Any phone line hums at night.") for i in range(60)]
    rows += [(40, "My call phone line 5550104444 is odd.")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(frame).collect()}
    assert found[40] == []


def test_found_identifiers_lead_to_new_contexts_and_whole_spans(spark):
    unseen = [f"55501044{i:02d}" for i in range(5)]
    texts = [f"Please call phone line +1 555 010 {1000 + i} now." for i in range(300)]
    texts += [f"My call phone line {u} is odd." for u in unseen]
    texts += [f"Try the fax desk {u} at noon." for u in unseen for _ in range(4)]
    texts += [f"Phone: +1 555 020 {1000 + i} is mine." for i in range(30)]
    first = len(texts)
    texts += ["Try the fax desk 0307776666 at noon.", "Try phone line (030) 1234 5678 at noon.", "Phone: 5550209999 is mine.", "In phone line 5550104477, 12 of 30 said."]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    masked = pii.clean_documents(frame.selectExpr("*", "'en' lang", "'a' source", "0L n_chars")).where(f"doc_id >= {first}").collect()
    assert [r["text"] for r in sorted(masked)] == [
        "Try the fax desk <phone> at noon.", "Try phone line <phone> at noon.", "Phone: <phone> is mine.", "In phone line <phone>, 12 of 30 said."
    ]
    found = {r["doc_id"]: r for r in pii.find_personal_data(frame).where(f"doc_id >= {first}").collect()}
    for i, row in found.items():
        assert all(texts[i][s["start"]:s["end"]] == s["value"] for s in row["spans"])


def test_pii_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    for row in QUERIES["op6_pii"](spark, MIDDLE).collect():
        base = base_spans(texts[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert {*base.split(",")} - {""} <= {*row["spans"].split(",")}


def test_tokens_equal_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for row in QUERIES["op4_bpe_round_trip"](spark, SMALL).collect():
        ids = library.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        back = library.decode(ids, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_tokens_on_noise():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mine = bpe.tokenizer("byte_bpe_50k.json")
    rng = random.Random(3)
    for _ in range(3_000):
        text = "".join(rng.choice("aA1 \n\t'é字🙂<|endoftext|>s. \x1c\x85\xa0") for _ in range(rng.randint(0, 30)))
        text += "<|endoftext|>" * (rng.random() < 0.2)
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == ids
        assert mine.decode(mine.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_windows_against_brute_force():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(6)]
    for _ in range(200):
        items = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(4)]
        text = [rng.choice(words) for _ in range(60)]
        spans, found = decontaminate.occurrences(decontaminate.words_of(" ".join(text)), decontaminate.matchers(items, 5))
        hit, expected = set(), set()
        for number, item in enumerate(items):
            own = item.split()
            size = min(5, len(own))
            for i in range(len(own) - size + 1 if size else 0):
                for j in range(len(text) - size + 1):
                    if text[j:j + size] == own[i:i + size]:
                        hit |= set(range(j, j + size))
                        expected.add(number)
        assert found == expected and {p for a, b in spans for p in range(a, b)} == hit


def test_passes_give_the_same_hits(spark):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    one = decontaminate.decontaminate(docs, bench).collect()
    many = decontaminate.decontaminate(docs, bench, pass_bytes=2_000).collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and any(r["n_hit"] for r in one)


def near_truth(texts, size=2, percent=80):
    """Components by comparing all pairs."""
    sets = {}
    for key, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        k = min(size, len(words))
        sets[key] = {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set()
    label = {k: k for k in texts}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(sorted(k for k in sets if sets[k]), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {k: root(k) for k in texts}


def test_near_duplicates_of_a_large_loose_group(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(5_000)}" for _ in range(60)]
    texts = {}
    for i in range(260):
        words = list(base)
        for _ in range(rng.randint(2, 9)):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    for i in range(260, 330):
        texts[i] = " ".join(f"w{rng.randrange(5_000)}" for _ in range(rng.randint(1, 40)))
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame, words_per_shingle=2).collect()}
    assert found == near_truth(texts)


def test_components_of_paths_and_hubs(spark):
    rng = random.Random(2)
    chain = list(range(40))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 299), (None, 5)]
    frame = spark.createDataFrame(edges, "u bigint, v bigint")
    found = {r["id"]: r["component"] for r in components.components(frame).collect()}
    assert found == {**{i: 0 for i in range(40)}, **{i: 100 for i in range(100, 160)}, 300: 299, 299: 299}
    assert components.components(frame.limit(0)).count() == 0


def test_repeated_words_by_sort_and_by_list(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("ab") + rng.choice("cdef") for _ in range(rng.randint(0, 200))) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")

    def brute(text):
        w = text.split()
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i:i + 3])].append(i)
        return len({p for starts in at.values() if len(starts) > 1 for i in starts for p in range(i, i + 3)})

    for bound in (0, 32, 10**6):
        monkeypatch.setattr(quality_rules, "LOOKED_UP", bound)
        for row in quality_rules.quality_rules(frame).collect():
            assert row["n_repeat_words"] == brute(texts[row["doc_id"]])


def test_differencing_is_tight_and_whole():
    rng = random.Random(4)
    sizes = [rng.randint(1, 10_000) for _ in range(4_000)] + [1_000_000]
    placed = shards.differencing(sizes, 24)
    sums = [0] * 24
    for size, shard in zip(sizes, placed, strict=True):
        sums[shard] += size
    assert sum(sums) == sum(sizes) and max(sums) == 1_000_000
    rest = sorted(sums)[:-1]
    assert rest[-1] - rest[0] <= 30
    assert shards.differencing([4, 5, 6, 7, 8], 2).count(0) in (2, 3)
    assert shards.differencing([], 24) == []


def test_shards_balance_bytes(spark):
    rows = QUERIES["op10_shards"](spark, MIDDLE).collect()
    sums = defaultdict(int)
    for r in rows:
        sums[r["shard"]] += r["size"]
    assert len(sums) == 24 and max(sums.values()) - min(sums.values()) <= 64
    for shard in sums:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    home = {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        assert home.setdefault(raw, r["shard"]) == r["shard"]


def test_kernel_against_enumeration():
    def brute(a, b):
        a, b = f"\x02{a}\x03", f"\x02{b}\x03"
        weights = [defaultdict(float), defaultdict(float)]
        for word, w in zip((a, b), weights, strict=True):
            for where in combinations(range(len(word)), toxicity.LENGTH):
                w["".join(word[i] for i in where)] += float(toxicity.DECAY) ** (where[-1] - where[0] + 1)
        return sum(v * weights[1][k] for k, v in weights[0].items())

    words = ["idiot", "i.diot", "clown", "scum", "abc", "toto"]
    found = toxicity.subsequence_kernel(toxicity.coded(words, -1), toxicity.coded(words, -2))
    expected = np.array([[brute(a, b) for b in words] for a in words])
    assert np.allclose(found, expected, rtol=1e-4)
    assert np.allclose(toxicity.self_kernel(toxicity.coded(words, -1)), expected.diagonal(), rtol=1e-4)


def test_units():
    assert toxicity.units('You I D I O T, "Clown"! so-so') == ["you", "idiot", "clown", "so-so"]
    assert len(toxicity.units("a" * 100)) == 8 and toxicity.units("") == []
    assert toxicity.units("st up id 傻逼") == ["st", "up", "id", "傻逼", "stupid傻逼"] and toxicity.units("an x") == ["an", "anx"]


def test_many_unlike_insults_are_all_learned():
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choices(letters, k=9))
    insults = {word("abcdefghijklmnopqrstuvwxyz"): 12 for _ in range(200)}
    clean = {word("abcdefghijklmnopqrstuvwxyz"): 12 for _ in range(2000)}
    names = list(insults)
    # Each insult is taught plain and with one inserted character; others are inserted elsewhere.
    machine = toxicity.fit_machine(insults | {w[:6] + "x" + w[6:]: 4 for w in names}, clean)
    assert len(machine.landmarks) >= 200
    gapped = [w[:4] + "*" + w[4:] for w in names]
    fresh = machine.decide([word("abcdefghijklmnopqrstuvwxyz") for _ in range(1000)])
    assert (machine.decide(names) > 0).mean() >= 0.97 and (fresh > 0).mean() <= 0.02
    # Unseen spellings rank above clean words; where the score of 0.5 lies is up to the calibration.
    assert (machine.decide(gapped) > np.quantile(fresh, 0.99)).mean() >= 0.9


@pytest.mark.parametrize(("name", "label", "least"), [("op2_toxicity_svm", "toxic", 0.9), ("op5_quality_qda", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    rows = QUERIES[name](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id")
    held = rows.where("held_out").select("doc_id", "predicted", label).collect()
    parts, left = (5, 0) if label == "toxic" else (3, 1)
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % parts == left for r in held)
    assert sum(r["predicted"] == r[label] for r in held) / len(held) >= least


def test_main_text_of_the_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{MIDDLE}/pages.parquet").collect()}
    for row in QUERIES["op3_main_text"](spark, MIDDLE).collect():
        article = re.search(r"(?s)<article>(.*)</article>", pages[row["page_id"]])[1]
        blocks = re.split(r"</?(?:p|h1|br)>", re.sub("</?b>", "", article))
        expected = " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert row["text"] == expected and row["n_chars"] == len(expected)


def test_wrapper_learns_a_constant_block(spark):
    def page(i):
        return (f"<body><div><p>Welcome to our site</p></div><div><p>Story {i} begins here today</p>"
                f"<p>It ends with {i} words</p></div><div><p>Call us any time</p></div></body>")

    from fieldglass.llm import wrapper

    rows = [(i, f"https://plain.example/{i}", page(i)) for i in range(12)]
    found = wrapper.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert {r["page_id"]: r["text"] for r in found.collect()} == {
        i: f"Story {i} begins here today It ends with {i} words" for i in range(12)
    }


def test_matching_keeps_order_and_prefers_equal_texts():
    pivot = html_tree.parse("<div><p>a</p><p>same</p></div>")
    page = html_tree.parse("<div><p>new</p><p>b</p><p>same</p></div>")
    pairs = html_tree.Matching(pivot, page).texts()
    assert ("same", "same") in {(pivot.text[a], page.text[b]) for a, b in pairs} and len(pairs) == 2


def test_signature_slack_is_five_standard_errors():
    assert near_dup.SIGNATURE_SLACK >= 5 * (0.8 * 0.2 / 512) ** 0.5


def test_found_identifiers_look_like_their_kind(spark):
    seeds = [(i, f"Phone line +49301234{i:04d} is busy.") for i in range(60)]
    others = [(100, "Phone line 12 is busy."), (101, "Phone line (030) 123 4567 is busy."), (102, "Phone line a@b is busy.")]
    frame = spark.createDataFrame([*seeds, *others], "doc_id bigint, text string")
    spans = {r["doc_id"]: [(s["kind"], s["value"]) for s in r["spans"]] for r in pii.find_personal_data(frame).collect()}
    assert spans[100] == [] and spans[102] == [] and spans[101] == [("phone", "(030) 123 4567")]
    assert all(len(spans[i]) == 1 for i in range(60))


def _main_texts(spark, rows, **options):
    from fieldglass.llm import wrapper

    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return [r["text"] for r in wrapper.extract_main_text(pages, **options).orderBy("page_id").collect()]


def _stories(count, seed=5):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(30)) for _ in range(count)]


@pytest.mark.parametrize("hints", [True, False])
def test_main_text_by_alignment_alone(spark, hints):
    stories = _stories(24)
    rows = [(i, f"http://a.b/{i}", f"<div>Menu</div><div><p>{x}</p></div><div>Call us</div>") for i, x in enumerate(stories)]
    assert _main_texts(spark, rows, hints=hints) == stories


def test_main_text_where_names_mislead(spark):
    stories = _stories(12)
    article = "<div>Always here</div><article class='post comments-open category-social'><p>{}</p></article>"
    framed = "<div class='layout with-sidebar'><div>Top</div><main><p>{}</p></main></div>"
    teaser = "<div>Always here</div><div><p>{}</p></div><article class=teaser>Teaser card</article>"
    sidebar = "<div>Always here</div><div class=widget><p>{}</p></div>"
    for page in (article, framed, teaser, sidebar):
        assert _main_texts(spark, [(i, f"http://a.b/{i}", page.format(x)) for i, x in enumerate(stories)]) == stories


def test_reader_comments_are_no_content_however_long(spark):
    page = "<article><p>{}</p></article><div class='comments'><article class='comment'>{}</article></div>"
    stories = _stories(12)
    rows = [(i, f"http://a.b/{i}", page.format(x, x[::-1] * 5)) for i, x in enumerate(stories)]
    assert _main_texts(spark, rows) == stories


def test_wrapper_of_two_layouts_and_empty_pages(spark):
    stories = _stories(24)
    one, two = "<div>Always here</div><p>{}</p>", "<table><tr><td>Stock</table><section><p>{}</p></section><div>Call us</div>"
    rows = [(i, f"http://a.b/{i}", (two if i % 2 else one).format(x)) for i, x in enumerate(stories)]
    rows += [(90, "http://a.b/x", ""), (91, "http://a.b/y", None), (92, "http://a.b/z", "<p> </p>")]
    assert _main_texts(spark, rows) == [*stories, "", "", ""]


def test_texts_that_rotate_through_a_slot_are_template(spark):
    stories = _stories(60)
    offers = _stories(6, seed=6)
    rows = [(i, f"http://a.b/{i}", f"<div>{offers[i % 6]}</div><p>{x} {x}</p>") for i, x in enumerate(stories)]
    assert _main_texts(spark, rows, hints=False) == [f"{x} {x}" for x in stories]


def test_copies_say_nothing_about_the_template(spark):
    stories = _stories(12)
    page = "<div>Always here</div><p>{}</p>"
    rows = [(i, f"http://a.b/{i}", page.format(x)) for i, x in enumerate(stories + [stories[0]] * 4)]
    assert _main_texts(spark, rows) == stories + [stories[0]] * 4


def test_statistics_look_at_whole_lines():
    from fieldglass.llm.quality_qda import FEATURES, statistics

    ends = FEATURES.index("sentence_ends")
    assert statistics("A long line ends." + '"' * 20 + " " * 20)[ends] == statistics("A long line ends.")[ends]
    assert statistics("No end")[ends] < statistics("An end.")[ends]
