"""Main text of web pages by wrapper induction over the pages of a host.

Pages of a host that are made up of the same elements form a layout.  One pivot
page per layout is aligned with all its other pages by simple tree matching.
Text nodes that stay the same while the rest of the page changes are template, and so
are slots through which a few texts rotate; varying slots are content.  Names of elements and classes only sort the varying
slots (article, menu, comments), and stand alone where a host gives no evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldglass.llm.common import discard, landed
from fieldglass.llm.html_tree import HINTED, PLAIN, Matching, Tree, from_skeleton, parse

#: A text node is template if at least so many pages that are no copies of the pivot were aligned ...
LEAST_PAGES = 4
LEAST_PAGES_MAIN = 8
#: ... and at least this share of them has the same text there.
CONSTANT = 0.6
CONSTANT_MAIN = 0.9
#: A slot whose different texts are at most this part of the different pages (by their longest text) rotates.
ROTATING = 0.5
#: A page that shares more than this of what is the pivot's own is a copy and says nothing about the template.
COPY = 0.5
#: What a page shares with the pivot anyway: this quantile of the shared characters over the layout's pages.
COMMON_QUANTILE = 0.1
#: Layouts in which pages share more than this part of the pivot anyway give no evidence.
ALL_ALIKE = 0.9
#: Without a marked article, blocks with more than this share of link text are menus.
LINK_SHARE = 0.5
#: A marked article is a teaser if the varying text outside is more than so many times as long.
TEASER = 3

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


@lru_cache(maxsize=64)
def _tree(skeleton: str) -> Tree:
    return from_skeleton(skeleton)


def parsed(pages: DataFrame, hints: bool) -> DataFrame:
    """Every page's tree from rows (page_id, url, html, host): page_id, url, host, layout, skeleton, texts."""
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layouts, skeletons, texts = [], [], []
            for page in batch.column(2):
                tree = parse(page.as_py(), hints)
                layouts.append(tree.layout())
                skeletons.append(tree.skeleton())
                texts.append([t for t in tree.text if t])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(layouts, pa.int64()),
                 pa.array(skeletons, pa.string()), pa.array(texts, pa.list_(pa.string()))],
                names=["page_id", "url", "host", "layout", "skeleton", "texts"],
            )

    schema = f"page_id {kind}, url string, host string, layout bigint, skeleton string, texts array<string>"
    return pages.select("page_id", "url", "html", "host").mapInArrow(run, schema)


def pivots_of(trees: DataFrame) -> DataFrame:
    """The pivot of every host and layout: host, layout, chosen (the pivot's layout), pivot (its skeleton).

    Pivots have texts.  Layouts of few pages are aligned with the pivot of the
    host's largest layout.
    """
    order = F.struct(F.xxhash64("url", "skeleton"), "skeleton")
    full = F.size("texts") > 0
    own = landed(trees.groupBy("host", "layout").agg(
        F.count(F.when(full, 1)).alias("pages"), F.min_by(F.when(full, F.col("skeleton")), F.when(full, order)).alias("pivot")
    ), "layouts")
    largest = own.where("pages > 0").groupBy("host").agg(
        F.max_by(F.struct(F.col("layout").alias("main"), F.col("pivot").alias("main_pivot")), F.struct("pages", "layout")).alias("m")
    ).select("host", "m.*")
    rare = F.col("pages") < LEAST_PAGES_MAIN
    return own.join(largest, "host").select(
        "host", "layout", F.when(rare, F.col("main")).otherwise(F.col("layout")).alias("chosen"),
        F.when(rare, F.col("main_pivot")).otherwise(F.col("pivot")).alias("pivot"),
    )


def aligned(trees: DataFrame, pivots: DataFrame) -> DataFrame:
    """Pages beside what they share with their pivot: page_id, url, host, chosen, skeleton, texts, total, kept, copy,
    longest (hash of the longest text), seen (aligned text nodes of the pivot), there (their places in the page),
    marks (their text hashes there) and equal (whether they are the pivot's)."""
    kind = dict(trees.dtypes)["page_id"]
    kept_columns = ["page_id", "url", "host", "chosen", "skeleton", "texts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, kept, copies, longest = [], [], [], []
            lists: tuple[list, ...] = ([], [], [], [])
            for pivot_lines, lines in zip(batch.column(6).to_pylist(), batch.column(4).to_pylist(), strict=True):
                pairs: list[tuple[int, int]] = []
                equal: list[bool] = []
                total, copy, page = 0, False, from_skeleton(lines)
                if pivot_lines is not None:
                    pivot = _tree(pivot_lines)
                    pairs = sorted(Matching(pivot, page).texts())
                    equal = [pivot.mark[a] == page.mark[b] for a, b in pairs]
                    total = sum(pivot.length)
                    copy = is_copy(pivot, [a for (a, _), e in zip(pairs, equal, strict=True) if e])
                totals.append(total)
                kept.append(sum(pivot.length[a] for (a, _), e in zip(pairs, equal, strict=True) if e))
                copies.append(copy)
                longest.append(max(zip(page.length, page.mark))[1])
                for out, found in zip(
                    lists, ([a for a, _ in pairs], [b for _, b in pairs], [page.mark[b] for _, b in pairs], equal),
                    strict=True,
                ):
                    out.append(found)
            numbers = [pa.array(x, pa.list_(pa.int64())) for x in lists[:3]]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(6)), pa.array(totals, pa.int64()), pa.array(kept, pa.int64()),
                 pa.array(copies, pa.bool_()), pa.array(longest, pa.int64()), *numbers,
                 pa.array(lists[3], pa.list_(pa.bool_()))],
                names=[*kept_columns, "total", "kept", "copy", "longest", "seen", "there", "marks", "equal"],
            )

    both = trees.join(pivots, ["host", "layout"], "left").select(*kept_columns, "pivot")
    return both.mapInArrow(
        run, f"page_id {kind}, url string, host string, chosen bigint, skeleton string, texts array<string>, total bigint,"
        " kept bigint, copy boolean, longest bigint, seen array<bigint>, there array<bigint>, marks array<bigint>,"
        " equal array<boolean>",
    )


def is_copy(pivot: Tree, same: list[int]) -> bool:
    """Whether most of the texts that the pivot marks as its main region come back unchanged; no, if that is none or a teaser."""
    top = max(pivot.main)
    own = [i for i, main in enumerate(pivot.main) if main == top and pivot.label[i] == "#"]
    size = sum(pivot.length[i] for i in own)
    if not top or sum(pivot.length) - size > TEASER * size:
        return False
    return sum(pivot.main[a] == top for a in same) > COPY * len(own)


def templates(pages: DataFrame) -> DataFrame:
    """The template of every pivot: host, chosen and arrays of its nodes, at most those of one page: constant (template
    where the text is the pivot's), firm (the same, sure enough for a main region) and rotating (template whatever the text).

    A page counts unless it shares most of what pages of its layout do not share
    with the pivot anyway.
    """
    usual = pages.groupBy("host", "chosen").agg(F.percentile_approx("kept", COMMON_QUANTILE, 1000).alias("usual"))
    usual = usual.select(F.col("host").alias("h"), F.col("chosen").alias("c"), "usual")
    usable = pages.where("not copy").join(usual, (F.col("host") == F.col("h")) & (F.col("chosen") == F.col("c"))).where(
        (F.col("usual") <= ALL_ALIKE * F.col("total"))
        & (F.col("kept") - F.col("usual") <= COPY * (F.col("total") - F.col("usual")))
    )
    slots = usable.select("host", "chosen", "longest", F.explode(F.arrays_zip("seen", "marks", "equal")).alias("slot"))
    nodes = slots.groupBy("host", "chosen", F.col("slot.seen").alias("node")).agg(
        F.count("*").alias("pages"), F.count_if("slot.equal").alias("same"),
        F.approx_count_distinct("slot.marks").alias("texts"), F.approx_count_distinct("longest").alias("different"),
    )
    constant = (F.col("pages") >= LEAST_PAGES) & (F.col("same") >= CONSTANT * F.col("pages"))
    firm = (F.col("pages") >= LEAST_PAGES_MAIN) & (F.col("same") >= CONSTANT_MAIN * F.col("pages"))
    rotating = (F.col("different") >= LEAST_PAGES_MAIN) & (F.col("texts") <= ROTATING * F.col("different"))
    return nodes.where(constant | rotating).groupBy("host", "chosen").agg(*(
        F.array_sort(F.collect_list(F.when(test, F.col("node")))).alias(name)
        for name, test in (("constant", constant), ("firm", firm), ("rotating", rotating))
    ))


def content(page: Tree, texts: list[str], template: set[int], firm: set[int]) -> str:
    """The main text: varying slots, of which the article's are taken where the page marks one that is no teaser.

    ``template`` are the page's nodes with a constant text, ``firm`` those that are constant even for a main region.
    Names that hint at furniture hold unless the varying text under them is longer than all other.
    """
    blocks = [i for i, label in enumerate(page.label) if label == "#"]
    text = dict(zip(blocks, texts, strict=True))
    varying = [i for i in blocks if i not in (firm if page.main[i] else template)]

    def size(nodes: list[int]) -> int:
        return sum(page.length[i] for i in nodes if page.linked[i] <= LINK_SHARE * page.length[i])

    free = [i for i in varying if page.furniture[i] == PLAIN]
    hinted = [i for i in varying if page.furniture[i] == HINTED]
    if template and size(hinted) > size(free):
        free = sorted(free + hinted)
    top = max((page.main[i] for i in free), default=0)
    inside = [i for i in free if page.main[i] == top]
    outside = [i for i in free if not page.main[i] and page.linked[i] <= LINK_SHARE * page.length[i]]
    if not top or size(outside) > TEASER * sum(page.length[i] for i in inside):
        inside = outside
    return " ".join(text[i] for i in inside)


def extract_main_text(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", hints: bool = True
) -> DataFrame:
    """Main text of every page, one row per row: page_id, url, text.

    The wrapper of a layout comes from all its pages but copies of the pivot.  The
    joins are plain equi-joins next to their exchange, so that a host with a third
    of all pages is split by adaptive execution, and nothing of a host is gathered
    but counts per node of its pivots.  Without ``hints``, element and class names
    are not used at all.

    Null or empty pages give "".  Pages without a host form one group.  Repeated
    rows keep a row each and count as copies.  Other columns are left out; an
    empty table gives an empty one.
    """
    kind = dict(pages.dtypes)[id_column]
    plain = pages.select(
        F.col(id_column).alias("page_id"), F.col(url_column).alias("url"),
        F.coalesce(F.col(html_column), F.lit("")).alias("html"),
        F.lower(F.coalesce(F.regexp_extract(F.col(url_column), HOST, 1), F.lit(""))).alias("host"),
    )
    trees = landed(parsed(plain, hints), "trees", "zstd")
    pivots = landed(pivots_of(trees), "pivots")
    shared = landed(aligned(trees, pivots), "aligned", "zstd")
    discard(trees)
    wrappers = landed(templates(shared), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 10)), strict=True)
            for lines, texts, seen, there, equal, constant, firm, rotating in rows:
                constant, firm, rotating = set(constant or ()), set(firm or ()), set(rotating or ())
                places = list(zip(seen, there, equal, strict=True))
                template = {b for a, b, same in places if a in rotating or same and a in constant}
                out.append(content(from_skeleton(lines), texts, template, {b for a, b, same in places if same and a in firm}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"]
            )

    joined = shared.join(wrappers, ["host", "chosen"], "left").select(
        "page_id", "url", "skeleton", "texts", "seen", "there", "equal", "constant", "firm", "rotating"
    )
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string")
