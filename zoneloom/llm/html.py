"""Main text of web pages by wrapper induction.

Pages of a host are aligned by simple tree matching. The trees of all its pages, with runs of like siblings folded into
one, are merged into the host's wrapper; a wrapper node is a slot that text of many pages falls into. A slot's text that
stands on many different pages is template; slots whose text varies are content, but for those inside elements that
are boilerplate by their kind (menus, adverts, forms) or that hold little but links.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from zoneloom.session import cut_lineage

TEMPLATE_SHARE = 0.5  # of a slot's different pages that repeat a text before it is template
TEMPLATE_PAGES, NAMED_PAGES = 2, 3  # different pages, at least; within article or main elements
NAMED_SHARE = 0.5  # of a page's varying text in article or main elements, from which what is outside them is left out
DEPTH = 150  # levels of elements that trees tell apart; deeper ones share the slot of the one at this level
LINK_SHARE = 0.6  # of a slot's characters inside links, from which it is navigation
FOLD = 400  # trees that one task merges; more of a host are merged in rounds
BROADCAST_BYTES = 16 << 20  # wrappers that are sent to every task; larger ones are joined by host

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template title iframe object svg canvas math".split())
BLOCKS = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("nav header footer aside form button select textarea menu dialog label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
# Words of class or id names that mark boilerplate. Fixed values.
MARKS = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|login|menu|modal|nav|navbar|navigation|newsletter|"
    r"notices?|pagination|popup|promo\w*|related|replies|reply|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[^a-z])"
)
CLOSED_BY = {
    "p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
SCOPES = frozenset("article section div table ul ol body main aside nav header footer form td th blockquote".split())


class _Page(HTMLParser):
    """Blocks of text in page order: ``(path, text, characters in links)``; a path lists elements from the root."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[str] = []
        self.hidden = 0
        self.links = 0
        self.muted = 0
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[tuple[str, ...], str, int]] = []

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            path = [n for n in self.path if _tag(n) in BLOCKS]
            if len(path) > DEPTH:
                path[DEPTH - 1 :] = [next((n for n in path[DEPTH - 1 :] if n.endswith("-")), path[DEPTH - 1])]
            self.blocks.append((tuple(path), text, self.linked))
        self.parts, self.linked = [], 0

    def _pop(self, to: int) -> None:
        for node in reversed(self.path[to:]):
            tag = _tag(node)
            if tag in BLOCKS:
                self._flush()
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"
            self.muted -= node.endswith("-") and tag not in BLOCKS
            self.path.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for i in range(len(self.path) - 1, -1, -1):
            above = _tag(self.path[i])
            if tag in CLOSED_BY.get(above, ()):
                self._pop(i)
                break
            if above in SCOPES:
                break
        if tag in BLOCKS:
            if tag != "html" and "head" in self.path:  # its end may be left out
                self._pop(self.path.index("head"))
            self._flush()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        named = dict(attrs)
        mark = re.sub("(?<=[a-z])(?=[A-Z])", "-", " ".join(filter(None, (named.get("class"), named.get("id"))))).lower()
        hint = "-" if tag in BOILERPLATE or (named.get("role") or "").lower() in ROLES or "hidden" in named or MARKS.search(mark) else ""
        self.path.append(f"{tag}.{re.sub('[0-9]+', '', mark)}{hint}" if mark or hint else tag)
        self.hidden += tag in HIDDEN
        self.links += tag == "a"
        self.muted += bool(hint) and tag not in BLOCKS  # marked parts of a block: the block goes on behind them

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.path) - 1, -1, -1):
            if _tag(self.path[i]) == tag:
                self._pop(i)
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden and not self.muted:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self._pop(0)
        self._flush()


def _tag(node: str) -> str:
    return node.partition(".")[0]


def page_blocks(html: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page.blocks


# A tree is a list: name, then its children. Like neighbours among the children are folded into one.
def tree_of(paths: list[tuple[str, ...]]) -> list:
    """The folded tree of a page from the paths of its blocks."""
    root: list = [""]
    for path in paths:
        node = root
        for name in path:
            if len(node) > 1 and node[-1][0] == name:
                node = node[-1]
            else:
                same = next((c for c in node[1:] if c[0] == name), None)
                if same is None:
                    same = [name]
                    node.append(same)
                node = same
    return root


def match(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the most nodes that two trees with the same root share in order, and the pairs of children."""
    if a[0] != b[0]:
        return 0, []
    m, n = len(a), len(b)
    best = [[0] * n for _ in range(m)]
    gain = [[0] * n for _ in range(m)]
    for i in range(1, m):
        for j in range(1, n):
            gain[i][j] = match(a[i], b[j])[0] if a[i][0] == b[j][0] else 0
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + gain[i][j])
    pairs, i, j = [], m - 1, n - 1
    while i and j:
        if gain[i][j] and best[i][j] == best[i - 1][j - 1] + gain[i][j]:
            pairs.append((i, j))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m - 1][n - 1] + 1, pairs[::-1]


def merge(wrapper: list, tree: list) -> list:
    """The wrapper with the tree's nodes that it lacks, each behind the child that stands before it."""
    pairs = {j: i for i, j in match(wrapper, tree)[1]}
    children, added = list(wrapper[1:]), []
    last = 0
    for j in range(1, len(tree)):
        if j in pairs:
            last = pairs[j]
            children[last - 1] = merge(wrapper[last], tree[j])
        else:
            added.append((last, tree[j]))
    for after, child in reversed(added):
        children.insert(after, child)
    return [wrapper[0], *children]


def slots_of(wrapper: list, tree: list) -> dict[tuple[str, ...], str]:
    """For each path of a folded page tree the name of its wrapper slot: the numbers of children from the root."""
    found: dict[tuple[str, ...], str] = {(): ""}

    def walk(w: list, t: list, path: tuple[str, ...], slot: str) -> None:
        found[path] = slot
        for i, j in match(w, t)[1]:
            walk(w[i], t[j], (*path, t[j][0]), f"{slot}/{i}")

    walk(wrapper, tree, (), "")
    return found


def _text_key(text: str) -> int:
    return int(np.uint64(xxh64_intdigest(text.encode())).view(np.int64))


def _host(url: str | None) -> str:
    found = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", url or "")
    return found[1].lower() if found else ""


@lru_cache(maxsize=4096)
def _slots(wrapper: str, tree: str) -> dict[tuple[str, ...], str]:
    return slots_of(json.loads(wrapper), json.loads(tree))


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page and path: its host, folded tree, the key of each text, of all the page's texts, and the link share."""
    names = ["host", "tree", "path", "text", "page", "size", "linked"]
    for batch in batches:
        rows: list[tuple] = []
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            blocks = page_blocks(html)
            if not blocks:
                continue
            host, tree = _host(url), json.dumps(tree_of([b[0] for b in blocks]), separators=(",", ":"))
            page = _text_key("\n".join(b[1] for b in blocks))
            rows += [(host, tree, json.dumps(p, separators=(",", ":")), _text_key(t), page, len(t), linked) for p, t, linked in blocks]
        columns = list(zip(*rows)) or [()] * len(names)
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def induce_wrappers(trees: DataFrame) -> DataFrame:
    """``(host, wrapper)`` from distinct ``(host, tree)``: in each round a task merges some ``FOLD`` trees of a host, in
    the order of their text, until every host has one left."""
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = sorted(rows["tree"])
        wrapper = json.loads(ordered[0])
        for tree in ordered[1:]:
            wrapper = merge(wrapper, json.loads(tree))
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "tree": [json.dumps(wrapper, separators=(",", ":"))]})

    while True:
        counts = trees.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        parts = trees.join(counts, "host").withColumn("part", F.pmod(F.xxhash64("tree"), F.ceil(F.col("n") / FOLD)))
        trees = cut_lineage(parts.select("host", "part", "tree").groupBy("host", "part").applyInPandas(fold, "host string, tree string").distinct())
        if trees.groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            return trees.withColumnRenamed("tree", "wrapper")


def _slot_names(rows: DataFrame) -> DataFrame:
    """Adds the slot of distinct ``(host, tree, path)`` rows with their host's ``wrapper``."""
    @F.pandas_udf("string")
    def slot(wrappers: pd.Series, trees: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([_slots(w, t).get(tuple(json.loads(p))) for w, t, p in zip(wrappers, trees, paths)], dtype=object)

    return rows.withColumn("slot", slot("wrapper", "tree", "path"))


def induce(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(host, wrapper, templates, navigation)``: per host its tree, the ``slot:text`` keys that are template, and the
    slots that hold little but links.

    A text counts once for all pages with the same texts, so copies of a page do not make a template.
    """
    facts = pages.select(F.col(url).alias("u"), F.col(html).alias("h")).mapInArrow(
        _facts, "host string, tree string, path string, text bigint, page bigint, size bigint, linked bigint"
    )
    seen = cut_lineage(facts.groupBy("host", "tree", "path", "text", "page").agg(F.sum("size").alias("size"), F.sum("linked").alias("linked")))
    wrappers = cut_lineage(induce_wrappers(cut_lineage(seen.select("host", "tree").distinct())))
    places = cut_lineage(_slot_names(seen.select("host", "tree", "path").distinct().join(wrappers, "host")).select("host", "tree", "path", "slot"))
    filled = seen.join(places, ["host", "tree", "path"])
    named = F.max(F.col("path").rlike(r'"(article|main)[".]')).alias("named")
    per_page = filled.groupBy("host", "slot", "text", "page").agg(F.sum("size").alias("size"), F.sum("linked").alias("linked"), named)
    per_text = cut_lineage(per_page.groupBy("host", "slot", "text").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("size").alias("size"), F.sum("linked").alias("linked"), F.max("named").alias("named")
    ))
    slot_pages = filled.select("host", "slot", "page").distinct().groupBy("host", "slot").agg(F.count(F.lit(1)).alias("all_pages"))
    often = per_text.filter(F.col("pages") >= F.when(F.col("named"), NAMED_PAGES).otherwise(TEMPLATE_PAGES)).join(slot_pages, ["host", "slot"]).filter(F.col("pages") >= TEMPLATE_SHARE * F.col("all_pages"))
    # A slot has at most 1 / TEMPLATE_SHARE such texts, so these arrays are bounded by the wrapper.
    templates = often.groupBy("host").agg(F.collect_set(F.concat_ws(":", "slot", "text")).alias("templates"))
    slots = per_text.groupBy("host", "slot").agg((F.sum("linked") >= LINK_SHARE * F.sum("size")).alias("navigation"))
    navigation = slots.filter("navigation").groupBy("host").agg(F.collect_set("slot").alias("navigation"))
    return wrappers.join(templates, "host", "left").join(navigation, "host", "left")


def main_text(html: str | None, wrapper: str | None, templates: frozenset[str], navigation: frozenset[str]) -> str:
    """The content blocks of a page, one per line."""
    blocks = page_blocks(html)
    if not blocks:
        return ""
    tree = json.dumps(tree_of([b[0] for b in blocks]), separators=(",", ":"))
    slots = _slots(wrapper, tree) if wrapper else {}
    varying = []
    for path, text, _ in blocks:
        slot = slots.get(path)
        if slot is None or (slot not in navigation and f"{slot}:{_text_key(text)}" not in templates):
            varying.append((path, text))
    content = [c for c in varying if not any(name.endswith("-") for name in c[0])]
    if not content:  # names of classes can mislead, so they do not empty a page
        content = [c for c in varying if not any(_tag(name) in BOILERPLATE for name in c[0])]
    # Where most of it is in the page's article or main part, text outside that is not content.
    named = [c for c in content if any(_tag(n) in ("article", "main") for n in c[0])]
    if sum(len(t) for _, t in named) >= NAMED_SHARE * sum(len(t) for _, t in content):
        content = named
    return "\n".join(text for _, text in content)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(key, url, text, n_chars)`` per row. Null, empty and textless pages give the empty text.

    Pages without a host form a host of their own; a page that shares its host with no different page has no template
    and keeps every block that its elements do not mark as boilerplate.
    """
    learnt = cut_lineage(induce(pages, url, html))
    size = learnt.agg(F.sum(F.length("wrapper") + F.coalesce(F.length(F.array_join("templates", ",")), F.lit(0)))).first()[0] or 0
    # The host is found in SQL here, by the same rule as _host.
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("h"), host.alias("host"))
    joined = rows.join(F.broadcast(learnt) if size <= BROADCAST_BYTES else learnt, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            texts = []
            for html, host, row in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), range(batch.num_rows)):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = (batch.column(4)[row].as_py(), *(frozenset(batch.column(c)[row].as_py() or ()) for c in (5, 6)))
                texts.append(main_text(html, *known[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["k", "u", "text"])

    made = joined.select("k", "u", "h", "host", "wrapper", "templates", "navigation").mapInArrow(
        run, f"k {rows.schema['k'].dataType.simpleString()}, u string, text string"
    )
    return made.select(F.col("k").alias(key), F.col("u").alias(url), "text", F.length("text").cast("bigint").alias("n_chars"))
