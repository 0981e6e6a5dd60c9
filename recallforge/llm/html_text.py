"""Op 6, HTML extraction by wrapper induction: the trees of a host's pages are aligned, constant nodes are template.

Every task folds its pages into one small wrapper tree per host; the partial wrappers of a host are then folded into
one.  Like siblings are one node, so a level is aligned by signature, in any order of siblings.  A wrapper node holds
the digests of the texts that all its pages have below it, and of up to ``SURE`` different pages it was on.  A page is
aligned with its host's wrapper, and blocks equal to a constant text of their node are dropped, in a marked article
too.  On a host of fewer pages than ``SURE``, which may be near copies of one another, that holds only if constant
texts are under half of its blocks; else they stay.  Menus, headers, footers, sidebars, notices, adverts, forms and
comments are dropped by their marks; of a page with a marked article that article is kept, of others all blocks that
are left.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, slices

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*)>""", re.S)
CLASS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var wbr ins del nobr math mi mo mn ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mtable mtr mtd semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe svg select button".split())
DROPPED = frozenset("nav footer aside form head header menu dialog".split())
MARKS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus share social related newsletter subscribe popup modal widget complementary contentinfo banner".split())
MAIN = frozenset(("article", "main"))
#: Elements that hold the article whatever their names say, and beginnings of names that tell of other elements.
HOLDERS = frozenset(("html", "body", "article", "main"))
ABOUT = ("has-", "with-", "without-", "no-", "has_", "with_", "without_", "no_")
MOST_HOSTS, ROOT_BYTES, SALTS = 2000, 16 << 20, 64
SURE = 5  # different pages that a text is equal on to be template whatever its share
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd td th tr table pre blockquote figure".split())
WIDE = 60  # children of a level from which its one-page shapes are folded
#: An open element: (the one around it, tag, signature, inside a dropped region, inside an article or main).
Element = tuple
ROOT: Element = (None, "", "", False, False)
#: Fields of a wrapper node: signature, children by signature, text digests that all its pages have, digests of up to
#: ``SURE`` different pages, number of pages, number of text blocks on them, whether it is in a dropped region.
SIG, KIDS, TEXTS, SEEN, PAGES, BLOCKS, GONE = range(7)


def parse(page: str | None) -> list[tuple[Element, str]]:
    """The blocks of a page in order: (innermost open element, text with single spaces)."""
    out: list[tuple[Element, str]] = []
    if not page:
        return out
    stack: list[Element] = [ROOT]
    opened: Counter[str] = Counter()
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((stack[-1], text))

    at = 0
    while m := TAG.search(page, at):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "br":
            held.append(" ")
            continue
        names, marked = set(), False
        if not m[1] and m[3]:
            for c in CLASS.findall(m[3]):
                for name in "".join(c).lower().split():
                    parts = set(re.split("[_-]+", name)) - {""}
                    names |= parts
                    marked = marked or bool(parts & MARKS) and not name.startswith(ABOUT)
        marked = marked and tag not in HOLDERS
        if tag in RAW and not m[1]:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in INLINE and not (marked and not m[1]) and not (m[1] and opened[tag]):
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        if m[1]:
            if opened[tag]:
                while True:
                    found = stack.pop()[1]
                    opened[found] -= 1
                    if found == tag:
                        break
            continue
        while stack[-1][1] == "p" or (tag == "li" and stack[-1][1] == "li"):
            opened[stack.pop()[1]] -= 1
        around = stack[-1]
        gone = around[3] or marked or (tag in DROPPED and not (tag == "header" and around[4]))
        stack.append((around, tag, tag + "".join("." + n for n in sorted(names)), gone, around[4] or tag in MAIN))
        opened[tag] += 1
    if at < len(page):
        held.append(page[at:])
    flush()
    return out


def digest(text: str) -> int:
    held = text.encode("utf-8", "replace")
    return len(held) << 32 | zlib.crc32(held)


def aligned(e: Element, held: dict[int, object], step: Callable) -> object:
    """The node that ``step`` leads to for ``e``, from the root over all elements around it; kept in ``held``."""
    missing = []
    while id(e) not in held:
        missing.append(e)
        e = e[0]
    node = held[id(e)]
    for e in reversed(missing):
        node = held[id(e)] = step(node, e)
    return node


def tree(blocks: list[tuple[Element, str]]) -> list:
    """A wrapper of one page.  Pages are told apart by their article, so copies with another advert are one page."""
    open_blocks = [(e, t) for e, t in blocks if not e[3]]
    seen = frozenset([digest("\n".join([t for e, t in open_blocks if e[4]] or [t for _, t in open_blocks]))])
    root = ["", {}, set(), seen, 1, 0, False]
    held: dict[int, object] = {id(ROOT): root}

    def step(node: list, e: Element) -> list:
        kid = node[KIDS].get(e[2])
        if kid is None:
            kid = node[KIDS][e[2]] = [e[2], {}, set(), seen, 1, 0, e[3]]
        return kid

    for e, text in blocks:
        node = aligned(e, held, step)
        node[TEXTS].add(digest(text))
        node[BLOCKS] += 1
    return root


def walk(wrapper: list) -> Iterator[tuple[int, list]]:
    """(depth, node) of all nodes, parents first."""
    todo = [(0, wrapper)]
    while todo:
        depth, node = todo.pop()
        yield depth, node
        todo.extend((depth + 1, k) for k in reversed(node[KIDS].values()))


def dumps(wrapper: list) -> str:
    return json.dumps([[d, n[SIG], sorted(n[TEXTS]), sorted(n[SEEN]), *n[PAGES:]] for d, n in walk(wrapper)])


def loads(text: str) -> list:
    spine: list[list] = []
    for depth, sig, texts, seen, *rest in json.loads(text):
        node = [sig, {}, set(texts), frozenset(seen), *rest]
        del spine[depth:]
        if spine:
            spine[-1][KIDS][sig] = node
        spine.append(node)
    return spine[0]


def matching(a: list, b: list) -> int:
    """The number of node pairs that ``merge`` makes of two wrappers."""
    todo, n = [(a, b)] if a[SIG] == b[SIG] else [], 0
    while todo:
        x, y = todo.pop()
        n += 1
        todo.extend((kid, y[KIDS][sig]) for sig, kid in x[KIDS].items() if sig in y[KIDS])
    return n


def merge(a: list, b: list) -> list:
    """Put wrapper ``b`` into ``a``, which is changed: nodes of equal signature are matched level by level, others added."""
    todo, wide = [(a, b)], []
    while todo:
        x, y = todo.pop()
        x[TEXTS] &= y[TEXTS]
        if len(x[SEEN]) < SURE:
            x[SEEN] = frozenset(sorted(x[SEEN] | y[SEEN])[:SURE])
        x[PAGES] += y[PAGES]
        x[BLOCKS] += y[BLOCKS]
        x[GONE] = x[GONE] and y[GONE]
        for sig, kid in y[KIDS].items():
            if sig in x[KIDS]:
                todo.append((x[KIDS][sig], kid))
            else:
                x[KIDS][sig] = kid
        if len(x[KIDS]) > WIDE:
            wide.append(x)
    for x in wide:
        fold(x)
    return a


def unite(a: list, b: list) -> list:
    """Put node ``b`` of the same page into ``a``, which is changed."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        x[TEXTS] |= y[TEXTS]
        x[BLOCKS] += y[BLOCKS]
        x[GONE] = x[GONE] and y[GONE]
        for sig, kid in y[KIDS].items():
            if sig in x[KIDS]:
                todo.append((x[KIDS][sig], kid))
            else:
                x[KIDS][sig] = kid
    return a


def fold(node: list) -> None:
    """The children of ``node`` with names that only one page has become one child for each tag (and another if dropped).

    It stands for any names of the tag, with the pages, blocks and common texts of all that it was made of.
    """
    pages: dict[tuple, list[str]] = {}
    for sig, kid in node[KIDS].items():
        if len(kid[SEEN]) == 1 and "." in sig and not sig.endswith(".*"):
            pages.setdefault((sig.split(".")[0], *kid[SEEN], kid[GONE]), []).append(sig)
    for (tag, _, gone), sigs in pages.items():
        one = functools.reduce(unite, [node[KIDS].pop(sig) for sig in sigs])
        sig = one[SIG] = wild(tag, gone)
        node[KIDS][sig] = merge(node[KIDS][sig], one) if sig in node[KIDS] else one


def wild(tag: str, gone: bool) -> str:
    return tag + ("!.*" if gone else ".*")


def slot(wrapper: list) -> list[str]:
    """Path of the lowest container of all nodes that vary, to look at a wrapper; extraction keeps all that varies."""
    live: set[int] = set()
    for _, n in reversed(list(walk(wrapper))):
        varies = n[BLOCKS] > len(n[TEXTS]) * n[PAGES] or (len(n[SEEN]) == 1 and n[BLOCKS] > 0)
        if not n[GONE] and (varies or any(id(k) in live for k in n[KIDS].values())):
            live.add(id(n))
    path, node = [], wrapper
    while True:
        inner = [k for k in node[KIDS].values() if id(k) in live]
        if len(inner) != 1 or node[BLOCKS] or inner[0][SIG].split(".")[0] in LEAVES:
            return path
        node = inner[0]
        path.append(node[SIG])


def constants(wrapper: list) -> str:
    """The template as JSON: [depth, signature, digests of constant texts] of the nodes that have any, and those above."""
    need = len(wrapper[SEEN])
    if need > 1:  # names of one page only, as those with an article's number, are no signatures
        for _, n in walk(wrapper):
            fold(n)
    nodes = list(walk(wrapper))
    fixed = {id(n): n[TEXTS] if len(n[SEEN]) >= need > 1 and not n[GONE] else set() for _, n in nodes}
    if need < SURE:
        same = sum(len(fixed[id(n)]) * n[PAGES] for _, n in nodes)
        if 2 * same >= sum(n[BLOCKS] for _, n in nodes if not n[GONE]):
            fixed = dict.fromkeys(fixed, set())
    kept: set[int] = set()
    for _, n in reversed(nodes):
        if fixed[id(n)] or any(id(k) in kept for k in n[KIDS].values()):
            kept.add(id(n))
    return json.dumps([[d, n[SIG], sorted(fixed[id(n)])] for d, n in nodes if id(n) in kept])


@functools.lru_cache(256)
def template(text: str) -> tuple[dict, frozenset] | None:
    """The nodes of ``constants`` as (children by signature, digests); None if there are none."""
    spine: list[tuple[dict, frozenset]] = []
    for depth, sig, digests in json.loads(text):
        node = ({}, frozenset(digests))
        del spine[depth:]
        if spine:
            spine[-1][0][sig] = node
        spine.append(node)
    return spine[0] if spine else None


def content(blocks: list[tuple[Element, str]], wrapper: tuple[dict, frozenset] | None) -> str:
    """The kept blocks, joined: those outside of dropped regions that are not template; of a marked article if any is left."""
    held: dict[int, object] = {id(ROOT): wrapper}

    def step(node: tuple | None, e: Element) -> tuple | None:
        return node and (node[0].get(e[2]) or node[0].get(wild(e[1], e[3])))

    open_blocks = [(e, t) for e, t in blocks if not e[3]]
    kept = [(e, t) for e, t in open_blocks if not (wrapper and (n := aligned(e, held, step)) and digest(t) in n[1])]
    kept = kept or open_blocks
    return "\n\n".join([t for e, t in kept if e[4]] or [t for _, t in kept])


def host(column: str = "url"):
    """The lower-cased host of a url; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, template): the constant nodes of each host as JSON, from all its pages."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(wrappers), pa.string()), pa.array([dumps(w) for w in wrappers.values()], pa.string())], names=["host", "wrapper"])

        for whole in batches:
            for batch in slices(whole, "html"):
                for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                    if blocks := parse(page):
                        new = tree(blocks)
                        wrappers[h] = merge(wrappers[h], new) if h in wrappers else new
                if len(wrappers) > MOST_HOSTS:
                    yield out()
                    wrappers.clear()
        yield out()

    def united(part: pd.DataFrame) -> list:
        return functools.reduce(merge, map(loads, sorted(part["wrapper"])))

    def some(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [part["host"].iloc[0]], "wrapper": [dumps(united(part))]})

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [part["host"].iloc[0]], "template": [constants(united(part))]})

    # a host that is in every task is united in two steps, so that no task gets all its partial wrappers
    rows = pages.select(host(url_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(partial, "host string, wrapper string")
    salted = rows.withColumn("salt", F.expr(f"pmod(xxhash64(wrapper), {SALTS})"))
    return salted.groupBy("host", "salt").applyInPandas(some, "host string, wrapper string").groupBy("host").applyInPandas(whole, "host string, template string")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null and empty html give an empty text; pages without a host, null urls included, share one wrapper.  Repeated
    pages are extracted each.  Long pages are parsed whole.  Other columns, whatever their names, are not read.
    """
    templates = materialize(induce(pages, url_col, html_col), "templates")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(url_col).alias("host"))
    if (templates.agg(F.sum(F.octet_length("host") + F.octet_length("template"))).first()[0] or 0) <= ROOT_BYTES:
        joined = rows.join(F.broadcast(templates), "host", "left")
    else:
        salted = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.expr(f"cast(pmod(xxhash64(page_id, url), {SALTS}) as int)")).join(salted, ["host", "salt"], "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                found = [content(parse(h), template(t) if t else None) for h, t in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "template").mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages; null and empty html, repeated and long pages as in ``extract_text``."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
