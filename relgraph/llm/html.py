"""Main text of HTML pages by consensus paths of their hosts."""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.llm.common import lean, rows_out, stored
from relgraph.llm.urls import url_parts

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template textarea iframe svg title select".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
_CLOSES_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p "
    "pre section table ul".split()
)
_AUTO = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CONTAINERS = set("html body main article section div td aside nav header footer form ul ol dl table blockquote figure center".split())
#: Containers that may be chosen for the main text, and those that are kept or left whole.
_ENTERED = set("html body main article div td center".split())
_WHOLE = set("article section ul ol dl blockquote figure".split())
_NEARLY_ALL = 0.9
_OUT_TAGS = set("nav footer aside form button menu dialog head".split())
_OUT_NAMES = set(
    "nav navbar navigation menu footer sidebar breadcrumb breadcrumbs cookie cookies consent notice notices banner ad ads advert adverts "
    "advertisement promo sponsor sponsored comment comments reply replies disqus share sharing social related newsletter subscribe popup "
    "modal widget login pagination skip masthead".split()
)


class Block(NamedTuple):
    """A run of text of one block, the containers around it, and how much of it is links."""

    path: tuple[str, ...]
    text: str
    linked: int
    out: bool


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(raw)} if raw.strip(" /\n\t") else {}


def _step(tag: str, attributes: dict[str, str]) -> str:
    """Tag and first class, or else id, with digits generalised."""
    name = (attributes.get("class") or attributes.get("id") or "").split()
    return f"{tag}.{re.sub(r'[0-9]+', 'N', name[0].lower())}" if name else tag


def _outside(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in _OUT_TAGS or (tag == "header" and not in_article):
        return True
    if "hidden" in attributes or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if tag in ("html", "body", "main", "article") or tag in _INLINE:
        return False
    names = re.split(r"[\s_-]+", f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}".lower())
    return bool(_OUT_NAMES.intersection(names))


def blocks(html: str) -> list[Block]:
    """All text of a page in blocks, in page order; scripts, styles and comments left out."""
    found: list[Block] = []
    stack: list[tuple[str, str, bool]] = []  # tag, step, outside
    buffer: list[str] = []
    linked = 0
    links = 0

    def flush():
        nonlocal linked
        text = " ".join(unescape("".join(buffer)).split())
        if text:
            path = tuple(step for tag, step, _ in stack if tag in _CONTAINERS)
            found.append(Block(path, text, min(linked, len(text)), bool(stack) and stack[-1][2]))
        buffer.clear()
        linked = 0

    def pop_to(depth):
        nonlocal links
        while len(stack) > depth:
            if stack.pop()[0] == "a":
                links -= 1

    def keep(text):
        nonlocal linked
        buffer.append(text)
        if links:
            linked += len(text)

    at = 0
    while at < len(html):
        m = _TOKEN.search(html, at)
        if m is None:
            keep(html[at:])
            break
        keep(html[at: m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is None or (tag in _INLINE and any(t not in _INLINE for t, *_ in stack[depth + 1:])):
                continue
            if tag not in _INLINE:
                flush()
            pop_to(depth)
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
            at = close.end() if close else len(html)
            continue
        if tag == "br":
            buffer.append(" ")
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in _INLINE:
            flush()
        closing = {"p"} if tag in _CLOSES_P else _AUTO.get(tag)
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closing:
                    pop_to(k)
                    break
                if stack[k][0] in _CONTAINERS:
                    break
        attributes = _attributes(m[3])
        out = bool(stack) and stack[-1][2]
        out = out or _outside(tag, attributes, any(t in ("article", "main") for t, *_ in stack))
        stack.append((tag, _step(tag, attributes), out))
        links += tag == "a"
    flush()
    return found


def best_path(found: list[Block]) -> str | None:
    """The container of the main text, "" for the whole page; null without any text.

    A ``main`` or ``article`` with more than half of the text is taken, else the page.
    From there the path goes down through other containers that hold nearly all
    text, but never past an article and never past text that stands directly in a
    container, such as a heading. Sections, lists, tables, quotes and figures are text
    of what they stand in. Text that is mostly links does not count.
    """
    direct: dict[tuple[str, ...], int] = defaultdict(int)
    below: dict[tuple[str, ...], int] = defaultdict(int)
    for block in found:
        if not block.out:
            weight = max(0, len(block.text) - 2 * block.linked)
            direct[block.path] += weight
            for up in range(len(block.path) + 1):
                below[block.path[:up]] += weight
    if not below:
        return None
    tags = {p: [step.partition(".")[0] for step in p] for p in below}
    # a cell of a layout table may be gone into, the table itself may not be chosen
    open_paths = [p for p in below if p and tags[p][-1] in _ENTERED and not _WHOLE.intersection(tags[p][:-1])]
    path: tuple[str, ...] = ()

    def heading_lost(to):
        return any(direct.get(to[:k]) for k in range(len(path), len(to)))

    for wanted in ("main", "article"):
        inside = [p for p in open_paths if tags[p][-1] == wanted and p[: len(path)] == path and 2 * below[p] > below[path]]
        inside = [p for p in inside if wanted == "main" or not heading_lost(p)]
        if inside:
            path = min(inside, key=lambda p: (len(p), -below[p], p))
    enough = max(1, _NEARLY_ALL * below[path])
    for p in sorted(open_paths, key=len):
        if len(p) > len(path) and p[: len(path)] == path and below[p] >= enough and not heading_lost(p):
            path = p
    return ">".join(path)


def text_under(found: list[Block], path: str) -> str:
    wanted = tuple(path.split(">")) if path else ()
    return "\n".join(b.text for b in found if not b.out and b.path[: len(wanted)] == wanted)


def _votes(batches):
    schema = pa.schema([("host", pa.string()), ("path", pa.string())])
    for batch in batches:
        paths = [best_path(blocks(h or "")) for h in batch.column("html").to_pylist()]
        yield rows_out(schema, batch.column("host"), paths)


def _extract(batches):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("path", pa.string()), ("text", pa.string())])
    for batch in batches:
        used, texts = [], []
        for html, winners in zip(batch.column("html").to_pylist(), batch.column("winners").to_pylist()):
            found = blocks(html or "")
            text, path = "", None
            own = best_path(found)
            for path in [own] if own in (winners or ()) else [*(winners or ()), own]:
                if path is not None and (text := text_under(found, path)):
                    break
            texts.append(text)
            used.append(path if text else None)
        yield rows_out(schema, batch.column("page_id"), batch.column("url"), used, texts)


def extract_text(pages: DataFrame, share: float = 0.25) -> DataFrame:
    """``page_id, url, path, text`` for every row of ``pages`` (``page_id, url, html``).

    Each page votes for the container of its main text (``best_path``), as a path of tags
    and first classes with digits generalised. Paths with ``share`` of a host's votes or
    more win; a page takes the text under its own one if that wins, else under the first
    winner that it has, or under its own one. The path "" is the whole page. Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
    styles and reader comments below it are left out.

    Votes are counted before they are shuffled. The winners, four paths a host at most,
    are written, so that the planner can tell their size; beyond it they are joined by
    host, and Spark splits a host with many pages. Null or empty HTML gives an empty
    text; pages without a host have one another's votes; repeated rows are all returned.
    """
    named = lean(pages).select("page_id", "url", "html", url_parts(F.col("url"))["host"].alias("host"))
    votes = named.select("host", "html").mapInArrow(_votes, "host string, path string").where("path is not null")
    counted = stored(votes.groupBy("host", "path").agg(F.count("*").alias("n")), "votes")
    total = counted.groupBy("host").agg(F.sum("n").alias("of"))
    strong = counted.join(total, "host").where(F.col("n") >= share * F.col("of"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))
    winners = stored(strong.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("winners")), "winners")
    return named.join(winners, "host", "left").select("page_id", "url", "html", "winners").mapInArrow(
        _extract, "page_id long, url string, path string, text string"
    )
