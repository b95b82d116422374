"""Operator 8: main-text extraction by deducing each host's template from token support.

Tokens are a page's elements, told apart by their path, and its texts (lists and other blocks). A
first pass sums, per host and token, the distinct pages it is on and its occurrences (copies of a
page count once, so that they don't make an article template; partial sums combine before any
shuffle, so a host with a third of all pages is spread). Elements on most of the host's pages nest
by path into the host's template, whose size is bounded by twice a page's; texts on almost all of
them are template too, and what else varies are its slots. The main container is an article or
main, else found by descending from the outermost template element while one once-a-page child
holds all of the slot text that no menu, advert, form, footer or the like encloses. The second pass
extracts the container's text from each page without template texts. Hosts with fewer than
``MIN_PAGES`` distinct pages use the container of all pages together.

Tokens aren't grouped into equivalence classes of equal occurrence vectors. An element's path
already names all that encloses it, and what encloses it is on every page that it is on, so
grouping and checking the nesting would drop no token; in a trial it made the whole template
invalid where an element that is there once a page lay in one of several equal ones.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.llm.scratch import Scratch

MIN_PAGES = 3  # pages from which a host has a template of its own
SUPPORT = 0.5  # least share of a host's pages that a template token is on
TEXT_SUPPORT = 0.95  # least share of a host's distinct pages that a template text is on
DESCEND = 0.8  # default of deduce_container for text of which nobody knows what is template

# HTML element kinds, and names, roles and class words that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math canvas object select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
FURNITURE = RAW | frozenset("head nav footer aside form button input menu dialog option label fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "notification popup modal overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "comment comments commentlist disqus respond reply share sharing social related widget pagination pager login search skip toolbar".split())
CONTAINERS = frozenset("html body div section article main td center table tbody tr".split())
HEADING_WORDS = frozenset("header masthead topbar".split())
LISTS, SECTIONS = frozenset(("ul", "ol", "dl")), frozenset(("body", "article", "main", "section", "td", "th"))
P_CLOSERS = BLOCK - frozenset("body html head caption legend li dd dt td th tr tbody thead tfoot option optgroup summary figcaption".split())
SAME_CLOSERS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class _Element:
    __slots__ = ("name", "path", "furniture", "article", "list", "doubtful")

    def __init__(self, name: str, path: str, furniture: bool, article: bool, parent: _Element | None = None, doubtful: bool = False):
        self.name, self.path, self.furniture, self.article = name, path, furniture, article
        #: the outermost list around it, as far as no section or table cell starts anew
        self.list = None if parent is None or name in SECTIONS else parent.list or (self if name in LISTS else None)
        #: paths of the elements around it, itself included, that their class words call furniture
        self.doubtful: tuple[str, ...] = () if parent is None else parent.doubtful + (path,) if doubtful else parent.doubtful


def _element(name: str, attributes: str, parent: _Element) -> _Element:
    label, furniture, doubtful = name, name in FURNITURE, False
    article = parent.article or name in ("article", "main")
    if attributes.strip():
        for kind, *values in _ATTR.findall(attributes):
            kind, value = kind.lower(), next((v for v in values if v), "").lower()
            if kind == "hidden":
                furniture = True
            elif kind == "aria-hidden":
                furniture |= value.strip() == "true"
            elif kind == "role":
                furniture |= value.strip() in FURNITURE_ROLES
            elif kind in ("class", "id") and value:
                words = set(re.split(r"[^a-z]+", value))
                doubtful |= bool(words & FURNITURE_WORDS) or bool(words & HEADING_WORDS) and not article
                label += "." + ".".join(sorted(value.split()))
    furniture |= name == "header" and not article
    if name in ("html", "body", "article", "main"):
        furniture = doubtful = False
    return _Element(name, f"{parent.path}/{label}", parent.furniture or furniture, article, parent, doubtful)


def page_events(html: str) -> Iterator[tuple[str, _Element, str]]:
    """("open", element, "") per element, ("text", enclosing element, raw text), ("break", ...).

    Unclosed and misnested elements are closed as browsers roughly do; the content of raw-text
    elements is skipped.
    """
    root = _Element("", "", False, False)
    stack, at = [root], 0
    while at < len(html):
        tag = _TAG.search(html, at)
        if tag is None:
            yield "text", stack[-1], html[at:]
            return
        if tag.start() > at:
            yield "text", stack[-1], html[at:tag.start()]
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        if tag[1] or tag[4]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if depth:
                del stack[depth:]
            if name in BLOCK:
                yield "break", stack[-1], ""
            continue
        attributes = tag[3] or tag[6] or ""
        if name in P_CLOSERS:
            _close(stack, {"p"})
        if name in SAME_CLOSERS:
            _close(stack, SAME_CLOSERS[name])
        if name in BLOCK:
            yield "break", stack[-1], ""
        element = _element(name, attributes, stack[-1])
        yield "open", element, ""
        if name == "br":
            yield "text", stack[-1], " "
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif name not in VOID and not attributes.endswith("/"):
            stack.append(element)


def _close(stack: list[_Element], names: set[str]) -> None:
    """Close the nearest open element of ``names``, unless a container stands between."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in names:
            del stack[i:]
            return
        if stack[i].name in BLOCK:
            return


def page_blocks(events: list, content: frozenset[str] = frozenset()) -> list[tuple[_Element, str]]:
    """(element, line) of each block with text outside furniture. Text of an element that is
    furniture unless its path is ``content`` makes blocks of its own."""
    blocks, open_ = [], {}
    for kind, element, raw in [*events, ("break", None, "")]:
        if kind == "break":
            for at, parts in open_.values():
                line = " ".join("".join(parts).split())
                if line:
                    blocks.append((at, line))
            open_ = {}
        elif kind == "text" and not element.furniture:
            inner = next((p for p in reversed(element.doubtful) if p not in content), "") if element.doubtful else ""
            open_.setdefault(inner, (element, []))[1].append(_html.unescape(raw))
    return blocks


def page_doubts(events: list, blocks: list[tuple[_Element, str]]) -> tuple[Counter, set[str], int]:
    """Of elements that their class words call furniture: the text held, those around an article; all text."""
    held: Counter = Counter()
    for element, line in blocks:
        for path in set(element.doubtful):
            held[path] += len(line)
    main = {p for kind, e, _ in events if kind == "open" and e.doubtful and not e.furniture and e.name in ("article", "main") for p in e.doubtful}
    return held, main, sum(len(line) for _, line in blocks)


def page_texts(blocks: list[tuple[_Element, str]]) -> list[tuple[str, str, list[int]]]:
    """(token, path, blocks) of the texts that are template or not as a whole: lists and other blocks."""
    texts: dict[int, list[int]] = {}
    for i, (element, _) in enumerate(blocks):
        texts.setdefault(id(element.list) if element.list else -1 - i, []).append(i)
    out = []
    for own in texts.values():
        element = blocks[own[0]][0]
        path = (element.list or element).path
        lines = "\n".join(blocks[i][1] for i in own)
        out.append((xxhash.xxh3_64_hexdigest(f"{path}\0{lines}"), path, own))
    return out


#: sums per host and token; of elements that their class words call furniture also their text that
#: those around them don't count, the text held, the text of the pages they are on, and on how many
#: of these an article is in them
SUMS = ("pages", "times", "chars", "back", "held", "around", "main")


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[tuple, list] = {}
        for host, html in zip(*(c.to_pylist() for c in batch.columns)):
            paths: dict[str, list] = {}  # times, chars, back, doubtful
            runs: dict[tuple[str, str], list] = {}
            events = list(page_events(html or ""))
            for kind, element, _ in events:
                if kind == "open" and not element.furniture:
                    paths.setdefault(element.path, [0, 0, 0, element.path in element.doubtful])[0] += 1
            blocks = page_blocks(events)
            held, main, around = page_doubts(events, blocks)
            for element, line in blocks:
                at = element.path
                while at:
                    one = paths[at]
                    one[1] += len(line)
                    if one[3] and at not in main and 2 * held[at] <= around:
                        one[2] += len(line)
                        break
                    at = at[:at.rfind("/")]
            for token, path, own in page_texts(blocks):
                run = runs.setdefault((path, token), [0, 0, 0, False])
                run[0] += 1
                run[1] += sum(len(blocks[i][1]) for i in own)
            found = [(path, None, *v) for path, v in paths.items()] + [(*key, *v) for key, v in runs.items()]
            found.append(("", None, 1, 0, 0, False))
            for path, run, n, chars, back, doubtful in found:
                for group in (host, "*") if run is None else (host,):
                    one = sums.setdefault((group, path, run), [0] * 7)
                    one[0] += 1
                    one[1] += n
                    one[2] += chars
                    if doubtful:
                        one[3:] = one[3] + back, one[4] + held[path], one[5] + around, one[6] + (path in main)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array([k[2] for k in sums], pa.string()),
             *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(7))],
            ["host", "path", "run", *SUMS])


def deduce_container(classes: pd.DataFrame, n_pages: int, descend: float = DESCEND) -> str:
    """Path of the main container, from a host's template paths (path, pages, times, chars).

    Once-a-page sectioning elements nest by path; among them ``article`` or ``main`` wins, else the
    descent by slot text from the outermost one: to a child that has at least the share ``descend``
    of its parent's. With 1.0 on text without the template's, only template stays outside.
    """
    once = classes[(classes["times"] == classes["pages"]) & (classes["path"] != "")].sort_values("path")
    once = once[once["path"].str.extract(r"/([^/.]*)[^/]*$")[0].isin(CONTAINERS)]
    named = once[once["path"].str.match(r".*/(article|main)(\.[^/]*)?$") & (once["pages"] >= SUPPORT * n_pages)]
    if len(named):
        best = named.sort_values(["chars", "path"], ascending=[False, True]).iloc[0]
        if best["chars"] > 0:
            return str(best["path"])
    at, chars = "", once["chars"].max() if len(once) else 0
    while True:
        inside = once[once["path"].str.startswith(at + "/") & (once["chars"] >= descend * chars) & (once["chars"] > 0)]
        if not len(inside):
            return at
        step = inside.assign(depth=inside["path"].str.count("/")).sort_values(["depth", "chars", "path"], ascending=[True, False, True]).iloc[0]
        at, chars = str(step["path"]), step["chars"]


def slot_text(paths: pd.DataFrame, texts: pd.DataFrame, content: set[str]) -> pd.DataFrame:
    """``paths`` whose chars are without those of the template ``texts`` below them, and with those
    of elements that are ``content`` in spite of their class words."""
    more: dict[str, int] = {}
    doubtful = set(paths["path"][paths["around"] > 0])

    def add(at: str, chars: int) -> None:
        while at:
            more[at] = more.get(at, 0) + chars
            if at in doubtful and at not in content:
                return
            at = at[:at.rfind("/")]

    for at, chars in zip(texts["path"], texts["chars"]):
        add(at, -chars)
    for at, chars in zip(paths["path"], paths["back"]):
        if at in content:
            add(at[:at.rfind("/")], chars)
    return paths.assign(chars=paths["chars"] + paths["path"].map(more).fillna(0).astype("int64"))


def host_templates(tokens: DataFrame) -> DataFrame:
    """(host, n_pages, container, template_runs, content, furniture) from summed token occurrences."""
    total = tokens.where("path = '' and run is null").select("host", F.col("pages").alias("n_pages"))
    least = F.when(F.col("run").isNull(), SUPPORT).otherwise(TEXT_SUPPORT)
    valid = tokens.join(total, "host").where(F.col("pages") >= least * F.col("n_pages"))
    valid = valid.where(f"n_pages >= {MIN_PAGES} or host = '*'")

    def deduce(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n_pages"].iloc[0])
        paths = pdf[pdf["run"].isna()]
        # class words make no furniture of what holds an article or most of the text of the pages it is on
        doubtful = set(paths["path"][paths["around"] > 0])
        content = set(paths["path"][(paths["main"] > 0) | (2 * paths["held"] > paths["around"])])
        paths = slot_text(paths, pdf[pdf["run"].notna()], content)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "n_pages": [n], "container": [deduce_container(paths, n, 1.0)],
                             "template_runs": [pdf["run"].dropna().tolist()], "content": [sorted(content)], "furniture": [sorted(doubtful - content)]})

    return valid.groupBy("host").applyInPandas(
        deduce, "host string, n_pages long, container string, template_runs array<string>, content array<string>, furniture array<string>")


def extract_text(html: str | None, container: str, template_runs=(), content=(), furniture=()) -> str:
    """The blocks of a page's container, one per line; the outermost article, main or body of a
    page without that container. Template texts are left out, unless nothing else would be left.
    Elements with class words of furniture that aren't in the host's ``content`` or ``furniture`` are
    judged by the page alone."""
    events = list(page_events(html or ""))
    held, main, around = page_doubts(events, page_blocks(events))
    content = frozenset(content) | {p for p in held if p in main or 2 * held[p] > around} - set(furniture)
    if container and not any(e.path == container or e.path.startswith(container + "/") for _, e, _ in events):
        container = ""
    if not container:
        for kind in ("article", "main"):
            paths = {e.path for what, e, _ in events if what == "open" and e.name == kind and not e.furniture}
            if len(paths) == 1:
                container = paths.pop()
                break
    blocks = [(e, line) for e, line in page_blocks(events, content) if content.issuperset(e.doubtful)]
    inside = {i for i, (e, _) in enumerate(blocks) if not container or e.path == container or e.path.startswith(container + "/")}
    skip = set(template_runs)
    drop = {i for token, _, own in page_texts(blocks) if token in skip for i in own} if skip else set()
    left = inside - drop or inside
    return "\n".join(line for i, (_, line) in enumerate(blocks) if i in left)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, container) for every row of page_id, url, html.

    Null or tagless html is handled (empty text, or all of it); a null url has host ""; every row
    of a repeated page gives a row. Other columns are ignored; an empty table gives no rows.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    seen = rows.select(F.xxhash64("html", F.length("html")).alias("page"), "host", "html").dropDuplicates(["page", "host"]).select("host", "html")
    tokens = seen.mapInArrow(_occurrences, "host string, path string, run string, " + ", ".join(f"{c} long" for c in SUMS))
    tokens = tokens.groupBy("host", "path", "run").agg(*(F.sum(c).alias(c) for c in SUMS))
    templates = Scratch(pages.sparkSession, "templates").table(host_templates(tokens), "templates")
    parts = ["container", "template_runs", "content", "furniture"]
    shared = templates.where("host = '*'").select(*parts).first()
    shared = tuple(shared) if shared else ("", [], [], [])
    own = templates.where("host <> '*'").select("host", F.struct(*parts).alias("template"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, used = [], []
            for html, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist()):
                template = tuple(template[c] for c in parts) if template else shared
                used.append(template[0])
                texts.append(extract_text(html, *template))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(used, pa.string())],
                ["page_id", "url", "text", "n_chars", "container"])

    page_type = dict(rows.dtypes)["page_id"]
    return rows.join(own, "host", "left").select("page_id", "url", "html", "template").mapInArrow(
        extract, f"page_id {page_type}, url string, text string, n_chars long, container string")
