"""Operator 1, main text of web pages by tag-path ratios.

Every text node of a page has a root-to-leaf tag path.  Text length and
punctuation are summed per path and divided by the path's number of nodes, both
ratios are smoothed along the page with a Gaussian, fused to one value per
node, and paths whose mean value passes a share of the page's standard
deviation are content paths.  The smallest element that holds nearly all text
of content paths is the content region.  All blocks of content paths are the
result, wherever they are, and with them the other blocks of the region, unless
links are most of them (in an article such a block stays if it is more than a
few words); nothing inside page furniture is.  Where the region has no heading
of the first level, the last one before it in the same container is the title
and comes with what stands between the two.

Furniture: elements that are never prose (scripts, styles, navigation, forms
and the like), containers whose class, id or role says so (menus, notices,
adverts, reader comments and the like), and paragraphs named as notices or
adverts.  Headings and block quotations are prose whatever their names, and so
are buttons and labels in the middle of a paragraph.  What the page decides as
a whole: a form that holds most of the text is no furniture, a ``header`` is none
if it shares its container with the region and nothing but the two is there, and a
heading that only counts comments goes.

A null or empty page gives the empty text.  Pages are read whole, whatever
their length, in one pass that is linear in it; unclosed, misnested and unknown
tags are tolerated, and quotes delimit an attribute's value only where it
begins.  Repeated
rows give repeated results; an empty table gives an empty one; extra columns
stay as they are unless they are named like a result column, which replaces
them.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Share of the standard deviation that a content path's mean has to reach.
THRESHOLD = 0.8
#: Width of the Gaussian, in text nodes.
SIGMA = 1.0
#: Share of the content paths' text that the region has to hold.
COVER = 0.85
#: Words that a linked block of an article has at least to stay.
REFERENCE = 4

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "svg", "math", "canvas", "object", "audio", "video")
FURNITURE = frozenset((*RAW, *"head nav footer aside form button select option datalist dialog menu label fieldset legend input".split()))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES |= dict.fromkeys(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), ("p",)
)
PARTS = INLINE | HEADINGS | frozenset("p li td tr tbody pre blockquote ul ol".split())
#: Blocks in whose middle a button or a label is a word of the text.
PROSE = HEADINGS | frozenset("p li dd dt td th blockquote figcaption".split())
SCOPE = frozenset("html body article section main div ul ol table td th aside nav footer header form blockquote figure button dl".split())

_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w+|paywall|"
    r"nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side-?bar|footer|header|masthead|toolbar|topbar|share|sharing|social\w*|related|recommend\w*|"
    r"comments?|commentlist|respond|replies|discussion|disqus\w*|widgets?|pagination|pager|login|signup|skip-?link)(?:$|[\s_-])",
    re.I,
)
#: Of these, names that an article's own parts may have, too.
_PROSE_NAMES = re.compile(r"(?:^|\s)discussion(?:$|\s)", re.I)
_TEASER = re.compile(r"(?:^|[\s_-])(?:teasers?|cards?|promo\w*|related|recommend\w*)(?:$|[\s_-])", re.I)
_COUNTED = re.compile(r"\(?\d*\)?\s*(?:comments?|replies|reply|responses?)\s*\(?\d*\)?:?", re.I)
_KEPT = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main)[\s_-]*(?:content|body|text|header)?(?:$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar".split())
#: What makes a single paragraph furniture.
_NOTICE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|newsletter|subscri\w+|paywall|pagination|pager)(?:$|[\s_-])"
    r"|(?:^|\s)(?:share|sharing|related|comments?)(?:[\s_-](?:this|links?|buttons?|bar|box|list|posts?|articles?|stories|content|form|meta|count))?(?:$|\s)",
    re.I,
)
_ADVERT = re.compile(r"(?:^|\s)(?:ads?|advert\w*|sponsored)(?:$|\s)", re.I)
_COMMENTS = re.compile(r"(?:^|[\s_-])comments?(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*+)>", re.S)
_ATTR = re.compile(r"([^\s/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'][^\s]*)))?")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_PUNCTUATION = re.compile(r"[,.;:!?…、。，！？¿¡]")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


class Node(NamedTuple):
    """A text node: number of its tag path, number of the element around it, its block, whether furniture or links hold it; whether a form does, and the number of the page header that does."""

    text: str
    path: int
    parent: int
    block: int
    furniture: bool
    linked: bool
    form: bool = False
    header: int = 0


class Element(NamedTuple):
    """Number of the parent (always a smaller one), and what holds for all that is inside."""

    tag: str
    parent: int
    depth: int
    path: int
    furniture: bool
    article: bool
    linked: bool
    form: bool = False
    header: int = 0
    prose: bool = False


def _furniture(tag: str, attrs: str, inside_article: bool, articles: int = 0) -> bool:
    """Whether an element is furniture by itself; ``articles``: how many have begun before it."""
    if tag in FURNITURE and tag != "form":
        return True
    if tag in ("html", "body") or not _TELLING.search(attrs):
        return False
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
        return True
    if found.get("role", "").lower() in _ROLES:
        return True
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if tag in ("article", "main"):
        return bool(_COMMENTS.search(names)) or tag == "article" and articles > 0 and bool(_TEASER.search(names))
    if _ADVERT.search(names):
        return True
    if tag in HEADINGS or tag == "blockquote":
        return False
    if tag == "p":
        return bool(_NOTICE.search(names))
    if tag == "header" and inside_article:
        return False
    if inside_article:
        names = _PROSE_NAMES.sub(" ", names)
    return bool(_NAMED.search(names)) and not _KEPT.fullmatch(found.get("class", ""))


def parse(page: str) -> tuple[list[Node], list[Element]]:
    """Text nodes in page order, and all elements by number; 0 is the page itself."""
    nodes: list[Node] = []
    elements = [Element("", 0, 0, 0, False, False, False)]
    paths: dict[tuple[int, str], int] = {}
    stack = [0]  # numbers of open elements
    scopes = [0]  # places in the stack of elements that implied ends don't cross
    places: dict[str, list[int]] = {}  # tag: its places in the stack
    at = block = articles = 0

    def text(raw: str) -> None:
        if raw:
            top = elements[stack[-1]]
            nodes.append(Node(html.unescape(raw), top.path, stack[-1], block, top.furniture, top.linked, top.form, top.header))

    def in_prose() -> bool:
        return elements[stack[-1]].prose and not elements[stack[-1]].form

    def close_to(k: int) -> None:
        nonlocal block
        while len(stack) > k:
            tag = elements[stack.pop()].tag
            places[tag].pop()
            if scopes[-1] == len(stack):
                scopes.pop()
            if tag not in INLINE and not (tag in ("button", "label") and in_prose()):
                block += 1

    last = page.rfind(">") + 1  # what begins later is no tag
    while m := _TOKEN.search(page, at, last):
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        held = places.get(tag)
        if m[1]:
            if held and not (tag in INLINE and scopes[-1] > held[-1]):
                close_to(held[-1])
            elif tag == "p":
                block += 1
            continue
        if tag == "br":
            text(" ")
            continue
        worded = tag in ("button", "label") and in_prose()
        if tag not in INLINE and not worded:
            block += 1
        ends = CLOSES.get(tag, ())
        while (k := max([places[t][-1] for t in ends if places.get(t)], default=0)) and k >= scopes[-1]:
            close_to(k)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "math", "path"):
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        above = elements[stack[-1]]
        path = paths.setdefault((above.path, tag), len(paths) + 1)
        furniture = above.furniture or not worded and _furniture(tag, m[3], above.article, articles)
        articles += tag == "article" and not furniture
        header = above.header or (len(elements) if tag == "header" and not above.article else 0)
        places.setdefault(tag, []).append(len(stack))
        if tag in SCOPE:
            scopes.append(len(stack))
        elements.append(Element(tag, stack[-1], above.depth + 1, path, furniture, above.article or tag in ("article", "main"), above.linked or tag == "a", above.form or tag == "form", header, tag in PROSE or above.prose and (tag in INLINE or worded)))
        stack.append(len(elements) - 1)
    text(page[at:].partition("<!--")[0])
    return nodes, elements


def path_values(nodes: list[Node]) -> np.ndarray:
    """Fused, smoothed ratio of every node's path."""
    lengths = np.array([len(n.text.strip()) for n in nodes], float)
    marks = np.array([len(_PUNCTUATION.findall(n.text)) for n in nodes], float)
    paths = {p: k for k, p in enumerate(dict.fromkeys(n.path for n in nodes))}
    of = np.array([paths[n.path] for n in nodes])
    count = np.bincount(of)
    reach = np.arange(-3, 4)
    weights = np.exp(-(reach**2) / (2 * SIGMA**2))
    weights /= weights.sum()
    ratios = [np.convolve(np.pad((np.bincount(of, x) / count)[of], 3, mode="edge"), weights, "valid") for x in (lengths, marks)]
    fused = ratios[0] * (1 + ratios[1])
    return (np.bincount(of, fused) / count)[of]


def _ends(elements: list[Element]) -> list[int]:
    """Number after the last element inside each; elements are numbered as they begin, so what lies in one follows it."""
    ends = list(range(1, len(elements) + 1))
    for k in range(len(elements) - 1, 0, -1):
        ends[elements[k].parent] = max(ends[elements[k].parent], ends[k])
    return ends


def _near(elements: list[Element], k: int, tags: frozenset, most: int = 4) -> int:
    """The nearest of an element and the ``most`` - 1 around it that has one of the tags; 0 if none has."""
    for _ in range(most):
        if elements[k].tag in tags:
            return k
        k = elements[k].parent
    return 0


def _around(elements: list[Element], k: int) -> list[int]:
    """``k`` and the elements around it, outwards."""
    out = [k]
    while out[-1]:
        out.append(elements[out[-1]].parent)
    return out


H1, PAGE = frozenset(["h1"]), ("", "html", "body")


def _title(elements: list[Element], live: list[Node], region: int, ends: list[int]) -> set[int]:
    """Ids of the nodes from the last first-level heading before the region up to it, in a container of their own and far less than it."""
    own = [k for k, n in enumerate(live) if region <= n.parent < ends[region]]
    if not own or any(_near(elements, live[k].parent, H1) for k in own):
        return set()
    heads = (k for k in range(own[0] - 1, -1, -1) if _near(elements, live[k].parent, H1))
    last = next(heads, None)
    if last is None:
        return set()
    h1, around = _near(elements, live[last].parent, H1), set(_around(elements, region))
    shared = next(x for x in _around(elements, h1) if x in around)
    between = [n for n in live[: own[0]] if h1 <= n.parent < ends[shared]]
    if elements[shared].tag in PAGE or 4 * sum(len(n.text) for n in between) > sum(len(live[k].text) for k in own):
        return set()
    return {id(n) for n in between}


def _own_headers(elements: list[Element], plain: list[Node], region: int, ends: list[int]) -> set[int]:
    """Headers that hold a heading and share a container with the region only: no navigation, aside, footer or form is in it."""
    around, out, own = set(_around(elements, region)), set(), {}
    for n in plain:
        if n.header:
            own.setdefault(n.header, []).append(n)
    noise = np.cumsum([0, *(e.tag in ("nav", "aside", "footer", "form") for e in elements)])
    for h, nodes in own.items():
        top = elements[h].parent
        if top not in around or elements[top].tag in PAGE or noise[ends[top]] - noise[top]:
            continue
        links = sum(len(n.text) for n in nodes if n.linked)
        if any(_near(elements, n.parent, HEADINGS) for n in nodes) and links * 2 <= sum(len(n.text) for n in nodes):
            out.add(h)
    return out


def extract(page: str | None) -> str:
    """Main text of one page."""
    nodes, elements = parse(page or "")
    plain = [n for n in nodes if not n.furniture and n.text.strip()]
    inside_form = sum(len(n.text) for n in plain if n.form and not n.header)
    forms = inside_form > sum(len(n.text) for n in plain if not n.form and not n.header)  # the page is a form
    live = [n for n in plain if not n.header and (forms or not n.form)]
    if not live:
        return ""
    value = path_values(live)
    chosen = value >= min(THRESHOLD * value.std(), value.max())
    size = [0] * len(elements)
    for n, c in zip(live, chosen):
        if c:
            size[n.parent] += len(n.text)
    for k in range(len(elements) - 1, 0, -1):  # a parent's number is smaller
        size[elements[k].parent] += size[k]
    region = max((k for k in range(len(elements)) if size[k] >= COVER * size[0]), key=lambda k: (elements[k].depth, -k))
    # A single paragraph never is the region: what holds it is.
    while elements[region].tag in PARTS:
        region = elements[region].parent
    # An article as a whole, not one of its parts.
    k = region
    while k:
        if elements[k].tag in ("article", "main"):
            region = k
        k = elements[k].parent
    ends = _ends(elements)
    titles = _title(elements, live, region, ends)
    heads = _own_headers(elements, plain, region, ends)
    chosen_of = {id(n): bool(c) for n, c in zip(live, chosen)}
    inside = [(n, chosen_of.get(id(n), True) or id(n) in titles) for n in plain if n.header in heads or id(n) in titles or id(n) in chosen_of and (chosen_of[id(n)] or region <= n.parent < ends[region])]
    blocks: dict[int, list[tuple[Node, bool]]] = {}
    for n, c in inside:
        blocks.setdefault(n.block, []).append((n, c))
    spaces = {}
    for n in nodes:
        if n.block in blocks and not n.furniture and (forms or not n.form):
            spaces.setdefault(n.block, []).append(n.text)
    out = []
    for k, own in blocks.items():
        chars = sum(len(n.text.strip()) for n, _ in own)
        links = sum(len(n.text.strip()) for n, _ in own if n.linked)
        said = " ".join("".join(spaces[k]).split())
        listed = elements[region].tag in ("article", "main") and len(said.split()) >= REFERENCE
        counts = elements[own[0][0].parent].tag in HEADINGS and _COUNTED.fullmatch(said)
        if (any(c for _, c in own) or listed or links * 2 <= chars) and not counts:
            out.append(said)
    return "\n\n".join(x for x in out if x)


def extract_pages(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` without ``source``, with ``text`` and ``n_chars``."""
    keep = [c for c in pages.columns if c not in (source, "text", "n_chars")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(p) for p in part.column(source).to_pylist()]
                columns = [part.column(c) for c in keep] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])

    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*keep, F.col(source)).mapInArrow(run, schema)
