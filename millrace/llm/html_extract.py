"""Operator 2: main text of web pages, by tag-path ratios.

A page is read once into text nodes, each with its tag path from the root.  Over all nodes of one
path, text length and punctuation marks are added up and divided by the number of nodes; the two
ratios are smoothed along the page by a Gaussian kernel and fused by their product.  Nodes
whose fused ratio reaches its standard deviation over the page are content, and all of them are in the
result, but for those outside the deepest container of nearly all content text whose own container falls
short of the same threshold.  Other blocks (headings, short lines) join it if they are in that
container, directly in one with content, headings before it in one around it or alone in one beside it, or if
all that stands in a container beside it is set as the article's paragraphs are.  Elements for
navigation and the like, form controls and hidden ones are left out.

A class or id never decides.  An element whose name, as a whole, is one of adverts, notices or comments is left
out only if it holds less than half of the content text, something else is left, and a second sign says the same:
its role, being a form, half of its text in links, standing outside the article or its container or behind all
other content, records of one shape, or a mean ratio below twice the threshold.  A name of which only a part is
such a word ("related-work") counts for nothing.  Without any name, records of one shape behind the article that
begin with a short line and have no headings are reader comments.  A
lone short line set as the article's paragraphs are ("Share") stays.

Pages are independent, so the operator is one scan with no shuffle.

Defined cases: null and empty pages give an empty text; a page with no text nodes, or with boilerplate
elements alone, too; unclosed and stray tags are closed or skipped as browsers do; repeated rows give
equal rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import words as W

# Elements and names of the markup.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HOLDS = frozenset("html body main article section div td center figure blockquote li".split())
_OUT = frozenset("head nav footer aside button select option menu dialog svg math object canvas audio video label legend".split())
_SOFT = frozenset("form fieldset".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login sidebar sidebars side menu menus nav navbar navigation breadcrumb breadcrumbs toc footer header masthead topbar toolbar comment comments disqus replies share sharing social related recommended recommendations widget widgets pagination pager search tags hidden skip complementary contentinfo".split()
)
#: Words that say nothing beside one of the above ("comment-list").
_PLAIN = frozenset("area bar block box button buttons container form inner item items link links list panel section wrap wrapper".split())
_ROLES = frozenset("alert banner complementary contentinfo dialog menu navigation search".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}}
_WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}}
_PUNCTUATION = re.compile(r"[^\w\s]")

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>?""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")


_NAMED, _SIGNED, _HARD = 1, 2, 3


def _says(token: str) -> bool:
    """Whether a name as a whole is one of boilerplate: one of the words, or several of them with plain ones."""
    parts = [w.lower() for w in _SPLIT.split(token) if w]
    return bool(parts) and all(w in _WORDS or w in _PLAIN for w in parts) and any(w in _WORDS for w in parts)


def _boilerplate(tag: str, attributes: str, inside: bool) -> int:
    """_HARD: the element's kind or hiding says so; _SIGNED: it is a form or its role says so; _NAMED: its class or id does; else 0."""
    if tag in _OUT or (tag == "header" and not inside):
        return _HARD
    kind = _SIGNED if tag in _SOFT else 0
    if not attributes or tag in ("html", "body"):
        return kind
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _NONE.search(value)):
            return _HARD
        if name == "role" and value.strip().lower() in _ROLES:
            kind = _SIGNED
        elif name in ("class", "id") and any(map(_says, value.split())):
            kind = max(kind, _NAMED)
    return kind


_CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


class Page:
    """Text blocks of a page, each with path, container and the innermost named element around it (-1 in hard boilerplate)."""

    def __init__(self, source: str):
        self.paths: dict[tuple[int, str], int] = {}
        self.parent, self.holds = [-1], [True]
        self.texts: list[str] = []
        self.path: list[int] = []
        self.node: list[int] = []
        self.named = [-1]  # the named element around each named element; 0: none
        self.mark: list[int] = []
        # whether a block, or a named element, is in an article or main element
        self.inside: list[bool] = []
        self.named_inside = [False]
        self.signed = [False]
        # characters of a block that stand in links, and the shape (tag and class) of each container
        self.linked: list[int] = []
        self.shape = [""]
        self._read(source)

    def heads(self) -> list[bool]:
        """For each path whether it lies in a heading."""
        found = [False] * len(self.paths)
        for (parent, tag), k in self.paths.items():  # a path comes after the one it extends
            found[k] = tag in _HEADS or (parent >= 0 and found[parent])
        return found

    def _read(self, source: str) -> None:
        # open elements: tag, path, container, named element (-1: hard boilerplate), inside an article
        stack = [("", -1, 0, 0, False)]
        opened: dict[str, int] = {}
        parts: list[str] = []
        where, linked = stack[0], 0

        def flush():
            nonlocal linked
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    self.texts.append(text)
                    self.path.append(where[1])
                    self.node.append(where[2])
                    self.mark.append(where[3])
                    self.inside.append(where[4])
                    self.linked.append(linked)
            linked = 0

        def pop():
            opened[stack.pop()[0]] -= 1

        at = 0
        while True:
            m = _TAG.search(source, at)
            raw = source[at : m.start()] if m else source[at:]
            if raw:
                if not parts:
                    where = stack[-1]
                parts.append(raw)
                linked += len(raw) if opened.get("a", 0) else 0
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                if tag in _BLOCK:
                    flush()
                if opened.get(tag, 0):
                    if tag not in _BLOCK and any(s[0] in _BLOCK for s in stack[_last(stack, tag) :]):
                        continue
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                continue
            attributes = m[3] or m[6] or ""
            if tag in _BLOCK:
                flush()
                if opened.get("p", 0) and tag not in ("option", "body", "html"):
                    k = _last(stack, "p")
                    while len(stack) > k:
                        pop()
                if tag in _CLOSES:
                    k = len(stack) - 1
                    while k > 0 and stack[k][0] not in _WITHIN[tag]:
                        if stack[k][0] in _CLOSES[tag]:
                            while len(stack) > k:
                                pop()
                            break
                        k -= 1
            elif tag == "br":
                parts.append(" ")
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if tag in _VOID:  # a slash at the end closes no other element
                continue
            _, path, node, mark, inside = stack[-1]
            inside = inside or tag in ("article", "main")
            if tag in _BLOCK or tag == "a":
                path = self.paths.setdefault((path, tag), len(self.paths))
            if tag in _HOLDS:
                self.parent.append(node)
                found = _CLASS.search(attributes)
                self.shape.append(f"{tag}.{' '.join((found[1] or found[2] or found[3] or '').split())}" if found else tag)
                node = len(self.parent) - 1
            kind = _boilerplate(tag, attributes, inside) if mark >= 0 else 0
            if kind in (_NAMED, _SIGNED):
                self.signed.append(kind == _SIGNED)
                self.named.append(mark)
                self.named_inside.append(stack[-1][4])
                mark = len(self.named) - 1
            stack.append((tag, path, node, -1 if kind == _HARD else mark, inside))
            opened[tag] = opened.get(tag, 0) + 1
        flush()


def _last(stack: list, tag: str) -> int:
    k = len(stack) - 1
    while stack[k][0] != tag:
        k -= 1
    return k


def _smooth(values: list[float], radius: int = 1) -> list[float]:
    kernel = [math.exp(-((i / radius) ** 2) / 2) for i in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for j, w in enumerate(kernel):
            k = i + j - radius
            if 0 <= k < len(values):
                total += w * values[k]
                weight += w
        out.append(total / weight)
    return out


def _around_article(page: Page, named: int) -> bool:
    """Whether a named element holds the article or main element, or a part of it."""
    for mark, inside in zip(page.mark, page.inside, strict=True):
        while inside and mark > 0:
            if mark == named:
                return True
            mark = page.named[mark]
    return False


def path_ratios(lengths: list[int], marks: list[int], path: list[int]) -> tuple[list[float], float]:
    """For each block the fused ratio of its tag path, and the threshold for content.

    lengths, marks: each block's characters and punctuation marks.  Both are added up over a path and divided by its
    blocks, smoothed along the page and multiplied; where nothing is punctuated, length alone counts.  The
    threshold is the standard deviation over the page, or the greatest value if that is less.
    """
    length, mark, count = {}, {}, {}
    for n, m, p in zip(lengths, marks, path, strict=True):
        length[p], mark[p], count[p] = length.get(p, 0) + n, mark.get(p, 0) + m, count.get(p, 0) + 1
    tpr = _smooth([length[p] / count[p] for p in path])
    ppr = _smooth([mark[p] / count[p] for p in path])
    fused = [a * b for a, b in zip(tpr, ppr, strict=True)]
    if not any(fused):
        fused = tpr
    mean = sum(fused) / len(fused)
    return fused, min(math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused)), max(fused))


def _container(page: Page, own: list[int], share: float) -> tuple[int, list[bool]]:
    """The deepest container with `share` of the weights in `own`, and for each container whether it is that or within."""
    weight = own.copy()
    for k in range(len(weight) - 1, 0, -1):
        weight[page.parent[k]] += weight[k]
    inner: dict[int, int] = {}
    for k in range(1, len(weight)):
        p = page.parent[k]
        if p not in inner or weight[k] > weight[inner[p]]:
            inner[p] = k
    root = 0
    while root in inner and weight[inner[root]] >= share * weight[0]:
        root = inner[root]
    near = [k == root for k in range(len(weight))]
    for k in range(root + 1, len(weight)):
        near[k] = near[page.parent[k]]
    return root, near


def _records(page: Page) -> list[bool]:
    """For each container whether it and at least two more, of one shape with a class, stand in one parent."""
    count: dict[tuple[int, str], int] = {}
    for p, x in zip(page.parent, page.shape, strict=True):
        count[p, x] = count.get((p, x), 0) + 1
    found = [p >= 0 and "." in x and count[p, x] >= 3 for p, x in zip(page.parent, page.shape, strict=True)]
    for k in range(1, len(found)):
        found[k] = found[k] or found[page.parent[k]]
    return found


def _dropped(page: Page, lengths: list[int], fused: list[float], bound: float, chosen: list[bool], said: bool, share: float) -> list[bool]:
    """For each named element whether its name and a second sign speak against it."""
    many = len(page.named)
    # of the blocks of each named element: chosen characters, all characters, linked ones, blocks, sum of ratios, in the container, in records, first and last block
    held, size, linked, count, ratio, within, record = ([0] * many for _ in range(7))
    last_of, own = [-1] * many, [0] * len(page.parent)
    for n, node, yes in zip(lengths, page.node, chosen, strict=True):
        own[node] += n if yes else 0
    _, near = _container(page, own, share)
    records = _records(page)
    for at, mark in enumerate(page.mark):
        if mark < 0:
            continue
        for x, add in ((held, lengths[at] if chosen[at] else 0), (size, lengths[at]), (linked, page.linked[at]), (count, 1), (ratio, fused[at]), (within, near[page.node[at]]), (record, records[page.node[at]])):
            x[mark] += add
        last_of[mark] = at
    for k in range(many - 1, 0, -1):
        p = page.named[k]
        if p >= 0:
            for x in (held, size, linked, count, ratio, within, record):
                x[p] += x[k]
            last_of[p] = max(last_of[p], last_of[k])
    last = max((at for at, yes in enumerate(chosen) if yes), default=-1)
    drop = [False] * many
    for k in range(1, many):
        outside = said and not page.named_inside[k] and not _around_article(page, k)
        sign = page.signed[k] or 2 * linked[k] >= size[k] or not within[k] or last_of[k] >= last or 2 * record[k] >= count[k] or ratio[k] < 2 * bound * count[k]
        drop[k] = drop[page.named[k]] or outside or (2 * held[k] < held[0] and sign)
    return drop


def _comments(page: Page, chosen: list[bool], share: float) -> list[bool]:
    """For each block whether it lies in records of one shape behind the article, which begin with a short line and have no heading."""
    heads, gone = page.heads(), [False] * len(page.texts)
    groups: dict[tuple[int, str], dict[int, list[int]]] = {}
    top: list[tuple[tuple[int, str], int] | None] = [None] * len(page.parent)
    count: dict[tuple[int, str], int] = {}
    for p, x in zip(page.parent, page.shape, strict=True):
        count[p, x] = count.get((p, x), 0) + 1
    for k in range(1, len(page.parent)):
        key = (page.parent[k], page.shape[k])
        top[k] = (key, k) if "." in page.shape[k] and count[key] >= 3 else top[page.parent[k]]
    for at, node in enumerate(page.node):
        if top[node] is not None and page.mark[at] >= 0:
            key, k = top[node]
            groups.setdefault(key, {}).setdefault(k, []).append(at)
    whole = sum(len(t) for t, yes in zip(page.texts, chosen, strict=True) if yes)
    for members in groups.values():
        blocks = [at for own in members.values() for at in own]
        text = sum(len(page.texts[at]) for at in blocks if chosen[at])
        before = any(yes for yes in chosen[: min(blocks)])
        after = any(yes for at, yes in enumerate(chosen) if at > max(blocks))
        short = all(len(own) >= 2 and len(page.texts[own[0]]) <= 60 and page.texts[own[0]][-1] not in ".!?:;" for own in members.values())
        plain = not any(page.path[at] >= 0 and heads[page.path[at]] for at in blocks)
        if before and not after and short and plain and 2 * text < whole:
            for at in blocks:
                gone[at] = True
    return gone


def content_blocks(source: str | None, share: float = 0.8) -> list[str]:
    """The article's blocks, in page order: all chosen ones, and others that stand with them.

    share: how much of the chosen text the container must hold whose other blocks are kept as well; chosen
    blocks are kept wherever they are.
    """
    if not source:
        return []
    page = Page(source)
    if not page.texts:
        return []
    lengths, marks = [len(t) for t in page.texts], [len(_PUNCTUATION.findall(t)) for t in page.texts]
    fused, bound = path_ratios(lengths, marks, page.path)
    chosen = [x >= bound and mark >= 0 for x, mark in zip(fused, page.mark, strict=True)]
    if not any(chosen):
        chosen = [mark >= 0 for mark in page.mark]
    said = any(x and not mark for x, mark in zip(page.inside, page.mark, strict=True))
    drop = _dropped(page, lengths, fused, bound, chosen, said, share)
    out = [mark < 0 or drop[mark] for mark in page.mark]
    if not any(c and not o for c, o in zip(chosen, out, strict=True)):  # the names would leave nothing
        if said:
            chosen = [x and not o for x, o in zip(page.inside, out, strict=True)]
        if not any(c and not o for c, o in zip(chosen, out, strict=True)):
            out = [mark < 0 for mark in page.mark]
    chosen = [c and not o for c, o in zip(chosen, out, strict=True)]
    if not any(chosen):
        return []
    out = [o or x for o, x in zip(out, _comments(page, chosen, share), strict=True)]
    chosen = [c and not o for c, o in zip(chosen, out, strict=True)]
    own = [0] * len(page.parent)
    for text, node, yes in zip(page.texts, page.node, chosen, strict=True):
        own[node] += len(text) if yes else 0
    root, near = _container(page, own, share)
    # outside the container, chosen blocks must also reach the threshold as their own container has them
    local: dict[int, list[int]] = {}
    for n, m, node in zip(lengths, marks, page.node, strict=True):
        x = local.setdefault(node, [0, 0, 0])
        x[0], x[1], x[2] = x[0] + n, x[1] + m, x[2] + 1
    plain = not any(marks)
    stands = {k: near[k] or (n / c) * (1 if plain else m / c) >= bound for k, (n, m, c) in local.items()}
    around, k = set(), root
    while k >= 0:
        around.add(k)
        k = page.parent[k]
    heads, started, out_blocks = page.heads(), False, []
    # containers beside the article's, of which every block is chosen and none links, or is a heading
    pure, titled = {k: page.parent[k] in around for k in local}, {k: page.parent[k] in around for k in local}
    for at, node in enumerate(page.node):
        pure[node] = pure[node] and chosen[at] and not page.linked[at]
        titled[node] = titled[node] and page.path[at] >= 0 and heads[page.path[at]] and not page.linked[at]
    for at, (text, node) in enumerate(zip(page.texts, page.node, strict=True)):
        if out[at]:
            continue
        title = page.path[at] >= 0 and heads[page.path[at]] and (node in around or titled[node]) and not started
        if chosen[at] and (stands[node] or pure[node]) or near[node] or (own[node] and stands[node]) or title:
            out_blocks.append(text)
        started = started or (near[node] and chosen[at])
    return out_blocks


def _extract(batches):
    for batch in W.pieces(batches, "html"):
        found = ["\n\n".join(content_blocks(h)) for h in batch.column("html").to_pylist()]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
