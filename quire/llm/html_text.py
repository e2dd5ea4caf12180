"""Operator 2, HTML extraction by minimum-cut labelling.

A page is read into blocks: stretches of text between the starts and ends of
block elements. A linear classifier over a block's tag, length, links and the elements it lies
in gives evidence for content (positive) or boilerplate (negative); evidence becomes
the block's terminal capacity, what labelling it otherwise would cost. Neighbours
in page order and blocks under one parent are tied by smoothness edges,
stronger the nearer they stand in the tree. The minimum cut labels the whole page
at once; the blocks on the source's side are the main text.

Names of elements are soft: a class, id or role that consists of words for
boilerplate and of words for page parts ("related-posts") tells much, one that only holds such a word
among others ("related-work") tells little, one that says that there is or isn't such a
part ("has-sidebar", "no-ads") nothing. What a wrapper is called does not count where
the article lies inside it: a marked article, or all paragraphs of a page that has no other text, however short. All steps but the cut take time in proportion to the page,
however deep its elements nest.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import table

# HTML's element names by kind.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their contents are not markup. What follows an unclosed one of the first two is its content to the end, other unclosed ones are empty.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
TO_THE_END = frozenset(["script", "style"])
#: Shown instead of what can't be shown, or not as text.
UNSEEN = frozenset("button template canvas object audio video svg annotation annotation-xml datalist".split())
CLOSES_P = BLOCK - {"body", "caption", "head", "html", "legend", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Elements whose start ends an open one of these kinds, unless one of the bounds lies between.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
}
# The classifier: tags and words of names that tell of boilerplate or content, and weights.
BOILER_TAGS = frozenset("nav footer aside form menu dialog search select fieldset head".split())
MAIN_TAGS = frozenset(["article", "main"])
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs consent contentinfo cookie cookies "
    "copyright dialog disclaimer footer gdpr legal login menu menubar modal nav navbar navigation newsletter next notice notices notification overlay pager pagination popup prev previous promo "
    "promoted promotion recommended recommendations related search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar topbar widget widgets complementary alert".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus feedback replies reply respond reviews".split())
#: Words for boxes that may hold anything: where a page has no other content, such a box holds its article.
HOLDER_WORDS = frozenset("alert banner dialog legal modal notice overlay popup widget widgets".split())
HEAD_WORDS = frozenset(["header", "masthead"])
MAIN_WORDS = frozenset("article content entry main post story".split())
#: Words for parts of a page that say nothing of what is in them.
PART_WORDS = frozenset(
    "area bar block body bottom box button buttons card column container entry form global group holder icons inner item items left link links list main middle module outer page panel "
    "post posts primary reader region right row secondary section site slot small text thread top unit user users view wrap wrapper article articles content stories story".split()
)
#: Words before the name of a part that tell whether the page has it.
HAVING = frozenset("has have no not with without is hide hides show shows".split())
W_MAIN, W_OUTSIDE, W_UNMARKED, W_BOILER, W_WEAK = 3.0, -3.5, -0.5, -9.0, -1.2
W_PARAGRAPH, W_HEADING, W_ITEM, W_BARE, W_LENGTH, W_LINKS = 1.2, 0.8, -0.6, 0.6, 1.0, -4.0
#: Of pages without a marked article: a block with words outside links. What part of links counts in the article, and in a paragraph with such words.
W_WORDS, LINKED_PROSE = 0.9, 0.4
#: A name's evidence counts for its first levels.
WEAK_LEVELS = 2
#: Characters without links that make a block prose; share of a page's prose that makes a wrapper the article's; and how much that is at least.
PROSE, MOST, ENOUGH = 80, 2 / 3, 400
#: Of smoothness edges: neighbours in page order, blocks under one parent.
S_ORDER, S_PARENT, SCALE = 1.0, 0.4, 1000

_ATTRIBUTES = r"""((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+|=)*+)"""
_TAG = re.compile(rf"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)(?:{_ATTRIBUTES}>|([^>]*+)(?:>|\Z))|<[!?/][^>]*+(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""", re.I)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ENDED = re.compile(r"""(?:^|[\s"'])/\s*$""")


@dataclass(eq=False)
class Element:
    """What an element's own start tag says, and, after ``inherit``, what it has from those around it."""

    tag: str
    parent: "Element | None"
    depth: int
    block: "Element"
    main: bool = False
    strong: bool = False
    comments: bool = False
    holder: bool = False
    head: bool = False
    weak: int = 0
    hidden: bool = False
    closed: bool = False
    in_main: bool = False
    boiler: bool = False
    weakness: int = 0
    prose: int = 0


@dataclass(eq=False)
class Block:
    text: str
    element: Element
    linked: int
    worded: bool = False  # it has words outside links
    evidence: float = field(default=0.0)


@lru_cache(maxsize=4096)
def name_says(name: str) -> tuple[bool, bool, bool, bool, bool, bool]:
    """(main, strong, comments, holder, head, weak) of a class, id or role."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[0] in HAVING:
        return False, False, False, False, False, False
    parts = [w for w in words if not w.isdigit()]
    told = [w for w in parts if w in BOILER_WORDS or w in COMMENT_WORDS]
    head = any(w in HEAD_WORDS for w in parts)
    whole = bool(told) and all(w in BOILER_WORDS or w in COMMENT_WORDS or w in PART_WORDS or w in HEAD_WORDS for w in parts)
    main = bool(parts) and not told and not head and any(w in MAIN_WORDS for w in parts) and all(w in MAIN_WORDS or w in PART_WORDS for w in parts)
    alone = head and not told and all(w in HEAD_WORDS or w in PART_WORDS for w in parts) and not (set(parts) & {"article", "entry", "post", "story"})
    return main, whole, whole and any(w in COMMENT_WORDS for w in told), whole and all(w in HOLDER_WORDS for w in told), alone, bool(told) and not whole


def _open(tag: str, attributes: str, parent: Element) -> Element:
    at = Element(tag, parent, parent.depth + 1, parent.block)
    if tag in BLOCK:
        at.block = at
    named, others = False, tag in BOILER_TAGS and tag not in ("form", "fieldset")
    for name, *values in _NAMED.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            at.hidden = True
        elif name in ("class", "id", "role"):
            for one in value.split():
                main, strong, comments, holder, head, weak = name_says(one)
                named |= main
                others |= strong and not holder
                at.strong |= strong
                at.comments |= comments
                at.head |= head
                at.weak |= weak
    if tag in ("html", "body"):
        at.strong = at.comments = at.head = False
        at.weak = 0
    else:
        at.main = tag in MAIN_TAGS or named and tag not in ("a", "span")
    at.hidden |= tag in UNSEEN
    at.head |= tag == "header"
    at.strong |= tag in BOILER_TAGS
    at.holder = at.strong and not others
    if tag == "main":
        at.strong = at.comments = at.head = at.holder = False
    return at


def read_blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The page's blocks and elements in order; unclosed and wrongly nested elements are closed much as browsers do."""
    root = Element("#root", None, 0, None)
    root.block = root
    stack, elements, blocks, buffer = [root], [root], [], []
    where: dict[str, list[int]] = {}  # of each tag, the places in the stack where it is open
    unclosed: set[str] = set()  # tags that aren't closed anywhere behind the current place
    linked, worded = 0, False

    def flush() -> None:
        nonlocal linked, worded
        if buffer and (text := " ".join("".join(buffer).split())):
            blocks.append(Block(text, stack[-1].block, linked, worded))
        buffer.clear()
        linked, worded = 0, False

    def pop_to(index: int) -> None:
        while len(stack) > index:
            e = stack.pop()
            if not e.closed:
                where[e.tag].pop()

    def last(tags, bounds=()) -> int:
        i = max((where[t][-1] for t in tags if where.get(t)), default=0)
        return i if i > max((where[t][-1] for t in bounds if where.get(t)), default=0) else 0

    def closing_tag(tag: str, at: int):
        if tag in unclosed:
            return None
        found = _closing(tag).search(page, at)
        if not found:
            unclosed.add(tag)
        return found

    def say(raw: str) -> None:
        nonlocal linked, worded
        e = stack[-1]
        if (e.boiler or e.hidden) and not (e.block.boiler or e.block.hidden):
            return  # hidden or boilerplate within a block's text
        text = html.unescape(raw) if "&" in raw else raw
        buffer.append(text)
        if where.get("a"):
            linked += len(text.strip())
        else:
            worded = worded or any(map(str.isalnum, text))

    at, end = 0, len(page)
    while at < end:
        found = _TAG.search(page, at)
        if not found:
            say(page[at:])
            break
        if found.start() > at:
            say(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        closing, tag = found[1], found[2].lower()
        if closing:
            i = last((tag,))
            if tag in BLOCK:
                if i:
                    flush()
                    pop_to(i)
                elif tag == "p":
                    flush()
            elif i > stack[-1].block.depth:
                pop_to(i)
            elif i:  # an inline element that ends inside a block that began in it
                stack[i].closed = True
                where[tag].pop()
            continue
        if tag in RAW:
            close = closing_tag(tag, at)
            at = close.end() if close else end if tag in TO_THE_END else at
            if tag in ("textarea", "iframe"):
                buffer.append(" ")
            continue
        if tag in VOID or tag in UNSEEN and (_ENDED.search(found[3] or "") and tag == "svg" or not closing_tag(tag, at)):
            if tag in BLOCK:
                flush()
                if i := last(("p",), ("button", "td", "th", "table")):
                    pop_to(i)
            elif tag == "br":
                buffer.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P and (i := last(("p",), ("button", "td", "th", "table"))):
                pop_to(i)
            if tag in SIBLINGS:
                same, bounds = SIBLINGS[tag]
                while i := last(same, bounds):
                    pop_to(i)
        if tag == "a" and (i := last(("a",))) > stack[-1].block.depth:
            pop_to(i)
        e = _open(tag, found[3] or found[4] or "", stack[-1])
        e.depth = len(stack)
        # for texts inside a block; ``inherit`` looks at the whole tree
        e.boiler = stack[-1].boiler if tag not in BLOCK else False
        e.hidden |= stack[-1].hidden
        if tag not in BLOCK:
            e.boiler |= e.strong
            if tag in ("button", "object"):
                buffer.append(" ")
        where.setdefault(tag, []).append(len(stack))
        stack.append(e)
        elements.append(e)
    flush()
    return blocks, elements


@lru_cache(maxsize=64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I)


def _free(elements: list[Element], blocks: list[Block]) -> set[int]:
    """Elements (by ``id``) whose names and tags are not held against them, as the article lies inside."""

    def chain(e: Element | None) -> set[int]:
        out = set()
        while e is not None:
            out.add(id(e))
            e = e.parent
        return out

    def upwards(e: Element, of: dict[int, tuple[bool, bool]]) -> tuple[bool, bool]:
        inner = of[id(e.parent)] if e.parent is not None else (False, False)
        return inner[0] or e.strong or e.hidden, inner[1] or e.comments or e.hidden

    shut: dict[int, tuple[bool, bool]] = {}  # (some element up to here is boilerplate, or comments)
    for e in elements:
        shut[id(e)] = upwards(e, shut)
    named = [e for e in elements if e.tag == "main" and not e.hidden]
    if named:
        return set().union(*map(chain, named[:1]))
    if not any(e.strong for e in elements) or any(e.main and not shut[id(e)][0] for e in elements):
        return set()
    for b in blocks:
        if len(b.text) - b.linked >= PROSE and not b.element.hidden:
            b.element.prose += len(b.text) - b.linked
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.prose += e.prose
    whole = elements[0].prose
    most = max((e for e in elements if e.main and not shut[id(e)][1]), key=lambda e: e.prose, default=None)
    if most is not None and 2 * most.prose >= max(whole, 1):
        return chain(most)
    box = _only_box(elements, blocks)
    if box is not None:
        return chain(box)
    if whole < ENOUGH:
        return set()
    layout = [e for e in elements if e.strong and not shut[id(e)][1] and (e.tag not in BOILER_TAGS or e.tag in ("form", "fieldset")) and e.prose >= MOST * whole]
    return {id(e) for e in layout}


def _only_box(elements: list[Element], blocks: list[Block]) -> Element | None:
    """The innermost form or box that holds all paragraphs that could be the page's article, however short it is; none where a text
    that isn't a heading or links stands outside of forms, boxes and boilerplate."""
    inside: dict[int, tuple[bool, bool]] = {}  # (in a form or box, in other boilerplate)
    for e in elements:
        boxed, other = inside[id(e.parent)] if e.parent is not None else (False, False)
        inside[id(e)] = boxed or e.strong, other or e.hidden or e.strong and not e.holder
    paragraphs: dict[int, int] = {id(e): 0 for e in elements}
    total = 0
    for b in blocks:
        boxed, other = inside[id(b.element)]
        if other or not b.worded:
            continue
        if not boxed and not b.element.head and b.element.tag not in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return None
        if boxed and b.element.tag in ("p", "blockquote", "pre"):
            paragraphs[id(b.element)] += 1
            total += 1
    for e in reversed(elements):
        if e.parent is not None:
            paragraphs[id(e.parent)] += paragraphs[id(e)]
    around = [e for e in elements if total and e.strong and e.holder and not e.hidden and paragraphs[id(e)] == total]
    return around[-1] if around else None


def inherit(elements: list[Element], blocks: list[Block]) -> None:
    """What elements have from those around them: whether they lie in the article, in boilerplate, and how many weak names stand above."""
    free = _free(elements, blocks)
    for e in elements:
        up = e.parent
        e.in_main, e.boiler, e.weakness = (up.in_main, up.boiler, up.weakness) if up is not None else (False, False, 0)
        held = id(e) not in free
        if e.hidden or held and (e.strong or e.head and not e.in_main and not (e.main and e.tag in MAIN_TAGS)):
            e.boiler = True
        elif e.main:
            e.in_main = True
        e.weakness = min(WEAK_LEVELS, e.weakness + (held and e.weak))


def weigh(blocks: list[Block]) -> None:
    """Evidence of each block, by a linear classifier."""
    whole = any(b.element.in_main and not b.element.boiler for b in blocks)
    for b in blocks:
        tag, size = b.element.tag, len(b.text)
        x = W_MAIN if b.element.in_main else W_OUTSIDE if whole else W_UNMARKED
        if tag in ("p", "blockquote", "pre", "figcaption"):
            x += W_PARAGRAPH
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "td", "th"):
            x += W_HEADING
        elif tag == "li":
            x += W_ITEM
        elif tag in ("#root", "body") and not whole:
            x += W_BARE
        x += W_WORDS * (b.worded and not whole)
        prose = b.element.in_main or tag == "p" and b.worded and not whole
        x += W_LENGTH * min(1.5, size / 120) + W_LINKS * min(1.0, b.linked / size) * (LINKED_PROSE if prose else 1.0)
        b.evidence = x + W_WEAK * b.element.weakness + (W_BOILER if b.element.boiler else 0.0)


def _distance(a: Element, b: Element) -> int:
    """Steps from one element to the other in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(i, j, capacity) between blocks next in page order, and between a block and the one before it under the same parent."""
    out: list[tuple[int, int, int]] = []
    before: dict[int, int] = {}
    for j, b in enumerate(blocks):
        if j:
            out.append((j - 1, j, int(SCALE * S_ORDER / (1 + _distance(blocks[j - 1].element, b.element)))))
        parent = id(b.element.parent or b.element)
        if (i := before.get(parent)) is not None:
            out.append((i, j, int(SCALE * S_PARENT)))
        before[parent] = j
    return out


def source_side(evidence: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the source's side of the least minimum cut, by Dinic's maximum flow.

    Positive evidence is capacity from the source, negative to the sink; links have their capacity either way.
    """
    n = len(evidence)
    near: list[list[int]] = [[] for _ in range(n)]
    head, room = [], []
    for i, j, c in links:
        near[i].append(len(head))
        head.append(j)
        room.append(c)
        near[j].append(len(head))
        head.append(i)
        room.append(c)
    gives, takes = [max(0, e) for e in evidence], [max(0, -e) for e in evidence]
    while True:
        level, queue, reached = [-1] * n, deque(), False
        for i in range(n):
            if gives[i]:
                level[i] = 0
                queue.append(i)
        while queue:
            i = queue.popleft()
            reached |= takes[i] > 0
            for e in near[i]:
                if room[e] and level[head[e]] < 0:
                    level[head[e]] = level[i] + 1
                    queue.append(head[e])
        if not reached:
            return [x >= 0 for x in level]
        step = [0] * n
        for start in range(n):
            while gives[start]:
                path, i = [], start
                while not takes[i]:
                    while step[i] < len(near[i]) and not (room[e := near[i][step[i]]] and level[head[e]] == level[i] + 1):
                        step[i] += 1
                    if step[i] < len(near[i]):
                        path.append(near[i][step[i]])
                        i = head[path[-1]]
                    elif path:  # a dead end: back, and past the edge that led here
                        i = head[path.pop() ^ 1]
                        step[i] += 1
                    else:
                        break
                if not takes[i]:
                    break
                flow = min([gives[start], takes[i], *(room[e] for e in path)])
                gives[start] -= flow
                takes[i] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def labelled(page: str) -> list[tuple[Block, bool]]:
    """The page's blocks, and whether the minimum cut takes them for content."""
    blocks, elements = read_blocks(page)
    inherit(elements, blocks)
    weigh(blocks)
    return list(zip(blocks, source_side([round(SCALE * b.evidence) for b in blocks], edges(blocks))))


def main_text(page: str) -> str:
    """The main text: content blocks joined by line feeds."""
    return "\n".join(b.text for b, keep in labelled(page) if keep)


def extract_text(df: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without content, have an empty text. Repeated
    rows are extracted each; an empty table gives an empty result; other columns are
    not read.
    """
    own = df.select(F.coalesce(F.col(page), F.lit("")).alias("html"), F.col(page_id).alias("page_id"), F.col(url).alias("url"))

    def work(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    return own.mapInArrow(work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
