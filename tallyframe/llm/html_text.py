"""Main text of web pages by composite text density.

The page becomes a tree of elements. Elements that hold no article by their
name, role, class or id are cut first, unless they contain one all the same. Every element then gets its composite
density: characters per tag, adjusted by the share of link characters and link
tags, with the page's own link share as a base. The element whose children's
densities sum to most is the main subtree; where it lies in an article or main
element, that element is. Elsewhere the least density on the way from it to the
body is the bound: whatever stands beside this way and is not less dense is text,
too, as are headings, and what lies between two parts of the text unless it is
mostly links. The blocks of all parts are the text, in page order.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyframe.llm import units

# Element names and words of the HTML language and its use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CUT = frozenset(
    "head script style noscript template iframe nav header footer aside form button select textarea input dialog "
    "menu svg canvas object embed audio video map title xmp noframes".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login sidebar side "
    "menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead comment comments "
    "respond disqus reply replies share sharing social related recommended recommendations widget widgets toolbar skip".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
P_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
# element: (those a new one ends, those that bound the search)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
P_BOUND = frozenset("article section div td th li table blockquote body main button figure".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>", re.S
)
# Values are read with their names, so words inside a value are no names.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_LETTERS = re.compile(r"[a-z]+")
# Tokens with one of these tell what the page has beside the element.
LAYOUT_WORDS = frozenset("has no with without hide show".split())
# Second words that leave the first one its meaning: ad-slot, cookie-bar.
BOX_WORDS = frozenset("area bar block box buttons container inner item items link links list panel section slot unit wrap wrapper".split())
# Names that are signs by themselves; only a main element inside speaks against them.
STRONG = CUT - {"form", "header", "dialog"}


class Element:
    __slots__ = ("name", "parent", "inside", "chars", "tags", "link_chars", "links", "density", "cut", "holds")

    def __init__(self, name: str, parent: Element | None):
        self.name, self.parent, self.inside = name, parent, []
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = 0.0
        self.cut = False
        self.holds = 0  # 2: contains a main element, 1: an article


def _tells(token: str) -> bool:
    """Whether a class or an id says that the element holds no article: as a
    whole or by its end, as in site-footer."""
    words = _LETTERS.findall(token)
    if not words or not LAYOUT_WORDS.isdisjoint(words):
        return False
    if words[-1] in BOX_WORDS and len(words) > 1:
        words.pop()
    return words[-1] in CUT_WORDS and (words[-1] != "side" or len(words) == 1)


def _marked(rest: str) -> bool:
    """Whether the attributes say so."""
    if "=" not in rest and "hidden" not in rest.lower():
        return False
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "role" and value.strip() in CUT_ROLES:
            return True
        if key in ("class", "id") and any(map(_tells, value.split())):
            return True
    return False


def _is_cut(name: str, rest: str) -> bool:
    return name in CUT or name not in ("html", "body", "article", "main") and _marked(rest)


def _pruned(root: Element) -> Element:
    """``root`` without the elements to cut. One with an article or a main element
    inside stays; comments and teasers marked as such are no articles here."""
    for e in reversed(_in_order(root)):
        e.inside = [x for x in e.inside if type(x) is str or not x.cut or x.holds > (x.name in STRONG)]
        for x in e.inside:
            if type(x) is Element:
                e.holds = max(e.holds, 2 if x.name == "main" else x.holds)
    return root


def tree(page: str) -> Element:
    """The elements of the page that are not cut, texts between them decoded."""
    root = Element("#page", None)
    here, at = root, 0
    stack: list[str] = []  # names of the open elements

    def close(n: int) -> None:
        nonlocal here
        for _ in range(n):
            stack.pop()
            here = here.parent

    def text(raw: str) -> None:
        if raw:
            here.inside.append(html.unescape(raw))

    def end(names, bound) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k] in names:
                close(len(stack) - k)
                return
            if stack[k] in bound:
                return

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["close"] or m["close2"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] == name:
                    close(len(stack) - k)
                    break
            continue
        rest = m["rest"] or m["rest2"] or ""
        if name in P_ENDS:
            end(("p",), P_BOUND)
        if name in ENDS:
            end(*ENDS[name])
        if name in RAW:
            stop = re.compile(rf"</{name}[\s>/]|\Z", re.I).search(page, at)
            raw, at = page[at : stop.start()], stop.start()
            done = page.find(">", at)
            at = n if done < 0 else done + 1
            if name not in CUT:
                text(raw)
            continue
        if name in VOID:
            here.inside.append(" " if name in ("br", "wbr") else Element(name, here))
            continue
        child = Element(name, here)
        child.cut = _is_cut(name, rest)
        if name == "article" and not _marked(rest):
            child.holds = 1
        here.inside.append(child)
        here = child
        stack.append(name)
    return _pruned(root)


def _in_order(root: Element) -> list[Element]:
    out, todo = [], [root]
    while todo:
        e = todo.pop()
        out.append(e)
        todo.extend(x for x in e.inside if type(x) is Element)
    return out


def measure(root: Element) -> list[Element]:
    """Fill in counts and densities; all elements, parents first."""
    every = _in_order(root)
    for e in reversed(every):
        for x in e.inside:
            if type(x) is Element:
                e.chars += x.chars
                e.tags += x.tags + 1
                e.link_chars += x.link_chars
                e.links += x.links
            else:
                e.chars += len("".join(x.split()))
        if e.name == "a":
            e.link_chars, e.links = e.chars, e.links + 1
    share = root.link_chars / max(root.chars, 1)
    for e in every:
        e.density = _density(e, share)
    return every


def _density(e: Element, share: float) -> float:
    if not e.chars:
        return 0.0
    plain, links, tags = max(e.chars - e.link_chars, 1), max(e.link_chars, 1), max(e.tags, 1)
    base = math.log(e.chars / plain * e.link_chars + share * e.chars + math.e)
    return e.chars / tags * math.log(max(e.chars / links * tags / max(e.links, 1), 1.0)) / max(math.log(base), 1.0)


def _parts(e: Element, inner: Element, share: float) -> list[Element]:
    """What lies directly in ``e``: ``inner``, its elements that are no inline
    ones, and each run of text and inline elements between them as one."""
    out: list[Element] = []
    for x in e.inside:
        if x is inner or type(x) is Element and x.name not in INLINE:
            out.append(x)
            continue
        if not out or out[-1].name != "#run":
            out.append(Element("#run", e))
        run = out[-1]
        run.inside.append(x)
        if type(x) is Element:
            run.chars, run.tags = run.chars + x.chars, run.tags + x.tags + 1
            run.link_chars, run.links = run.link_chars + x.link_chars, run.links + x.links
        else:
            run.chars += len("".join(x.split()))
    for x in out:
        if x.name == "#run":
            x.density = _density(x, share)
    return out


def main_element(root: Element) -> Element:
    """The main subtree, or an element made of all parts of the text."""
    every = measure(root)
    body = next((e for e in every if e.name == "body"), root)

    def total(e: Element) -> float:
        return sum(x.density for x in e.inside if type(x) is Element)

    best = max((e for e in every if e.name not in INLINE), key=total, default=root)
    if total(best) == 0.0:
        best = body
    outer = best
    while outer is not None and outer.name not in ("article", "main"):
        outer = outer.parent
    if outer is not None:
        return outer
    way = [best]
    while way[-1] is not body and way[-1].parent is not None:
        way.append(way[-1].parent)
    least = min(e.density for e in way)
    share = root.link_chars / max(root.chars, 1)
    before: list[Element] = []  # last first
    after: list[Element] = []
    for inner, parent in zip(way, way[1:], strict=False):
        parts = _parts(parent, inner, share)
        here = next(k for k, x in enumerate(parts) if x is inner)
        taken = [k for k, x in enumerate(parts) if k == here or x.chars and (x.density >= least or x.name in HEADINGS and 2 * x.link_chars < x.chars)]
        sure = set(taken)
        own = [k for k in range(taken[0], taken[-1] + 1) if k in sure or 2 * parts[k].link_chars < parts[k].chars]
        before += [parts[k] for k in reversed(own) if k < here]
        after += [parts[k] for k in own if k > here]
    if not before and not after:
        return best
    whole = Element("#text", None)
    whole.inside = [*reversed(before), best, *after]
    return whole


def blocks(element: Element) -> list[str]:
    """The texts of the element's blocks in page order, white space made single."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        joined = " ".join("".join(run).split())
        run.clear()
        if joined:
            out.append(joined)

    todo: list = [element]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif type(x) is Element:
            if x.name in INLINE:
                todo.extend(reversed(x.inside))
            else:
                flush()
                todo.append(None)
                todo.extend(reversed(x.inside))
        else:
            run.append(x)
    flush()
    return out


def main_text(page: str | None) -> str:
    """The main text of one page; empty where there is none."""
    return "\n\n".join(blocks(main_element(tree(page)))) if page else ""


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null, empty and textless pages have an empty text. Broken markup is read as
    far as it goes. Repeated rows are extracted one by one; an empty table gives
    an empty result; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for part in units.slices(batch, "html"):
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
