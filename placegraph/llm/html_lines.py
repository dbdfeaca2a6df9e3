"""The text lines of a web page: one per block, with what the markup says of it.

A line's level is 2 inside an article, 1 inside a main element, else 0. Lines inside
elements that the markup names as frame (menus, headers, footers, sidebars, notices,
adverts, forms, comments, hidden parts, scripts and styles) are left out.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")

# Element names of HTML and words that sites use for parts of their frame.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noframes xmp".split())
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
head header hgroup hr html legend li main menu nav noscript ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul""".split())
REPEATED = set("li dt dd tr td th option".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Frame that may hold articles of its own (teasers, comments): an article inside it is frame as well.
HARD_TAGS = set("nav aside footer dialog template menu noscript".split())
#: Frame that holds no article: one inside it was left open or wraps the page.
SOFT_TAGS = set("header form button select fieldset svg canvas object audio video search".split())
HARD_ROLES = set("navigation complementary contentinfo dialog alertdialog menu menubar".split())
SOFT_ROLES = set("banner search form alert status toolbar".split())
HARD_WORDS = set("""aside breadcrumb breadcrumbs comment comments commentlist discussion disqus footer menu modal nav navbar navigation navi outbrain popup recommended
related replies respond sidebar taboola teaser teasers widget widgets""".split())
SOFT_WORDS = set("""ad ads adbox advert adverts advertisement advertising adsense banner consent cookie cookies copyright disclaimer gdpr header login masthead newsletter
notice notices notification pager pagination paywall popin promo promoted promotion search share sharing signup skip social sponsor sponsored subscribe subscription
toolbar topbar tracking warning""".split())
NEGATIONS = {"no", "has", "with", "without", "non"}


@lru_cache(maxsize=4096)
def _frame(name: str, attributes: str) -> tuple[int, int, bool]:
    """How an element's own markup frames it (0 not, 1 soft, 2 hard), the level it opens, and whether it is frame as a header only."""
    found = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes.strip("/ \t\r\n\f") else {}
    role = found.get("role", "").lower().strip()
    level = 2 if name == "article" or found.get("itemprop", "").lower() == "articlebody" else 1 if name == "main" or role == "main" else 0
    words = [w.lower() for w in WORDS.findall(f"{found.get('class', '')} {found.get('id', '')}")]
    said = {w for before, w in zip(["", *words], words) if before not in NEGATIONS}
    if name in ("html", "body", "main") or role == "main":
        said = set()
    elif level:
        said &= {"comment", "comments", "teaser", "related", "recommended", "ad", "advert", "sponsored"}
    style = found.get("style", "").lower().replace(" ", "")
    if name in HARD_TAGS or role in HARD_ROLES or said & HARD_WORDS or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style:
        return 2, level, False
    soft = (said & SOFT_WORDS) | {w for w in (name, role) if w in SOFT_TAGS | SOFT_ROLES}
    return int(bool(soft)), level, soft == {"header"}


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """``(text, level)`` of each unframed block in page order, blank ones left out.

    Character references are decoded and white space is one space. Inside an article a
    header keeps its headings. An element that is never closed ends with its parent.
    """
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # name, frame, level, only headings
    opened: dict[str, int] = {}
    html, at = html or "", 0

    def flush():
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((text, stack[-1][2]))

    def cut(size: int):
        for name, *_ in stack[size:]:
            opened[name] -= 1
        del stack[size:]

    for m in TOKEN.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at and not stack[-1][1] and not stack[-1][3]:
            parts.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if m[1]:
            if opened.get(name):
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                cut(k)
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in BLOCKS:
            k = len(stack) - 1
            while k and stack[k][0] not in BLOCKS:
                k -= 1
            if stack[k][0] == "p" or (stack[k][0] == name and name in REPEATED):
                cut(k)
        _, frame, level, heads = stack[-1]
        own, opens, titled = _frame(name, m[3])
        if m[3].endswith("/") and own:
            continue
        if opens and frame == 1:
            frame = 0
        if titled and level and frame == 0:
            own, heads = 0, True
        elif name in HEADINGS:
            heads = False
        stack.append((name, max(frame, own), max(level, opens), heads))
        opened[name] = opened.get(name, 0) + 1
    if at < len(html) and not stack[-1][1] and not stack[-1][3]:
        parts.append(unescape(html[at:]))
    flush()
    return out
