"""The readable part of one page: a tree from the standard parser, the best block, and its clean HTML.

Every walk is a single pass over the nodes, children before parents, so time is linear in a page whatever its nesting.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

#: What marks content, in the order in which it is tried: ids, elements, a role, classes.
PREFERRED = [
    "#img-content", "#js_content", "article", "main", "[role=main]", ".article-content", ".article-body", ".post-content", ".entry-content", ".post-body",
    ".content-body", ".story-body", ".markdown-body", ".rich-text", ".richtext", ".doc-content", ".detail-content",
]
GENERIC = ["article", "main", "[role=main]", "section", "div"]
#: Characters that a block needs and the score that it must pass, for preferred and for generic blocks.
PREFERRED_LEAST, GENERIC_LEAST, SCORED_LEAST = (120, 40), (160, 60), 160
#: Names that speak for and against a block, and weights of what it holds.
POSITIVE = re.compile(r"article|content|entry|post|story|detail|body|text|markdown|rich", re.I)
NEGATIVE = re.compile(
    r"nav|menu|footer|header|sidebar|share|social|related|recommend|comment|breadcrumb|subscribe|newsletter|advert|ads|promo|cookie|modal|popup|pager|"
    r"pagination|toolbar|hero", re.I,
)
TEXT_WEIGHT, LINK_WEIGHT, POSITIVE_WEIGHT, NEGATIVE_WEIGHT = 0.035, 220, 120, 140
WEIGHTS = {"p": 24, "h": 28, "li": 8, "blockquote": 18, "pre": 22, "img": 10}
#: Phrases of what surrounds content, of lines that open it, and of what ends the messenger's articles.
BOILERPLATE = re.compile(
    r"相关阅读|推荐阅读|猜你喜欢|相关推荐|分享|扫码|打开微信|上一篇|下一篇|责任编辑|版权所有|声明：|广告|赞助|在小说阅读器|去阅读|沉浸阅读|related articles|read more|"
    r"share this|all rights reserved|cookie", re.I,
)
HARD_BOILERPLATE = re.compile(r"^\s*(?:相关阅读|推荐阅读|猜你喜欢|相关推荐|上一篇|下一篇|share this|related articles|read more|在小说阅读器|去阅读|沉浸阅读)", re.I)
LEADING_META = re.compile(r"^\s*(原创|作者|来源|编辑|文[:：]|by\s|发表于|阅读原文|在.+阅读$|在小说阅读器|去阅读|沉浸阅读)", re.I)
END_MARKER = re.compile(r"^(?:（完）|\(完\)|全文完|完)$")
SEPARATOR = re.compile(r"^(?:[.\-_*•。·…\s]{6,}|\.{6,}|。{6,}|_{6,}|\*{6,}|•{6,})$")
PROMO = re.compile(
    r"Tips[:：]|后台私信|交流群|加助理|网址[:：]|自动交易系统|复利吃息系统|知识星球|星球|私董会|定投|X ID[:：]|星标|感谢你的阅读|欢迎⭐|欢迎\*|web3leon|aidog\.xyz", re.I,
)
#: Elements that are never content, those that stay, their attributes, and those that a container keeps together.
REMOVED = set("script style noscript iframe object embed svg form button input textarea select dialog template canvas nav aside footer".split())
ALLOWED = set("article section p h1 h2 h3 h4 h5 h6 ul ol li blockquote pre code figure figcaption caption img a strong b em i u del sup sub br hr table thead tbody tr th td".split())
ATTRIBUTES = {
    "a": ["href", "title"], "img": ["src", "alt", "title"], "th": ["colspan", "rowspan", "scope"], "td": ["colspan", "rowspan"], "ol": ["start", "reversed"],
    "li": ["value"], "blockquote": ["cite"], "table": ["summary"],
}
KEPT_TOGETHER = set("table thead tbody tr th td caption ul ol blockquote pre figure".split())
PARAGRAPH_BREAKS = set("p ul ol li blockquote pre figure img table h1 h2 h3 h4 h5 h6".split())
MESSENGER_NOISE = {
    "id": set("meta_content js_tags js_profile_qrcode js_pc_qr_code_img".split()),
    "class": set("rich_media_meta_list rich_media_meta rich_media_tool rich_media_extra rich_media_area_extra wx_profile_msg_inner original_primary_card_tips reward_area qr_code_pc_outer js_reprinted_source".split()),
}
IMAGE_SOURCES = ["src", "data-src", "data-actualsrc", "data-original", "data-lazy-src", "data-url"]
MESSENGER = "mp.weixin.qq.com"
VOID = {"br", "hr", "img", "meta", "link", "input", "source", "wbr", "col", "area", "base", "embed", "param", "track"}
_HEADING = re.compile("h[1-6]")
_CODE = re.compile(r"[{}();\[\]]|=|function|const|var|let|import|export")


class Node:
    __slots__ = ("tag", "attrs", "children", "text", "links", "counts", "inside")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def signature(self) -> str:
        return " ".join(filter(None, [self.tag, *(self.attrs.get(k) for k in ("id", "class", "role", "aria-label"))])).lower()

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


class _Tree(HTMLParser):
    """A forgiving tree: void elements close themselves, and a p ends where another block starts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root", {})
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "h1", "h2", "h3", "div", "section", "article", "ul", "ol", "table", "blockquote", "pre") and self.stack[-1].tag == "p":
            self.stack.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)

    def parse_marked_section(self, i, report=1):
        """A section that HTML does not know is a comment up to the next >."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.rawdata.find(">", i) + 1 or -1


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def in_order(root: Node) -> list[Node]:
    """The elements below root in the document's order."""
    out, stack = [], root.elements()[::-1]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += node.elements()[::-1]
    return out


def text_of(node: Node) -> str:
    """The collapsed text of a node."""
    out, stack = [], [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            out.append(at)
        else:
            stack += at.children[::-1]
    return " ".join("".join(out).split())


def _joined(a: tuple[int, bool, bool], b: tuple[int, bool, bool]) -> tuple[int, bool, bool]:
    """Length of collapsed text, and whether white space stands before and after it, of two texts side by side."""
    if not a[0] or not b[0]:
        space = (a[1] or a[2]) if not a[0] else (b[1] or b[2])
        if not a[0] and not b[0]:
            return 0, space or b[1] or b[2], space or b[1] or b[2]
        return (b[0], b[1] or space, b[2]) if not a[0] else (a[0], a[1], a[2] or space)
    return a[0] + b[0] + (a[2] or b[1]), a[1], b[2]


def measure(node: Node) -> None:
    """Sets text, links (length of text in links) and counts of a node from its children, which are measured."""
    whole, node.links, node.counts, node.inside = (0, False, False), 0, {}, set()
    for c in node.children:
        if isinstance(c, str):
            words = c.split()
            whole = _joined(whole, (sum(map(len, words)) + max(0, len(words) - 1), c[:1].isspace(), c[-1:].isspace()))
        else:
            whole = _joined(whole, c.text)
            node.links += c.text[0] + c.links if c.tag == "a" else c.links
            for k, n in c.counts.items():
                node.counts[k] = node.counts.get(k, 0) + n
            kind = "h" if _HEADING.fullmatch(c.tag) else c.tag
            if kind in WEIGHTS:
                node.counts[kind] = node.counts.get(kind, 0) + 1
            node.inside |= c.inside | ({c.tag} & PARAGRAPH_BREAKS)
    node.text = whole


def _meets(node: Node, selector: str) -> bool:
    if selector[0] == "#":
        return node.attrs.get("id") == selector[1:]
    if selector[0] == ".":
        return selector[1:] in node.attrs.get("class", "").split()
    return node.attrs.get("role") == "main" if selector[0] == "[" else node.tag == selector


def score(node: Node) -> float:
    """The score of a measured block."""
    length = node.text[0]
    if length < SCORED_LEAST:
        return float("-inf")
    out, signature = length * TEXT_WEIGHT + sum(WEIGHTS[k] * n for k, n in node.counts.items()), node.signature()
    out += POSITIVE_WEIGHT * bool(POSITIVE.search(signature)) - NEGATIVE_WEIGHT * bool(NEGATIVE.search(signature))
    return out - LINK_WEIGHT * node.links / max(length, 1)


def content_root(root: Node) -> tuple[Node | None, float]:
    """The best block of a measured tree and its score; the body, with 0, where no block passes."""
    nodes = in_order(root)
    for groups, (least, bar) in (([[n for n in nodes if _meets(n, s)] for s in PREFERRED], PREFERRED_LEAST), ([[n for n in nodes if any(_meets(n, s) for s in GENERIC)]], GENERIC_LEAST)):
        best, most = None, float(bar)
        for node in (n for group in groups for n in group):
            if node.text[0] >= least and (s := score(node)) > most:
                best, most = node, s
        if best is not None:
            return best, most
    return next((n for n in nodes if n.tag == "body"), root), 0.0


def _density(node: Node) -> float:
    return node.links / node.text[0] if node.text[0] else 0.0


def _is_noise(node: Node, messenger: bool) -> bool:
    """Whether a measured element is no content."""
    a = node.attrs
    if node.tag in REMOVED or "hidden" in a or a.get("aria-hidden") == "true":
        return True
    if messenger and (a.get("id") in MESSENGER_NOISE["id"] or MESSENGER_NOISE["class"] & set(a.get("class", "").split())):
        return True
    signature, length = node.signature(), node.text[0]
    negative = bool(NEGATIVE.search(signature))
    if negative and not POSITIVE.search(signature):
        return True
    if 0 < length < 260 and BOILERPLATE.search(text := text_of(node)) and (HARD_BOILERPLATE.search(text) or negative or _density(node) > 0.28):
        return True
    return 0 < length < 1200 and _density(node) > 0.55


def _host(url: str) -> str | None:
    try:
        return urlsplit(url).hostname if "://" in url else None
    except ValueError:
        return None


def _absolute(value: str | None, base: str) -> str | None:
    try:
        out = urljoin(base, value.strip()) if value else ""
        return out if urlsplit(out).scheme in ("http", "https") and urlsplit(out).netloc else None
    except ValueError:
        return None


def _image_source(node: Node) -> str | None:
    srcset = node.attrs.get("srcset", "").split(",")[0].split()
    found = [node.attrs.get(k) for k in IMAGE_SOURCES] + srcset[:1]
    return next((x for x in found if x and not x.startswith("data:")), None)


def _is_layout(node: Node) -> bool:
    """Whether a pre of the messenger is there for its layout and not for code."""
    text = text_of(node)
    units = len(re.findall(r"[぀-ヿ㐀-鿿가-힯]|[A-Za-z0-9]+", text))
    return len(text) >= 20 and any(n.tag in ("p", "section", "div") for n in in_order(node)) and len(_CODE.findall(text)) < units * 0.05


def _clean(node: Node, base: str, messenger: bool) -> list[Node | str]:
    """What stays of an element whose children are clean: itself, its children, or nothing."""
    if node.tag == "source":
        return []
    if node.tag == "a":
        href = _absolute(node.attrs.get("href"), base)
        if href is None:
            return node.children
        node.attrs["href"] = href
    elif node.tag == "img":
        src = _absolute(_image_source(node), base)
        if src is None:
            return []
        alt = " ".join(node.attrs.get("alt", "").split())
        node.attrs = {**node.attrs, "src": src, "alt": alt} if alt else {k: v for k, v in node.attrs.items() if k != "alt"} | {"src": src}
    if node.tag == "pre" and messenger and _is_layout(node):
        node.tag = "div"
    if node.tag in ("section", "article", "div"):
        measure(node)
        if not node.inside and node.text[0] >= 8 and _density(node) < 0.4:
            node.tag = "p"
        else:
            own = any(isinstance(c, str) and c.strip() for c in node.children)
            elements = node.elements()
            together = any(c.tag in KEPT_TOGETHER for c in elements)
            lone = not own and (len(elements) == 1 or (elements and not POSITIVE.search(node.signature())))
            if messenger and node.tag == "section" or not together and lone:
                return node.children
    if node.tag not in ALLOWED:
        return node.children
    node.attrs = {k: node.attrs[k] for k in ATTRIBUTES.get(node.tag, []) if k in node.attrs}
    measure(node)
    return [node] if node.tag in ("img", "br", "hr") or node.text[0] or node.elements() else []


def _below(root: Node, then: Callable[[Node], list[Node | str]]) -> None:
    """Puts then(element) in the place of each element below root, children before parents."""
    for node in [*in_order(root)[::-1], root]:
        out: list[Node | str] = []
        for c in node.children:
            out += then(c) if isinstance(c, Node) else [c]
        node.children = out
        measure(node)


def render(node: Node) -> str:
    """HTML of what is in a node."""
    out: list[str] = []
    stack: list = node.children[::-1]
    while stack:
        at = stack.pop()
        if isinstance(at, tuple):
            out.append(at[0])
        elif isinstance(at, str):
            out.append(escape(at, quote=False))
        else:
            out.append(f"<{at.tag}" + "".join(f' {k}="{escape(v)}"' for k, v in at.attrs.items()) + ">")
            if at.tag not in VOID:
                stack.append((f"</{at.tag}>",))
            stack += at.children[::-1]
    return re.sub(r">\s+<", "><", "".join(out).replace("\xa0", " ")).strip()


def _is_promo(text: str) -> bool:
    return bool(text) and bool(len(text) <= 160 and SEPARATOR.search(text) or PROMO.search(text))


def promo_start(texts: list[str]) -> int | None:
    """Where the closing promotion of an article starts, from the texts of its blocks: among the last twelve, the first promotion after
    the last end mark, else the first of a run of two or more; empty blocks do not break a run."""
    first = max(0, len(texts) - 12)
    ends = [i for i in range(first, len(texts)) if END_MARKER.search(texts[i])]
    after = next((i for i in range(ends[-1] + 1, len(texts)) if _is_promo(texts[i])), None) if ends else None
    if after is not None:
        return after
    run: list[int] = []
    for i in range(first, len(texts)):
        if _is_promo(texts[i]):
            run.append(i)
            if len(run) == 2:
                return run[0]
        elif texts[i]:
            run = []
    return None


def trim(root: Node, title: str | None, messenger: bool) -> None:
    """Takes from the blocks of an article the heading that repeats its title, the lines that open it, and the closing promotion."""
    named = next((c for c in root.elements() if c.tag in ("h1", "h2", "h3")), None)
    gone: list[Node] = [named] if named is not None and text_of(named) == " ".join((title or "").split()) else []
    blocks = [c for c in root.elements() if c not in gone]
    texts = [text_of(c) for c in blocks]
    lead = next((i for i, t in enumerate(texts) if not t or len(t) > 120 or not LEADING_META.search(t)), len(texts))
    end = promo_start(texts[lead:]) if messenger else None
    gone += blocks[:lead] + (blocks[lead + end :] if end is not None else [])
    root.children = [c for c in root.children if not any(c is g for g in gone)]


def readable(html: str | None, url: str | None, title: str | None, given: str | None = None) -> tuple[str, float]:
    """Clean HTML and score of the best block of a page, or of the HTML that is given for it (score 0)."""
    base = url or ""
    messenger = _host(base) == MESSENGER
    if given is not None:
        root, most = parse(given), 0.0
    else:
        tree = parse(html or "")
        _below(tree, lambda node: [node])
        best, most = content_root(tree)
        root = Node("root", {})
        root.children = best.children if best.tag in ("body", "root") else [best]
        _below(root, lambda node: [] if _is_noise(node, messenger) else [node])
        _below(root, lambda node: _clean(node, base, messenger))
    trim(root, title, messenger)
    return render(root), most


def readable_all(*columns) -> Iterator[tuple[str, float]]:
    return (readable(*x) for x in zip(*columns, strict=True))
