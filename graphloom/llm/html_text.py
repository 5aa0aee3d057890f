"""HTML extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks in page order: stretches of text that no block element interrupts. Features are the tags
and class or id words of a block's ancestors and properties of its text; the field labels blocks main or other, with
weights for neighbouring labels, and Viterbi picks the best sequence. Training pages with labelled blocks are made by a
rule in this module: many layouts of articles among menus, headers, footers, sidebars, notices, adverts, forms, comments.

Scripts, styles, comments, templates and the head are no blocks. Pages are read whole, in time linear in their length;
elements of any number and depth, attributes of any length and blocks of any length are read alike.

Defined results: a null or empty page, or one without a main block, gives an empty text; a page that is cut off or misnested
is read as far as it goes, open elements end with it; plain text is one block; repeated rows are read each for itself; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

#: Quotes count after "=" only. Values have any length; nothing is given back, and a scan that fails ends where the next begins, so a page takes linear time.
_TAG = re.compile(r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/<>\"']*+)((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s<>\"'][^\s<>]*+)?+)*+)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=<>/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?+""")
_NAMED = re.compile(r"(?:^|\W)(?:class|id|role)$", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong sub sup time tt u var ins del big wbr img math mi mn mo mrow msup msub mfrac msqrt mtext".split())
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "noscript", "template", "iframe", "svg", "title", "object", "canvas", "select", "textarea")}

ENDS_P = frozenset("p div ul ol table section article h1 h2 h3 h4 h5 h6 blockquote pre form footer header nav aside main hr figure address dl".split())
HOLDS_P = ("td", "th", "button", "caption")  # a paragraph outside is not ended by a block inside
#: Elements that their next sibling ends, with those that hold a list of their own.
SIBLINGS = {"li": ("ul", "ol", "menu"), "td": ("table",), "th": ("table",), "tr": ("table",), "dt": ("dl",), "dd": ("dl",)}

TAGS = ("article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "p", "h1", "h2", "h3", "h4", "div", "section", "blockquote", "pre", "figure", "figcaption", "button", "dl", "details", "address", "menu", "dialog", "fieldset", "body")
#: Words of class, id and role attributes by what they speak for.
NAMED = (
    ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promoted", "banner", "adbox", "dfp"),
    ("comment", "comments", "reply", "replies", "respond", "discussion", "disqus"),
    ("sidebar", "side", "aside", "widget", "rail", "complementary"),
    ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "topbar", "pagination", "pager", "tabs", "toolbar"),
    ("footer", "foot", "bottom", "copyright", "legal", "contentinfo", "colophon"),
    ("header", "masthead", "top", "branding", "logo", "site"),
    ("cookie", "cookies", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay", "paywall", "message", "warning"),
    ("share", "social", "sharing", "follow"),
    ("related", "recommended", "recommendations", "more", "trending", "popular", "teaser", "teasers"),
    ("newsletter", "subscribe", "signup", "login", "search", "form", "register"),
    ("article", "content", "post", "entry", "story", "text", "main", "body", "prose"),
)
_NAMED_AT = {w: k for k, words in enumerate(NAMED) for w in words}
_TAG_AT = {t: k for k, t in enumerate(TAGS)}
_CLUTTER = re.compile(r"©|\(c\)|all rights reserved|cookie|subscribe|sign (?:in|up)|log ?in|privacy|terms of|advert|sponsored|newsletter|read more|share this|leave a (?:reply|comment)|posted by|reply\b|powered by", re.I)
BASE = len(TAGS) + len(NAMED)
N_FEATURES = BASE + len(TAGS) + 22


class Block:
    """Text pieces of a leaf block, its ancestors' features and how much of it is linked."""

    __slots__ = ("linked", "named", "parent", "pieces", "tags", "text")

    def __init__(self, tags, named, parent):
        self.tags, self.named, self.parent, self.pieces, self.linked, self.text = tags, named, parent, [], 0, ""


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page that hold text, in order, white space made single spaces."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset, frozenset, bool, str]] = [("", frozenset(), frozenset(), False, "")]  # tag, tag features, named features, in the head, innermost block element
    open_: dict[str, list[int]] = {}  # places of the open elements of each name
    current: Block | None = None
    depth_a, at, n = 0, 0, len(page)

    def add(piece: str) -> None:
        nonlocal current
        if stack[-1][3] or not piece:
            return
        if current is None:
            if piece.isspace():
                return
            current = Block(stack[-1][1], stack[-1][2], stack[-1][4])
            out.append(current)
        piece = html.unescape(piece) if "&" in piece else piece
        current.pieces.append(piece)
        if depth_a:
            current.linked += len(piece)

    def close(k: int) -> None:
        nonlocal depth_a
        while len(stack) > k:
            name = stack.pop()[0]
            open_[name].pop()
            depth_a -= name == "a"

    def last(names) -> int:
        """The place of the innermost open element of any of the names; 0 is none."""
        return max((open_[x][-1] for x in names if open_.get(x)), default=0)

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if open_.get(name):
                close(open_[name][-1])
            if name not in INLINE:
                current = None
            continue
        if name not in INLINE:
            current = None
            if name in ENDS_P and last(("p",)) > last(HOLDS_P):
                close(last(("p",)))  # a paragraph ends where a block begins
            elif name in SIBLINGS and last((name,)) > last(SIBLINGS[name]):
                close(last((name,)))
        if name in _END:
            if not m[3].endswith("/"):
                stop = _END[name].search(page, at)
                at = stop.end() if stop else n
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if name == "body":
            close(1)  # whatever of the head was left open
        _, tags, named, in_head, block = stack[-1]
        if name in _TAG_AT and _TAG_AT[name] not in tags:
            tags = tags | {_TAG_AT[name]}
        attrs = m[3]
        if attrs:
            pairs = [(g[0].lower(), g[1] or g[2] or g[3]) for g in _ATTRIBUTE.findall(attrs)]  # what stands in other values is none of these
            words = {w for k, v in pairs if v and _NAMED.search(k) for w in re.split(r"[^a-z0-9]+", v.lower())}
            found = {_NAMED_AT[w] for w in words if w in _NAMED_AT}
            if found and not found <= named:
                named = named | found
        open_.setdefault(name, []).append(len(stack))
        stack.append((name, tags, named, in_head or name == "head", block if name in INLINE else name))
        depth_a += name == "a"
    kept = []
    for b in out:
        b.text = " ".join("".join(b.pieces).split())
        if b.text:
            kept.append(b)
    return kept


def features(blocks: list[Block]) -> list[list[int]]:
    """Indices of the features of each block: ancestors, names, innermost tag, length, links, marks, place."""
    out = []
    n = len(blocks)
    for i, b in enumerate(blocks):
        f = list(b.tags)
        f += [len(TAGS) + k for k in b.named]
        if b.parent in _TAG_AT:
            f.append(BASE + _TAG_AT[b.parent])
        x = BASE + len(TAGS)
        t = b.text
        words = t.count(" ") + 1
        f.append(x + (0 if words < 3 else 1 if words < 6 else 2 if words < 12 else 3 if words < 25 else 4 if words < 60 else 5))
        share = b.linked / max(1, len(t))
        f.append(x + (6 if share == 0 else 7 if share < 0.3 else 8 if share < 0.8 else 9))
        f.append(x + (10 if t[-1] in ".!?…:;\"”»" else 11))
        if _CLUTTER.search(t):
            f.append(x + (12 if words < 30 else 13))
        if any(c in t for c in ",;") and words >= 12:
            f.append(x + 14)
        f.append(x + (15 if i == 0 else 16 if i == n - 1 else 17))
        if not b.named:
            f.append(x + 18)
        if not (b.tags - {_TAG_AT["body"], _TAG_AT["p"], _TAG_AT["div"], _TAG_AT["section"]}):
            f.append(x + 19)
        if words < 12 and t[:1].isupper() and b.parent[:1] == "h":
            f.append(x + 20)
        f.append(x + 21)
        out.append(f)
    return out


def made_pages(n: int = 400, seed: int = 31) -> list[tuple[str, list[int]]]:
    """Pages by rule, with the label of each leaf block in order."""
    rng = np.random.default_rng(seed)
    syllables = "an ther ing on en tion ed ha re st ou nd le ment que ai ver ge ung heit ci os mar lo ka ri ben sol the of to und der la de".split()
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))
    flip = lambda p=0.5: rng.random() < p

    def sentence(a=4, b=22):
        return some(a, b).capitalize() + str(rng.choice([".", ".", ".", "!", "?"]))

    def para(a=1, b=6):
        return " ".join(sentence() + (", " + some(2, 6) + "." if flip(0.3) else "") for _ in range(rng.integers(a, b)))

    out = []
    for _ in range(n):
        parts: list[str] = []
        labels: list[int] = []

        def put(text, label, before="<p>", after="</p>", parts=parts, labels=labels):
            parts.append(f"{before}{text}{after}")
            labels.append(label)

        def links(k, label=0, parts=parts):
            parts.append("<ul>")
            for _ in range(k):
                put(f'<a href="/{word()}">{some(1, 5)}</a>', label, "<li>", "</li>")  # noqa: B023
            parts.append("</ul>")

        def clutter(kind, parts=parts):
            if kind == "nav":
                a, z = (("<nav>", "</nav>"), ('<div class="nav menu">', "</div>"), ('<div id="breadcrumb">', "</div>"))[rng.integers(3)]
                parts.append(a)
                links(rng.integers(2, 8))  # noqa: B023
                parts.append(z)
            elif kind == "header":
                a, z = (("<header>", "</header>"), ('<div id="header" class="site-header">', "</div>"))[rng.integers(2)]
                parts.append(a)
                put(some(1, 5), 0, "<h2>" if flip() else "<div>", "")  # noqa: B023
                if flip():
                    put(some(3, 9), 0)  # noqa: B023
                parts.append(z)
            elif kind == "ad":
                put(para(1, 3), 0, f'<div class="{rng.choice(["ad", "advert", "ads box", "sponsored", "promo", "banner"])}">' + ("<p>" if flip(0.3) else ""), "</div>")  # noqa: B023
            elif kind == "aside":
                a, z = (("<aside>", "</aside>"), ('<div class="sidebar">', "</div>"), ('<div class="related widget">', "</div>"))[rng.integers(3)]
                parts.append(a)
                if flip():
                    put(some(1, 4), 0, "<h3>", "</h3>")  # noqa: B023
                if flip():
                    links(rng.integers(1, 5))  # noqa: B023
                for _ in range(rng.integers(0, 3)):
                    put(para(1, 3), 0)  # noqa: B023
                parts.append(z)
            elif kind == "notice":
                put(rng.choice(["We use cookies. ", "This site uses cookies ", "Please subscribe to our newsletter. ", ""]) + sentence(), 0, f'<div class="{rng.choice(["cookie-notice", "notice", "alert", "popup", "consent"])}">', "</div>")  # noqa: B023
            elif kind == "form":
                parts.append('<form action="/x">' if flip() else '<form class="login">')
                put(some(1, 5), 0, "<label>" if flip() else "<p>", "<br>")  # noqa: B023
                put(rng.choice(["Sign up", "Search", "Subscribe", "Log in", some(1, 2)]), 0, '<input type="text"><button>', "</button></form>")  # noqa: B023
            elif kind == "comments":
                a, z = (('<section id="comments">', "</section>"), ('<div class="comments">', "</div>"))[rng.integers(2)]
                parts.append(a)
                if flip(0.6):
                    put(rng.choice(["Comments", f"{rng.integers(1, 40)} comments", "Leave a reply"]), 0, "<h3>", "</h3>")  # noqa: B023
                for _ in range(rng.integers(1, 5)):
                    if flip(0.5):
                        put("Posted by " + some(1, 3), 0, '<div class="comment">', "")  # noqa: B023
                        put(para(1, 4), 0, "<p>", "</p></div>")  # noqa: B023
                    else:
                        put(para(1, 4), 0, '<div class="comment"><p>' if flip() else '<article class="comment"><p>', "</p></div>" if flip(2) else "")  # noqa: B023
                parts.append(z)
            elif kind == "share":
                put(rng.choice(["Share this", "Follow us", some(1, 4)]), 0, f'<div class="{rng.choice(["share", "social"])}">', "</div>")  # noqa: B023
            elif kind == "footer":
                a, z = (("<footer>", "</footer>"), ('<div id="footer">', "</div>"), ('<div class="site-footer legal">', "</div>"))[rng.integers(3)]
                parts.append(a)
                put(rng.choice(["&copy; ", "&copy; 2024 ", "(c) ", ""]) + word() + ".example.com &middot; " + para(1, 3), 0, "<p>" if flip(0.4) else "", "")  # noqa: B023
                parts.append(z)

        for kind in ("notice", "header", "nav", "ad", "form"):
            if flip(0.45 + 0.4 * (kind == "nav")):
                clutter(kind)
        if flip(0.3):
            clutter("aside")
        frames = [("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main" class="post entry">', "</div>"), ("<main><article>", "</article></main>"), ("<section>", "</section>"), ("<div>", "</div>")]
        a, z = frames[rng.integers(len(frames))]
        parts.append(a)
        if flip(0.85):
            head = "<header>" if flip(0.1) else ""
            put(some(2, 12).capitalize() + str(rng.choice(["", ".", "%%%"])), 1, head + "<h1>", "</h1>" + ("</header>" if head else ""))
        for _ in range(rng.integers(1, 9)):
            r = rng.random()
            if r < 0.66:
                put(para(1, 7), 1, "<p>", "</p>" if flip(0.9) else "")
            elif r < 0.74:
                put(para(1, 3), 1, "<p><b>", "<br>")
            elif r < 0.8:
                put(some(2, 7).capitalize(), 1, "<h2>", "</h2>")
            elif r < 0.85:
                parts.append("<ul>" if flip() else "<ol>")
                for _ in range(rng.integers(2, 5)):
                    put(some(2, 12), 1, "<li>", "</li>" if flip() else "")
                parts.append("</ul></ol>")
            elif r < 0.9:
                put(para(1, 3), 1, "<blockquote>", "</blockquote>")
            elif r < 0.94:
                put(f'{some(3, 9)} <a href="/x">{some(1, 3)}</a> {some(3, 9)}, <em>{word()}</em>.', 1)
            elif r < 0.97:
                put(word().capitalize() + ".", 1)
            else:
                clutter(str(rng.choice(["ad", "share", "aside", "notice"])))
        parts.append(z)
        for kind in ("share", "aside", "comments", "form", "ad", "nav"):
            if flip(0.25):
                clutter(kind)
        if flip(0.85):
            clutter("footer")
        out.append(("<!DOCTYPE html><html><head><title>" + some(1, 5) + "</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>" + "".join(parts) + "</body></html>", labels))
    return out


_MODEL: dict = {}


def model() -> dict:
    """Weights per feature (for main against other) and per pair of neighbouring labels; the driver learns and sends them."""
    if not _MODEL:
        data = []
        for page, labels in made_pages():
            blocks = blocks_of(page)
            if len(blocks) == len(labels):
                data.append((features(blocks), labels))
        w, t = np.zeros(N_FEATURES), np.zeros((2, 2))
        length = max(len(y) for _, y in data)
        x = np.zeros((len(data), length, N_FEATURES), np.float32)
        y = np.zeros((len(data), length), int)
        real = np.zeros((len(data), length), bool)
        for k, (f, labels) in enumerate(data):
            for i, own in enumerate(f):
                x[k, i, own] = 1
            y[k, : len(labels)] = labels
            real[k, : len(labels)] = True
        total = real.sum()
        inside = real[:, 1:]
        seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & inside).sum() for b in (0, 1)] for a in (0, 1)])
        vw, vt = np.zeros_like(w), np.zeros_like(t)
        for _ in range(150):
            score = np.stack([np.zeros(x.shape[:2]), x @ w], 2)
            p, pairs = _marginals(score, t, real)
            gw = np.tensordot((y - p) * real, x, ([0, 1], [0, 1])) / total - 2e-4 * w
            gt = (seen - pairs) / total - 2e-4 * t
            vw, vt = 0.9 * vw + gw, 0.9 * vt + gt
            w, t = w + 1.2 * vw, t + 1.2 * vt
        _MODEL.update(w=w, t=t)
    return _MODEL


def _lse(z: np.ndarray, axis: int) -> np.ndarray:
    top = z.max(axis, keepdims=True)
    return (top + np.log(np.exp(z - top).sum(axis, keepdims=True))).squeeze(axis)


def _marginals(score: np.ndarray, t: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of label 1 at each place, and expected counts of label pairs: forward-backward over padded pages."""
    n, length, _ = score.shape
    fore, back = np.zeros_like(score), np.zeros_like(score)
    fore[:, 0] = score[:, 0]
    for i in range(1, length):
        step = _lse(fore[:, i - 1, :, None] + t, 1) + score[:, i]
        fore[:, i] = np.where(real[:, i, None], step, fore[:, i - 1])
    for i in range(length - 2, -1, -1):
        step = _lse(t + (score[:, i + 1] + back[:, i + 1])[:, None, :], 2)
        back[:, i] = np.where(real[:, i + 1, None], step, 0)
    z = _lse(fore[:, -1], 1)
    p = np.exp(fore + back - z[:, None, None])[:, :, 1] * real
    joint = np.exp(fore[:, :-1, :, None] + t + (score[:, 1:] + back[:, 1:])[:, :, None, :] - z[:, None, None, None])
    return p, (joint * real[:, 1:, None, None]).sum((0, 1))


def decode(scores: list[float], t: np.ndarray) -> list[int]:
    """Viterbi over the main-against-other scores of a page's blocks."""
    if not scores:
        return []
    (t00, t01), (t10, t11) = t.tolist()
    a, b, back = 0.0, scores[0], []
    for s in scores[1:]:
        back.append((0 if a + t00 >= b + t10 else 1, 0 if a + t01 >= b + t11 else 1))
        a, b = max(a + t00, b + t10), max(a + t01, b + t11) + s
    label = [0 if a >= b else 1]
    for step in reversed(back):
        label.append(step[label[-1]])
    return label[::-1]


def extract(page: str | None, m: dict) -> str:
    """The main text of one page."""
    blocks = blocks_of(page or "")
    w = m["list"] if "list" in m else m.setdefault("list", m["w"].tolist())
    labels = decode([sum(w[k] for k in f) for f in features(blocks)], m["t"])
    return " ".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def extract_text(pages: DataFrame, carry: list[str], source: str = "html") -> DataFrame:
    """Columns `carry` of `pages` with the main text of each page."""
    learned = dict(model())

    def run(column: pa.Array) -> list[pa.Array]:
        return [pa.array([extract(p, learned) for p in column.to_pylist()], pa.string())]

    return map_texts(pages, run, "text string", carry, text=source)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_text(table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
