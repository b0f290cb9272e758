"""A page's lines and which of them belong to its main body (problem 4), read as a stream of the standard library's parser events."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache, wraps
from hashlib import blake2b
from html.parser import HTMLParser
from itertools import accumulate

import numpy as np

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript head title template svg iframe object".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 pre td th".split())
#: Elements that stand around a page's subject, that hold it, that only divide it, and others that may hold lines.
AROUND_TAGS = frozenset("nav aside footer header form dialog menu".split())
MAIN_TAGS = frozenset("main article".split())
PARTS = frozenset("section main article figure".split())
BOXES = AROUND_TAGS | PARTS | {"div"}
#: Names of elements' classes, ids and roles that say the same.
AROUND = re.compile(
    r"(?:^|[-_ ])(?:nav|navbar|menu|topmenu|crumb|crumbs|breadcrumb|breadcrumbs|cookie|cookies|consent|gdpr|banner|sidebar|side|aside|promo|promotion|ad|ads|advert|sponsor|related|recommend\w*|foot|footer|bottom|share|social|comments?|newsletter|feedback|popup|modal)(?:$|[-_ ])",
    re.I,
)
MAIN = re.compile(r"(?:^|[-_ ])(?:main|content|article|post|entry|story|body|text)(?:$|[-_ ])", re.I)
SEPARATORS = re.compile(r"\s+[|·•»›>/–—]\s+|\s{3,}|\t")
COPYRIGHT = re.compile(r"^(?:©|\(c\)|copyright\b)", re.I)
#: Markup shows by an element that HTML knows; <product.name> and the like are text.
TAG = re.compile(r"<(?:!doctype\b|!--|/?(?:html|head|body|div|p|a|span|ul|ol|li|dl|dt|dd|h[1-6]|table|tr|td|th|br|img|nav|main|article|section|aside|footer|header|script|noscript|style|form|b|i|em|strong|pre|code|blockquote)(?:\s[^<>]*)?/?>)", re.I)
#: A product's name by itself: two to six capitalised words or short numbers, at least one of them with a digit, no sentence mark.
NAME = re.compile(r"^(?=.*\d)(?!(?:Error|Code|Fehler|Erreur|Version|Page|Step|Note) )[A-Z][A-Za-z]*\d{0,3}[A-Za-z]?\+?(?: (?:[A-Z][A-Za-z]*\d{0,3}[A-Za-z]?|\d{1,3}[A-Za-z]?)\+?){1,5}$")
SENTENCE_END = re.compile(r"[.!?…。！？।](?:[\"'”’»)\]」』]*)$")
RUN, DIGIT = re.compile(r"[a-z0-9]+"), re.compile(r"[0-9]")
WIDE = re.compile("[\u1100-\u11ff\u2e80-\ua4cf\uac00-\ud7a3\uf900-\ufaff\uff00-\uff60]")
NEWLINES = re.compile(r"&(?:#0*1[03]|#[xX]0*[aAdD]|NewLine);?")

#: Standard deviation, in lines, of the Gaussian that smooths the ratios.
SIGMA = 1.5
#: How far apart the means of two clusters are at least, in logarithms.
APART = 0.5
_at = np.arange(-4, 5)
KERNEL = np.exp(-(_at**2) / (2 * SIGMA**2))
KERNEL /= KERNEL.sum()
#: A line of so many words is a label and its value (a reference, a time), known whatever the value; a longer one as it stands.
LABEL_WORDS = 8
#: On how many of its host's pages a line around the body is taken to stand, and how much likelier a line outside the ratios' core is to be one, as nothing else is known of it.
SPREAD, OUTSIDE = 0.5, 4.0
#: Lines of the upper cluster that so many others or fewer lie between make one run.
GAP = 3


def remembered(f: Callable) -> Callable:
    """f of a text, kept for short ones: the same menus and footers stand on every page of a host."""
    kept = lru_cache(maxsize=1 << 15)(f)

    @wraps(f)
    def call(text: str):
        return kept(text) if len(text) <= 200 else f(text)

    return call


@remembered
def known_as(text: str) -> int:
    """A line as it is counted and looked up: a hash of its words in lower case without the mark at the end, of a short line without its numbers and codes."""
    words = text.lower().rstrip(" .!:。？?！").split()
    whole = " ".join(RUN.sub(lambda m: "#" if DIGIT.search(m[0]) else m[0], w) for w in words) if len(words) <= LABEL_WORDS else " ".join(words)
    return int.from_bytes(blake2b(whole.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def width(text: str) -> int:
    """The places that a text takes: characters of East Asian scripts, which say more each, take two."""
    return len(text) if text.isascii() else len(text) + len(WIDE.findall(text))


@remembered
def features(text: str) -> tuple[tuple[int, ...], int, int, int, int]:
    """Of a line's text: its hash and those of its items if separators divide it, looks (see Page), names among the items, width, and separators."""
    items = [x.strip() for x in SEPARATORS.split(text) if x.strip()] if SEPARATORS.search(text) else [text]
    many = len(items) > 1
    single = text[0].isupper() and bool(DIGIT.search(text)) and bool(NAME.match(text))
    looks = single + 4 * bool(COPYRIGHT.match(text)) + 8 * bool(SENTENCE_END.search(text)) + 16 * bool(SENTENCE_END.search(items[-1] if items else text))
    looks += 32 * any(COPYRIGHT.match(x) for x in items) + 64 * (not DIGIT.search(text) or len(text.split()) > LABEL_WORDS)
    hashes = (known_as(text), *(known_as(x) for x in items)) if many else (known_as(text),)
    return hashes, looks, sum(bool(NAME.match(x)) for x in items) if many else 0, width(text), max(0, len(items) - 1)


@dataclass
class Page:
    """The lines of a page that show text, and the boxes (elements that hold lines) they lie in; a box's number is above its holder's."""

    markup: bool
    row: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    tags: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    strong: list[bool] = field(default_factory=list)
    box: list[int] = field(default_factory=list)
    units: list[tuple[int, ...]] = field(default_factory=list)
    #: Bits: 1 a product's name, 2 the page's own, 4 a copyright notice, 8 ends as a sentence, 16 the last item does, 32 an item is one, 64 counted as it stands, numbers included.
    looks: list[int] = field(default_factory=list)
    names: list[int] = field(default_factory=list)
    kinds: list[str | None] = field(default_factory=list)
    up: list[int] = field(default_factory=lambda: [-1])
    around: list[bool] = field(default_factory=lambda: [False])
    main: list[bool] = field(default_factory=lambda: [False])
    part: list[bool] = field(default_factory=lambda: [False])
    notes: list[tuple[str, int]] = field(default_factory=list)


class Reader(HTMLParser):
    """Keeps, for each line of a page, its visible text, its tags, the text in links, and the box that its text lies in. Each event is handled once, whatever the depth."""

    def __init__(self, lines: int):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = [""] * lines
        self.tags, self.linked, self.where = [0] * lines, [0] * lines, [0] * lines
        self.strong = [False] * lines
        self.notes: list[str] = []  # text for clients without scripts
        self.up, self.tag, self.around, self.main = [-1], ["body"], [False], [False]
        self.open, self.opened = [0], {}  # the boxes that are open, and how many of each tag
        self.hidden: list[str] = []
        self.link = self.heading = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags[self.lineno - 1] += 1
        if tag in VOID:
            return
        if tag in HIDDEN:
            self.hidden.append(tag)
        elif tag == "a":
            self.link += 1
        elif tag in HEADINGS:
            self.heading += 1
        elif tag in BOXES:
            names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
            around = tag in AROUND_TAGS or bool(names and AROUND.search(names))
            self.up.append(self.open[-1])
            self.tag.append(tag)
            self.around.append(around)
            self.main.append(tag in MAIN_TAGS or bool(names and not around and MAIN.search(names)))
            self.open.append(len(self.up) - 1)
            same = "main" if tag in MAIN_TAGS else tag  # <article> ... </main> is one element to its author
            self.opened[same] = self.opened.get(same, 0) + 1
        elif tag == "body":
            self.hidden.clear()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.tags[self.lineno - 1] += 1

    def handle_endtag(self, tag: str) -> None:
        self.tags[self.lineno - 1] += 1
        if tag in HIDDEN:
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag) :]
        elif tag == "a":
            self.link = max(0, self.link - 1)
        elif tag in HEADINGS:
            self.heading = max(0, self.heading - 1)
        elif tag in BOXES:
            want = "main" if tag in MAIN_TAGS else tag
            while self.opened.get(want, 0):  # boxes within it that were left open end with it
                got = self.tag[self.open.pop()]
                got = "main" if got in MAIN_TAGS else got
                self.opened[got] -= 1
                if got == want:
                    self.link = self.heading = 0
                    break

    def handle_data(self, data: str) -> None:
        if self.hidden:
            if self.hidden[-1] == "noscript" and data.strip():
                self.notes += [x.strip() for x in data.split("\n") if x.strip()]
            return
        for i, part in enumerate(data.split("\n"), self.lineno - 1):
            seen = part.strip()
            if not seen or i >= len(self.text):
                continue
            self.text[i] = f"{self.text[i]} {seen}" if self.text[i] else seen
            if self.link:
                self.linked[i] += width(seen)
            if self.heading:
                self.strong[i] = True
            self.where[i] = self.open[-1]


def slug(url: str | None, title: str | None = None) -> str:
    """What a page's address calls it, as words joined by -; if there is no address, what its title does."""
    path = re.sub(r"[?#].*$", "", url or "").rstrip("/")
    last = path.rsplit("/", 1)[-1] if "/" in path else ""
    return re.sub(r"[^a-z0-9]+", "-", (last or (title or "").split("|")[0]).lower()).strip("-")


def of_page(name: str, own: str) -> bool:
    """Whether a product's name is the page's own, by the page's address or title."""
    key = re.sub(r"[^a-z0-9]+", "-", name.lower().replace("+", " plus")).strip("-")
    return bool(key) and bool(re.search(rf"(?:^|-){re.escape(key)}(?:-[0-9a-f]{{4,}})?$", own))


def visible(content: str) -> tuple[list[str], Reader | None]:
    """The visible text of each line, and the reader if the page has markup."""
    if not TAG.search(content):
        return [html.unescape(x).strip() for x in content.split("\n")], None
    r = Reader(content.count("\n") + 1)
    r.feed(closed(NEWLINES.sub(" ", content)))
    r.close()
    return r.text, r


def closed(content: str) -> str:
    """A page without a comment that nothing ends, and with no tags begun behind its last one's end: the parser would look for their ends again and again."""
    at = content.find("<!--", content.rfind("-->") + 1)
    content = content[:at] if at >= 0 else content
    end = content.rfind(">") + 1
    return content[:end] + content[end:].replace("<", "&lt;")


def read(content: str, own: str = "", judge: Callable[[str], str | None] | None = None) -> Page:
    """A page's lines that show text; `judge` gives each line's kind, for problem 5."""
    text, r = visible(content)
    page = Page(r is not None)
    shown = [i for i, t in enumerate(text) if t]
    seen = [features(text[i]) for i in shown]
    page.row = shown
    page.units, page.names, page.size = [x[0] for x in seen], [x[2] for x in seen], [x[3] for x in seen]
    page.looks = [x[1] + 2 * (x[1] & 1 and of_page(text[i], own)) for i, x in zip(shown, seen, strict=True)]
    page.kinds = [judge(text[i]) for i in shown] if judge else []
    if r is None:
        page.tags = [x[4] for x in seen]  # separators stand for tags there
        page.linked, page.strong, page.box = [0] * len(shown), [False] * len(shown), [0] * len(shown)
    else:
        page.tags, page.linked, page.strong, page.box = ([x[i] for i in shown] for x in (r.tags, r.linked, r.strong, r.where))
    if r is not None:
        page.up, page.around, page.main, page.part = r.up, r.around, r.main, [t in PARTS for t in r.tag]
        page.notes = [(judge(t) or "", known_as(t)) for t in r.notes] if judge else []
    return page


def smoothed(ratio: np.ndarray) -> np.ndarray:
    """The ratios after a Gaussian over neighbouring lines; the ends are mirrored."""
    n, k = len(ratio), len(KERNEL) // 2
    if n <= k:
        return np.full(n, ratio.mean() if n else 0.0)
    return np.convolve(np.concatenate([ratio[k:0:-1], ratio, ratio[-2 : -k - 2 : -1]]), KERNEL, "valid")


def threshold(s: np.ndarray) -> float:
    """The midpoint of two means of the logarithms of smoothed ratios; below all if the two aren't APART, as of lines that are all alike."""
    x = sorted(s.tolist())
    if not x or x[-1] - x[0] < 1e-9:
        return -np.inf
    low, high, sums = x[0], x[-1], list(accumulate(x, initial=0.0))
    for _ in range(12):
        k = bisect_right(x, (low + high) / 2)
        a, b = sums[k] / k if k else low, (sums[-1] - sums[k]) / (len(x) - k) if k < len(x) else high
        if abs(a - low) + abs(b - high) < 1e-6:
            break
        low, high = a, b
    return (low + high) / 2 if high - low > APART else -np.inf


def content_lines(ratio: np.ndarray) -> np.ndarray:
    """Which lines are in the upper of two clusters of the smoothed ratios (two means, whose midpoint is the threshold)."""
    s = np.log1p(smoothed(ratio))
    return s > threshold(s) if len(s) else np.zeros(0, bool)


Known = frozenset[int] | set[int]
NOTHING: Known = frozenset()
IN, OUT, OPEN = 1, -1, 0


def lonely(pages: int) -> bool:
    """Whether a host has so few pages that a line seen on one of them alone, outside the core, is likelier to stand around bodies."""
    return OUTSIDE * (1 - SPREAD) ** (pages - 1) > 1


def around(p: Page, n: int, known: Known) -> bool:
    """Whether what a line says shows that it isn't of the main body: it is known to stand around bodies, or its items are."""
    if p.units[n][0] in known or p.looks[n] & 4:
        return True
    if len(p.units[n]) < 3:
        return False
    some = sum(u in known for u in p.units[n][1:]) + bool(p.looks[n] & 32)
    return some >= 2 or (some == 1 and some + p.names[n] >= 2 and not p.looks[n] & 16)


def of_lines(p: Page, at: list[int], out: list[bool], body: Known, pages: int, first: bool) -> list[int]:
    """For each of some lines that no elements divide: IN or OUT of the main body, or OPEN.

    The core reaches from the first to the last line of the upper cluster. Within it a line is of the body unless it is known to stand around; so is the line
    just before it, as a heading. Outside, a line is of the body if the host's other pages have it in theirs, or if nobody has it, although the host's
    menus and footers would be on other pages too; of few pages, the ratios decide. first: nothing is known yet.
    """
    ratio = np.array([p.size[n] / (1 + p.tags[n]) for n in at], float)
    s = np.log1p(smoothed(ratio))
    cut = threshold(s) if len(at) else 0.0
    rich = s > cut
    up = np.flatnonzero(rich & (np.log1p(ratio) > cut) & ~np.array([out[n] for n in at], bool))  # a core begins and ends with lines that are rich themselves
    lo, hi = (int(up[0]), int(up[-1])) if len(up) else (len(at), -1)
    if first and len(up):  # the run of most text: other lines of the upper cluster, beyond GAP others, are left open, and what lies between
        runs = np.split(up, np.flatnonzero(np.diff(up) > GAP + 1) + 1)
        run = max(runs, key=lambda x: sum(p.size[at[k]] for k in x))
        ends, lo, hi = (lo, hi), int(run[0]), int(run[-1])
    alone = lonely(pages)
    own = any(p.looks[n] & 2 for n in at)
    where = []
    kept = False
    before: int | None = None  # the main line just above, if there is one
    for k, n in enumerate(at):
        inside = lo <= k <= hi
        if first:
            where.append(IN if inside else OPEN if len(up) and ends[0] - 1 <= k <= ends[1] else OUT)
            continue
        wrapped = before is not None and p.row[before] == p.row[n] - 1 and p.size[before] > 50 and not p.looks[before] & 8
        if p.looks[n] & 1 and not (wrapped and rich[k]):
            follows = k + 1 < len(at) and p.row[at[k + 1]] == p.row[n] + 1 and p.looks[at[k + 1]] & 1
            heads = alone and not own and k == lo - 1  # nothing on the page is named as its address is
            fits = not kept and not follows and (p.looks[n] & 2 or heads)  # the page's own name is its heading, or in a list of others
        elif out[n]:
            fits = False
        else:
            fits = inside or k == lo - 1 or p.units[n][0] in body or not alone
        where.append(IN if fits else OUT)
        kept, before = kept or bool(fits), n if fits else None
    return where


def judged(p: Page, known: Known = NOTHING, body: Known = NOTHING, pages: int = 1, first: bool = False) -> list[int]:
    """For each line: IN or OUT of the main body, or OPEN, where it is a question of what the host's other pages say.

    known: hashes of the lines that stand around bodies on the host's pages; body: of those that stand within; pages: how many pages the host has.
    first: nothing is known; small boxes within the body count as outside, further regions of it are left open.
    """
    n = len(p.row)
    if not n:
        return []
    out = [around(p, i, known) for i in range(n)]
    if not p.markup:
        return of_lines(p, list(range(n)), out, body, pages, first)
    boxes = len(p.up)
    ratio = [a / (t + 1) for a, t in zip(p.size, p.tags, strict=True)]
    s = np.log1p(smoothed(np.array(ratio)))
    cut = threshold(s)
    rich = (s > cut).tolist()
    single = [math.log1p(x) > cut for x in ratio]  # a region or box of a line or two is smoothed away by what is around it
    free = [a - x for a, x in zip(p.size, p.linked, strict=True)]
    heads, gone = p.strong, out
    # of each box, with the boxes in it: lines, headings and cells, lines that are known or names, text outside links, that of known lines, lines of the upper cluster
    lines, strong, listed, text, theirs, full = ([0] * boxes for _ in range(6))
    own = [0] * boxes
    for i, b in enumerate(p.box):
        own[b] += 1
        strong[b] += heads[i]
        listed[b] += gone[i] or p.looks[i] & 1
        text[b] += free[i]
        theirs[b] += free[i] * gone[i]
        full[b] += rich[i] or single[i]
    lines[:] = own
    for b in range(boxes - 1, 0, -1):
        if lines[b]:
            holder = p.up[b]
            for x in (lines, strong, listed, text, theirs, full):
                x[holder] += x[b]
    kids: list[list[int]] = [[] for _ in range(boxes)]
    for b in range(1, boxes):
        if lines[b]:
            kids[p.up[b]].append(b)
    top = 0  # down to where the page divides into regions
    while not own[top] and len(kids[top]) == 1:
        top = kids[top][0]
    if own[top] or not kids[top]:
        while p.up[top] >= 0 and p.part[top] and not p.main[top]:
            top = p.up[top]
    few = lonely(pages)
    region, dead = [-1] * boxes, [False] * boxes  # which region a box lies in, and whether it holds none of the body
    for b in range(boxes):
        holder = p.up[b]
        if holder == top:
            region[b] = b
        elif holder >= 0 and region[holder] >= 0:
            region[b] = region[holder]
            small = not strong[b] and not p.part[b] and (lines[b] <= 4 and (first or listed[b] == lines[b] or (few and not full[b])) or (theirs[b] and 2 * theirs[b] >= text[b]))
            dead[b] = dead[holder] or (not p.part[b] and p.around[b]) or bool(small)
    of = [region[b] if region[b] >= 0 else top for b in p.box]
    shown = [not dead[b] and (not gone[i] or heads[i]) for i, b in enumerate(p.box)]  # of the known lines, headings and cells stay with their region
    # of each region: its weight, whether it shows a heading or cell, whether some of its own lines are known, the text it holds, and what speaks against it
    rivals: dict[int, list[float]] = {}
    for i, g in enumerate(of):
        r = rivals.setdefault(g, [0.0, 0.0, 0.0, 0.0, 0.0])
        held = shown[i] and not gone[i] and (rich[i] or single[i] or heads[i])
        if shown[i]:
            r[0] += free[i] * (1.0 if rich[i] or heads[i] else 0.5) + 60 * heads[i]
            r[1] += heads[i]
        if gone[i] and (p.box[i] == g or p.up[p.box[i]] == g):
            r[2] = 1.0
        if held:
            r[3] += free[i]
        if gone[i] or free[i] <= 0:
            r[4] += p.size[i]
        elif not held and (first or few):
            r[4] += free[i]
    best, most = -1, 0.0
    for g, r in rivals.items():
        discount = 0.1 if g != top and not r[1] and r[2] else 1.0
        r[3] *= discount
        weight = r[0] * discount * (1.0 if g == top else 0.02 if p.around[g] and not p.main[g] else 3.0 if p.main[g] else 1.0)
        if weight > most:
            best, most = g, weight
    if best < 0 or (best != top and p.around[best] and not p.main[best] and most < 1):
        return [OUT] * n
    others = {g for g, r in rivals.items() if g != best and not (g != top and p.around[g] and not p.main[g]) and r[3] > r[4]}
    result = [IN if of[i] == best and shown[i] else (OPEN if first else IN) if of[i] in others and shown[i] else OUT for i in range(n)]
    if best == top and not any(heads[i] for i in range(n) if of[i] == top):  # lines that no elements divide
        at = [i for i in range(n) if of[i] == top and shown[i]]
        for i, w in zip(at, of_lines(p, at, out, body, pages, first), strict=True):
            result[i] = w
    return result


def told(p: Page) -> tuple[list[int], list[int]]:
    """The hashes that a page has within its body and around it, as far as its markup and ratios alone tell."""
    within, about = {}, {}
    for us, looks, w in zip(p.units, p.looks, judged(p, first=True), strict=True):
        if w or (p.markup and looks & 64):  # of a further region only what recurs word by word tells something
            for u in us:
                (within if w == IN else about)[u] = None
    return list(within), [u for u in about if u not in within]


def main_lines(content: str, own: str = "", known: Known = NOTHING, body: Known = NOTHING, pages: int = 1) -> list[int]:
    """The numbers of a page's lines, split at line feeds and counted from 0, in the main body. known, body, pages: what its host's pages teach (see judged)."""
    p = read(content, own)
    return [r for r, w in zip(p.row, judged(p, known, body, pages), strict=True) if w == IN]
