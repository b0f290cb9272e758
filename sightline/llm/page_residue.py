"""Template residue and the text of error pages (problem 5): what a line shows."""

from __future__ import annotations

import re
from functools import lru_cache

from sightline.llm import page_terms as T
from sightline.llm.webpage import remembered

_NAME = r"[A-Za-z][\w.\- ]*"
#: Fields that were to be filled in, as template languages and authors mark them.
FIELDS = re.compile(
    "|".join(
        (
            r"\{\{[#/^>&]?\s*" + _NAME + r"\s*\}\}",
            r"\{%-?\s*" + _NAME + r"\s*-?%\}",
            r"<%[=\-]?\s*" + _NAME + r"\s*-?%>",
            r"[$#]\{\s*" + _NAME + r"\s*\}(?!/)",
            r"(?<![\w$#{%])\{[a-z][\w.]*\}(?!\})",
            r"\[\[\s*" + _NAME + r"\s*\]\]",
            r"\[(?:INSERT|ENTER|ADD|YOUR) [\w .]+\]",
            r"\(\([\w .]+ here\)\)",
            r"(?<!\w)\$[a-z][a-z0-9_.]*[a-z0-9]\$(?!\w)",
            r"(?<!\w)%[A-Z][A-Z0-9_]*[A-Z0-9]%(?!\w)",
            r"(?<!\w)__[A-Z][A-Z0-9_]*[A-Z0-9]__(?!\w)",
            r"@@[\w.]+@@",
            r"\bXX-[A-Z0-9_]+-XX\b",
            r"\b(?:TODO|FIXME|TBD): ?[a-z]\w*",
            r"(?<![\w<])<[a-z]+(?:[._][a-z]+)+>|<(?:title|price|region|storage|name|model|date|product|brand|color|colour|size)>",
            r"\[object Object\]",
        )
    )
)
#: Text that tells its reader to write such a field, or what becomes of it, only writes about it.
ABOUT_FIELDS = re.compile(r"\b(?:write|writes|type|enter|put|paste|use|uses|called|named|replaces?|replaced|variable|placeholder|syntax)\b", re.I)
#: What a program shows for a value that it doesn't have, where a value should stand.
NO_VALUE = r"(?:undefined|null|NaN|None|nil)"
VALUES = re.compile(
    rf"^{NO_VALUE}$|:\s*{NO_VALUE}(?=\W*$|[,;.])|,\s+{NO_VALUE}(?=\W*$)|\b(?:[Tt]he|[Ff]or|[Oo]n|[Ii]n|[Ww]ith|costs|[Bb]uy|from|by|of)\s+{NO_VALUE}\b(?!\s+(?:values?|fields?|pointers?|references?|functions?|objects?|checks?|or\b|and undefined))"
)
ABOUT_VALUES = re.compile(rf"\b(?:as|or|is|are|be|was|were|returns?|not|to|than|equals?)\s+{NO_VALUE}\b")
WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"\w+(?:['’]\w+)*")
BULLET = re.compile(r"^(?:[-*•·‣–]|\d{1,3}[.)])\s+")
CLAUSE = re.compile(r"[.!?;,。！？、，]+(?:\s+|(?<=[。！？、，])(?=\S))")
VERSION = re.compile(r"\b\d+\.\d")
HAN = re.compile(r"[぀-ヿ㐀-鿿]")
#: What programs print where they fail, whatever follows: structured error bodies, traces, banners of servers, an error's number.
OUTPUT = re.compile(
    r"""^(?:\{\s*"(?:error|errors|status|code|message|detail|exception)"\s*:.*\}$|traceback \(most recent call last\)|(?:fatal error|parse error|uncaught \w*(?:error|exception))\b.*:|(?:[a-z_$][\w$]*\.)+[\w$]*(?:exception|error)\b"""
    r"""|(?:nginx|apache|iis|varnish|cloudflare|caddy|envoy|haproxy)\b.*\b(?:gateway|error|timeout|denied|unavailable|forbidden)\b|upstream connect error|(?:http )?(?:error|fehler|erreur|errore|erro|ошибка)(?: code)?[ :#]*[45]\d\d\b)""",
    re.I | re.S,
)
#: A code and its reason phrase, in either order, as the standard has them or servers shorten them.
STATUS = re.compile(r"^\W*(?:http\W*)?(?:error\W*)?(?:[45]\d\d\W+)?(?:" + "|".join(re.escape(x) for x in sorted(T.REASONS.values(), key=len, reverse=True)) + r"|gateway time-?out|temporarily unavailable|service temporarily unavailable)\W*(?:[45]\d\d)?\W*$", re.I)
CODE = re.compile(r"^\W*(?:http\W*)?(?:error|fehler|erreur|errore|erro|ошибка|エラー|错误)\W*[45]\d\d\W*$", re.I)

#: A line is a message if known words, of which unknown ones outweigh two, are this share of it; all a page says is one at a larger share.
COVER, ALL = 0.7, 0.9
#: A first clause of so many words is a message by itself, whatever follows; a shorter one needs a second, or a rest of such words.
ENOUGH = 6
_PLAIN = {k: T.words(v) for k, v in (T.TOPICS | T.STATES).items()}
_STEMS = {k: T.matcher(" ".join(w for w in v.split() if w.endswith("-"))) for k, v in (T.TOPICS | T.STATES | {"not": T.NOT}).items() if "-" in v}
_NOT, _COMMON, _ABOUT = T.words(T.NOT), T.words(T.COMMON), T.words(T.ABOUT)
_FILL = {"topic": T.words(T.FILLER_TOPICS), "state": T.words(T.FILLER_STATES), "common": T.words(T.FILLER_COMMON)}
_HAN = [(a.split(), b.split()) for a, b in T.HAN_PAIRS]
_HAN_WORDS = sorted({w for a, b in _HAN for w in a + b} | set(T.HAN_COMMON.split()), key=len, reverse=True)
_HAN_KNOWN = re.compile("|".join(map(re.escape, _HAN_WORDS)) + r"|[぀-ゟー・]|\W|[A-Za-z0-9]")
_HAN_FILL = [(a.split(), b.split()) for a, b in T.HAN_FILLERS]
_HAN_FILL_KNOWN = re.compile("|".join(map(re.escape, sorted({w for a, b in _HAN_FILL for w in a + b}, key=len, reverse=True))) + r"|[぀-ゟー・]|\W|[入力]")
_STANDARD = T.words(T.STANDARD_FILLER)
_LATIN = frozenset(w[:3] for w in _STANDARD if len(w) > 2)
_FUNCTION = _COMMON - _STANDARD


_SENSES: dict[str, frozenset[str]] = {}
for _k, _v in [*_PLAIN.items(), ("not", _NOT), ("common", _COMMON)]:
    for _w in _v:
        _SENSES[_w] = _SENSES.get(_w, frozenset()) | {_k}
_ANY_STEM = T.matcher(" ".join(w for v in [*T.TOPICS.values(), *T.STATES.values(), T.NOT] for w in v.split() if w.endswith("-")))
_NOTHING: frozenset[str] = frozenset()
_REFERENCE = re.compile(r"(?=\w*\d)[0-9a-f]{4,}\Z")


def senses(token: str) -> frozenset[str]:
    """What a word can mean in a message: topics, states, `not`, `common`; empty if it isn't a word of messages."""
    found = _SENSES.get(token)
    return found if found is not None else _rarer(token)


@lru_cache(maxsize=1 << 15)
def _rarer(token: str) -> frozenset[str]:
    if token.isdigit() or _REFERENCE.match(token):  # references are hexadecimal
        return frozenset(("common",))
    if _ANY_STEM.match(token):
        return frozenset(k for k, m in _STEMS.items() if m.match(token)) or _NOTHING
    token = token.replace("’", "'")
    if token in _SENSES:
        return _SENSES[token]
    if "'" in token:  # l'accès, n'est, we're
        parts = [senses(x) if x in _COMMON or len(x) > 1 else frozenset(("common",)) for x in token.split("'")]
        if all(parts):
            return frozenset().union(*parts)
    return _NOTHING


_TOPICS = frozenset(T.TOPICS)
BARE = re.compile(r"\W*[45]\d\d\W*")
_MERELY = frozenset(("not", "common"))


def told(s: set[str], tokens: list[str]) -> bool:
    """Whether topics and states of one message meet: a page that is missing, access that is denied, scripts that are demanded, and so on."""
    no = "not" in s
    you = not {"you", "sie", "vous", "usted", "u"}.isdisjoint(tokens)
    return bool(
        ("missing" in s and s & {"page", "server", "script"})
        or ("found" in s and no and s & {"page", "server", "script", "access"})
        or ("denied" in s and (s & {"access", "page", "server"} or you))
        or ("access" in s and no)
        or ("expired" in s and s & {"session", "server", "page"})
        or ("broken" in s and (s & {"server", "fault", "page"} or "something" in tokens or "went" in tokens))
        or ("fault" in s and "server" in s)
        or ("fell" in s and s & {"page", "server"} and not {"is", "are", "currently", "temporarily"}.isdisjoint(tokens))
        or ("down" in s and (s & {"page", "server"} or not {"we", "wir", "nous", "estamos", "currently", "under", "is", "scheduled"}.isdisjoint(tokens)))
        or ("script" in s and s & {"demand", "missing"})
        or ("check" in s and s & {"human", "script"})
        or ("human" in s and (no or "unusual" in tokens))
        or ("many" in s and "server" in s)
    )


def message(text: str, tokens: list[str] | None = None, meant: list[frozenset[str]] | None = None) -> float:
    """How much of a text is the message of a page that failed, was withheld, or wants scripts: 0 if no topic meets its state, else the share of its words that such messages have."""
    low = text.lower()
    if HAN.search(low):
        spans = [len(m[0]) for m in _HAN_KNOWN.finditer(low)]
        if not any(any(x in low for x in a) and any(x in low for x in b) for a, b in _HAN):
            return 0.0
        return sum(spans) / len(low)
    if tokens is None or meant is None:
        tokens = TOKEN.findall(low)
        meant = [senses(t) for t in tokens]
    known = len(meant) - meant.count(_NOTHING)
    cover = known / (known + 2 * (len(tokens) - known)) if tokens else 0.0
    if cover < COVER or not _ABOUT.isdisjoint(tokens) or "if" in tokens[1:]:
        return 0.0
    return cover if told(set().union(*meant), tokens) else 0.0


def interim(text: str, tokens: list[str], meant: list[frozenset[str]]) -> bool:
    """Whether a text may be a message where a page says nothing else: it holds little but words of messages, as what says to wait, or to go on, does; or it is about a page, a server, access or scripts; or it is a bare code."""
    if HAN.search(text):
        return any(x in text for a, _ in _HAN for x in a) and sum(len(m[0]) for m in _HAN_KNOWN.finditer(text)) >= COVER * len(text)
    known = len(meant) - meant.count(_NOTHING)
    if not tokens or known < 2 * (len(tokens) - known) or not _ABOUT.isdisjoint(tokens):
        return False
    return (len(tokens) >= 2 and known >= ALL * len(tokens)) or any(not m.isdisjoint(_TOPICS) for m in meant) or bool(BARE.fullmatch(text))


def repeats(words: list[str]) -> bool:
    """One short phrase over and over: at least twice, filling the line."""
    n = len(words)
    if n < 4:
        return False
    return any(n % k == 0 and n // k >= 2 and words == words[:k] * (n // k) for k in range(1, n // 2 + 1))


def latin(words: list[str]) -> bool:
    """Pseudo-Latin: most of the words begin as words of the standard filler do, and hardly any is a word that real sentences need."""
    n = len(words)
    if n < 3 or not ("lorem" in words or "ipsum" in words or n >= 5):
        return False
    return len([w for w in words if w in _STANDARD or w[:3] in _LATIN]) >= 0.6 * n and len([w for w in words if w in _FUNCTION]) <= 0.2 * n


@lru_cache(maxsize=1 << 12)
def mashed(word: str) -> bool:
    """One letter over and over, or a run along a row of the keyboard."""
    return len(word) >= 2 and len(set(word)) == 1 or len(word) >= 3 and any(word in row * 2 or word[::-1] in row for row in T.KEYBOARD)


def stand_in(text: str, words: list[str]) -> bool:
    """Whether a text stands in for another: it names what should be here, and little else."""
    if HAN.search(text):
        return any(any(x in text for x in a) and any(x in text for x in b) for a, b in _HAN_FILL) and sum(len(m[0]) for m in _HAN_FILL_KNOWN.finditer(text)) >= ALL * len(text)
    state = len([w for w in words if w in _FILL["state"]])
    if not state:
        return False
    topic = sum(w in _FILL["topic"] for w in words)
    known = sum(any(w in v for v in _FILL.values()) for w in words)
    return (topic > 0 or state > 1 or state == len(words)) and known >= ALL * len(words)


def filler(text: str) -> bool:
    """Whether a text is filler: pseudo-Latin, one phrase over and over, runs on the keyboard, or what stands in for other text."""
    low = text.lower()
    words = WORD.findall(low)
    if not words:
        return False
    if mashed(words[0]) and all(map(mashed, words)) and (len(words) > 1 or len(words[0]) > 3):
        return True
    return (latin(words) and not re.search(r"\d", low)) or (words.count(words[0]) > 1 and repeats(words)) or stand_in(low, words)


#: Cheap signs without which a line has no field or missing value.
FIELD_SIGNS = re.compile(r"[{}\[\]<>$%@]|__|\(\(|XX-|TODO|FIXME|TBD")
VALUE_SIGNS = re.compile(NO_VALUE)


def failed(text: str, tokens: list[str] | None = None, meant: list[frozenset[str]] | None = None) -> bool:
    """Whether a text, of any length, is a failure from its start: what programs print, a status with its reason, or a message."""
    return bool(OUTPUT.match(text) and not about(text)) or bool(STATUS.match(text) or CODE.match(text)) or message(text, tokens, meant) >= COVER


def about(text: str) -> bool:
    """Whether a sentence tells of an error: it says what became of it, in which version or when. What programs print is full of such words, but not of sentences' own."""
    tokens = TOKEN.findall(text.lower())
    return not {"fix", "fixed", "fixes", "corrected", "corrects", "moved", "release", "build", "changelog", "behoben", "corrigé", "corregido"}.isdisjoint(tokens)


@remembered
def evidence(line: str) -> str | None:
    """What a line of the main body shows: placeholder, filler, failure (errors, maintenance, access and robot checks, demands for scripts), `interim`, or None.

    Words decide, not sentences: a failure has a topic and the state of it (a page, missing; scripts, demanded) and few words that no such message
    has, over the whole line; a text that tells of one has other words, or says when, where and in which version. If a line's first clause is a
    failure, so is the line if that clause is of ENOUGH words, or the next one is a failure too, or most words of the rest are of messages. `interim` (wait, go on) only counts where a page says nothing else.
    """
    text = BULLET.sub("", line.strip())
    if not text:
        return None
    if FIELD_SIGNS.search(text) and FIELDS.search(text) and not (ABOUT_FIELDS.search(text) and len(text.split()) >= 6):
        return "placeholder"
    if VALUE_SIGNS.search(text) and VALUES.search(text) and not ABOUT_VALUES.search(text):
        return "placeholder"
    if filler(text):
        return "filler"
    tokens = TOKEN.findall(text.lower())
    meant = [senses(t) for t in tokens]
    if not HAN.search(text):
        if _MERELY.issuperset(_NOTHING.union(*meant)):  # no topic and no state: no message, but perhaps words alone that any has, or what programs print
            if OUTPUT.match(text) or STATUS.match(text) or CODE.match(text):
                return "failure" if failed(text) else None
            return "interim" if interim(text, tokens, meant) else None
    if failed(text, tokens, meant):
        return "failure"
    clauses = CLAUSE.split(text, maxsplit=2) if tokens else []
    if len(clauses) > 1 and about(text[: len(clauses[0]) + len(clauses[1]) + 2]):
        return None
    if len(clauses) > 1 and (failed(clauses[0]) or filler(clauses[0])):
        rest = TOKEN.findall(text[len(clauses[0]) :].lower())
        if filler(clauses[0]):
            if sum(any(t in v for v in _FILL.values()) for t in rest) >= COVER * len(rest):
                return "filler"
        else:
            known = sum(bool(senses(t)) for t in rest)
            if len(TOKEN.findall(clauses[0])) >= ENOUGH or message(clauses[1]) or (known >= (COVER + ALL) / 2 * len(rest) and _ABOUT.isdisjoint(rest)):
                return "failure"
    return "interim" if interim(text, tokens, meant) else None
