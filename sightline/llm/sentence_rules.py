"""Sentence boundaries (problem 10): the rules, and the finite transducer compiled from them."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Abbreviations, in lower case, without the last period.
#: Never the end of a sentence: titles and words that always go on.
GOES_ON = frozenset(
    """dr mr mrs ms prof st mt gen col capt lt sgt hon rev fr hr sr sra srta dra dña d.ª mme mlle mgr me vs cf e.g i.e eg ie a.k.a aka viz incl excl approx
    ca bzw z.b d.h u.a o.ä s.o s.u vgl inkl zzgl evtl ggf sog bspw env c.-à-d p.ex aprox p.ej ud uds vd ee ing lic arq ltda.me
    ок см ср напр т.е т.к т.н г-н г-жа им ул просп пер обл стр рис табл гл прим डॉ रु श्री सुश्री प्रो أ.د""".split()
)
#: Not the end before a number: No. 7, Fig. 3, Jan. 9.
BEFORE_NUMBER = frozenset(
    """no nr nos fig figs p pp vol vols sec sect ch chap art arts par para pt ed rev ver vers v abb bd kap s tab núm num n pág págs pag cap tel ext jan feb mar apr jun jul aug sep sept oct nov dec
    mär mai okt dez janv févr avr juil déc ene abr ago dic fev set out стр рис гл д кв п ч вып том""".split()
)
#: Units: the end is possible after a number (16 min.), not before one (min. 60).
UNITS = frozenset("min mins sec secs std hr hrs h kg g mg lb oz km m cm mm ft in pol tr ч мин сек руб тыс млн г т гг вв в".split())
SHORT = GOES_ON | BEFORE_NUMBER | UNITS | {"co", "cie", "bros"}
#: Before these, the period of Co. and the like goes on.
FIRMS = re.compile(r"\s+(?:KG|Inc|Ltd|OHG|LLC|GmbH|Corp|Cie)\b")
#: German words after which a number with a period is an ordinal.
ORDINAL = re.compile(r"(?:^|[\s(„«\"])(?:am|der|die|das|dem|den|des|vom|zum|zur|im|ab|bis|seit|beim|ein|eine|einen|einem|einer|jeder|jede|jedes|dieser|diese|dieses)\s+\d{1,2}$", re.I)
#: Words that begin sentences, so that the U.S. before them ends one.
STARTERS = re.compile(r"\s+(?:The|This|That|These|Those|It|He|She|We|They|You|I|In|On|At|If|When|But|And|So|A|An|El|La|Los|Las|Le|Les|Der|Die|Das)\b")

#: Written in capitals and still no end: EE. UU.
COUNTRIES = frozenset("ee".split())

DOTTED = re.compile(r"^(?:[^\W\d_]\.)+[^\W\d_]$")
#: What a word doesn't go beyond, looking back from a period; periods within it do belong to it (e.g, U.S).
BOUNDS = frozenset(" \t\r\n\u00a0\u3000?!…。！？।؟([{“„«\"「『（‹")
#: The longest word that is looked at letter by letter; no abbreviation is as long. Of longer ones all that matters is whether they are addresses.
WORD = 64
BOUND = re.compile("[" + re.escape("".join(sorted(BOUNDS))) + "]")
#: What bounds a word, and what shows that it is an address.
ADDRESS = re.compile(BOUND.pattern + "|://|@")
#: A word that leans on the next: l'art., d'env.
ELIDED = re.compile(r"^(?:[a-zà-ÿ]{1,2}|qu)['’](?=[^\W\d_]{2})", re.I)
#: What follows a period within a domain; a label of one has 63 characters at most.
DOMAIN = re.compile(r"[A-Za-z][\w-]{0,62}\.[a-z]")
SPECIAL = re.compile(r"[.!?…。！？।॥؟۔]+(?: ?\.{2,})?|[\"“”„«»‹›「」『』()\[\]{}（）【】:：,，、]")
CLOSERS = "\"”’»›」』)]}）】'"
SHUT = "”’»›」』)]}）】"
OPENERS = "“„«‹「『([{（【¿¡'‘"
STRONG = set("。！？।॥؟۔")
CASELESS = {"Lo"}

# Next to a mark: how the text goes on.
NEVER, LOWER, CASELESS_NEXT, UPPER = range(4)


@lru_cache(maxsize=1 << 12)
def begins(c: str) -> int:
    """The class of a text by its first visible character."""
    kind = unicodedata.category(c)
    if c.isdigit() or kind in ("Lu", "Lt", "So", "Sc", "No"):
        return UPPER
    return CASELESS_NEXT if kind in ("Lo", "Lm", "Mn", "Mc") else LOWER


def next_class(text: str, at: int) -> tuple[int, bool, str]:
    """How text goes on from `at`: the class of its next visible character, whether space comes first, and that character."""
    i, n = at, len(text)
    while i < n and text[i] in SHUT:
        i += 1
    at = i
    while i < n and text[i].isspace():
        i += 1
    if i == n:
        return UPPER, True, ""
    c = text[i]
    space = i > at
    if c in OPENERS or c == '"':  # an opened quotation goes on as its first letter does
        return (LOWER if i + 1 < n and unicodedata.category(text[i + 1]) == "Ll" else UPPER), space, c
    return begins(c), space, c


class Word:
    """Whether the word at a place that moves on through a text is an address. Each character is read once, however long the word is."""

    __slots__ = ("at", "address")

    def __init__(self, at: int, address: bool = False):
        self.at, self.address = at, address

    def upto(self, text: str, to: int) -> bool:
        for m in ADDRESS.finditer(text, self.at, to):
            self.address = m[0] not in BOUNDS
        self.at = max(self.at, to)
        return self.address


def period(text: str, at: int, lo: int, kind: int, space: bool, c: str, look: Word) -> bool:
    """Whether the single period at `at` may end a sentence, by the word before it and the way the text goes on (see next_class).

    lo: where the text begins. look: knows of a word longer than WORD whether it is an address."""
    after, least = at + 1, max(lo, at - WORD)
    i = max(text.rfind(" ", least, at) + 1, least)
    if BOUND.search(text, i, at):
        i = at
        while text[i - 1] not in BOUNDS:
            i -= 1
    if i == least and i > lo and text[i - 1] not in BOUNDS:  # a longer word
        if space or not c:
            return True
        return not (c.isdigit() or kind == LOWER or (kind == UPPER and c.isalpha() and (DOMAIN.match(text, after) or look.upto(text, at))))
    word = text[i:at].lstrip(".")
    if space and kind >= CASELESS_NEXT and not c.isdigit() and len(word) > 8 and word.isalpha():
        return True
    if "'" in word or "’" in word:
        word = ELIDED.sub("", word)
    low = word.lower()
    if space and kind == UPPER and len(low) > 2 and low not in SHORT and low.isalpha() and low == word:  # a plain word
        return True
    alone = len(low) == 1 and low.isalpha()
    gap = text[max(lo, at - len(word) - 12) : at - len(word)].rstrip()
    numbered = bool(gap) and gap[-1].isdigit()
    if not space and c:
        if c.isdigit():
            return False
        if kind == LOWER:
            return False
        if kind == UPPER and c.isalpha():
            return not (alone and not numbered or DOTTED.match(low) or DOMAIN.match(text, after) or "://" in word or "@" in word)
    if len(word) > 1 and word.isupper() and word.isalpha():
        return low not in COUNTRIES
    if low in UNITS:
        return numbered or not (c.isdigit() or alone)
    if low in GOES_ON:
        return False
    if low in BEFORE_NUMBER and c.isdigit():
        return False
    if alone:
        return numbered
    if DOTTED.match(low):
        return low in ("a.m", "p.m") or word.islower() or bool(STARTERS.match(text, after)) or not c
    if low in ("co", "cie", "bros") and FIRMS.match(text, after):
        return False
    if low.isdigit() and len(low) <= 2 and kind == UPPER and ORDINAL.search(text[max(lo, at - 24) : at]):
        return False
    return True


def switched(text: str, at: int) -> bool:
    """Whether the last letter or digit before `at` is Latin: another script after it, behind space, begins anew."""
    while at > 0 and not text[at - 1].isalnum():
        at -= 1
    return at > 0 and text[at - 1].isascii()


def mark_class(text: str, start: int, end: int, lo: int, look: Word) -> int:
    """NEVER, or how the text goes on after the marks text[start:end]."""
    marks = text[start:end]
    kind, space, c = next_class(text, end)
    if "…" in marks or ".." in marks.replace(" ", ""):
        if "?" in marks or "!" in marks:
            return kind
        return UPPER if (kind == UPPER and not c.isdigit()) or (kind == CASELESS_NEXT and space and switched(text, start)) else NEVER
    if marks == ".":
        return kind if period(text, start, lo, kind, space, c, look) else NEVER
    if STRONG & set(marks):
        return UPPER if kind != LOWER or c.isalpha() else LOWER
    return kind


# The transducer. A state: where in the sentence (0 start, 1 within, 2 just after a colon or comma), the open quotation (0 none, else kind * 3 + how it
# was opened), the open bracket (0 none, 1 opened at the start of the sentence, 2 within it), and whether a mark came just before.
QUOTES = {'"': 1, "“": 2, "„": 3, "«": 4, "‹": 5, "「": 6, "『": 7, "»": 8}
CLOSES = {'"': (1,), "”": (2, 3), "“": (3,), "»": (4,), "›": (5,), "」": (6,), "』": (7,), "«": (8,)}
START = (0, 0, 0, False)
State = tuple[int, int, int, bool]


@lru_cache(maxsize=None)
def step(state: State, symbol: str, how: int, words: bool, neutral: bool) -> tuple[State, bool]:
    """The next state and whether a sentence ends just after this symbol (and the closers that follow).

    symbol: `.` for marks, a quotation mark, a bracket, or `,` for colons and commas. how: the way the text goes on after it. words: whether there is
    text between the last symbol and this one. neutral: a quotation mark or bracket without its counterpart.
    """
    where, quote, bracket, marked = state
    if words:
        where, marked = 1, False
    if not symbol:
        return (where, quote, bracket, marked), False
    if symbol == ".":
        if quote or bracket:
            return (where, quote, bracket, how != NEVER or marked), False
        if where == 0 and not words:
            return (where, quote, bracket, False), False
        if how in (UPPER, CASELESS_NEXT):
            return START, True
        return (1, 0, 0, False), False
    if symbol == ",":
        return (2 if where else 0, quote, bracket, False), False
    if neutral:
        if marked and how == UPPER and not quote and not bracket:
            return START, True
        return (where, quote, bracket, marked), False
    if symbol in "([{（【":
        if bracket or quote:
            return (where, quote, bracket, False), False
        return (1, quote, 1 if where == 0 else 2, False), False
    if symbol in ")]}）】":
        if quote or not bracket:
            return (where, quote, bracket, marked), False
        if marked and bracket == 1 and how != LOWER:
            return START, True
        return (1, 0, 0, False), False
    closes = CLOSES.get(symbol, ())
    if quote and quote // 3 in closes:
        opened = quote % 3
        if marked and not bracket and (how == UPPER or (how == CASELESS_NEXT and opened == 2)):
            return START, True
        return (1, 0, bracket, marked and bool(bracket)), False
    if not quote and symbol in QUOTES:
        return (where, QUOTES[symbol] * 3 + where, bracket, False), False
    return (where, quote, bracket, marked), False


PAIRS = (("“", "”"), ("「", "」"), ("『", "』"), ("(", ")"), ("[", "]"), ("{", "}"), ("（", "）"), ("【", "】"), ("‹", "›"))


def unpaired(text: str) -> frozenset[str]:
    """Quotation marks and brackets of a piece of text that lack their counterparts; these say nothing about its sentences."""
    bad: set[str] = set()
    if text.count('"') % 2:
        bad.add('"')
    low = text.count("„")
    if low:
        if text.count("“") + text.count("”") < low:
            bad |= {"„"}
    for a, b in PAIRS:
        x, y = text.count(a), text.count(b)
        if a == "“" and low:
            continue
        if x != y:
            bad |= {a, b}
    if text.count("«") != text.count("»"):
        bad |= {"«", "»"}
    return frozenset(bad)


def symbols(text: str, lo: int, hi: int, skip: frozenset[str], begin: int = 0, address: bool = False) -> list[tuple[int, int, str, int, bool, bool]]:
    """The symbols of text[lo:hi]: start, end, symbol, how the text goes on, whether words come before it, whether it is neutral.

    Looks a few dozen characters around each, beyond lo and hi too; begin: where the piece begins, the furthest to look back; address: whether
    the word at lo is an address by what lies before lo."""
    out, last, look = [], lo, Word(lo, address)
    shut, told = -1, (LOWER, False, "")  # after one closer, the text goes on as after the closers behind it
    for m in SPECIAL.finditer(text, lo, hi):
        s, e = m.span()
        c = m[0]
        words = s > last and not text[last:s].isspace()
        last = e
        if c[0] in ".!?…。！？।॥؟۔":
            out.append((s, e, ".", mark_class(text, s, e, begin, look), words, False))
        elif c in ":：,，、":
            out.append((s, e, ",", LOWER, words, False))
        else:
            how, space, after = (told if s < shut else next_class(text, e)) if c in CLOSERS or c in "“«" else (LOWER, False, "")
            if s >= shut and c in SHUT:
                shut, told = e, (how, space, after)
                while shut < len(text) and text[shut] in SHUT:
                    shut += 1
            if how == CASELESS_NEXT and space and switched(text, s):
                how = UPPER
            out.append((s, e, c, how, words, c in skip))
    if last < hi and not text[last:hi].isspace():
        out.append((hi, hi, "", LOWER, True, False))
    return out


def run(marks: list[tuple[int, int, str, int, bool, bool]], state: State) -> tuple[State, list[int]]:
    """The transducer over symbols from a state: the state it ends in, and where sentences end."""
    ends = []
    for _, e, symbol, how, words, neutral in marks:
        state, ended = step(state, symbol, how, words, neutral)
        if ended:
            ends.append(e)
    return state, ends
