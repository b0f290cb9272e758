"""Sentence units of documents in any language and script (problem 10)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import sentence_rules as R
from sightline.plans.materialize import spread, written

#: Documents longer than this are cut in chunks of this many characters, which are worked on apart.
CHUNK = 8192

LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
BULLET = re.compile(r"[ \t]*[-*•·‣▪◦][ \t]+\S")
NUMBERED = re.compile(r"[ \t]*\d{1,3}[.)][ \t]+\S")
THAI = re.compile(r"[฀-๿຀-໿]")
HAN = re.compile(r"[㐀-鿿]")
SPACES = re.compile(r"[ \t\u00a0\u3000]+")
THAI_SPACES = re.compile(r"[ \t\u00a0\u3000\r\n]+")
#: Thai words that go on after a number or code: units and counting words.
COUNTED = re.compile(r"ชั่วโมง|นาที|วินาที|วัน|สัปดาห์|เดือน|ปี|ครั้ง|บาท|เปอร์เซ็นต์|รายการ|หน้า(?!จอ)|กิโล|เมตร|เซนติ|มิลลิ|กรัม|วัตต์|โวลต์|แอมป์|มิลลิแอมป์|นิ้ว|พิกเซล|เท่า|คน|ชิ้น|รุ่น|ใน|และ|หรือ|ที่|ของ|จาก|ถึง|ต่อ|ได้|เป็น|มี|จึง|แล้ว")
NAME_WORD = re.compile(r"^[A-Z][a-z]+[A-Za-z]*$|^[A-Z][a-z]*[A-Z][a-z]+$")
TIER_WORD = re.compile(r"^(?:Pro|Plus|Ultra|Lite|Mini|Max|Neo|Flip|Fold|Core|Slim|Turbo|XL|FE|SE)\b")

Piece = tuple[int, int, str]


def pieces(text: str) -> Iterator[Piece]:
    """Stretches of text that no sentence goes beyond: (start, end, kind), kind `item` for a list item, `text` for lines that may run on."""
    at, begin, last = 0, None, 0
    was_item = True  # a number at the start of a line tells an item only after a blank line or an item
    for m in LINE.finditer(text):
        line = m[0]
        if not line:
            break
        body = line.strip()
        start, end = m.start(), m.start() + len(line.rstrip())
        if not body:
            if begin is not None:
                yield begin, last, "text"
                begin = None
            was_item = True
            continue
        if BULLET.match(line) or (was_item and begin is None and NUMBERED.match(line)):
            if begin is not None:
                yield begin, last, "text"
                begin = None
            yield start, end, "item"
            was_item = True
            continue
        if begin is None:
            begin = start
        last, was_item = end, False
        at = m.end()
    if begin is not None:
        yield begin, last, "text"


def named(tokens: list[str]) -> bool:
    """Whether Latin tokens end in a product's name that has its number already."""
    seen = False
    for t in reversed(tokens):
        if NAME_WORD.match(t) and not TIER_WORD.match(t):
            return seen
        if t.isdigit() or re.match(r"^[A-Z]\d{1,3}$", t):
            seen = True
        elif not TIER_WORD.match(t):
            return False
    return False


def spaced(text: str, lo: int, hi: int, thai: bool) -> list[int]:
    """Where a statement ends at a space, in scripts that put none within one (Thai always, Chinese where there are no marks).

    Between two letters of the script a space always separates. Before a number, code or name it doesn't in Thai, which sets these off; after
    one it does unless the next word counts or measures. Among Latin words, a name begins a new statement after a value, or after a full name.
    """
    script = THAI if thai else HAN
    ends, latin = [], []
    begin = lo
    for m in (THAI_SPACES if thai else SPACES).finditer(text, lo, hi):
        s, e = m.span()
        if e >= hi:
            break
        token = re.split(r"[^A-Za-z0-9.,\-/+%°]", text[begin:s])[-1]
        whole = token == text[begin:s]
        before, after = text[s - 1], text[e]
        latin = [*latin, token] if whole else [token]
        begin = e
        b, a = bool(script.match(before)), bool(script.match(after))
        nxt = re.match(r"[A-Za-z0-9.,\-/+%°]*", text[e:hi])[0]
        quote = before in "”」』）)》》\"" or after in "“「『（《\""
        if b and a:
            cut = True
        elif b:
            run = re.match(r"[A-Za-z0-9 .,+'\-]*", text[e:hi])[0]
            subject = bool(NAME_WORD.match(re.match(r"[A-Za-z]*", nxt)[0])) and e + len(run) < hi and bool(script.match(text[e + len(run)])) and not run.endswith(" ")
            cut = not thai or subject or after in "\"“„«" or (not re.search(r"\d", nxt) and bool(re.search(r"(?<![\w.])[a-z]{2,}(?![\w])", run))) or bool(re.match(r"\([A-Z][a-z]* [a-z]+ ", text[e:hi]))
        elif a:
            cut = not (thai and COUNTED.match(text, e))
        elif quote:
            cut = not thai
        else:
            word = re.match(r"[A-Za-z]*", nxt)[0]
            value = bool(re.search(r"\d", token)) or token in ("GB", "TB", "MB", "W", "V", "mAh", "Hz", "MP")
            starts = bool(NAME_WORD.match(word)) and not TIER_WORD.match(word)
            inside = any(NAME_WORD.match(t) and not TIER_WORD.match(t) for t in latin)
            cut = starts and (named(latin) or (value and not inside))
        if cut:
            ends.append(s)
            latin = []
    return ends


def shut(text: str, e: int, hi: int) -> int:
    """An end moved past the closers that follow it."""
    while e < hi and text[e] in R.CLOSERS and (text[e] not in "\"'" or (e + 1 >= hi or text[e + 1].isspace() or text[e + 1] in R.CLOSERS)):
        e += 1
    return e


def trimmed(text: str, lo: int, ends: list[int], hi: int) -> list[int]:
    """The ends, each moved past the closers that follow it, without space before it."""
    out = []
    for e in ends:
        e = shut(text, e, hi)
        while e > lo and text[e - 1].isspace():
            e -= 1
        if e > lo:
            out.append(e)
    return out


def lines_of(text: str, lo: int, hi: int) -> list[int]:
    return [m.start() for m in re.finditer(r"\r\n|\r|\n", text[lo:hi])]


def marks_in(text: str, lo: int, hi: int) -> list:
    return R.symbols(text, lo, hi, R.unpaired(text[lo:hi]), lo)


def closed(text: str, lo: int, hi: int) -> int:
    """How a piece ends: 2 with a mark of its own, 1 with a mark inside a quotation or bracket, 0 without."""
    tail = text[lo:hi].rstrip("\"”’»›」』)]}）】'")
    if not tail or tail[-1] not in ".!?…。！？।॥؟۔":
        return 0
    return 2 if len(tail) == hi - lo else 1


#: Of a piece: where it lies, its kind, how it ends (see closed), where it also ends a sentence, and where it does if it is bare of marks.
Outline = tuple[int, int, str, int, list[int], list[int]]


def outline(text: str, lo: int, hi: int, kind: str) -> Outline:
    """What a piece's text says about its sentences beside its marks: ends at spaces in Thai and, where there are no marks, at line ends and in Chinese at spaces."""
    if kind == "item":
        return lo, hi, kind, 0, [], []
    body = text[lo:hi]
    thai = bool(THAI.search(body))
    chinese = HAN.search(body) and not re.search(r"[぀-ヿ]", body)
    always = spaced(text, lo, hi, True) if thai else []
    bare = sorted({*(() if thai else (lo + i for i in lines_of(text, lo, hi))), *(spaced(text, lo, hi, False) if chinese else ())})
    if chinese and not re.search(r"[。！？](?![”」』\"])", body):
        always, bare = sorted({*always, *bare}), []
    return lo, hi, kind, closed(text, lo, hi), trimmed(text, lo, always, hi), trimmed(text, lo, bare, hi)


def finished(found: list[tuple[Outline, list[int]]]) -> list[int]:
    """The ends in all pieces, given those that the transducer tells. A document has marks if any piece of running text in it shows one of its own."""
    marked = any(ends or piece[3] == 2 for piece, ends in found if piece[2] == "text")
    out: list[int] = []
    for (_, hi, kind, how, always, bare), ends in found:
        if kind == "text":
            unmarked = not ends and (how == 0 or (how == 1 and not marked))
            out += sorted({*ends, *always, *(bare if unmarked else ())} - {hi})
        out.append(hi)
    return out


def told(text: str, lo: int, hi: int) -> list[int]:
    """Where the transducer says that sentences of a piece end, but for its own end."""
    return [shut(text, e, hi) for e in R.run(marks_in(text, lo, hi), R.START)[1] if e < hi]


def sentence_ends(text: str | None) -> list[int]:
    """Code points from the start of text to the end of each of its sentences."""
    if not text:
        return []
    return finished([(outline(text, *p), told(text, p[0], p[1]) if p[2] == "text" else []) for p in pieces(text)])


# Long documents: each chunk is a function from the state before it to the state after it; a prefix scan composes these.

#: As far as a rule looks around a mark, before a chunk and behind it: a word, and what is before it.
REACH = R.WORD + 32
#: Where a chunk may end: after a letter or digit, and not before a mark.
CUT = re.compile(r"[^\W_](?![.!?…。！？।॥؟۔\"“”„«»‹›「」『』()\[\]{}（）【】:：,，、'’])")

#: A stretch of a piece in a chunk: start, end, where the piece begins and ends, what is unpaired in the piece, the quotation marks and brackets that
#: may be open at the start, and whether the word there is an address.
SPAN = "lo int, hi int, begin int, end int, skip string, open string, address boolean"
Span = tuple[int, int, int, int, str, str, bool]


def chunks(text: str, size: int, found: list[Piece]) -> Iterator[list[Span]]:
    """The running text of a document in stretches of at most about `size` characters, cut between any two characters of which neither is a mark."""
    spans: list[Span] = []
    held = 0
    for a, b, kind in found:
        if kind != "text":
            continue
        body = text[a:b]
        skip = R.unpaired(body)
        opened = "".join(sorted({c for c in set(body) if (c in R.QUOTES or c in "([{（【") and c not in skip}))
        at, word = a, R.Word(a)
        while at < b:
            cut = b
            if b - at > size - held:
                m = CUT.search(text, min(b, at + max(1, size - held)) - 1, b)
                cut = m.end() if m else b
            spans.append((at, cut, a, b, "".join(sorted(skip)), opened if at > a else "", word.address))
            held += cut - at
            at = cut
            if cut < b:
                word.upto(text, cut)
            if held >= size:
                yield spans
                spans, held = [], 0
    if spans:
        yield spans


STATES: list[R.State] = [(w, q, b, m) for w in range(3) for q in [0, *range(3, 27)] for b in range(3) for m in (False, True)]
NUMBER = {s: i for i, s in enumerate(STATES)}


def starts(opened: str) -> list[R.State]:
    """The states in which text may go on whose piece has these quotation marks and brackets."""
    quotes = [0, *(R.QUOTES[c] * 3 + w for c in opened if c in R.QUOTES for w in range(3))]
    brackets = range(3) if any(c in "([{（【" for c in opened) else range(1)
    return [(w, q, b, m) for w in range(3) for q in quotes for b in brackets for m in (False, True)]


def fan(marks: list, begin: list[R.State]) -> tuple[list[R.State], list[list[int]], list[int]]:
    """The transducer from several states at once: the state that each leads to, where sentences end as long as it matters which it was, and where they end from then on."""
    now: dict[R.State, list[int]] = {s: [i] for i, s in enumerate(begin)}
    heads: list[list[int]] = [[] for _ in begin]
    tail: list[int] = []
    for n, (_, e, symbol, how, words, neutral) in enumerate(marks):
        if len(now) == 1:  # all lead here
            state, tail = R.run(marks[n:], next(iter(now)))
            return [state] * len(begin), heads, tail
        then: dict[R.State, list[int]] = {}
        for s, who in now.items():
            to, ended = R.step(s, symbol, how, words, neutral)
            if ended:
                for i in who:
                    heads[i].append(e)
            if to in then:
                then[to] += who
            else:
                then[to] = who
        now = then
    last = [R.START] * len(begin)
    for s, who in now.items():
        for i in who:
            last[i] = s
    return last, heads, tail


def scanned(effects: np.ndarray) -> np.ndarray:
    """The state before each chunk of a document, by a prefix scan: in log2(n) rounds each chunk's function is composed with that of the one 1, 2, 4, ... before it."""
    total = effects.astype(np.int64).copy()
    n, far = len(total), 1
    while far < n:
        total[far:] = np.take_along_axis(total[far:], total[:-far], axis=1)
        far *= 2
    first = NUMBER[R.START]
    return np.concatenate([[first], total[:-1, first]]) if n else np.zeros(0, int)


CHUNKED = f"_id long, _n int, _base int, _slice string, _spans array<struct<{SPAN.replace(' ', ': ').replace(',:', ',')}>>, _pieces array<struct<lo: int, hi: int, kind: string, how: int, always: array<int>, bare: array<int>>>"
RUN = "_id long, _n int, _from array<int>, _to array<int>, _heads array<array<int>>, _tail array<int>, _pieces array<struct<lo: int, hi: int, kind: string, how: int, always: array<int>, bare: array<int>>>"


def _chunked(parts: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Of each document a row with the outlines of its pieces, and one for each chunk with the text that it and its rules look at."""
    span, piece = [c.split()[0] for c in SPAN.split(", ")], ["lo", "hi", "kind", "how", "always", "bare"]
    for p in parts:
        for i, t in zip(p["_id"], p["_text"], strict=True):
            found = list(pieces(t))
            rows = [(i, -1, 0, "", [], [dict(zip(piece, outline(t, *x), strict=True)) for x in found])]
            for n, spans in enumerate(chunks(t, size, found)):
                base = max(0, spans[0][0] - REACH)
                rows.append((i, n, base, t[base : spans[-1][1] + REACH], [dict(zip(span, x, strict=True)) for x in spans], []))
                if len(rows) >= 64:
                    yield pd.DataFrame(rows, columns=["_id", "_n", "_base", "_slice", "_spans", "_pieces"])
                    rows = []
            yield pd.DataFrame(rows, columns=["_id", "_n", "_base", "_slice", "_spans", "_pieces"])


def ran(base: int, text: str, spans: list[dict]) -> tuple[list[int], list[int], list[list[int]], list[int]]:
    """Of a chunk: the states it may begin in, what they lead to, and where sentences end (see fan)."""

    def marks(s: dict) -> list:
        return R.symbols(text, s["lo"] - base, s["hi"] - base, frozenset(s["skip"]), max(0, s["begin"] - base), s["address"])

    def placed(s: dict, ends: list[int]) -> list[int]:
        hi = min(s["end"] - base, len(text))
        return [base + shut(text, e, hi) for e in ends if base + e < s["end"]]

    first = spans[0]
    begin = starts(first["open"]) if first["lo"] > first["begin"] else [R.START]
    last, heads, tail = fan(marks(first), begin)
    heads, tail = [placed(first, h) for h in heads], placed(first, tail)
    for s in spans[1:]:  # each begins a piece, and so afresh
        state, ends = R.run(marks(s), R.START)
        last, tail = [state] * len(begin), tail + placed(s, ends)
    return [NUMBER[s] for s in begin], [NUMBER[s] for s in last], heads, tail


def _run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        out = [ran(b, t, s) if len(s) else ([], [], [], []) for b, t, s in zip(p["_base"], p["_slice"], p["_spans"], strict=True)]
        yield pd.DataFrame({"_id": p["_id"], "_n": p["_n"], **{c: [x[k] for x in out] for k, c in enumerate(("_from", "_to", "_heads", "_tail"))}, "_pieces": p["_pieces"]})


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    """The ends of a document, from its chunks' functions: the scan tells each chunk's first state, and that which of its ends hold."""
    rows = rows.sort_values("_n", ignore_index=True)
    doc, found, rows = rows["_id"].iloc[0], rows["_pieces"].iloc[0], rows.iloc[1:]
    ends: list[int] = []
    if len(rows):
        effects = np.full((len(rows), len(STATES)), NUMBER[R.START], np.int16)
        for k, (a, b) in enumerate(zip(rows["_from"], rows["_to"], strict=True)):
            if len(a) == 1:
                effects[k] = b[0]  # a piece begins: no state before it matters
            else:
                effects[k, a] = b
        for s, a, heads, tail in zip(scanned(effects), rows["_from"], rows["_heads"], rows["_tail"], strict=True):
            k = 0 if len(a) == 1 else int(np.flatnonzero(np.asarray(a) == s)[0])
            ends += [*heads[k], *tail]
    at = np.asarray(ends, np.int64)
    whole = []
    for x in found:
        mine = at[np.searchsorted(at, x["lo"], "right") : np.searchsorted(at, x["hi"], "right")].tolist() if x["kind"] == "text" else []
        whole.append(((x["lo"], x["hi"], x["kind"], x["how"], list(x["always"]), list(x["bare"])), mine))
    return pd.DataFrame({"_id": [doc], "_ends": [finished(whole)]})


def _whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        yield pd.DataFrame({"_id": p["_id"], "_ends": [sentence_ends(t) for t in p["_text"]]})


def sentences(documents: DataFrame, id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, end_char: one row for each sentence; end_char counts code points from the start of text to just after the sentence, closers included.

    Rules on the characters around each mark (abbreviations, numbers, domains, how the text goes on) turn text into symbols; a finite transducer over
    these, whose states hold the open quotation, the open bracket and the place in the sentence, tells where sentences end. Headings, list items and
    blank lines bound it. Texts without marks are cut at line ends, Chinese and Thai ones at spaces between statements.
    A document longer than `chunk` is cut, between any two characters that aren't marks, into chunks that are worked on apart: of each, for every state it may begin
    in, the state after it and the ends in it; these functions are composed by a prefix scan per document, which tells the ends that hold. So a long
    text is read twice, once to be cut, once to be run, and its chunks are spread over tasks. The result is the same as in one run.
    Null, empty and blank texts give no rows; equal texts in several documents are split in each; rows without an id give none.
    """
    rows = documents.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_text")).where(r"_id is not null and _text rlike '\\S'")
    rows = spread(rows, "_id")
    short = rows.where(F.length("_text") <= chunk).mapInPandas(_whole, "_id long, _ends array<int>")
    long = rows.where(F.length("_text") > chunk)
    cut = written(long.mapInPandas(partial(_chunked, size=chunk), CHUNKED), "chunks")
    whole = spread(cut, "_id", "_n").mapInPandas(_run, RUN).groupBy("_id").applyInPandas(_joined, "_id long, _ends array<int>")
    return short.unionByName(whole).select(F.col("_id").alias(id), F.explode(F.col("_ends").cast("array<long>")).alias("end_char"))
