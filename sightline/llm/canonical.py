"""Mapping free-entered values to a canonical list (problem 6): symmetric-delete lookups, ranked by a weighted Damerau-Levenshtein distance."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import partial
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.text import folded, stripped
from sightline.plans.materialize import BROADCAST_BYTES, written

UNMATCHED = "unmatched"
#: A learned pair of words in two scripts must be seen on so many reference rows.
PAIR_SUPPORT = 2
#: So many pairs, and makers, are read to the driver (they are the words of a brand list); more are an error, never dropped.
MOST_PAIRS, MOST_MAKERS = 200_000, 100_000

# Words of product pages and feeds.
ACCESSORIES = re.compile(
    r"\b(?:case|cases|cover|covers|sleeve|pouch|bumper|charger|chargers|charging|adapter|adaptor|cable|cord|protector|protectors|glass|film|skin|sticker|strap|straps|band|wristband|holder|mount|stand|dock|stylus|pen|"
    r"battery pack|power ?bank|powerbank|earbuds|buds|headset|headphones|earphones|watch|tablet|tab|pad|book|laptop|notebook|tv|router|speaker|keyboard|mouse|memory card|sd card|sim tray|replacement|spare|"
    r"hülle|schutzfolie|ladegerät|kabel|armband|coque|étui|chargeur|câble|funda|cargador|correa)\b|ケース|カバー|充電器|フィルム|чехол|зарядк|手机壳|充电器"
)
PAGE_WORDS = re.compile(
    r"\b(?:support page|product page|support|hilfe|help|manuals? (?:&|and) downloads?|manuals?|downloads?|specs?|specifications?|reviews?|prices?|buy|shop|official site|official|overview|details|datasheet|aide|ayuda|soporte)\b|サポート|仕様"
)
ADDED = re.compile(
    r"\b\d+\s*(?:gb|tb|go|mb)\s*/\s*\d+\s*(?:gb|tb|go|mb)\b|\b\d+\s*\+\s*\d+\s*gb\b|\b\d+\s*(?:gb|tb|go|mb)(?: ram| rom| storage)?\b|(?<![\w])[2-6]g(?![\w])|\b(?:lte|volte|wifi|nfc)\b|"
    r"\bdual[ -]?sim\b|\bsingle[ -]?sim\b|\besim\b|/ds\b|\bds\b|\bglobal(?: version)?\b|\b(?:international|unlocked|refurbished|renewed|sealed|boxed)\b|\bsmart ?phones?\b|\bmobile phone\b|\bcell ?phone\b|\bhandset\b|"
    r"\b(?:the|all)[ -]new\b|\bnew\b|\bthe\b|\b(?:black|white|blue|green|red|silver|gold|grey|gray|purple|pink|yellow|orange|violet|graphite|titanium|cream|mint|lavender|schwarz|weiß|blau|grün|rot|noir|blanc|bleu|negro|blanco|azul)\b"
)
LABEL = re.compile(r"^\s*(?:model|model no\.?|model number|codename|code name|name|device|product|id|modell|modèle|modelo)\s*[:=#]\s*", re.I)
#: Words that make another model of the same series.
TIERS = frozenset("pro plus ultra lite mini max neo flip fold core slim turbo air prime edge se fe gt play active classic".split())
#: The same words as other scripts write them, beside what the reference list itself teaches.
WORDS = {
    "プロ": "pro", "プラス": "plus", "ウルトラ": "ultra", "ライト": "lite", "ミニ": "mini", "マックス": "max", "ネオ": "neo", "フリップ": "flip", "フォールド": "fold", "コア": "core", "スリム": "slim", "ターボ": "turbo", "ノート": "note", "エッジ": "edge",
    "про": "pro", "плюс": "plus", "ультра": "ultra", "лайт": "lite", "мини": "mini", "макс": "max", "нео": "neo", "флип": "flip", "фолд": "fold", "кор": "core", "слим": "slim", "турбо": "turbo", "ноут": "note", "эдж": "edge",
    "프로": "pro", "플러스": "plus", "울트라": "ultra", "라이트": "lite", "미니": "mini", "맥스": "max", "네오": "neo", "폴드": "fold", "플립": "flip",
}
#: Letters of other scripts that look like Latin ones.
ALIKE = str.maketrans("авекмнорстухіјѕԁɡհոսαβεηικμνορτυχոօ", "abekmhopctyxijsdghnuabenikmvoptuxno")
ROMAN = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюя", "a b v g d e zh z i y k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya".replace("_", "").split(" "), strict=True))

RUN = re.compile(r"[a-z]+|[0-9]+|[^\W\d_a-z]+")
LOOKALIKE = re.compile(r"(?<=[0-9])[oil]|[oil](?=[0-9])")

Form = tuple[str, str, str, int]


def reads(word: str, words: dict[str, str]) -> list[str]:
    """A run of another script in Latin letters: by known words, one after another; else by look-alikes; else letter by letter."""
    out, i = [], 0
    longest = max(map(len, words), default=0)
    while i < len(word):
        for k in range(min(longest, len(word) - i), 0, -1):
            if (w := words.get(word[i : i + k])) is not None:
                out.append(w)
                i += k
                break
        else:
            break
    if i == len(word):
        return out
    alike = word.translate(ALIKE)
    if alike.isascii():
        return [alike]
    plain = unicodedata.normalize("NFKD", word)
    return ["".join(ROMAN.get(c, c) for c in plain if not unicodedata.combining(c))]


def cleaned(value: str) -> str | None:
    """A value without markup, coding, labels and added words; None if it names something that isn't a phone."""
    v = html.unescape(html.unescape(value))
    if "%" in v:
        v = unquote(v)
    v = unicodedata.normalize("NFKC", v).replace("‑", "-").lower()
    v = re.sub(r"<[^>]*>", " ", v)
    v = re.sub(r"[‐-―−]", "-", v)
    v = LABEL.sub("", v.strip(" \t\r\n\"'“”«»[]"))
    if " " not in v and re.search(r"\w\+\w", v):
        v = v.replace("+", " ")
    v = re.sub(r"(?<=\w)\s?\+(?!\w)", " plus", v)
    flat = re.sub(r"[_\-]+", " ", v)
    if ACCESSORIES.search(flat):
        return None
    parts = re.split(r"\s[|\-–—:·»]\s|\|", v)
    if len(parts) > 1:
        v = " ".join(p for i, p in enumerate(parts) if i == 0 or re.search(r"\d", p) or not PAGE_WORDS.search(p))
    v = ADDED.sub(" ", re.sub(r"_", " ", v))
    return PAGE_WORDS.sub(" ", v)


def tokens(text: str, words: dict[str, str]) -> list[str]:
    out: list[str] = []
    for chunk in re.split(r"[\s]+", text):
        for piece in re.split(r"[^\w]+", chunk):
            runs = RUN.findall(piece)
            mixed = any(not r.isascii() for r in runs) and any(r.isascii() and r.isalpha() for r in runs)
            if mixed:
                alike = piece.translate(ALIKE)
                known = [r for r in runs if not r.isascii() and r in words or not r.isascii() and len(r) > 2]
                if alike.isascii() and not known:
                    runs = RUN.findall(alike)
            for r in runs:
                out += [r] if r.isascii() else reads(r, words)
    return [t for t in out if t]


def form(parts: list[str]) -> Form:
    """Digits, letters before them, letters after them, and how many of the letters just before stand alone (1 for the A of Galaxy A54, else 0)."""
    if len(parts) > 2 and parts[0] in TIERS and any(p.isdigit() for p in parts) and not parts[-1].isdigit() | (parts[-1] in TIERS):
        parts = [*parts[1:], parts[0]]
    elif len(parts) > 2 and parts[0] in TIERS and parts[-1].isdigit():
        parts = [*parts[1:], parts[0]]
    at = next((i for i, p in enumerate(parts) if p.isdigit()), None)
    if at is None:
        return "", "".join(parts), "", 0
    end = at
    while end + 1 < len(parts) and parts[end + 1].isdigit():
        end += 1
    digits = "".join(parts[at : end + 1])
    rest = parts[end + 1 :]
    alone = int(at > 1 and len(parts[at - 1]) == 1)
    return digits + "".join(p for p in rest if p.isdigit()), "".join(parts[:at]), "".join(p for p in rest if not p.isdigit()), alone


def forms(value: str, words: dict[str, str], makers: frozenset[str], longest: int | None = None) -> list[Form]:
    """How a value can be read: as it is; with digits for the letters that look like them; each also without the maker's name in front.

    longest: letters and digits of the longest listed form and one more, beyond which no reading can be within a slip of one."""
    text = cleaned(value)
    if text is None:
        return []
    found: dict[Form, None] = {}
    texts = [text]
    if (swapped := re.sub(r"[a-z0-9]*\d[a-z0-9]*", lambda m: LOOKALIKE.sub(lambda c: "0" if c[0] == "o" else "1", m[0]), text)) != text:
        texts.append(swapped)
    for t in texts:
        parts = tokens(t, words)
        if not parts:
            continue
        f = form(parts)
        found[f] = None
        for n in sorted({len(m) for m in makers}):
            if n < len(f[1]) and f[1][:n] in makers:
                found[(f[0], f[1][n:], f[2], f[3])] = None
    return [f for f in found if longest is None or len(f[0]) + len(f[1]) + len(f[2]) <= longest]


def deletes(digits: str, before: str, after: str) -> set[str]:
    """The keys of a form: itself, and with any one letter taken out. Two forms with one slip between them share a key."""
    whole = f"{digits}|{before}|{after}"
    keys = {whole}
    if len(before) + len(after) >= 3:
        keys |= {f"{digits}|{before[:i]}{before[i + 1 :]}|{after}" for i in range(len(before))}
        keys |= {f"{digits}|{before}|{after[:i]}{after[i + 1 :]}" for i in range(len(after))}
    return keys


def slip(a: str, b: str) -> tuple[float, str] | None:
    """The weight of the one slip between two words, and its kind; (0, "") if they are equal, None if it takes more than one."""
    if a == b:
        return 0.0, ""
    if abs(len(a) - len(b)) > 1:
        return None
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        if a[i + 1 :] == b[i + 1 :]:
            return 0.8, "other"
        if a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1]:
            return 0.4, "turned"
        return None
    long, short = (a, b) if len(a) > len(b) else (b, a)
    if long[i + 1 :] != short[i:]:
        return None
    double = i > 0 and long[i] == long[i - 1] or i + 1 < len(long) and long[i] == long[i + 1]
    return (0.3, "double") if double and len(a) > len(b) else (0.5, "more" if len(a) > len(b) else "less")


def distance(kind: str, typed: tuple[str, str, str], listed: Form) -> float | None:
    """How far a typed form is from a listed one, None if it is another model. Digits must agree.

    A code may have one slip in the letters before its digits, but no other letter there and none in the letters after, as those tell models apart.
    A name may have one slip in its words, not in a letter that stands alone (Galaxy A54) and not in a short word after the number.
    """
    digits, before, after, alone = listed
    if typed[0] != digits:
        return None
    b, a = typed[1], typed[2]
    if (b, a) == (before, after):
        return 0.0
    if a == after:
        if alone:
            if b[-1:] != before[-1:]:
                return None
            b, before = b[:-1], before[:-1]
        s = slip(b, before)
        if s is None:
            return None
        if kind == "code":
            return s[0] if len(digits) >= 3 and len(before) >= 2 and s[1] != "other" else None
        if not digits:
            return s[0] if len(before) >= 7 else None
        return s[0] if len(before) >= 4 else None
    if b == before and kind != "code" and len(after) >= 3:
        s = slip(a, after)
        if s is None or (len(after) < 4 and s[1] == "other") or a in TIERS:
            return None
        return s[0]
    return None


INDEX = "key string, canonical string, maker string, kind string, freq long, digits string, before string, after string, alone int"


def _index(parts: Iterator[pd.DataFrame], words: dict[str, str], makers: frozenset[str]) -> Iterator[pd.DataFrame]:
    for p in parts:
        rows = []
        for r in p.itertuples(index=False):
            for f in forms(r.surface, words, frozenset())[:1]:
                if len(f[0]) + len(f[1]) + len(f[2]) >= 3 and (f[1] or f[2]):
                    rows += [(k, r.canonical, r.maker, r.kind, r.freq, *f) for k in deletes(*f[:3])]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])


def _asked(parts: Iterator[pd.DataFrame], words: dict[str, str], makers: frozenset[str], longest: int) -> Iterator[pd.DataFrame]:
    for p in parts:
        rows = [(v, k, *f[:3]) for v in p["value"] for f in forms(v, words, makers, longest) for k in deletes(*f[:3])]
        yield pd.DataFrame(rows, columns=["value", "key", "d", "b", "a"])


def _judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        cost = [distance(r.kind, (r.d, r.b, r.a), (r.digits, r.before, r.after, r.alone)) for r in p.itertuples(index=False)]
        out = p[["value", "canonical", "maker", "kind", "freq"]].assign(cost=pd.array(cost, dtype="Float64").astype(float))
        yield out[out["cost"].notna()]


def reference(validations: DataFrame, devices: DataFrame, aliases: DataFrame) -> DataFrame:
    """canonical, maker, kind (code, name or alias), surface, freq: all that the list's models are called; freq is the number of rows that say so."""
    canon = validations.select(F.col("canonical_model").alias("canonical"), folded(F.col("manufacturer")).alias("maker"), "raw_value").where("canonical is not null")
    known = canon.select("canonical")
    dev = devices.select(F.col("id").alias("device"), F.col("model_number").alias("canonical"), "marketing_name", "codename", folded(F.col("manufacturer")).alias("maker")).join(known, "canonical", "left_semi")
    names = aliases.select(F.col("device_id").alias("device"), "alias_type", "value", folded(F.col("manufacturer")).alias("_m")).join(dev.select("device", "canonical", "maker"), "device")
    kind = F.when(F.col("alias_type") == "model", "code").when(F.col("alias_type") == "marketing", "name").otherwise("alias")
    every = (
        canon.select("canonical", "maker", F.lit("code").alias("kind"), F.col("canonical").alias("surface"))
        .unionByName(canon.select("canonical", "maker", F.lit("code").alias("kind"), F.col("raw_value").alias("surface")))
        .unionByName(dev.select("canonical", "maker", F.lit("name").alias("kind"), F.col("marketing_name").alias("surface")))
        .unionByName(dev.select("canonical", "maker", F.lit("alias").alias("kind"), F.col("codename").alias("surface")))
        .unionByName(names.select("canonical", F.coalesce("_m", "maker").alias("maker"), kind.alias("kind"), F.col("value").alias("surface")))
    )
    return every.select("canonical", F.coalesce("maker", F.lit("")).alias("maker"), "kind", folded(F.col("surface")).alias("surface")).where("surface <> ''").groupBy("canonical", "maker", "kind", "surface").agg(F.count("*").alias("freq"))


def taught(listed: DataFrame) -> dict[str, str]:
    """Words of other scripts and their Latin counterparts, from names of one model that have as many words in either script. More than MOST_PAIRS are an error."""
    words = listed.select("canonical", F.split(F.regexp_replace("surface", r"\s+", " "), " ").alias("w"))
    latin = listed.where("kind = 'name'").select("canonical", F.split(F.regexp_replace("surface", r"\s+", " "), " ").alias("l"))
    pairs = words.join(latin, "canonical").where(F.size("w") == F.size("l")).select(F.explode(F.arrays_zip("w", "l")).alias("p")).select("p.w", "p.l")
    pairs = pairs.where(r"w rlike '^[^\\x00-\\x7f]+$' and l rlike '^[a-z]+$'").groupBy("w", "l").count().where(F.col("count") >= PAIR_SUPPORT)
    best = pairs.groupBy("w").agg(F.max(F.struct("count", "l")).alias("b")).select("w", F.col("b.l").alias("l"), F.col("b.count").alias("n"))
    return {unicodedata.normalize("NFKC", r["w"]): r["l"] for r in bounded(best, MOST_PAIRS, "w", "pairs of words")}


def bounded(df: DataFrame, most: int, key: str, what: str) -> list:
    """The rows of a small table; an error if there are more than that."""
    rows = df.orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def canonical_values(found: DataFrame, validations: DataFrame, devices: DataFrame, aliases: DataFrame, row: str = "result_id", value: str = "candidate_identifier", maker: str = "manufacturer", source: str = "source") -> DataFrame:
    """row, canonical_model: one row for each row of found whose value isn't null or blank, with the listed model that the value denotes, or `unmatched`.

    Values are read as digits, letters before and letters after, once coding, scripts, look-alikes, separators and added words are out of the
    way; of a value with more letters than the longest listed form and one, none can denote it. The list's codes, names and aliases are indexed by these with any one letter deleted; so are the values; equal keys meet in a join, in
    which the index is broadcast if its counted rows are small, and both sides are shuffled if not. Meetings are then judged: digits must
    agree, one slip in letters may not, and what tells models apart must. Of several models the nearest counts, then code before name before
    alias, then the maker (the row's manufacturer, or the one its source is named after), then how often the list says so; a tie that remains
    leaves the value unmatched. Distinct values are looked up once, however often they occur. Rows without a `row` value are kept.
    """
    listed = written(reference(validations, devices, aliases), "listed")
    words = WORDS | taught(listed)
    makers = frozenset(r["maker"] for r in bounded(listed.select("maker").distinct(), MOST_MAKERS, "maker", "makers") if r["maker"])
    index = written(listed.mapInPandas(partial(_index, words=words, makers=makers), INDEX).distinct(), "index")
    size = index.agg(F.count("*").alias("n"), F.max(F.length(F.concat("digits", "before", "after"))).alias("longest")).first()
    rows = found.select(F.col(row).alias("_row"), F.col(value).alias("value"), folded(F.col(maker)).alias("_maker"), folded(F.col(source)).alias("_source")).where(stripped(F.col("value")) != "")
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # distinct values are few bytes and much work: AQE would put them in one task
    asked = rows.select("value").distinct().repartition(n, "value").mapInPandas(partial(_asked, words=words, makers=makers, longest=(size["longest"] or 0) + 1), "value string, key string, d string, b string, a string")
    met = asked.join(F.broadcast(index) if size["n"] * 120 <= BROADCAST_BYTES else index, "key").drop("key").distinct()
    near = met.mapInPandas(_judge, "value string, canonical string, maker string, kind string, freq long, cost double")
    order = F.when(F.col("kind") == "code", 0).when(F.col("kind") == "name", 1).otherwise(2)
    by_value = Window.partitionBy("value")
    near = near.groupBy("value", "canonical", "maker").agg(F.min(F.struct("cost", order.alias("rank"))).alias("at"), F.sum("freq").alias("freq"))
    near = near.withColumn("best", F.min("at").over(by_value)).where(F.col("at") == F.col("best"))
    options = near.groupBy("value").agg(F.collect_list(F.struct("maker", "freq", "canonical")).alias("_options"))  # the nearest only: few per value
    said = F.coalesce(F.col("_maker"), F.regexp_extract("_source", r"^([a-z0-9]+)_", 1))
    joined = rows.join(options, "value", "left").withColumn("_said", said)
    same = F.filter("_options", lambda o: o["maker"] == F.col("_said"))
    left = F.when(F.size(same) > 0, same).otherwise(F.col("_options"))
    joined = joined.withColumn("_left", left)
    most = F.array_max(F.transform("_left", lambda o: o["freq"]))
    top = F.array_distinct(F.transform(F.filter("_left", lambda o: o["freq"] == most), lambda o: o["canonical"]))
    every = F.array_distinct(F.transform("_left", lambda o: o["canonical"]))
    chosen = F.when(F.size(every) == 1, every[0]).when((F.size(same) > 0) & (F.size(top) == 1), top[0])
    return joined.select(F.col("_row").alias(row), F.coalesce(chosen, F.lit(UNMATCHED)).alias("canonical_model"))
