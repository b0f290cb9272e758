"""Grammars of product identifiers, as rule tables compiled to expressions: the first rule that matches decides."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import stripped
from sightline.operators.page_changes import has_any

# What isn't an identifier, in the order in which it is asked.
LONGEST = 40
NOT_IDENTIFIERS = (
    ("cookie_text", ("cookie",)),
    ("promotion_text", ("exclusive offer", "trade in", "free case", "sign up", "newsletter", "get 10%", "save big", "receive an", "buy pixel", "pre-order")),
    ("navigation_text", ("skip to main content", "shop the collection", "compare all", "shop now", "shop the", "explore the")),
    ("watch_not_phone", ("watch",)),
    ("tablet_not_phone", ("tablet", "pad")),
    ("audio_product", ("buds", "earphone", "earbud", "headphone", "ear (", " ear ", "ear)")),
    ("charger", ("charger", "charging", "adapter", "power brick", "hypercharge combo", "supervooc charger")),
    ("case", ("case", "cover", "bumper", "sleeve")),
    ("software_name", ("os ", "oxygenos", "coloros", "hyperos", "miui", "android 1", "nothing os")),
)
STOP_WORDS = (
    "and the with your you for to a is are built designed so focus every single day on today now browsing enhance experience site by continuing agree our use of also available see sold "
    "separately required receive when trade current get free select"
).split()
MOST_WORDS, MOST_STOP_WORDS = 6, 1


def rejected(candidate: Column) -> Column:
    """Why a text can't be an identifier at all; null if nothing speaks against it. Nulls and blanks are `empty_field`."""
    text = stripped(F.coalesce(candidate, F.lit("")))
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(r"([a-z']+)"), F.lit(1))
    stops = F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS)))
    c = F.when(text == "", "empty_field").when(F.length(text) > LONGEST, "too_long")
    for reason, parts in NOT_IDENTIFIERS:
        c = c.when(has_any(low, parts), reason)
    return c.when((stops > MOST_STOP_WORDS) | (F.size(words) > MOST_WORDS), "contains_sentence")


@dataclass(frozen=True)
class Rule:
    """One rule of a grammar: a text that `form` matches has `reason` against it, or, without a reason, is valid.

    family: what a valid text's family is, or, in braces, the group of the form that tells it and how it is written. lengths: if given, the rule
    holds only for texts shorter or longer than these two. code: the text is a code, which is normalised to capitals. brand: whose it is, if not the maker's.
    """

    form: str
    reason: str | None = None
    family: str | None = None
    lengths: tuple[int, int] | None = None
    code: bool = False
    brand: str | None = None


FAMILY, LENGTH, PREFIX = "family_name_without_model", "invalid_length", "invalid_prefix"
# Words of a maker's other goods.
PC_WORDS = (
    "laptop", "notebook", "vivobook", "zenbook", "chromebook", "rog strix", "rog zephyrus", "tuf gaming", "motherboard", "prime ", "rog crosshair", "rog maximus", "graphics card", "geforce", "radeon", "rtx ", " gtx ",
    "monitor", "proart display", "router", "rt-ax", "zenwifi", "mini pc", "nuc", "chromebox", "mouse", "keyboard", "headset",
)
# The makers' forms, in the order in which they are asked; the first that matches decides.
GRAMMARS: dict[str, tuple[Rule, ...]] = {
    "google": (
        Rule("(?i)^pixel$", FAMILY), Rule(r"^Pixel (?:0?[1-9]|1[0-9]|20)a?(?: Pro(?: XL| Fold)?)?$", family="Pixel"), Rule(r"^Pixel [0-9]{1,2}a?(?: Pro(?: XL| Fold)?)?$", "invalid_generation")
    ),
    "oneplus": (
        Rule("^(?:CPH|PLK)[0-9]{4}$", family="OnePlus", code=True), Rule("^(?:CPH|PLK)[0-9]+$", LENGTH), Rule("(?i)^oneplus$", FAMILY), Rule(r"^OnePlus (?:[0-9]{1,2}[RT]?(?: Pro)?|Open|Nord(?: [A-Za-z0-9-]+)?)$", family="OnePlus"),
    ),
    "nothing": (Rule(r"^CMF Phone [0-9]$", family="CMF Phone", brand="cmf"), Rule(r"^Phone \([0-9][a-z]?\)(?: Plus| Pro| Lite)?$", family="Nothing Phone"), Rule("(?i)^(?:phone|nothing|cmf)$", FAMILY)),
    "xiaomi": (
        Rule("(?i)^(?:redmi|poco|xiaomi)$", FAMILY), Rule("^M[0-9]{4}[A-Z][0-9A-Z]{1,4}$", code=True), Rule(r"(?i)^m[\p{L}\p{N} ]+$", LENGTH, lengths=(8, 12)), Rule(r"^Redmi(?: Note)? [0-9]{1,2}[A-Za-z]?(?: Pro)?\+?$", family="Redmi", brand="redmi"),
        Rule(r"^POCO [A-Z][0-9]{1,2}(?: Pro)?$", family="POCO", brand="poco"), Rule(r"^Xiaomi [0-9]{1,2}[A-Za-z]?(?: Pro| Ultra| T)*$", family="Xiaomi"),
    ),
    "honor": (Rule("(?i)^honor$", FAMILY), Rule(r"(?i)^Honor Magic ?V?[0-9]{1,2}(?: Pro| Ultra)?$", family="Magic"), Rule(r"(?i)^Honor [0-9]{2,4}(?: Pro| Ultra)?$", family="Numbered")),
    "realme": (Rule("(?i)^realme$", FAMILY), Rule(r"(?i)^realme [0-9]{1,3}(?: Pro(?: Plus)?| Ultra)?(?: 5G| 4G)?$", family="numbered"), Rule(r"(?i)^realme (?:GT|Narzo|C)\s?(?:[0-9]{1,3})?[A-Za-z]{0,3}(?: Pro)?(?: 5G)?$", family="named-series")),
    "motorola": (Rule(r"(?i)^(Razr|Edge|Moto G|Moto E)(?: Plus| Ultra| Play| Power| Stylus| Fold)?(?: 5G)?(?: [0-9]{4})?(?: Gen [0-9])?$", family="{title}"),),
    "oppo": (Rule("(?i)^(?:find|find x|find n|reno|a)$", FAMILY), Rule(r"(?i)^(Find X|Find N|Reno|A)[0-9]{1,3}(?: Pro| Ultra| Max| Flip| F)?(?: 5G| 4G)?$", family="{title}")),
    "vivo": (Rule("(?i)^iqoo", "iqoo_not_vivo"), Rule("(?i)^[vxys]$", FAMILY), Rule(r"(?i)^([VXYS])[0-9]{1,3}(?:[A-Z]{1,2})?(?: Pro| Ultra| Plus)?(?: 5G)?$", family="{upper}-series", code=True)),
    "asus": (Rule("(?i)(?:" + "|".join(PC_WORDS) + ")", "pc_hardware"), Rule("(?i)^(?:zenfone|rog phone|rog)$", FAMILY), Rule(r"(?i)^(Zenfone|ROG Phone) [0-9]{1,2}(?: Pro| Ultra)?$", family="{title}")),
}
# What a maker's identifiers begin with, and the name of those that do and match no form.
BEGINS = {"google": ("pixel",), "oneplus": ("oneplus",), "nothing": ("phone", "cmf", "nothing"), "xiaomi": ("redmi", "poco", "xiaomi", "m"), "honor": ("honor",), "realme": ("realme",), "motorola": ("razr", "edge", "moto"), "oppo": ("find", "reno", "oppo a"), "vivo": ("v", "x", "y", "s"), "asus": ("zenfone", "rog phone")}
OPEN_NAMES = {"google": "pixel"}
SUPPORTED = "samsung google oneplus nothing xiaomi redmi poco honor realme motorola oppo vivo asus".split()


def rules_of(maker: str) -> list[Rule]:
    """A maker's rules with the last two: what begins otherwise, and what is left open."""
    own = GRAMMARS[maker]
    begin = "|".join(BEGINS[maker])
    return [*own, Rule(f"(?i)^(?:{begin})", f"unrecognized_{OPEN_NAMES.get(maker, maker)}_format"), Rule("", PREFIX)]


#: All rules of all makers, by number.
NUMBERED = [(maker, r) for maker in GRAMMARS for r in rules_of(maker)]


def _number(text: Column, maker: str) -> Column:
    """The number of the first of a maker's rules that holds."""
    first = next(n for n, (m, _) in enumerate(NUMBERED) if m == maker)
    c = F.when(F.lit(False), F.lit(-1))
    for n, r in enumerate(rules_of(maker), first):
        fits = text.rlike(r.form) if r.form else F.lit(True)
        c = c.when(fits & ((F.length(text) < r.lengths[0]) | (F.length(text) > r.lengths[1])) if r.lengths else fits, F.lit(n))
    return c


def _family(text: Column, number: Column) -> Column:
    c = F.get(F.array(*[F.lit(r.family if r.family and not r.family.startswith("{") else None).cast("string") for _, r in NUMBERED]), number)
    for n, (_, r) in enumerate(NUMBERED):
        if r.family and r.family.startswith("{"):
            told = F.regexp_extract(text, r.form, 1)
            how, rest = r.family[1:].split("}")
            c = F.when(number == n, F.concat(F.initcap(F.lower(told)) if how == "title" else F.upper(told), F.lit(rest))).otherwise(c)
    return c


def validated_by_maker(df: DataFrame, candidate: str, maker: str) -> DataFrame:
    """Adds `validation` (outcome VALID, INVALID or AMBIGUOUS, reason, family, normalized, brand) by the grammar of each row's maker, and `bridged`: whether a valid text's brand is SUPPORTED.

    What speaks against any identifier comes first (a null or blank one is empty_field), then the maker's rules in order. A maker without a
    grammar gives INVALID, unknown_manufacturer. The rules' numbers are found first; all else is looked up by them.
    """
    at = F.lower(F.col(maker))
    number = F.when(at.isNull(), F.lit(None).cast("int"))
    for name in GRAMMARS:  # one branch for each maker, of which a row's own alone is gone through
        number = number.when(at == name, _number(F.col("_text"), name))
    df = df.withColumn("_text", stripped(F.coalesce(F.col(candidate), F.lit("")))).withColumn("_why", rejected(F.col(candidate))).withColumn("_n", number)
    by = lambda value: F.get(F.array(*[F.lit(value(m, r)).cast("string") for m, r in NUMBERED]), F.col("_n"))
    df = df.withColumn("_reason", F.when(F.col("_n").isNull(), "unknown_manufacturer").when(F.col("_why").isNotNull(), F.col("_why")).otherwise(by(lambda m, r: r.reason)))
    valid = F.col("_reason").isNull()
    outcome = F.when(valid, "VALID").when(F.col("_reason").startswith("unrecognized_"), "AMBIGUOUS").otherwise("INVALID")
    validation = F.struct(
        outcome.alias("outcome"), F.col("_reason").alias("reason"), F.when(valid, _family(F.col("_text"), F.col("_n"))).alias("family"),
        F.when(valid, F.when(by(lambda m, r: "y" if r.code else None).isNotNull(), F.upper("_text")).otherwise(F.col("_text"))).alias("normalized"), F.when(valid, by(lambda m, r: r.brand or m)).alias("brand"),
    )
    return df.withColumn("validation", validation).withColumn("bridged", valid & F.col("validation.brand").isin(*SUPPORTED)).drop("_text", "_why", "_n", "_reason")


# The letter after SM- and what it stands for, and what the letters behind the digits tell.
SERIES = {"S": ("smartphone", "Galaxy S"), "A": ("smartphone", "Galaxy A"), "M": ("smartphone", "Galaxy M"), "F": ("foldable", "Galaxy Z"), "G": ("smartphone", "Galaxy S legacy"), "E": ("smartphone", "Galaxy F/E"), "C": ("smartphone", "Galaxy C"), "W": ("smartphone", "Galaxy W"), "X": ("tablet", "Galaxy Tab"), "T": ("tablet", "Galaxy Tab"), "R": ("smartwatch", "Galaxy Watch"), "L": ("laptop", "Galaxy Book")}
EXCLUDED = ("laptop", "smartwatch")
REGIONS = {"B": "global_or_india", "U": "usa", "N": "korea", "W": "canada", "0": "china", "E": "europe_variant", "J": "japan"}


def _mapped(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def samsung_model(raw: Column) -> Column:
    """canonical, category, series, region, family_key and reason of a code as SM-S928B/DS: series letter, digits, one regional letter, further letters."""
    text = F.regexp_replace(F.upper(stripped(F.coalesce(raw, F.lit("")))), " ", "")
    first = F.element_at(F.split(text, "[/,_]"), 1)
    form = r"^(SM-([SAGMFECTWXRVL])([0-9]{2,4}))([A-Z0-9]{0,10})$"
    base, letter, digits, rest = (F.regexp_extract(first, form, i) for i in (1, 2, 3, 4))
    category = _mapped({k: v[0] for k, v in SERIES.items()}, letter)
    region = _mapped(REGIONS, F.substring(rest, 1, 1))
    unlocked = rest.startswith("U1")
    reason = F.when(text.rlike(r"^SM-[A-Z0-9]+(?:BOOT|ENG)|FIRMWARE|^BUILD"), "matched_reject_pattern").when(base == "", "no_canonical_match").when(category.isin(*EXCLUDED), F.concat(F.lit("excluded_category:"), category))
    ok = reason.isNull()
    return F.struct(
        F.when(ok, F.concat(base, F.when(region.isNotNull() & ~unlocked, F.substring(rest, 1, 1)).otherwise(""))).alias("canonical"), category.alias("category"), F.when(ok, _mapped({k: v[1] for k, v in SERIES.items()}, letter)).alias("series"),
        F.when(ok, F.when(unlocked, F.lit("usa_unlocked")).otherwise(region)).alias("region"), F.when(ok, F.concat(F.lit("SM"), letter, digits)).alias("family_key"), reason.alias("reason"),
    )


# Pages of a shop that are no model's, and how families are written.
NO_PRODUCTS = (
    "store support blog legal press customer brand sustainability trade-in rcc redcoins-center affiliate-program accessibility oxygenos12 oxygenos13 oxygenos14 oxygenos15 store-app featuring sitemap jcart retail discount "
    "power-of-community trade-in-rule redcoins-shop"
).split()
NO_PRODUCT_PARTS = ("keyboard", "case", "cover", "screen-protector", "charger", "buds", "watch", "band")
OPPO_FAMILIES = {"find-x": ("Find X", "x"), "find-n": ("Find N", "n"), "reno": ("Reno", "reno"), "a": ("A", "a")}
MOTO_FAMILIES = {"razr": "Razr", "moto-g": "Moto G", "motorola-edge": "Edge", "moto-e": "Moto E"}


def _words(tokens: Column, kept: tuple[str, ...] = ("5g", "4g")) -> Column:
    """Tokens as words: those kept in capitals, else with a capital first letter, joined by spaces."""
    return F.array_join(F.transform(tokens, lambda t: F.when(t.isin(*kept), F.upper(t)).otherwise(F.initcap(t))), " ")


def _tail(tokens: Column, start: int) -> Column:
    return F.slice(tokens, start, F.greatest(F.size(tokens) - (start - 1), F.lit(0)))


def _spaced(head: Column, tail: Column) -> Column:
    return F.when(tail == "", head).otherwise(F.concat(head, F.lit(" "), tail))


def slug_name(slug: Column, maker: str, family: Column | None = None) -> Column:
    """The name of the model that a maker's page is about, by its address's last part (slug); null for what is no model's page. family: the part before it, for makers whose addresses have one."""
    low = F.lower(slug)
    none = F.lit(None).cast("string")
    if maker == "google":
        rest = F.split(low, "_")
        pro = F.get(rest, F.lit(2)) == "pro"
        last = F.get(rest, F.lit(3))
        more = F.when(pro & (last == "xl"), " Pro XL").when(pro & (last == "fold"), " Pro Fold").when(pro, " Pro").otherwise("")
        return F.when(low.startswith("pixel_"), F.concat(F.lit("Pixel "), rest[1], more))
    if maker == "oneplus":
        low = F.regexp_replace(low, "^/+|/+$", "")
        body = F.regexp_replace(low, "^oneplus-", "")
        form = "^([0-9]{1,2})(r|t)?(-pro)?$"
        name = F.concat(F.lit("OnePlus "), F.regexp_extract(body, form, 1), F.upper(F.regexp_extract(body, form, 2)), F.when(body.endswith("-pro"), " Pro").otherwise(""))
        return (
            F.when((low == "") | low.isin(*NO_PRODUCTS) | has_any(low, NO_PRODUCT_PARTS), none).when(low.isin("open", "oneplus-open"), "OnePlus Open")
            .when(body.rlike("^n[0-9]"), F.concat(F.lit("OnePlus Nord "), F.upper(F.substring(body, 2, 1 << 20)))).when(body.rlike(form), name).when(low.isNotNull(), F.concat(F.lit("OnePlus "), body))
        )
    if maker == "nothing":
        number = F.regexp_extract(low, "^phone-([0-9][^-]*)", 1)
        second = F.regexp_extract(low, "^phone-[^-]*-([^-]*)", 1)
        return F.when(low.rlike("^cmf-phone-[0-9]+$"), F.concat(F.lit("CMF Phone "), F.substring(low, 11, 1 << 20))).when(number != "", F.concat(F.lit("Phone ("), number, F.lit(")"), F.when(second.isin("plus", "pro", "lite"), F.concat(F.lit(" "), F.initcap(second))).otherwise("")))
    tokens = F.split(low if maker == "xiaomi" else slug, "-")
    if maker == "xiaomi":
        note = (tokens[0] == "redmi") & (F.get(tokens, F.lit(1)) == "note")
        rest = F.when(note, _tail(tokens, 3)).otherwise(_tail(tokens, 2))
        first, tail = F.get(rest, F.lit(0)), _tail(rest, 2)
        extras = F.array_join(F.transform(F.filter(tail, lambda t: t.isin("pro", "ultra", "t")), F.initcap), " ")
        redmi = F.concat(F.when(note, "Redmi Note ").otherwise("Redmi "), first, F.when(F.array_contains(tail, "pro"), " Pro").otherwise(""), F.when(F.array_contains(tail, "plus"), "+").otherwise(""))
        poco = F.concat(F.lit("POCO "), F.upper(first), F.when(F.get(tail, F.lit(0)) == "pro", " Pro").otherwise(""))
        return F.when(~F.coalesce(first.rlike("[0-9]"), F.lit(False)), none).when(tokens[0] == "redmi", redmi).when(tokens[0] == "poco", poco).when(tokens[0] == "xiaomi", _spaced(F.concat(F.lit("Xiaomi "), first), extras))
    if maker == "honor":
        name = _spaced(F.lit("Honor"), _words(_tail(tokens, 2), ()))
        name = F.regexp_replace(F.regexp_replace(name, r"\bMagic V([0-9]+)\b", "Magic v$1"), r"\bV ([0-9]+)", "V$1")  # a glued v stays as it is behind Magic
        return F.when(tokens[0] == "honor", name)
    if maker == "realme":
        tokens = F.split(F.regexp_replace(F.substring(slug, 8, 1 << 20), "^(gt|narzo|c)([0-9]+)(?=-|$)", "$1-$2"), "-")
        return F.when(slug.startswith("realme-") & (F.length(slug) > 7), F.concat(F.lit("realme "), _words(tokens, ("5g", "4g", "gt"))))
    if maker == "oppo" and family is not None:
        c = F.when(F.lit(False), none)
        for segment, (shown, letter) in OPPO_FAMILIES.items():
            own = F.split(F.regexp_replace(slug, "^find-", "") if segment.startswith("find-") else slug, "-")
            number = F.regexp_extract(own[0], f"^{letter}([0-9].*)$", 1)
            c = c.when((family == segment) & (number != ""), _spaced(F.concat(F.lit(shown), number), _words(_tail(own, 2))))
        return c
    if maker == "motorola" and family is not None:
        c = F.when(F.lit(False), none)
        for segment, shown in MOTO_FAMILIES.items():
            own = F.regexp_replace(slug, f"^{segment}(?:-|$)", "")
            c = c.when(family == segment, F.when(own == "", F.lit(shown)).otherwise(F.concat(F.lit(shown + " "), _words(F.split(own, "-"), ("5g",)))))
        return c
    return none


def find_models(text: Column) -> Column:
    """SM- codes in a text, in upper case, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\b(SM-[A-Z0-9]{3,16})\b"), F.lit(1)), F.upper))
