from __future__ import annotations

import pytest

from sightline.llm.canonical import canonical_values, deletes, distance, form, forms, slip

V = "canonical_model string, manufacturer string, raw_value string, maker string"
D = "id string, model_number string, marketing_name string, codename string, manufacturer string, value string"
A = "id string, device_id string, alias_type string, value string, manufacturer string, key string"
R = "result_id long, candidate_identifier string, manufacturer string, source string, canonical_model string, value string"


@pytest.fixture(scope="module")
def reference(spark):
    v = spark.createDataFrame([("SM-A123B", "samsung", "SM-A123B/DS", ""), ("CPH1234", "oneplus", "cph1234", ""), ("GP7777K", "google", None, ""), ("SM-S123B", "samsung", None, "x")], V)
    d = spark.createDataFrame([("1", "SM-A123B", "Galaxy A54 Core", "brelorarn", "samsung", ""), ("2", "CPH1234", "OnePlus 59 Pro", "brelorarn", "oneplus", ""), ("3", "GP7777K", "Pixel 43 Pro", None, "google", ""), ("4", "SM-S123B", "Galaxy S54 Core", None, "samsung", "")], D)
    a = spark.createDataFrame([("1", "2", "other", " Zemwyk Lorimbjas ", "oneplus", ""), ("2", "3", "other", "Пиксель 43 Про", "google", ""), ("3", "3", "marketing", "pixel 43 pro", None, ""), ("4", "9", "other", "stray", None, ""), ("5", None, None, None, None, None)], A)
    return v, d, a


CASES = {
    "sm a123b": "SM-A123B", "ＳＭ－Ａ１２３Ｂ": "SM-A123B", "SSM-A123B": "SM-A123B", "SM-Al23B": "SM-A123B", "SM-A123B/DS, global": "SM-A123B", "CPH1234 - Manuals & Downloads": "CPH1234", "PCH1234": "CPH1234", "Oneplus CPH1234": "CPH1234",
    "galaxy&nbsp;a54&nbsp;core": "SM-A123B", "Core Galaxy A54": "SM-A123B", "GalaxyA54Core": "SM-A123B", "Galxy A54 Core | specs": "SM-A123B", "samsung Galaxy A54 Core 5G 256GB": "SM-A123B", "galaxy s54 core": "SM-S123B",
    "oneplus+59+pro": "CPH1234", "OnePlus 59 プロ": "CPH1234", "OnePlus%2059%20Pro": "CPH1234", "the new OnePlus 59 Pro (512 GB, black)": "CPH1234", "Zemwyk-Lorimbjas": "CPH1234", "zemwyk lorimbjsa": "CPH1234", "Пиксель 43 Про": "GP7777K",
    "OnePlus 59": "unmatched", "OnePlus 59 Ultra": "unmatched", "OnePlus 58 Pro": "unmatched", "CPH1235": "unmatched", "SM-A123E": "unmatched", "Charger for CPH1234": "unmatched", "OnePlus 59 Pro screen protector": "unmatched", "Galaxy Tab 54": "unmatched",
    "Learn more": "unmatched", "-": "unmatched", "???": "unmatched", "x" * 5000: "unmatched",
}


def test_cases(spark, reference):
    keys = list(CASES)
    rows = [(i, k, None, "forum_tips", "", "") for i, k in enumerate(keys)] + [(900, None, "x", "y", "", ""), (901, "   ", "x", "y", "", ""), (902, "brelorarn", "oneplus", None, "", ""), (903, "BRELORARN", " Samsung ", None, "", ""), (904, "brelorarn", None, "oneplus_store_scan", "", ""), (905, "brelorarn", None, None, "", ""), (902, "brelorarn", "oneplus", None, "", "")]
    got = canonical_values(spark.createDataFrame(rows, R), *reference).collect()
    by = {}
    for r in got:
        by.setdefault(r["result_id"], []).append(r["canonical_model"])
    assert {k: by[i] for i, k in enumerate(keys)} == {k: [v] for k, v in CASES.items()}
    assert 900 not in by and 901 not in by
    assert by[902] == ["CPH1234"] * 2 and by[903] == ["SM-A123B"] and by[904] == ["CPH1234"] and by[905] == ["unmatched"]


def test_empty_tables(spark, reference):
    rows = spark.createDataFrame([(1, "CPH1234", None, None, "", "")], R)
    assert canonical_values(rows.limit(0), *reference).count() == 0
    assert [r["canonical_model"] for r in canonical_values(rows, *[t.limit(0) for t in reference]).collect()] == ["unmatched"]


def test_one_slip_shares_a_key():
    import itertools
    import random

    random.seed(3)
    for word in ("oneplus", "galaxy", "zenfone"):
        for i, c in itertools.product(range(len(word)), "axq"):
            for typed in (word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :], word[: i] + word[i : i + 2][::-1] + word[i + 2 :]):
                assert deletes("7", word, "") & deletes("7", typed, "")
                assert slip(typed, word) is not None


def test_forms():
    assert form(["galaxy", "a", "54", "core"]) == ("54", "galaxya", "core", 1) and form(["xt", "4123", "4"]) == ("41234", "xt", "", 0)
    assert distance("name", ("54", "galaxys", "core"), ("54", "galaxya", "core", 1)) is None
    assert forms("Case for Alpha 7", {}, frozenset()) == [] and forms("", {}, frozenset()) == []


def test_bounds_come_from_the_list(spark, reference):
    """A listed name of any length is found; a value longer than all of them and one letter is unmatched, whatever it holds."""
    v, d, a = reference
    long = "Grand " + "Marathon" * 40 + " 12 Pro"
    v = v.unionByName(spark.createDataFrame([("LONG12", "google", None, "")], V))
    d = d.unionByName(spark.createDataFrame([("9", "LONG12", long, None, "google", "")], D))
    asked = [(1, long.lower(), None, "s", "", ""), (2, long.replace("Grand", "Gran"), "google", "s", "", ""), (3, long + " extra" * 100, "google", "s", "", "")]
    got = {r["result_id"]: r["canonical_model"] for r in canonical_values(spark.createDataFrame(asked, R), v, d, a).collect()}
    assert got == {1: "LONG12", 2: "LONG12", 3: "unmatched"}
