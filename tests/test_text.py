"""Goldens and edge cases of the normalisers, tokens and string metrics."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import similarity as S
from kindred.functions import text as X
from kindred.functions import tokens as K


def one(spark, make, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(make(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "make, given_, expected",
    [
        (X.sound_key, "southern", "strn"), (X.sound_key, "sdrn", "strn"), (X.sound_key, "white", "wt"), (X.sound_key, "vhait", "wt"), (X.sound_key, "galaxy", "glks"), (X.sound_key, "gaileksi", "glks"),
        (X.bare_number, "090", "90"), (X.bare_number, "000", "0"), (X.clean, "amsholdings.com", "amsholdings"), (X.clean, "p.v.t. ltd", "pvt ltd"), (X.clean, "N°13 & Söhne's", "n 13 and sohnes"),
        (X.join_pins, "560 001", "560001"), (X.bare_numbers, "11th 94st 30rd 090", "11 94 30 90"), (X.norm_address, "eleventh ave", "11 ave"), (X.norm_address, "dover delaware", "dover"),
        (X.norm_address, "chandigarh", "chem"), (X.norm_name, "c0nsultants hea1th anch0r 5ervices", "consultants health anchor services"), (X.norm_address, "Door No 184, Plot No 12", "184 12"),
        (X.norm_address, "", ""), (X.norm_name, None, ""), (X.norm_address, None, ""), (X.norm_address, "rue de la paix, hauts de seine", "r la paix"),
    ],
)
def test_goldens(spark, make, given_, expected):
    assert one(spark, make, given_) == expected


def test_core_names(spark):
    assert one(spark, X.core_name, "syndicat parents france sas", "france") == "syndicat parents"
    assert one(spark, X.core_name, "limited company", "") == "limited company"


def test_scripts(spark):
    assert X.transliterate_text("డిజిటల్ టెక్") == "dijitl tek"
    assert X.transliterate_text("Ольга Петрова, Юрий Щукин") == "olga petrova, yurii shchukin" and X.transliterate_text("Αθήνα ψαρι") == "athena psari"
    assert X.transliterate_text("née Straße ١٢") == "nee strasse 12"
    for t in ("Ольга Петрова, Юрий Щукин", "Αθήνα ψαρι", "née Straße ١٢", "డిజిటల్ టెక్", "नई दिल्ली", "a – b’s 中文 😀 \u0301"):
        assert one(spark, X.plain, t).split() == X.transliterate_text(t).split()
    r = spark.createDataFrame([("1", "డిజిటల్ టెక్", "12 Main Street", " India ")], "entity_id string, business_name string, business_address string, country string")
    got = X.prepare(r).first()
    assert (got["name_n"], got["name_nonlatin"], got["addr_n"], got["country_key"], got["nums"]) == ("dijitl tek", True, "12 main st", "india", ["12"])
    assert one(spark, X.drop_mixed_script, "new delhi दिल्ली") == "new delhi"
    assert one(spark, X.drop_mixed_script, "delhi दिल्ली") == "delhi दिल्ली"  # exactly half stays
    assert one(spark, X.has_other_script, "a – b") is True


def test_tokens(spark):
    t = lambda make, n, c, a: sorted(one(spark, lambda *x: make(*x), n, c, a))
    assert t(K.unigrams, "digital tech", "digital tech", "53 rd nehru nagar 090") == sorted(["digital", "tech", "digitaltech", "#53", "#90", "nehru", "nagar"])
    c = t(lambda n, c, a: K.combos(c, a), "", "cozy hair tech", "nehru nagar 53 4")
    assert {"cozy_hair", "nehru_nagar", "53_4", "tech#53"} <= set(c)
    assert t(lambda n, c, a: K.combos(c, a), "", "solo", "") == []  # one word has no neighbour
    assert t(lambda n, c, a: K.sounds(c, a), "", "42 white", "7") == ["~wt", "~wt#7"]
    assert t(lambda n, c, a: K.characters(c), "", "ab", "") == sorted([" ab", "ab ", " ab "])


def test_string_metrics():
    assert S.ratio("", "") == 100 and S.token_set("", "") == 0 and S.partial("", "abc") == 0
    assert S.token_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert S.token_sort("b a", "a b") == 100 and S.partial("test", "this is a test!") == 100
    assert S.ratio("this is a test", "this is a test!") == pytest.approx(96.55, abs=0.01)
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(st.text("abc ", max_size=20), st.text("abc ", max_size=20))
@settings(max_examples=200, deadline=None)
def test_metric_properties(a, b):
    assert S.common_subsequence(a, b) == plain_lcs(a, b)
    for f in (S.ratio, S.token_sort, S.token_set, S.partial):
        assert f(a, b) == pytest.approx(f(b, a)) and 0 <= f(a, b) <= 100
    assert 0 <= S.jaro_winkler(a, b) <= 1
    if a and b and len(a) < len(b):
        windows = [b[max(0, e - len(a)) : e] for e in range(1, len(b) + len(a))]
        assert S.partial(a, b) == pytest.approx(max(S.ratio(a, w) for w in windows))
