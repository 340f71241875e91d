from urllib.parse import quote

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from touchline.constants import AVATAR_ADDRESS
from touchline.functions import text


def _text(value):
    return F.lit(value).cast("string")


def test_fixture_text(value):
    assert value(text.fixture_text(F.lit("A"), F.lit(True), F.lit("B"))) == "A (H) vs B"
    assert value(text.fixture_text(F.lit("A"), F.lit(False), F.lit("B"))) == "A (A) vs B"


def test_full_name(value):
    assert value(text.full_name(F.lit("A"), F.lit("B"))) == "A B"
    assert value(text.full_name(F.lit("A"), _text(None))) is None


@pytest.mark.parametrize(
    ("points", "label"), [(8, "special"), (7.99, "gold"), (6, "gold"), (4, "silver"), (3.99, "bronze"), (None, "bronze")]
)
def test_tier(value, points, label):
    assert value(text.tier(F.lit(points).cast("double"))) == label


@pytest.mark.parametrize("code", [None, 0])
def test_no_code_no_address(value, code):
    column = F.lit(code).cast("long")
    for address in text.image_addresses(column).values():
        assert value(address) == ""
    sources = text.image_sources(_text(""), _text(None), _text(""), column, F.lit("avatar"))
    assert value(sources) == ["avatar"]


def test_addresses(value):
    code = F.lit(12).cast("long")
    built = [value(address) for address in text.image_addresses(code).values()]
    assert built[1] == "https://resources.premierleague.com/premierleague/photos/players/110x140/p12.png"
    assert value(text.image_address(code)) == built[1]
    assert value(text.image_address(F.lit(None).cast("long"))) is None
    assert value(text.image_sources(_text(None), _text(None), _text(""), code, F.lit("avatar"))) == [*built, "avatar"]
    assert value(text.image_sources(F.lit("a"), _text(""), F.lit("c"), code, F.lit("avatar"))) == ["a", "c", "avatar"]


def test_percent_encoding(value):
    assert value(text.percent_encoded(F.lit("A b!~*'()é"))) == "A%20b!~*'()%C3%A9"
    assert value(text.percent_encoded(F.lit("1+1=2&%"))) == "1%2B1%3D2%26%25"


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=["Cs", "Cc"]), max_size=20), min_size=20, max_size=60))
def test_percent_encoding_of_any_text(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    encoded = rows.select("t", text.percent_encoded(F.col("t")).alias("e")).collect()
    assert [r["e"] for r in encoded] == [quote(r["t"], safe="!~*'()-_.") for r in encoded]


def test_avatar(value):
    got = value(text.avatar_address(F.lit("A B"), F.lit("MID")))
    assert got == AVATAR_ADDRESS + "A%20B&backgroundColor=3182ce&textColor=ffffff&fontSize=40"
    assert "backgroundColor=718096" in value(text.avatar_address(F.lit("A"), _text(None)))


@pytest.mark.parametrize(
    ("name", "letters"), [("Ann Lee Cook", "AC"), ("ann", "AN"), ("a", "A"), ("", "?"), (None, "?")]
)
def test_initials(value, name, letters):
    assert value(text.initials(_text(name))) == letters


@pytest.mark.parametrize(
    ("literal", "source", "kind", "decimals", "shown"),
    [
        (None, "string", "text", None, "-"),
        ("", "string", "text", None, "-"),
        ("x", "string", "text", None, "x"),
        ("x", "string", "number", 1, "-"),
        ("2.345", "string", "number", 1, "2.3"),
        (2.345, "double", "number", 1, "2.3"),
        (12.0, "double", "number", None, "12"),
        (12.5, "double", "number", None, "12.5"),
        (float("nan"), "double", "number", 1, "-"),
        (None, "double", "number", 1, "-"),
        (7, "bigint", "number", None, "7"),
        (True, "boolean", "boolean", None, "H"),
        (False, "boolean", "boolean", None, "A"),
        (None, "boolean", "boolean", None, "-"),
    ],
)
def test_display_value(value, literal, source, kind, decimals, shown):
    assert value(text.display_value(F.lit(literal).cast(source), source, kind, decimals)) == shown


@pytest.mark.parametrize(("chance", "shown"), [(None, "Unknown%"), (0.0, "Unknown%"), (75.0, "75%")])
def test_availability(value, chance, shown):
    assert value(text.availability_percent(F.lit(chance).cast("double"))) == shown


def test_money_and_ratio(value):
    assert value(text.money(F.lit(9.5))) == "£9.5m"
    assert value(text.difficulty_out_of_five(F.lit(3))) == "3/5"
    assert value(text.venue_word(F.lit(True))) == "Home"
    assert value(text.venue_word(F.lit(None).cast("boolean"))) == "Away"
    assert value(text.venue_letter(F.lit(False))) == "A"


def test_plain_numbers_are_written_out(spark):
    shown = {
        12345678.5: "12345678.5", 0.0005: "0.0005", 5e-7: "5e-7", 1.5e-9: "1.5e-9", 1e-6: "0.000001", 1e21: "1e+21", 1e20: "100000000000000000000",
        -12345678.5: "-12345678.5", -0.00025: "-0.00025", 3.0: "3", -4.0: "-4", 0.0: "0", 1234567.891: "1234567.891", 2.5: "2.5", None: None,
    }
    df = spark.createDataFrame([(v,) for v in shown], "v double")
    assert {r["v"]: r["t"] for r in df.select("v", text.plain_number(F.col("v")).alias("t")).collect()} == shown
