"""Text, address and display expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.constants import (
    AVATAR_ADDRESS,
    DEFAULT_COLOURS,
    LOWEST_TIER,
    POSITION_COLOURS,
    PRIMARY_IMAGE,
    SECONDARY_IMAGE,
    TERTIARY_IMAGE,
    TIERS,
)
from touchline.functions.numbers import read_number

BLANK = "-"


def present(text: Column) -> Column:
    """True for a text that is neither missing nor empty."""
    return text.isNotNull() & (text != "")


def full_name(first: Column, last: Column) -> Column:
    """Missing when either part is; ``concat_ws`` would skip the missing part."""
    return F.concat(first, F.lit(" "), last)


def fixture_text(team: Column, is_home: Column, opponent: Column) -> Column:
    return F.concat(team, F.when(is_home, " (H) vs ").otherwise(" (A) vs "), opponent)


def venue_letter(is_home: Column) -> Column:
    return F.when(is_home, "H").otherwise("A")


def venue_word(is_home: Column) -> Column:
    return F.when(is_home, "Home").otherwise("Away")


def tier(points: Column) -> Column:
    (floor, label), *rest = TIERS
    chain = F.when(points >= floor, label)
    for floor, label in rest:
        chain = chain.when(points >= floor, label)
    return chain.otherwise(LOWEST_TIER)


def position_colours(position: Column) -> Column:
    def pair(colours):
        return F.struct(F.lit(colours[0]).alias("bg"), F.lit(colours[1]).alias("text"))

    chain = None
    for label, colours in POSITION_COLOURS.items():
        chain = F.when(position == label, pair(colours)) if chain is None else chain.when(position == label, pair(colours))
    return chain.otherwise(pair(DEFAULT_COLOURS))


def _address(parts: tuple[str, str], code: Column) -> Column:
    return F.concat(F.lit(parts[0]), code.cast("string"), F.lit(parts[1]))


def _has_code(code: Column) -> Column:
    return F.coalesce(code, F.lit(0)) != 0


def image_addresses(code: Column) -> dict[str, Column]:
    """Three addresses built from the code; empty without a code."""
    parts = {
        "image_url_primary": PRIMARY_IMAGE,
        "image_url_secondary": SECONDARY_IMAGE,
        "image_url_tertiary": TERTIARY_IMAGE,
    }
    return {name: F.when(_has_code(code), _address(part, code)).otherwise("") for name, part in parts.items()}


def image_address(code: Column) -> Column:
    """The single address of a looked-up code, missing without one."""
    return _address(SECONDARY_IMAGE, code)


def percent_encoded(text: Column) -> Column:
    """Percent encoding that leaves ``! ~ * ' ( )`` alone and writes a space as ``%20``."""
    encoded = F.url_encode(text)
    for written, wanted in (("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        encoded = F.replace(encoded, F.lit(written), F.lit(wanted))
    return encoded


def avatar_address(name: Column, position: Column) -> Column:
    colours = position_colours(position)
    return F.concat(
        F.lit(AVATAR_ADDRESS),
        percent_encoded(F.coalesce(name, F.lit("null"))),
        F.lit("&backgroundColor="),
        colours["bg"],
        F.lit("&textColor="),
        colours["text"],
        F.lit("&fontSize=40"),
    )


def initials(name: Column) -> Column:
    words = F.split(F.coalesce(name, F.lit("")), " ")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    single = F.when(first == "", "?").otherwise(F.left(first, F.lit(2)))
    both = F.concat(F.left(first, F.lit(1)), F.left(last, F.lit(1)))
    return F.upper(F.when(F.size(words) > 1, both).otherwise(single))


def image_sources(primary: Column, secondary: Column, tertiary: Column, code: Column, avatar: Column) -> Column:
    """Addresses to try in order: the stored ones, else those generated from the code, and always the avatar."""
    stored = F.filter(F.array(primary, secondary, tertiary), present)
    generated = F.array(*image_addresses(code).values())
    shown = F.when((F.size(stored) == 0) & _has_code(code), generated).otherwise(stored)
    return F.concat(shown, F.array(avatar))


def fixed_decimals(number: Column, decimals: int) -> Column:
    return F.when(number.isNotNull() & ~F.isnan(number), F.format_string(f"%.{decimals}f", number))


def plain_number(number: Column) -> Column:
    """Whole numbers without a fraction part, others in shortest form; an exponent only from 1e21 on and below 1e-6."""
    size = F.abs(number)
    exponent = F.regexp_replace(F.lower(number.cast("string")), r"(\.0)?e(?=\d)", "e+")
    scientific = F.regexp_replace(exponent, r"\.0e", "e")
    fraction = F.regexp_replace(number.try_cast("decimal(38,22)").cast("string"), "0+$", "")
    shown = F.when((size >= 1e21) | ((size < 1e-6) & (size > 0)), scientific)
    shown = shown.when(number == F.rint(number), number.try_cast("decimal(38,0)").cast("string"))
    return F.when(F.isnan(number) | (size == float("inf")), number.cast("string")).otherwise(shown.otherwise(fraction))


def display_value(value: Column, source_type: str, kind: str, decimals: int | None) -> Column:
    """Cell text of a column of the catalogue; ``source_type`` is the Spark type name of the value."""
    if kind == "boolean":
        shown = venue_letter(value.cast("boolean"))
        return F.when(value.isNull(), BLANK).otherwise(shown)
    if kind == "number":
        number = read_number(value) if source_type == "string" else value.cast("double")
        shown = plain_number(number) if decimals is None else fixed_decimals(number, decimals)
        return F.when(F.isnan(number), BLANK).otherwise(F.coalesce(shown, F.lit(BLANK)))
    text = value.cast("string")
    return F.when(present(text), text).otherwise(BLANK)


def money(amount: Column) -> Column:
    return F.concat(F.lit("£"), fixed_decimals(amount, 1), F.lit("m"))


def difficulty_out_of_five(difficulty: Column) -> Column:
    return F.concat(plain_number(difficulty.cast("double")), F.lit("/5"))


def availability_percent(chance: Column) -> Column:
    known = F.when(chance != 0, plain_number(chance.cast("double")))
    return F.concat(F.coalesce(known, F.lit("Unknown")), F.lit("%"))
