"""Text helpers shared by the sources."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = " \t\n\r\f\u000b\u00a0"
_NOT_TEXT = r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def trimmed(text: Column) -> Column:
    """Without blanks at the ends, where line breaks and hard spaces count as blanks."""
    return F.btrim(text, F.lit(_BLANKS))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern``, or null."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def comma_list(items: Column) -> Column:
    return F.array_join(items, ", ")


def semicolons_to_commas(text: Column) -> Column:
    return F.replace(text, F.lit("; "), F.lit(", "))


def strip_inline(text: Column) -> Column:
    """Drop inline markup from XML text.

    The tags are named: the reader has decoded entities by now, so a pattern
    for any tag would also eat text such as ``p <0.05 and n>3``.
    """
    return F.regexp_replace(
        text, r"</?(?:i|b|u|sub|sup|em|strong|mml:[a-z]+)(?:\s[^>]*)?/?>", ""
    )


def title_case(text: Column) -> Column:
    """Capital after every character that is not a letter: ``Aim/Objective``."""
    words = F.split(F.lower(text), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(words, F.initcap), "")


def _code_point(number: Column) -> Column:
    """The character of a code point, null where there is none."""
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    bytes_ = F.unhex(F.lpad(F.hex(F.when(valid, number)), 8, "0"))
    return F.decode(bytes_, "UTF-32")


def _names(table: dict[str, str]) -> Column:
    return F.str_to_map(F.lit(" ".join(f"{name}={text}" for name, text in table.items())), F.lit(" "), F.lit("="))


def decode_entities(html: Column) -> Column:
    """Decode entities, each once: the names of HTML 5 with their semicolon, decimal and hexadecimal numbers."""
    common = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}
    rare = {name[:-1]: text for name, text in html5.items() if name.endswith(";") and name[:-1] not in common}

    def piece(part: Column, index: Column) -> Column:
        body = F.regexp_extract(part, r"^(#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        hexa = body.rlike("^#[xX]")
        number = F.when(
            hexa, F.conv(F.regexp_replace(body, "^#[xX]0*(?=.)", ""), 16, 10)
        ).when(body.startswith("#"), F.regexp_replace(body, "^#0*(?=.)", "")).try_cast("bigint")
        char = F.when(body.startswith("#"), _code_point(number)).otherwise(
            # A map is searched from its start, so the names of HTML 4 have one of their own.
            F.coalesce(F.try_element_at(_names(common), body), F.try_element_at(_names(rare), body))
        )
        decoded = F.when(char.isNull(), F.concat(F.lit("&"), part)).otherwise(
            F.concat(char, F.substr(part, F.length(body) + 2))
        )
        return F.when(index == 0, part).otherwise(decoded)

    pieces = F.array_join(F.transform(F.split(html, "&"), piece), "")
    return F.when(html.contains("&"), pieces).otherwise(html)


def markup_text(html: Column, joiner: str = " ") -> Column:
    """The text pieces of an HTML fragment, trimmed, blanks dropped, joined by ``joiner``."""
    def pieces(source: Column) -> Column:
        parts = F.split(F.regexp_replace(source, _NOT_TEXT, ""), r"<[^>]+>")
        return F.when(source.contains("<"), parts).when(source.isNotNull(), F.array(source))

    cleaned = F.transform(let(html, pieces), lambda p: trimmed(decode_entities(p)))
    return F.array_join(F.filter(cleaned, lambda p: p != ""), joiner)


def thousands_to_int(text: Column) -> Column:
    """``"12,345"`` to 12345; null where that is not a number."""
    return trimmed(F.replace(text, F.lit(","), F.lit(""))).try_cast("bigint")


def year_number(text: Column) -> Column:
    """``"2014"`` or ``"2014.0"`` to 2014; null where that is not a year."""
    return F.regexp_replace(trimmed(text.cast("string")), r"\.0+$", "").try_cast("int")


def in_natural_order(path: Column) -> Column:
    """A text that sorts numbers within paths by their value: ``batch_2`` before ``batch_10``."""
    padded = F.regexp_replace(path, r"([0-9]+)", "0" * 20 + "$1")
    return F.regexp_replace(padded, r"0*([0-9]{20})(?![0-9])", "$1")


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HHmmss")
