"""Text, number and JSON helpers as native column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.isspace accepts; all of them lie below U+3001.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
# Accepted spellings of true and false in condition files.
TRUE_WORDS = ("true", "1", "yes", "y", "はい", "有効", "対象", "含める")
FALSE_WORDS = ("false", "0", "no", "n", "いいえ", "無効", "対象外", "含めない")


def lookup(key: Column, table: Mapping[str, object]) -> Column:
    """Value of a small fixed table, NULL for an unknown key."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to an expression that refers to it several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def py_strip(text: Column) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(py_strip(text), F.lit(""))


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters that NFKC makes a sign, digit or letter of the accepted spellings, what they become, and numbers in one
    character of several digits; other scripts' digits count as digits."""
    wanted = set("+-_").union(*TRUE_WORDS, *FALSE_WORDS)
    wanted |= {letter.upper() for letter in wanted}
    single, numbers = {}, {}
    for char in map(chr, range(0x80, 0x30000)):
        plain = unicodedata.normalize("NFKC", char)
        if plain.isdecimal():
            plain = "".join(str(unicodedata.decimal(digit)) for digit in plain)
            (single if len(plain) == 1 else numbers)[char] = plain
        elif plain != char and plain in wanted:
            single[char] = plain
    return "".join(single), "".join(single.values()), numbers


def folded_word(text: Column) -> Column:
    """Fold the text of a number or switch as NFKC does."""
    source, target, numbers = _folds()
    folded = F.translate(text, source, target)
    for char, plain in numbers.items():
        folded = F.replace(folded, F.lit(char), F.lit(plain))
    return folded


def positive_int(text: Column) -> Column:
    """Integer of one or more, NULL otherwise; full-width digits are accepted."""
    value = py_strip(folded_word(text))
    number = F.when(value.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(value, F.lit("_"), F.lit("")))
    number = number.try_cast("bigint")
    return F.when(number >= 1, number)


def jp_boolean(text: Column) -> Column:
    """True, false, or NULL for an unknown spelling."""
    value = F.lower(py_strip(folded_word(text)))
    return F.when(value.isin(*TRUE_WORDS), F.lit(True)).when(
        value.isin(*FALSE_WORDS), F.lit(False)
    )


def keyword_list(text: Column) -> Column:
    """Split on ideographic commas, commas and bars; drop blanks."""
    pieces = F.split(F.translate(F.coalesce(text, F.lit("")), "、,", "||"), r"\|")
    return F.filter(F.transform(pieces, py_strip), lambda piece: piece != "")


def entity_text_key(text: Column) -> Column:
    """Comparison key of a name or an address: no white space, lower case."""
    return F.lower(F.translate(text, WHITESPACE, ""))


def search_history(prefecture: Column, municipality: Column, word: Column, query: Column) -> Column:
    blank = F.lit("")
    return F.concat(
        F.coalesce(prefecture, blank), F.lit("/"), F.coalesce(municipality, blank), F.lit("/"),
        F.coalesce(word, blank), F.lit(" ["), F.coalesce(query, blank), F.lit("]"),
    )


def json_list(text: Column) -> Column:
    """JSON array -> strings; scalar or object -> one string; malformed -> the raw text; empty -> []."""
    empty = F.array().cast("array<string>")
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    scalar = F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))
    items = F.expr("NULL").cast("array<string>")
    items = F.when(kind.startswith("ARRAY"), F.from_json(text, "array<string>")).otherwise(items)
    return (
        F.when(text.isNull() | (text == ""), empty)
        .when(value.isNull(), F.array(text))
        .when(kind.startswith("ARRAY"), items)
        .otherwise(F.array(scalar))
    )


def bounded_score(value: Column) -> Column:
    """Round half to even and clamp to 0..100."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.bround(value, 0).cast("int")))


def ordered_distinct(*arrays: Column) -> Column:
    """Concatenate and keep the first occurrence of each item."""
    return F.array_distinct(F.concat(*arrays))


def csv_cell(value: Column, kind: str) -> Column:
    """Display text of one cell; text that a spreadsheet would run as a formula is quoted."""
    if kind == "boolean":
        return F.when(value, "はい").when(~value, "いいえ").otherwise("")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(value.cast("string"), F.lit(""))
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def count_literal(text: Column, word: str) -> Column:
    """Number of non-overlapping occurrences of a fixed word; 0 for NULL."""
    lost = F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))
    return F.when(F.contains(text, F.lit(word)), (lost / F.lit(len(word))).cast("int")).otherwise(0)


def contains_any(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    """True when any of a fixed list of words occurs."""
    result = F.lit(False)
    for word in words:
        result = result | F.contains(text, F.lit(word))
    return result


def mentions(text: Column, words: tuple[str, ...], pattern: str | None = None) -> Column:
    """True when any word occurs or the pattern matches; the words are searched first."""
    found = contains_any(text, words)
    return found if pattern is None else found | text.rlike(pattern)


def iso_duration(start: Column, finish: Column) -> Column:
    """Elapsed 'H:MM:SS' (with days and microseconds when present), '' when either end is unusable."""
    begin = F.try_to_timestamp(start)
    end = F.try_to_timestamp(finish)
    micros = F.unix_micros(end) - F.unix_micros(begin)
    days = F.floor(micros / F.lit(86_400_000_000))
    rest = micros - days * F.lit(86_400_000_000)
    clock = F.format_string(
        "%d:%02d:%02d",
        F.floor(rest / F.lit(3_600_000_000)),
        F.floor(rest / F.lit(60_000_000)) % 60,
        F.floor(rest / F.lit(1_000_000)) % 60,
    )
    fraction = rest % F.lit(1_000_000)
    clock = F.when(fraction == 0, clock).otherwise(
        F.concat(clock, F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))
    )
    plural = F.when(F.abs(days) == 1, " day, ").otherwise(" days, ")
    text = F.when(days == 0, clock).otherwise(F.concat(days.cast("string"), plural, clock))
    return F.coalesce(text, F.lit(""))
