"""Text helpers as native columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tollgate.functions.patterns import Patterns

# Characters that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        "
    "        　"
)
_SPACE_CLASS = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_LINE_END = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"
#: Longer lists of words are looked for by an automaton.
NATIVE_WORDS = 64
# Units of duration texts such as "5m".
UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return strip(col) == ""


def first_line(col: Column) -> Column:
    return F.substring_index(strip(col), "\n", 1)


def cut(col: Column, size: int, tail: str = "...") -> Column:
    """``col`` as it is, or its first ``size`` characters and ``tail``."""
    return F.when(F.length(col) > size, F.concat(F.substring(col, 1, size), F.lit(tail))).otherwise(col)


def split_lines(col: Column) -> Column:
    """Lines at any line boundary; no empty last line."""
    body = F.regexp_replace(col, f"(?:{_LINE_END})\\z", "")
    return F.when(col == "", F.array().cast("array<string>")).otherwise(F.split(body, _LINE_END))


def truncate_lines(col: Column, limit: int) -> Column:
    """First ``limit`` lines, with a note when lines were left out."""
    lines = split_lines(col)
    note = F.concat(F.lit("\n... (truncated - "), F.size(lines).cast("string"), F.lit(" total lines)"))
    return F.concat(
        F.array_join(F.slice(lines, 1, limit), "\n"),
        F.when(F.size(lines) > limit, note).otherwise(F.lit("")),
    )


def words(col: Column) -> Column:
    """Words between runs of white space; empty array for blank text."""
    return F.when(is_blank(col), F.array().cast("array<string>")).otherwise(
        F.split(strip(col), f"{_SPACE_CLASS}+")
    )


def word_count(col: Column) -> Column:
    return F.size(words(col))


def has_letters(col: Column) -> Column:
    return col.rlike("\\p{L}")


def duration_seconds(col: Column) -> Column:
    """Seconds of texts such as ``30s``, ``5m``, ``1h``, ``2d``; null for other texts."""
    number = F.regexp_extract(col, "^\\s*(\\d+)\\s*([smhd])\\s*$", 1)
    unit = F.regexp_extract(col, "^\\s*(\\d+)\\s*([smhd])\\s*$", 2)
    factor = (
        F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    )
    return F.when(number != "", number.cast("long") * factor)


def duration_interval(text: str) -> str:
    """``5m`` as the text Spark's ``window`` takes: ``5 minutes``."""
    value, unit = text.strip()[:-1].strip(), text.strip()[-1:]
    if not value.isdigit() or unit not in UNITS:
        raise ValueError(f"not a duration: {text!r}")
    return f"{int(value)} {UNITS[unit]}"


def after_marker(col: Column, marker: str) -> Column:
    """Stripped text behind the first ``marker``; null when it does not occur."""
    pos = F.instr(col, marker)
    return F.when(pos > 0, strip(F.substr(col, pos + F.lit(len(marker)))))


def strip_caption_echo(raw: Column, prompt: Column) -> Column:
    """Caption text without the answer marker or else without the echoed prompt."""
    at = F.position(prompt, raw)
    without_prompt = F.concat(
        F.substr(raw, F.lit(1), at - 1), F.substr(raw, at + F.length(prompt))
    )
    return F.coalesce(
        after_marker(raw, "ASSISTANT:"),
        F.when((at > 0) & (F.length(prompt) > 0), strip(without_prompt)),
        strip(raw),
    )


def strip_explanation_echo(raw: Column) -> Column:
    """Explanation text behind its marker; a fixed text when nothing is left."""
    text = F.coalesce(after_marker(raw, "Explanation:"), after_marker(raw, "ASSISTANT:"), strip(raw))
    return F.when(text == "", F.lit("Failed to generate a clear explanation for the violation.")).otherwise(text)


def strip_description_echo(raw: Column, prompt: Column) -> Column:
    """Image description behind the echoed prompt and without a leading marker."""
    at = F.position(prompt, raw)
    text = F.when(
        (at > 0) & (F.length(prompt) > 0), strip(F.substr(raw, at + F.length(prompt)))
    ).otherwise(raw)
    return strip(F.when(text.startswith("ASSISTANT: "), F.substr(text, F.lit(12))).otherwise(text))


def round_two(col: Column) -> Column:
    """Two decimals by the exact value of the double, ties to even, as Python rounds.

    A value that reads as ``d.dd5`` lies just above or below that tie. Its exact
    thousandfold (the product and what the product lost) tells which.
    """
    product = col * 1000.0
    scaled = col * 134217729.0
    upper = scaled - (scaled - col)
    lost = (upper * 1000.0 - product) + (col - upper) * 1000.0
    hundredths = F.floor(product / 10.0)
    beyond = (product - (hundredths * 10.0 + 5.0)) + lost
    up = (beyond > 0) | ((beyond == 0) & (hundredths % 2 != 0))
    exact = (hundredths + F.when(up, 1).otherwise(0)) / 100.0
    return F.when(F.abs(col) < 1e12, exact).otherwise(F.bround(col, 2))


def two_decimals(col: Column) -> Column:
    """``%.2f`` as Python prints it."""
    return F.format_string("%.2f", round_two(col))


def no_text() -> Column:
    return F.array().cast("array<string>")


def messages_if(condition: Column, message: Column) -> Column:
    """A one-message array where ``condition`` holds, else an empty array."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(message)).otherwise(no_text())


def words_found(low: Column, listed: list[str]) -> Column:
    """The words of a fixed list that occur in a lower-cased text, in list order.

    Short lists become one native expression. Its code and time grow with the list, so longer
    ones go out in one broadcast and are looked for all at once (:mod:`tollgate.functions.patterns`).
    """
    if not listed:
        return no_text()
    if len(listed) <= NATIVE_WORDS:
        return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w.lower())), F.lit(w)) for w in listed]))
    shared = SparkSession.active().sparkContext.broadcast(tuple(listed))

    @pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = shared.value
        search = Patterns([w.lower() for w in words])
        for texts in batches:
            found = search.in_texts([None if t is None else t for t in texts])
            yield pd.Series([[words[n] for n in own] for own in found], dtype=object)

    return run(low)
