"""Cleaning and comparing of short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.fixed import FALSE_WORDS, INSTRUCTION_END, TRUE_WORDS, WORD_BREAKS

# Unicode white space plus the four information separators.
_SPACE = r"[\s\x1c-\x1f]+"


def replace_text(c: Column, search: str, by: str) -> Column:
    """Replace every occurrence of a literal."""
    return F.replace(c, F.lit(search), F.lit(by))


def clean_label(label: Column) -> Column:
    """Delete the question marks annotators put behind an unsure label."""
    return replace_text(label, "?", "")


def text_length(c: Column) -> Column:
    """Length in characters."""
    return F.length(c)


def stripped(c: Column) -> Column:
    """Without white space at both ends, line breaks and tabs included."""
    return F.regexp_replace(c, f"(?U)^{_SPACE}|{_SPACE}$", "")


def lower_stripped(c: Column) -> Column:
    return stripped(F.lower(c))


def render_prompt(template: Column, text: Column) -> Column:
    """The instruction sent to the generator: template, text (a null one is empty), end marker."""
    return F.concat(template, F.coalesce(text, F.lit("")), F.lit(" " + INSTRUCTION_END))


def digits_only(c: Column) -> Column:
    """Keep decimal digits of any script."""
    return F.regexp_replace(c, r"[^\p{Nd}]+", "")


def join_broken_words(c: Column) -> Column:
    """Close up words split by a hyphen at a line end or line start."""
    for mark in WORD_BREAKS:
        c = replace_text(c, mark, "")
    return c


def parse_flag(c: Column) -> Column:
    """Boolean of a spelled flag; any other word ends the job, null stays null."""
    word = F.lower(c)
    return (
        F.when(word.isNull(), F.lit(None).cast("boolean"))
        .when(word.isin(*TRUE_WORDS), F.lit(True))
        .when(word.isin(*FALSE_WORDS), F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("Boolean value expected: "), c)).cast("boolean"))
    )


def as_percent(score: Column) -> Column:
    """A ratio as percent with two decimals."""
    return F.round(score * 100, 2)


def display_name(c: Column, names: dict[str, str]) -> Column:
    """Look a name up in a fixed table; unknown names give null."""
    return F.create_map(*[F.lit(part) for pair in names.items() for part in pair])[c]


# Letters of German texts, whose escapes are spelled out; other letters are escaped unit by unit.
_LETTERS = {c: f"\\u{ord(c):04x}" for c in "äöüÄÖÜß"}


def needs_escapes(c: Column) -> Column:
    """Whether a JSON text in plain ASCII has to escape anything: quotes, backslashes, and all but printed ASCII."""
    return F.contains(c, F.lit('"')) | F.contains(c, F.lit("\\")) | c.rlike("[^ -~]")


def python_json_string(c: Column) -> Column:
    """A JSON string literal in plain ASCII: short escapes first, then \\uXXXX per UTF-16 unit. A text without anything to escape stays as it is."""
    escapes = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f", **_LETTERS}

    def unit(u: Column) -> Column:
        code = F.conv(u, 16, 10).cast("int")
        return F.when(code.between(32, 126), F.char(code)).otherwise(F.concat(F.lit("\\u"), F.lower(u)))

    def by_units(text: Column) -> Column:
        units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
        return F.when(text.rlike("[^ -~]"), F.array_join(F.transform(units, unit), "")).otherwise(text)

    short = c
    for raw, escape in escapes.items():
        short = replace_text(short, raw, escape)
    # An array of one, so that the short escapes are made once.
    escaped = F.get(F.transform(F.array(short), by_units), F.lit(0))
    return F.concat(F.lit('"'), F.when(needs_escapes(c), escaped).otherwise(c), F.lit('"'))
