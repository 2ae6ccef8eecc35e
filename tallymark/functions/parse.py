"""From a generated answer to a list of field maps."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.fixed import ANSWER_REPLACEMENTS, FAILED, INNER_LIST, OK
from tallymark.functions.records import normalized
from tallymark.functions.text import replace_text

RECORDS = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
_LENIENT = {"allowSingleQuotes": "true"}
# A look at one letter first, then the alternatives: most letters begin no string.
_QUOTED = r"""["'](?:(?<=")[^"\\]*+"|(?<=')[^'\\]*+')"""
_NOT_A_LIST = "not a list of records"
_MALFORMED = "malformed literal"

# Reading of Python literals on the JVM. Possessive loops, so that long texts need no deep stack.
_JSON_LIKE = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true", "allowUnquotedControlChars": "true"}
_STRING = r"""["'](?:(?<=")[^"\\]*+(?:\\.[^"\\]*+)*+"|(?<=')[^'\\]*+(?:\\.[^'\\]*+)*+')"""
# Numbers whose text is their print form: no signed or leading zero, no exponent, few enough digits, no trailing zero.
_NUMBER = r"(?:-?[1-9][0-9]{0,17}|0|-?(?:0(?!\.0000)|[1-9][0-9]{0,7})\.(?:0|[0-9]{0,5}[1-9]))"
_NAME = "(?:None|True|False)"
# Signs that stand for a string, a number, a constant and a flat record in the shape of a text; they never occur in its letters.
_S, _N, _C, _R = "\x01", "\x02", "\x03", "\x04"
_PAIR = f"{_S}:[{_S}{_N}{_C}]"
_RECORD_SHAPE = rf"\{{(?:{_PAIR}(?:,{_PAIR})*+,?)?\}}"
_RECORDS_SHAPE = rf"^\[(?:{_R}(?:,{_R})*+,?)?\]$"
_MIXED_SHAPE = rf"^\[(?:[{_R}{_S}{_N}](?:,[{_R}{_S}{_N}])*+,?)?\]$"
# The same with blanks, for texts whose strings are plain and stand alone as values.
_PLAIN_PAIR = rf"{_S}\s*+:\s*+{_S}\s*+"
_PLAIN_RECORD = rf"\{{\s*+(?:{_PLAIN_PAIR}(?:,\s*+{_PLAIN_PAIR})*+)?\}}\s*+"
_PLAIN_SHAPE = rf"^\s*+\[\s*+(?:{_PLAIN_RECORD}(?:,\s*+{_PLAIN_RECORD})*+)?\]\s*+$"
# What the shape cannot vouch for: other control characters, escapes that JSON reads otherwise or not at all.
_ODD_LETTERS = r"[\x00-\x08\x0a-\x1f]|\\(?![\\'\"nrtbfu])|\\u(?![0-9a-cA-Ce-fE-F][0-9a-fA-F]{3}|[dD][0-7][0-9a-fA-F]{2})"
# A name that is no constant, no string prefix and no call of an empty set makes any literal fail.
_BAD_NAME = rf"(?=[A-Za-z_])(?<![\w.{_S}])(?!(?:None|True|False|set)\b)[A-Za-z_]\w*+(?!{_S})"
_LITERAL = T.StructType([
    T.StructField("records", RECORDS),
    T.StructField("literals", T.ArrayType(T.MapType(T.StringType(), T.BooleanType()))),
    T.StructField("error", T.StringType()),
])
_LITERAL_ARROW = pa.struct([
    ("records", pa.list_(pa.map_(pa.string(), pa.string()))),
    ("literals", pa.list_(pa.map_(pa.string(), pa.bool_()))),
    ("error", pa.string()),
])


def cleaned_answer(answer: Column, null_words: str = "compat") -> Column:
    """Remove fences and line breaks, empty the nulls and close doubled brackets.

    ``compat`` empties the letters ``null`` wherever they stand, inside words too; ``fixed`` only as a value.
    """
    if null_words not in ("compat", "fixed"):
        raise ValueError(f"unknown null_words {null_words!r}")
    for search, by in ANSWER_REPLACEMENTS:
        if search == "null" and null_words == "fixed":
            answer = F.regexp_replace(answer, r":(\s*)null\b", f":$1{by}")
        else:
            answer = replace_text(answer, search, by)
    return answer


def first_list(text: Column) -> Column:
    """The first list without inner lists, else the whole text."""
    return F.coalesce(F.nullif(F.regexp_extract(text, INNER_LIST, 1), F.lit("")), text)


def _last_value_wins(record: Column) -> Column:
    keys = F.array_distinct(F.map_keys(record))

    def last(k: Column) -> Column:
        return F.element_at(F.filter(F.map_entries(record), lambda e: e["key"] == k), -1)["value"]

    return F.when(F.size(keys) < F.size(F.map_keys(record)), F.map_from_arrays(keys, F.transform(keys, last))) \
        .otherwise(record)


def json_objects(text: Column) -> Column:
    """A JSON list of nothing but objects as string maps; null for any other text. Repeated keys stay repeated."""
    return F.from_json(text, RECORDS, _LENIENT)


def json_records(text: Column) -> Column:
    """The objects of a JSON list as string maps, other elements left out; null when the text is no list."""
    items = F.from_json(text, T.ArrayType(T.StringType()), _LENIENT)
    maps = F.transform(items, lambda e: F.from_json(e, T.MapType(T.StringType(), T.StringType()), _LENIENT))
    return F.transform(F.filter(maps, lambda m: m.isNotNull()), _last_value_wins)


def _frame(text: Column) -> Column:
    """A text with signs in place of its strings, plain numbers and constants, and without blanks."""
    frame = F.regexp_replace(text, _STRING, _S)
    frame = F.regexp_replace(frame, rf"(?=[-0-9])(?<![\w.{_S}]){_NUMBER}(?![\w.{_S}])", _N)
    frame = F.regexp_replace(frame, rf"(?=[NTF])(?<![\w.{_S}]){_NAME}(?![\w.{_S}])", _C)
    return F.regexp_replace(frame, "[ \t]+", "")


def _as_json(text: Column, frame: Column) -> Column:
    """A literal of a known shape as JSON: numbers and constants of records become strings that begin with a sign, commas before a closing
    bracket go. Strings are matched as well, so nothing inside them is touched; the sign behind them is taken away again."""
    marked = F.regexp_replace(text, rf"((?:{_STRING})[ \t]*:[ \t]*)({_NUMBER}|{_NAME})(?![\w.])|({_STRING})", f'$1$3"{_S}$2"')
    values = F.contains(frame, F.lit(":" + _N)) | F.contains(frame, F.lit(":" + _C))
    text = F.when(values, replace_text(marked, f'"{_S}"', "")).otherwise(text)
    return F.when(frame.rlike(r",[\]}]"), F.regexp_replace(text, rf",(?=[ \t]*[\]}}])|({_STRING})", "$1")).otherwise(text)


def _of_shape(text: Column, shape: Column, json: Column) -> Column:
    """The records of a literal of a known shape, with signed values; null where Python has to read it."""
    items = F.from_json(F.when(~shape.rlike(_RECORDS_SHAPE), json), T.ArrayType(T.StringType()), _JSON_LIKE)
    # Only records begin with a brace, see below; numbers and strings would be exceptions to the parser.
    maps = F.transform(F.filter(items, lambda e: F.startswith(e, F.lit("{"))),
                       lambda e: F.from_json(e, T.MapType(T.StringType(), T.StringType()), _JSON_LIKE))
    # A string among the items is no record, even one that looks like it: such texts are left to Python.
    braces = lambda c: F.length(c) - F.length(replace_text(c, "{", ""))
    open_ = braces(text) == braces(F.regexp_replace(text, _STRING, ""))
    found = (
        F.when(shape.isin(_R, _S), F.from_json(F.lit("[]"), RECORDS))
        .when(shape.rlike(_RECORDS_SHAPE), F.from_json(json, RECORDS, _JSON_LIKE))
        .when(shape.rlike(_MIXED_SHAPE) & open_, F.filter(maps, lambda m: m.isNotNull()))
    )
    return F.transform(found, _last_value_wins)


def _signed(v: Column) -> Column:
    return F.startswith(v, F.lit(_S))


def _plain_values(records: Column) -> Column:
    """Signed values as they print; a None is an empty text."""
    return F.transform(records, lambda r: F.transform_values(r, lambda k, v: F.when(
        _signed(v), replace_text(F.substring(v, 2, 1 << 30), "None", "")).otherwise(v)))


def _value_flags(records: Column) -> Column:
    """Per record the keys of signed values, and whether they count as a value."""
    nothing = [_S + x for x in ("None", "False", "0", "0.0", "-0.0")]
    return F.transform(records, lambda r: F.transform_values(
        F.map_filter(r, lambda k, v: _signed(v)), lambda k, v: ~v.isin(nothing)))


def _utf8(text: str) -> str:
    """Half a surrogate pair, which an escape can make, is no character: it becomes a question mark."""
    return text.encode("utf-8", "replace").decode()


def _literal_row(text: str | None) -> dict | None:
    if text is None:
        return None
    try:
        found = [item for item in ast.literal_eval(text) if isinstance(item, dict)]
    except Exception as problem:  # any failure makes the row a failed one
        return {"records": None, "literals": None, "error": _utf8(str(problem))}
    found = [{_utf8(str(k)): _utf8(v) if isinstance(v, str) else v for k, v in item.items()} for item in found]
    as_text = [{k: "" if v is None else _utf8(str(v)) for k, v in item.items()} for item in found]
    return {
        "records": [list(item.items()) for item in as_text],
        "literals": [[(k, bool(v)) for k, v in item.items() if not isinstance(v, str)] for item in found],
        "error": None,
    }


def _literal_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", SyntaxWarning)  # odd escapes in answers are no news
        for batch in batches:  # most texts were read by the JVM and are null here
            asked = batch.is_valid().to_numpy(zero_copy_only=False)
            found = pa.array([_literal_row(text) for text in batch.drop_null().to_pylist()], type=_LITERAL_ARROW)
            yield found.take(pa.array(np.cumsum(asked) - 1, mask=~asked)) if asked.any() else pa.nulls(len(batch), _LITERAL_ARROW)


# Deterministic, so filters on other columns pass below it and prune the scan. A filter on a parsed column is evaluated
# below as well; store the parsed rows before filtering them by status if that matters.
_literal_records = F.arrow_udf(_literal_batches, _LITERAL)


def _plain_text(text: Column) -> Column:
    """The text where its shape is that of a list of flat records of plain quoted strings, else null: nothing else is given to the JSON parser, for
    which every other text is an exception."""
    return F.when(F.regexp_replace(text, _QUOTED, _S).rlike(_PLAIN_SHAPE), text)


def _needs_literal(records: Column) -> Column:
    """True unless JSON and literal reading of a plain text surely agree: it could be read, and no key is repeated."""
    repeated = F.exists(records, lambda r: F.size(F.array_distinct(F.map_keys(r))) < F.size(r))
    return records.isNull() | F.coalesce(repeated, F.lit(True))


def _read_exactly(staged: DataFrame) -> DataFrame:
    """Add to ``_text`` its ``_records`` (null: none can be read) and ``_flags``, whether it is sure that it ``_fails``, and whether
    it was left ``_unread`` by the JVM and what Python made of it (``_literal``)."""
    text, shape, read = F.col("_text"), F.col("_shape"), F.col("_read")
    staged = staged.select("*", json_objects(_plain_text(text)).alias("_json"))
    staged = staged.select("*", _needs_literal(F.col("_json")).alias("_hard"))
    known = F.col("_hard") & ~text.rlike(_ODD_LETTERS)
    staged = staged.select("*", F.when(known, _frame(text)).alias("_frame"))
    staged = staged.select("*", F.regexp_replace("_frame", _RECORD_SHAPE, _R).alias("_shape"))
    listed = shape.rlike(_RECORDS_SHAPE) | shape.rlike(_MIXED_SHAPE)
    staged = staged.select("*", F.when(listed, _as_json(text, F.col("_frame"))).alias("_rewritten"))
    triple = F.contains(text, F.lit("\'\'\'")) | F.contains(text, F.lit('"""')) | F.contains(text, F.lit("#"))
    staged = staged.select(
        "*", _of_shape(F.when(shape.isNotNull(), text), shape, F.col("_rewritten")).alias("_read"),
        F.coalesce(shape.isin("", _N, _C) | (shape.rlike(_BAD_NAME) & ~triple), F.lit(False)).alias("_fails"))
    unread = F.col("_hard") & read.isNull() & ~F.col("_fails")
    signed = F.coalesce(F.contains("_rewritten", F.lit(_S)), F.lit(False)) & read.isNotNull()
    # One row in, one row out: filters on other columns pass below this step, filters on what was read stop here. Without it the optimizer
    # would write the whole reading out once more for each column it is made of.
    row = F.struct(
        unread.alias("_unread"), F.col("_fails"), F.when(unread, text).alias("_asked"), F.when(signed, _value_flags(read)).alias("_own_flags"),
        F.when(unread | F.col("_fails"), F.lit(None)).when(F.col("_hard"), F.when(signed, _plain_values(read)).otherwise(read))
        .otherwise(F.col("_json")).alias("_own"))
    inner = ("_text", "_json", "_hard", "_frame", "_shape", "_rewritten", "_read", "_fails")
    keep = [c for c in staged.columns if c not in inner]
    staged = staged.select(*keep, F.explode(F.array(row)).alias("_row")).select(*keep, "_row.*")
    staged = staged.select("*", _literal_records(F.col("_asked")).alias("_literal"))
    return staged.select(
        "*", F.when(F.col("_unread"), F.col("_literal.records")).otherwise(F.col("_own")).alias("_records"),
        F.when(F.col("_unread"), F.col("_literal.literals")).otherwise(F.col("_own_flags")).alias("_flags"))


def with_parsed_answer(
    df: DataFrame, answer: str = "pred_output_as_string", mode: str = "exact", null_words: str = "compat",
) -> DataFrame:
    """Add ``y_pred``, ``conversion_status`` and ``error_message``.

    ``exact`` reads the answer as a Python literal. Three readers share the work and give the same records: answers made of plain
    quoted strings go to the JVM's JSON parser as they are. Of the others the JVM takes the shape, that is the text with signs for its strings,
    numbers and constants. Flat records of a valid shape are rewritten as JSON and parsed; a name outside strings, a lone number or
    nothing at all is sure to fail. Only what is left goes to Python: nested values, unusual numbers and escapes, joined or
    prefixed strings, comments. ``native`` uses the JSON parser for all: there ``true`` parses, numbers lose their point, and a
    trailing comma, ``None``, a bare object or a bare string fail.
    """
    if mode not in ("exact", "native"):
        raise ValueError(f"unknown mode {mode!r}")
    staged = df.select("*", first_list(cleaned_answer(F.col(answer), null_words)).alias("_text"))
    if mode == "native":
        staged = staged.select("*", json_records(F.col("_text")).alias("_records"))
        normal = normalized(F.col("_records"))
        error = F.when(F.col("_records").isNull(), F.lit(_NOT_A_LIST)).otherwise(F.lit(""))
    else:
        staged = _read_exactly(staged)
        normal = F.when(F.col("_flags").isNull(), normalized(F.col("_records"))) \
            .otherwise(normalized(F.col("_records"), F.col("_flags")))
        error = F.when(F.col(answer).isNull(), F.lit(_NOT_A_LIST)) \
            .when(F.col("_unread"), F.coalesce(F.col("_literal.error"), F.lit(""))) \
            .when(F.col("_fails"), F.lit(_MALFORMED)).otherwise(F.lit(""))
    return staged.select(
        *df.columns, normal.alias("y_pred"),
        F.when(F.col("_records").isNull(), F.lit(FAILED)).otherwise(F.lit(OK)).alias("conversion_status"),
        error.alias("error_message"),
    )
