"""Records are string maps: a missing key and an empty value are different things."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.fixed import DIGIT_FIELDS, FIELDS, FIELD_TITLES, MATCH_FIELDS
from tallymark.functions.text import digits_only, join_broken_words, needs_escapes, python_json_string, replace_text


# Lists of at most so many items are spelled out item by item.
SHORT = 4


def each(items: Column, function: Callable[[Column], Column], short: int = SHORT) -> Column:
    """``transform`` of a plain column. Spark compiles the items of a short list, while it interprets a lambda function node by node; longer
    lists still take the lambda. It pays for short functions: long ones grow the compiled code beyond what it saves."""
    n = F.size(items)
    made = F.slice(F.array(*[function(F.get(items, F.lit(i))) for i in range(short)]), F.lit(1), n)
    return F.when(n.between(0, short), made).otherwise(F.transform(items, function))


def _clean_value(key: Column, value: Column) -> Column:
    return (
        F.when(key.isin(*DIGIT_FIELDS), digits_only(value))
        .when(key.isin(*FIELDS), join_broken_words(value))
        .otherwise(value)
    )


def normalized(records: Column, literals: Column | None = None) -> Column:
    """Reduce number fields to digits, close broken words, and leave out records that then hold no value.

    ``literals`` maps per record the keys whose value was a number or another non-text literal to whether it counts as a
    value; those keep their print form.
    """
    if literals is None:
        cleaned = F.transform(
            records,
            lambda r: F.transform_values(r, lambda k, v: F.coalesce(_clean_value(k, v), F.lit(""))),
        )
        return F.filter(cleaned, lambda r: F.array_max(F.map_values(r)) != "")

    def keys_at(position: Column) -> Column:
        return F.coalesce(F.get(literals, position), F.create_map().cast("map<string,boolean>"))

    def clean(record: Column, position: Column) -> Column:
        return F.transform_values(
            record, lambda k, v: F.when(F.map_contains_key(keys_at(position), k), v).otherwise(_clean_value(k, v))
        )

    def filled(record: Column, position: Column) -> Column:
        return F.exists(
            F.map_entries(record),
            lambda e: F.coalesce(keys_at(position)[e["key"]], e["value"] != ""),
        )

    return F.filter(F.transform(records, clean), filled)


def field_view(records: Column, field: str) -> Column:
    """Each record reduced to one field, a missing one as an empty text; a null list stays null."""
    return F.transform(records, lambda r: F.create_map(F.lit(field), F.coalesce(r[field], F.lit(""))))


def _if_present(before: str, value: Column, after: str) -> Column:
    """The value between two texts; nothing for a missing value, since ``concat`` with a null is null."""
    return F.coalesce(F.concat(F.lit(before), value, F.lit(after)), F.lit(""))


def record_text(record: Column) -> Column:
    """A record as sentences, present fields only, in field order."""
    return F.concat(*[_if_present(f"{FIELD_TITLES[f]} ist ", record[f], ". ") for f in FIELDS])


def records_text(records: Column) -> Column:
    """All records as sorted sentences; an empty list gives an empty text."""
    return F.array_join(F.sort_array(F.transform(records, record_text)), " ")


def view_values(records: Column, field: str) -> Column:
    """One field of every record, a missing one as an empty text; a null list stays null."""
    return each(records, lambda r: F.coalesce(r[field], F.lit("")))


def view_records(values: Column, field: str) -> Column:
    """The records of ``field_view`` from its values."""
    return each(values, lambda v: F.create_map(F.lit(field), v))


def view_text(values: Column, field: str) -> Column:
    """The text of the records of ``field_view`` from its values."""
    sentence = lambda v: F.concat(F.lit(f"{FIELD_TITLES[field]} ist "), v, F.lit(". "))
    return F.array_join(F.sort_array(each(values, sentence)), " ")


def record_json(record: Column) -> Column:
    """A record as a JSON object with sorted keys, blanks after separators and ASCII escapes."""
    entries = F.sort_array(F.map_entries(record))
    escaped = F.transform(entries, lambda e: F.concat(python_json_string(e["key"]), F.lit(": "), python_json_string(e["value"])))
    plain = F.transform(entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('": "'), e["value"], F.lit('"')))
    # One look at the whole record, whose letters are joined once; most have nothing to escape.
    letters = F.concat(F.array_join(F.map_keys(record), ""), F.array_join(F.map_values(record), ""))
    pairs = F.when(F.exists(F.array(letters), needs_escapes), escaped).otherwise(plain)
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def records_json(records: Column) -> Column:
    """All records as a JSON list of JSON texts, each of them quoted once more."""

    def quoted(text: Column) -> Column:
        return F.concat(F.lit('"'), replace_text(replace_text(text, "\\", "\\\\"), '"', '\\"'), F.lit('"'))

    texts = F.sort_array(F.transform(records, lambda r: quoted(record_json(r))))
    return F.concat(F.lit("["), F.array_join(F.transform(texts, quoted), ", "), F.lit("]"))


def match_key(record: Column, fields: tuple[str, ...] = MATCH_FIELDS) -> Column:
    """One text per record that is equal exactly when the present fields are."""
    return F.concat(*[_if_present(f"{f}-", record[f], "__") for f in fields])


def match_keys(records: Column, fields: tuple[str, ...] = MATCH_FIELDS) -> Column:
    return F.transform(records, lambda r: match_key(r, fields))


def field_values(records: Column, field: str) -> Column:
    """The values of one field over the records that have it."""
    return F.filter(F.transform(records, lambda r: r[field]), lambda v: v.isNotNull())


def empty_records() -> Column:
    return F.array().cast("array<map<string,string>>")


def merged_lists(*lists: Column) -> Column:
    """Sorted union without duplicates."""
    return F.array_sort(reduce(F.array_union, lists))
