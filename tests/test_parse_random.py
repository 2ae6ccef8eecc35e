"""Exact parsing of random answers against a plain Python reading of every single one."""

import ast
import random
import re
import unicodedata
import warnings

from tallymark.fixed import ANSWER_REPLACEMENTS, INNER_LIST
from tallymark.functions.parse import with_parsed_answer

PIECES = [
    "[", "]", "{", "}", ":", ",", " ", "\n", "-\n", "\t", '"', "'", "\\", "`", "null", "None", "true", "True", "1", "30.0",
    "-5", "0", "NaN", '"kriterium"', "'kriterium'", '"maxPunkte"', "'zkNummer'", '"ZK 1.1"', "'40 %'", '"a\'b"', "'a\"b'",
    '"ä€"', '"٣ P"', '"x\\ty"', '""', "''", '"{"', "'[1]'", "[{", "}]", "}, {", '": "', "] ]", "]]", "Text", "\r", "\x0b", "u",
    '{"kriterium": "A"}', "{'maxPunkte': 5}", '{"kriterium": "A", "kriterium": "B"}', '{"a": {"b": "c"}}', '["x", {"y": "z"}]',
    '{"gewichtung": "30%", "maxPunkte": ""}', "'{\"a\":\"1\"}'", "b''", "0j", "set()", "{}", "[]", "...", " ", " ", "()", "(1,)", "{'s'}",
]
SHAPES = ["[{%s}]", "[{%s}, {%s}]", "%s", "x %s [%s] y", '[{"kriterium": %s, "maxPunkte": %s}]', "[%s]", "[{'a': '%s'}]"]


def is_number(ch):
    return unicodedata.category(ch) == "Nd"


def plain(answer):
    """Status and records of one answer."""
    text = answer
    for old, new in ANSWER_REPLACEMENTS:
        text = text.replace(old, new)
    found = re.search(INNER_LIST, text)
    try:
        items = [x for x in ast.literal_eval(found.group(0) if found else text) if isinstance(x, dict)]
    except Exception:
        return "failed", None
    out = []
    for item in items:
        values, kept = [], {}
        for key, value in item.items():
            if isinstance(value, str):
                if key in ("zkNummer", "gewichtung", "maxPunkte"):
                    value = "".join(filter(is_number, value))
                elif key == "kriterium":
                    value = value.replace("\n-", "").replace("-\n", "")
            values.append(bool(value))
            kept[str(key).encode("utf-8", "replace").decode()] = "" if value is None else str(value).encode("utf-8", "replace").decode()
        if any(values):
            out.append(kept)
    return "ok", out


def test_random_answers(spark):
    rng = random.Random(13)
    answers = []
    for _ in range(6000):
        shape = rng.choice(SHAPES)
        parts = tuple("".join(rng.choices(PIECES, k=rng.randint(0, 6))) for _ in range(shape.count("%s")))
        answers.append(shape % parts)
    answers += [f"[{{{k}: {v}}}]" for k in PIECES for v in PIECES]
    df = spark.createDataFrame(list(enumerate(answers)), "i int, pred_output_as_string string")
    wrong, ok = [], 0
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for row in with_parsed_answer(df).collect():
            want = plain(answers[row["i"]])
            ok += want[0] == "ok" and bool(want[1])
            if (row["conversion_status"], row["y_pred"]) != want:
                wrong.append((answers[row["i"]], want, row["conversion_status"], row["y_pred"]))
    assert ok > 300
    assert not wrong, (len(wrong), wrong[:5])


ODD = [
    "[", "]", "{", "}", ":", ",", " ", '"k"', "'maxPunkte'", '"kriterium"', "1.50", "1e5", "-0", "+1", "- 1", "007", "1_000", "0x1f", "1j", ".5", "5.", "1.",
    "0.00001", "0.0001", "-0.0", "12345678.5", "123456789.25", "9007199254740993", "123456789012345678901", "1+2j", "1-2", "not 1", "1 if 1 else 2",
    '"a\\n"', '"a\\\\"', "'a\\''", '"a\\""', '"\\x41"', '"\\u00e4"', '"\\ud83d"', '"\\u12"', '"\\N{DASH}"', '"\\0"', '"\\/"', '"\\\\\\x"', "r'a\\d'", "u'x'",
    "f'{1}'", "b'x'", '"""', "'''", "# true", "true", "set()", "set ()", "Falsey", "None", "False", "...", "\xa0", "ä", "\\", ";", "=", "=1", "*", "@", "(1)", "()",
    '"{"', "'{\'a\': 1}'", '"a, }"', '": 5,"', "'\"k\": None'", '"\t"', "\x0c", "\x01", "\x02", "lambda: 0", "a.b", "1 .real", "True", "'%s'",
]


def test_random_literals(spark):
    """Odd numbers, escapes, prefixes, comments, operators: whatever reads them, records and status are those of the plain reading."""
    rng = random.Random(31)
    shapes = [*SHAPES, '[{"k": %s}]', '[{"kriterium": %s,}, %s]', "[%s, {'k': %s}]", "{'k': %s}", '[{"k" : %s , %s: 1} ,]']
    answers = [shape.replace("%s", "\0") for shape in shapes for _ in range(450)]
    for i, shape in enumerate(answers):
        while "\0" in shape:
            shape = shape.replace("\0", "".join(rng.choices(ODD, k=rng.choice([1, 1, 1, 2, 3]))), 1)
        answers[i] = shape
    df = spark.createDataFrame(list(enumerate(answers)), "i int, pred_output_as_string string")
    wrong, ok = [], 0
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for row in with_parsed_answer(df).collect():
            want = plain(answers[row["i"]])
            ok += want[0] == "ok" and bool(want[1])
            if (row["conversion_status"], row["y_pred"]) != want:
                wrong.append((answers[row["i"]], want, row["conversion_status"], row["y_pred"]))
    assert ok > 300
    assert not wrong, (len(wrong), wrong[:5])
