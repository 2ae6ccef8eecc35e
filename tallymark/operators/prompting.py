"""Prompts over pages: fan-out, rendering and batch generation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.fixed import INSTRUCTION_END, NO, YES
from tallymark.functions.answers import presence_label
from tallymark.functions.parse import with_parsed_answer
from tallymark.functions.text import render_prompt
from tallymark.sources.prompts import PROMPTS, Prompt, select_prompts

GenerateFn = Callable[[Sequence[str]], Sequence[str]]
EmbedFn = Callable[[Sequence[str]], Sequence[Sequence[float]]]


class PerTask:
    """A model function that is made once per task, by ``make()``, before the first batch: the place to load a model."""

    def __init__(self, make: Callable[[], Callable]):
        self.make = make


def _ready(function):
    return function.make() if isinstance(function, PerTask) else function


def _instructions(template: str, pages) -> list[str]:
    return [f"{template}{page or ''} {INSTRUCTION_END}" for page in pages]


def _with_kept(df: DataFrame, keep: Sequence[str], text: str, new: Sequence[str], answer) -> DataFrame:
    """Add text columns made by ``answer()``: a function, made once per task, from a batch's texts to lists of new columns.

    Kept columns pass as Arrow arrays, whatever their type; only the texts become Python values.
    """
    out = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, T.StringType()) for n in new])
    names = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = answer()
        for batch in batches:
            for columns in make(batch.column(batch.num_columns - 1).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], *[pa.array(list(c), pa.string()) for c in columns]], names)

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, out)


def prompt_rows(prompts: Sequence[Prompt]) -> Column:
    """The catalogue as a literal array of structs."""
    return F.array(*[
        F.struct(F.lit(p.prompt_id).alias("prompt_id"), F.lit(p.template).alias("template")) for p in prompts
    ])


def fan_out(df: DataFrame, prompts: Sequence[Prompt]) -> DataFrame:
    """Every prompt with every row. The catalogue is part of the plan, so this is a map step and no join."""
    return df.select("*", F.explode(prompt_rows(prompts)).alias("_p")).select("*", "_p.*").drop("_p")


def render(df: DataFrame, text: str = "context") -> DataFrame:
    return df.withColumn("instruction", render_prompt(F.col("template"), F.col(text)))


def generate(
    df: DataFrame, prompts: Sequence[Prompt], generate_fn: GenerateFn | PerTask, text: str = "context",
    keep: Sequence[str] = ("row_idx",),
) -> DataFrame:
    """Answers of ``generate_fn`` to every prompt for every row: ``keep``, ``prompt_id``, ``answer``.

    Each text goes to Python once, and is joined there with all prompts, instead of once per prompt. A null text is an empty one. The
    batch size is the session's ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    asked = [(p.prompt_id, p.template) for p in prompts]

    def answer():
        ask = _ready(generate_fn)

        def columns(pages):
            for prompt_id, template in asked:
                yield [prompt_id] * len(pages), ask(_instructions(template, pages))

        return columns

    return _with_kept(df, keep, text, ("prompt_id", "answer"), answer)


def apply_prompts(
    df: DataFrame, generate_fn: GenerateFn | PerTask, prompt_id: str | None = None, text: str = "context",
    keep: Sequence[str] = ("row_idx",), prompts: tuple[Prompt, ...] = PROMPTS, mode: str = "exact",
    presence_prompt: str | None = None, embed_fn: EmbedFn | PerTask | None = None, label_mode: str = "fixed",
) -> DataFrame:
    """Ask for presence and for records, and read both answers.

    One row per input row and extraction prompt, with ``label_predicted``, ``pred_output_as_string``, ``y_pred``,
    ``conversion_status`` and ``error_message``. The presence question is asked once per row and travels with the
    answers to the extraction prompts, so nothing is joined afterwards. ``presence_prompt`` names it and may be left out if the
    catalogue has just one. With ``embed_fn`` an answer that says neither yes nor no gets the word whose vector is nearest to its own.
    """
    extract = select_prompts("extract", prompt_id, prompts)
    presence = select_prompts("presence", presence_prompt, prompts)
    if len(presence) != 1:
        raise ValueError(f"name one presence prompt; the catalogue has {len(presence)}")
    asked = [(p.prompt_id, p.template) for p in extract]
    question = presence[0].template

    def answer():
        ask, embed = _ready(generate_fn), _ready(embed_fn)
        words = [YES, NO]
        units = _units(embed(words)) if embed else None

        def columns(pages):
            present = list(ask(_instructions(question, pages)))
            nearest = [None] * len(pages)
            if embed and present:
                best = (_units(embed([a or "" for a in present])) @ units.T).argmax(axis=1)
                nearest = [words[k] for k in best]
            for name, template in asked:
                yield [name] * len(pages), present, nearest, ask(_instructions(template, pages))

        return columns

    new = ("prompt_id", "presence_answer", "_nearest", "pred_output_as_string")
    answered = _with_kept(df, keep, text, new, answer)
    label = presence_label(F.col("presence_answer"), F.col("_nearest") if embed_fn else None, label_mode)
    return with_parsed_answer(answered, mode=mode).withColumn("label_predicted", label).drop("_nearest")


def _units(vectors) -> np.ndarray:
    rows = np.asarray(vectors, dtype="float64")
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), np.finfo("float64").tiny)


def stub_generate(instructions: Sequence[str]) -> list[str]:
    """A stand-in for a model: answers depend on the whole text and the prompt, so runs can be compared.

    Presence questions are answered yes, no or neither by the length of the page. The others are answered by the number of letters
    e in the page and the place of the prompt in the catalogue: right, half right, wrong, empty or unreadable.
    """
    out = []
    for instruction in instructions:
        template, page = next(
            (k, instruction[len(p.template):]) for k, p in enumerate(PROMPTS) if instruction.startswith(p.template))
        page = page.removesuffix(f" {INSTRUCTION_END}")
        if PROMPTS[template].purpose == "presence":
            out.append(("Ja.", " Nein\n", f"Unklar: {page}")[len(page) % 3])
        else:
            out.append((
                f'[{{"kriterium": "Preis", "maxPunkte": "{len(page)} P"}}]', '[{"kriterium": "Preis"}]', "[]", "Keine Angabe.",
                '[{"kriterium": "Preis"}, {"kriterium": "Zusatz", "maxPunkte": "10"}]',
            )[(page.count("e") + template) % 5])
    return out


def stub_embed(texts: Sequence[str]) -> list[list[float]]:
    """A stand-in for an encoder: how often four letters occur in the text, and one."""
    return [[float(t.count(c)) for c in "jnae"] + [1.0] for t in texts]


def stub_model() -> GenerateFn:
    """Makes the stand-in model, as a factory for ``PerTask``."""
    return stub_generate


def stub_encoder() -> EmbedFn:
    return stub_embed
