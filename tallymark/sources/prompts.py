"""The prompt catalogue: four ways to ask for records and one question about their presence.

A prompt is job configuration, not data: the catalogue is a short tuple on the driver, and the operators write it into
the plan as literals. Callers may pass a catalogue of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from tallymark.fixed import INSTRUCTION_BEGIN


@dataclass(frozen=True)
class Prompt:
    prompt_id: str
    purpose: str  # "extract" or "presence"
    template: str


_ANSWER_SHAPE = (
    'Antworte nur mit einer JSON-Liste dieser Form: [{"zkNummer": "", "kriterium": "", "gewichtung": "", '
    '"maxPunkte": ""}]. Was nicht im Text steht, bleibt leer. Findest du nichts, antworte mit [{}].\n\nText:\n\n'
)
_ALL_FIELDS = (
    "Suche im folgenden Text einer Ausschreibung alle Zuschlagskriterien (kriterium) mit ihrer Nummer (zkNummer), "
    "ihrem Gewicht (gewichtung) und ihrer höchsten Punktzahl (maxPunkte). "
)

DEFAULT_EXTRACTION_PROMPT = "prompt_3"
PROMPTS = (
    Prompt("prompt_1", "extract", f"{INSTRUCTION_BEGIN} {_ALL_FIELDS}{_ANSWER_SHAPE}"),
    Prompt(
        "prompt_2", "extract",
        f"{INSTRUCTION_BEGIN} Eignungskriterien (EK) sind keine Zuschlagskriterien (ZK); lass sie weg. "
        f"{_ALL_FIELDS}{_ANSWER_SHAPE}",
    ),
    Prompt(
        "prompt_3", "extract",
        f"{INSTRUCTION_BEGIN} Suche im folgenden Text einer Ausschreibung die Namen aller Zuschlagskriterien "
        f"(kriterium) und lass die übrigen Felder leer. {_ANSWER_SHAPE}",
    ),
    Prompt(
        "prompt_4", "extract",
        f"{INSTRUCTION_BEGIN} {_ALL_FIELDS}Gewichte stehen oft in Prozent, Punkte als Zahl neben dem Kriterium, "
        f"Nummern oft hinter ZK. {_ANSWER_SHAPE}",
    ),
    Prompt(
        "presence_1", "presence",
        f"{INSTRUCTION_BEGIN} Nennt der folgende Text einer Ausschreibung Zuschlagskriterien? Antworte nur mit Ja oder "
        "Nein.\n\nText:\n\n",
    ),
)


def select_prompts(purpose: str, prompt_id: str | None = None, prompts: tuple[Prompt, ...] = PROMPTS):
    """Prompts of one purpose, or the one asked for."""
    return tuple(p for p in prompts if p.purpose == purpose and prompt_id in (None, p.prompt_id))
