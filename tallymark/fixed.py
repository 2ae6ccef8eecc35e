"""Names, texts and patterns that results depend on."""

# Keys of a criteria record, in record order.
FIELDS = ("zkNummer", "kriterium", "gewichtung", "maxPunkte")

# Field order inside a record match key.
MATCH_FIELDS = ("kriterium", "gewichtung", "maxPunkte", "zkNummer")

# Fields reduced to their digits before scoring.
DIGIT_FIELDS = ("zkNummer", "gewichtung", "maxPunkte")

# German titles used when a record is written as a sentence.
FIELD_TITLES = {
    "zkNummer": "Zuschlagskriteriumnummer",
    "kriterium": "Zuschlagskriterium",
    "gewichtung": "Gewichtung",
    "maxPunkte": "Maximalpunkte",
}

# The two classes and the two answers they are asked by.
POSITIVE = "has_criteria"
NEGATIVE = "has_no_criteria"
YES = "ja"
NO = "nein"

# States of an answer after parsing.
OK = "ok"
FAILED = "failed"

# Fields of a per-row score.
SCORE_FIELDS = (
    "precision_macro", "recall_macro", "f1_macro",
    "precision_micro", "recall_micro", "f1_micro",
    "precision_weighted", "recall_weighted", "f1_weighted",
    "accuracy_not_normalized", "accuracy_normalized",
)

# Short names in the report tables.
DISPLAY_NAMES = {
    "precision_macro": "Macro-P",
    "precision_micro": "Micro-P",
    "recall_macro": "Macro-R",
    "recall_micro": "Micro-R",
    "f1_macro": "Macro-F1",
    "f1_micro": "Micro-F1",
    "prompt_1": "1",
    "prompt_2": "2",
    "prompt_3": "3",
    "prompt_4": "4",
    "kriterium": "AC",
    "gewichtung": "W",
    "maxPunkte": "MNP",
    "zkNummer": "ID",
}

# Presence captions of the report tables, by table.
MIXED = "mixed"
CAPTIONS = {POSITIVE: "with criteria only", NEGATIVE: "without criteria only"}
NER_CAPTIONS = {POSITIVE: "with ACs only", NEGATIVE: "without ACs only"}

# Chat markers around an instruction.
INSTRUCTION_BEGIN = "[INST]"
INSTRUCTION_END = "[/INST]"

# Spellings of true and false.
TRUE_WORDS = ("yes", "true", "t", "y", "1")
FALSE_WORDS = ("no", "false", "f", "n", "0")

# The pattern of a list without inner lists.
INNER_LIST = r"(\[[^\[\]]*\])"

# Replacements that clean an answer, in this order.
ANSWER_REPLACEMENTS = (("`", ""), ("null", "''"), ("-\n", ""), ("\n", " "), ("] ]", "]"), ("]]", "]"))

# Marks of a word broken over two lines, removed in this order.
WORD_BREAKS = ("\n-", "-\n")
