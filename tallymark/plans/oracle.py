"""SQL for DuckDB that computes the same results as the registered queries by other means.

Expected records are stated from the columns the answers were laid out with, not by parsing the answers, so a parser
fault on the Spark side shows up as a mismatch.
"""

from __future__ import annotations

from tallymark.fixed import DISPLAY_NAMES, FIELD_TITLES, FIELDS, MATCH_FIELDS, SCORE_FIELDS
from tallymark.operators.metrics import COMPAT_RECALL, METRICS, REPORT_ROWS
from tallymark.plans.inputs import ANSWERS_SQL, LINES_SQL, ORDERS_SQL, PAGES_SQL, TEXTS_SQL
from tallymark.sources.prompts import PROMPTS

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
TITLES = tuple(FIELD_TITLES[f] for f in FIELDS)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Records by construction --------------------------------------------------------------------------------------------

# Three candidate records per page as (zk, kr, ge, mp) with NULL for a missing field, and when each one counts.
_CLEAN = """
clean AS (
  SELECT *, CAST(l_linenumber AS VARCHAR) AS zkn1, CAST(l_linenumber + 1 AS VARCHAR) AS zkn2,
    replace(ge1, '%', '') AS gen1, CASE WHEN ge2 IS NOT NULL THEN '30' END AS gen2,
    concat('Qualität ', l_partkey % 50) AS krn2,
    style IN (0, 1, 2, 3, 5, 7, 12, 13, 14, 15) AS listed,
    style IN (4, 8, 11) AS failed,
    style IN (4, 10, 11) OR (style = 5 AND list_text <> '[]') AS failed_native
  FROM pages
)"""
_WITH_PAGES = f"WITH pages AS ({PAGES_SQL}), {_CLEAN}"


def _lists(make) -> tuple[str, str]:
    """SQL of the annotated and the predicted list, each element made from the four field expressions."""
    first = make("zkn1", "kr1", "gen1", "mp1")
    second = make("zkn2", "krn2", "gen2", "''")
    truth = f"list_filter([CASE WHEN t1 THEN {first} END, CASE WHEN t2 THEN {second} END], lambda x: x IS NOT NULL)"
    found = make("zkn1", "pkr1", "gen1", "mp1")
    extra = make("NULL", "'Zusatz'", "NULL", "NULL")
    number = make("NULL", "'Zahl'", "NULL", "'30.0'")
    predicted = (
        f"CASE WHEN listed THEN list_filter([CASE WHEN p1 THEN {found} END, CASE WHEN p2 THEN {second} END, "
        f"CASE WHEN p3 THEN {extra} END], lambda x: x IS NOT NULL) "
        f"WHEN style = 6 THEN list_filter([{number}], lambda x: x IS NOT NULL) ELSE [] END"
    )
    return truth, predicted


def _match_key(zk: str, kr: str, ge: str, mp: str) -> str:
    by_name = {"zkNummer": zk, "kriterium": kr, "gewichtung": ge, "maxPunkte": mp}
    parts = [f"CASE WHEN ({by_name[f]}) IS NULL THEN '' ELSE '{f}-' || ({by_name[f]}) || '__' END" for f in MATCH_FIELDS]
    return "(" + " || ".join(parts) + ")"


def _sentence(zk: str, kr: str, ge: str, mp: str) -> str:
    parts = [
        f"CASE WHEN ({v}) IS NULL THEN '' ELSE '{t} ist ' || ({v}) || '. ' END" for t, v in zip(TITLES, (zk, kr, ge, mp))
    ]
    return "(" + " || ".join(parts) + ")"


def _field(name: str):
    place = FIELDS.index(name)
    return lambda *values: f"CAST({values[place]} AS VARCHAR)"


def _view_sentence(name: str):
    place, title = FIELDS.index(name), TITLES[FIELDS.index(name)]
    return lambda *values: f"('{title} ist ' || coalesce({values[place]}, '') || '. ')"


def _joined(items: str) -> str:
    return f"coalesce(array_to_string(list_sort({items}), ' '), '')"


# Scores -------------------------------------------------------------------------------------------------------------

def _score_columns(fields=SCORE_FIELDS) -> str:
    jaccard, recall = "i / (a + b - i)", "CASE WHEN a = 0 THEN 0.0 ELSE i / a END"
    micro_p, micro_f = "CASE WHEN b = 0 THEN 0.0 ELSE i / b END", "2 * i / (a + b)"
    formula = {
        "precision_macro": jaccard, "recall_macro": jaccard, "f1_macro": jaccard,
        "precision_micro": micro_p, "recall_micro": recall, "f1_micro": micro_f,
        "precision_weighted": recall, "recall_weighted": recall, "f1_weighted": recall,
        "accuracy_not_normalized": "0.0", "accuracy_normalized": "0.0",
    }
    return ", ".join(
        f"CAST(CASE WHEN a = i AND b = i THEN 1.0 ELSE {formula[m]} END AS DOUBLE) AS {m}" for m in fields
    )


def _counts(truth: str, predicted: str) -> str:
    return (
        f"CAST(len(list_distinct({truth})) AS DOUBLE) AS a, CAST(len(list_distinct({predicted})) AS DOUBLE) AS b, "
        f"CAST(len(list_intersect(list_distinct({truth}), list_distinct({predicted}))) AS DOUBLE) AS i"
    )


_T, _P = _lists(_match_key)
_RECORD_COUNTS = f"{_WITH_PAGES}, counted AS (SELECT *, {_counts(_T, _P)} FROM clean)"
_RECORD_SCORES = f"{_RECORD_COUNTS}, scored AS (SELECT *, {_score_columns()} FROM counted)"


def _span_sql() -> str:
    parts = []
    for f in MATCH_FIELDS:
        t, p = _lists(_field(f))
        parts.append(f"SELECT {KEY}, prompt_id, label, '{f}' AS field, {_counts(t, p)} FROM clean")
    return f"{_WITH_PAGES}, counted AS ({' UNION ALL '.join(parts)}), scored AS (SELECT *, {_score_columns()} FROM counted)"


# Unlike the Spark side, records lie in rows here and are counted with plain grouping.
_LONG_SCORES = f"""
WITH lines AS ({LINES_SQL}), orders_in AS ({ORDERS_SQL}),
keys AS (
  SELECT l_orderkey, concat('kriterium-', kr, '__gewichtung-', replace(ge, '%', ''), '__maxPunkte-', mp, '__zkNummer-',
    replace(zk, 'ZK', ''), '__') AS k, 't' AS side FROM lines
  UNION
  SELECT l_orderkey, concat('kriterium-', pkr, '__', CASE WHEN pge IS NULL THEN '' ELSE
    concat('gewichtung-', replace(pge, '%', ''), '__') END, 'maxPunkte-', mp, '__zkNummer-', replace(zk, 'ZK', ''), '__'),
    'p' FROM lines WHERE predicted
), per_key AS (
  SELECT l_orderkey, k, count(*) FILTER (side = 't') AS t, count(*) FILTER (side = 'p') AS p FROM keys GROUP BY ALL
), per_order AS (
  SELECT l_orderkey, sum(t) AS a, sum(p) AS b, sum(t * p) AS i FROM per_key GROUP BY ALL
), counted AS (
  SELECT o.*, CAST(coalesce(a, 0) AS DOUBLE) AS a, CAST(coalesce(b, 0) AS DOUBLE) AS b,
    CAST(coalesce(i, 0) AS DOUBLE) AS i FROM orders_in o LEFT JOIN per_order USING (l_orderkey)
), scored AS (SELECT *, {_score_columns()} FROM counted)"""


# Reports ------------------------------------------------------------------------------------------------------------

def _presence(source: str, positive: str = "with criteria only", negative: str = "without criteria only") -> str:
    """Every row as mixed, and once more under its class."""
    return (
        f"SELECT *, 'mixed' AS presence FROM {source} UNION ALL SELECT *, CASE label WHEN 'has_criteria' THEN '{positive}' "
        f"ELSE '{negative}' END FROM {source} WHERE label IS NOT NULL"
    )


_PROMPT = "replace(prompt_id, 'prompt_', '')"


def _re_report(scored: str, metrics: tuple[str, ...], where: str = "") -> str:
    means = ", ".join(f'round(avg({m}) * 100, 2) AS "{DISPLAY_NAMES[m]}"' for m in metrics)
    return (
        f"{scored}, tagged AS ({_presence('scored')}) SELECT {_PROMPT} AS \"Prompt\", presence AS \"Criteria Presence\", "
        f"{means} FROM tagged {where} GROUP BY ALL"
    )


def _ner_report() -> str:
    short = {f: DISPLAY_NAMES[f] for f in FIELDS}
    parts = []
    for s in ("precision", "recall", "f1"):
        for a in ("macro", "micro"):
            m = f"{s}_{a}"
            means = ", ".join(f"round(avg({m}) FILTER (field = '{f}') * 100, 2) AS \"{short[f]}\"" for f in FIELDS)
            parts.append(
                f"SELECT {_PROMPT} AS \"Prompt\", presence AS \"Criteria Presence\", '{DISPLAY_NAMES[m]}' AS \"Metric\", "
                f"{means} FROM tagged GROUP BY ALL"
            )
    tagged = _presence("scored", "with ACs only", "without ACs only")
    return f"{_span_sql()}, tagged AS ({tagged}), ner AS ({' UNION ALL '.join(parts)})"


# Classification metrics ---------------------------------------------------------------------------------------------

def _metric_sql(source: str, truth: str, predicted: str, by: str = "") -> str:
    """CTEs up to ``wide``: one row per group with a column per metric, counted class by class."""
    g = f"{by}, " if by else ""
    on = f"AND r.{by} IS NOT DISTINCT FROM c.{by}" if by else ""
    class_by = f"{by}, " if by else ""
    group = "GROUP BY ALL" if by else ""
    return f"""
rows_in AS (SELECT {g}{truth} AS y, {predicted} AS yhat FROM {source}),
classes AS (SELECT {g}y AS cls FROM rows_in UNION SELECT {g}yhat FROM rows_in),
per_class AS (
  SELECT {', '.join(f'c.{x}' for x in [by] if x)}{',' if by else ''} c.cls,
    CAST(count(*) FILTER (r.y IS NOT DISTINCT FROM c.cls) AS DOUBLE) AS t,
    CAST(count(*) FILTER (r.yhat IS NOT DISTINCT FROM c.cls) AS DOUBLE) AS p,
    CAST(count(*) FILTER (r.y IS NOT DISTINCT FROM c.cls AND r.yhat IS NOT DISTINCT FROM c.cls) AS DOUBLE) AS tp
  FROM classes c JOIN rows_in r ON true {on} GROUP BY ALL
), sums AS (
  SELECT {class_by} sum(t) AS s, sum(tp) AS c, sum(p * t) AS pt, sum(p * p) AS pp, sum(t * t) AS tt,
    avg(CASE WHEN p > 0 THEN tp / p ELSE 0 END) AS mp, avg(CASE WHEN t > 0 THEN tp / t ELSE 0 END) AS mr,
    avg(CASE WHEN t + p > 0 THEN 2 * tp / (t + p) ELSE 0 END) AS mf
  FROM per_class {group}
), wide AS (
  SELECT {class_by} c / s AS "accuracy", mf AS "macro-f1", c / s AS "micro-f1", mp AS "macro-precision",
    c / s AS "micro-precision", mr AS "macro-recall", c / s AS "micro-recall",
    CASE WHEN (s * s - pp) * (s * s - tt) = 0 THEN 0
         ELSE (c * s - pt) / sqrt((s * s - pp) * (s * s - tt)) END AS "matthews_corrcoef"
  FROM sums
)"""


def _unpivot(by: str = "", digits: int | None = None, source: str = "wide") -> str:
    g = f"{by}, " if by else ""
    shown = '"{0}"' if digits is None else f'round("{{0}}", {digits})'
    return " UNION ALL ".join(
        f"SELECT {g}'{m}' AS metric, {shown.format(m)} AS score FROM {source}" for m in METRICS
    )


def _report_sql(by: str, compat: bool, source: str = "wide") -> str:
    shown = COMPAT_RECALL if compat else {}
    return " UNION ALL ".join(
        f"SELECT {by}, '{name}' AS \"Metric\", round(\"{shown.get(name, m)}\" * 100, 2) AS score FROM {source}"
        for name, m in REPORT_ROWS
    )


# Splits -------------------------------------------------------------------------------------------------------------

_SPLITS = f"""
WITH texts AS ({TEXTS_SQL}),
named AS (SELECT doc_id, filename, text, label_predicted, replace(label, '?', '') AS label, sha256(text) AS text_key
          FROM texts WHERE label IS NOT NULL),
firsts AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1),
sizes AS (SELECT label, CAST(count(*) AS BIGINT) AS n FROM firsts GROUP BY label),
totals AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) - ceil(0.8::DOUBLE * sum(n)) AS BIGINT) AS draws FROM sizes),
train_base AS (SELECT label, n, draws, n * draws // total AS whole, n * draws % total AS rem FROM sizes, totals),
train_quota AS (
  SELECT label, n, whole + CASE WHEN row_number() OVER (ORDER BY rem DESC, label) <= draws - sum(whole) OVER () THEN 1
    ELSE 0 END AS n_train FROM train_base),
rest_totals AS (SELECT CAST(sum(n - n_train) AS BIGINT) AS total,
  CAST(sum(n - n_train) - ceil(0.5::DOUBLE * sum(n - n_train)) AS BIGINT) AS draws FROM train_quota),
val_base AS (SELECT label, n, n_train, draws, (n - n_train) * draws // total AS whole, (n - n_train) * draws % total AS rem
  FROM train_quota, rest_totals),
quotas AS (
  SELECT label, n_train, whole + CASE WHEN row_number() OVER (ORDER BY rem DESC, label) <= draws - sum(whole) OVER ()
    THEN 1 ELSE 0 END AS n_validation, row_number() OVER (ORDER BY label) - 1 AS label_id FROM val_base),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || text_key), doc_id) AS rk FROM firsts),
splits AS (
  SELECT r.*, label_id, CASE WHEN rk <= n_train THEN 'train' WHEN rk <= n_train + n_validation THEN 'validation'
    ELSE 'test' END AS split FROM ranked r JOIN quotas USING (label))"""


def _splits_of_stripped() -> str:
    text = _STRIPPED.format("text")
    return _SPLITS.replace("SELECT doc_id, filename, text, ", f"SELECT doc_id, filename, {text} AS text, ").replace(
        "sha256(text) AS text_key", f"sha256({text}) AS text_key")


def _side_by_side() -> str:
    return (
        f"{_SPLITS}, {_metric_sql('splits', 'label', 'label_predicted', 'split')}, long AS ({_unpivot('split')}) "
        'SELECT v.metric AS "Metric", round(v.score * 100, 2) AS "Validation", round(t.score * 100, 2) AS "Test" '
        "FROM long v JOIN long t ON v.metric = t.metric AND v.split = 'validation' AND t.split = 'test'"
    )


def _binary_by_scope() -> str:
    rows = """scoped AS (
      SELECT 'All' AS scope, * FROM named
      UNION ALL SELECT 'Validation', * FROM named WHERE filename IN (SELECT filename FROM splits WHERE split = 'validation')
      UNION ALL SELECT 'Test', * FROM named WHERE filename IN (SELECT filename FROM splits WHERE split = 'test')),
    flagged AS (SELECT scope, CASE WHEN label = 'has_criteria' THEN 1 ELSE 0 END AS t,
      CASE WHEN label_predicted = 'has_criteria' THEN 1 ELSE 0 END AS p FROM scoped)"""
    columns = ", ".join(f"max(score) FILTER (scope = '{s}') AS \"{s}\"" for s in ("Validation", "Test", "All"))
    return (
        f"{_SPLITS}, {rows}, {_metric_sql('flagged', 't', 'p', 'scope')}, "
        f"rep AS ({_report_sql('scope', False)}) SELECT \"Metric\", {columns} FROM rep GROUP BY ALL"
    )


# Query texts --------------------------------------------------------------------------------------------------------

def _simple_pages(select: str, where: str = "") -> str:
    return f"{_WITH_PAGES} SELECT {select} FROM clean {where}"


def _views_sql() -> str:
    t, p = _lists(_sentence)
    parts = [f"SELECT {KEY}, prompt_id, failed, 'None' AS label_view, {_joined(t)} AS y_true_as_string, "
             f"{_joined(p)} AS y_pred_as_string FROM clean"]
    for f in FIELDS:
        t, p = _lists(_view_sentence(f))
        parts.append(f"SELECT {KEY}, prompt_id, failed, '{f}', {_joined(t)}, {_joined(p)} FROM clean")
    return f"{_WITH_PAGES}, views AS ({' UNION ALL '.join(parts)})"


def _normalized_records() -> str:
    def struct(zk, kr, ge, mp):
        return (f"{{'zkNummer': CAST({zk} AS VARCHAR), 'kriterium': CAST({kr} AS VARCHAR), "
                f"'gewichtung': CAST({ge} AS VARCHAR), 'maxPunkte': CAST({mp} AS VARCHAR)}}")
    _, p = _lists(struct)
    return (
        f"{_WITH_PAGES}, found AS (SELECT {KEY}, {p} AS recs FROM clean), "
        f"rows_out AS (SELECT {KEY}, recs, unnest(range(len(recs))) AS pos FROM found) "
        f"SELECT {KEY}, CAST(pos AS INT) AS pos, {', '.join(f'recs[pos + 1].{f} AS {f}' for f in FIELDS)} FROM rows_out"
    )


def _match_keys() -> str:
    return (
        f"{_WITH_PAGES}, found AS (SELECT {KEY}, {_T} AS keys FROM clean) "
        f"SELECT {KEY}, CAST(unnest(range(len(keys))) AS INT) AS pos, unnest(keys) AS match_key FROM found"
    )


def _records_json() -> str:
    def text(zk, kr, ge, mp):
        pairs = (("gewichtung", ge), ("kriterium", kr), ("maxPunkte", mp), ("zkNummer", zk))
        parts = ", ".join(
            f"CASE WHEN ({v}) IS NOT NULL THEN '\\\\\\\"{k}\\\\\\\": \\\\\\\"' || replace({v}, 'ä', '\\\\\\\\u00e4') || "
            "'\\\\\\\"' END" for k, v in pairs
        )
        return f"('\"\\\"{{' || concat_ws(', ', {parts}) || '}}\\\"\"')"
    t, _ = _lists(text)
    joined = f"coalesce(array_to_string(list_sort({t}), ', '), '')"
    return f"{_WITH_PAGES} SELECT {KEY}, '[' || {joined} || ']' AS y_true_as_json FROM clean"


def _prompt_fanout() -> str:
    rows = ", ".join(f"({_quoted(p.prompt_id)}, {_quoted(p.template)})" for p in PROMPTS if p.purpose == "extract")
    return (
        f"SELECT doc_id, prompt_id, CAST(length(template || text || ' [/INST]') AS INT) AS instruction_length, "
        f"md5(template || text || ' [/INST]') AS instruction_md5 FROM documents, (VALUES {rows}) v(prompt_id, template)"
    )


_ANSWER_CLASS = (
    "CASE WHEN starts_with(a, 'ja') THEN 'has_criteria' WHEN starts_with(a, 'nein') THEN 'has_no_criteria' "
)
_STRIPPED = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"
_ANSWERS = f"WITH answers AS ({ANSWERS_SQL}), low AS (SELECT *, lower({_STRIPPED.format('answer')}) AS a FROM answers)"
_NEAREST = """
cat AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label),
sims AS (SELECT e.vec_id, c.label, list_cosine_similarity(e.embedding::DOUBLE[], c.v) AS sim
         FROM embeddings e, cat c{where})"""
_TURN_PAIRS = """
pairs_in AS (
  SELECT u.conv_id || '-' || u.turn AS pair_id, u.text AS reference, a.text AS candidate
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
ref_tokens AS (SELECT pair_id, token, count(*) AS n FROM (SELECT pair_id,
  unnest(regexp_extract_all(lower(reference), '[a-z0-9]+')) AS token FROM pairs_in) GROUP BY ALL),
cand_tokens AS (SELECT pair_id, token, count(*) AS n FROM (SELECT pair_id,
  unnest(regexp_extract_all(lower(candidate), '[a-z0-9]+')) AS token FROM pairs_in) GROUP BY ALL),
hits AS (
  SELECT pair_id, sum(least(r.n, c.n)) AS h FROM ref_tokens r JOIN cand_tokens c USING (pair_id, token) GROUP BY 1),
nr AS (SELECT pair_id, sum(n) AS n FROM ref_tokens GROUP BY 1),
nc AS (SELECT pair_id, sum(n) AS n FROM cand_tokens GROUP BY 1),
pr AS (
  SELECT p.pair_id, coalesce(h / nullif(nc.n, 0), 0)::DOUBLE AS precision,
    coalesce(h / nullif(nr.n, 0), 0)::DOUBLE AS recall
  FROM pairs_in p LEFT JOIN hits USING (pair_id) LEFT JOIN nr ON nr.pair_id = p.pair_id
    LEFT JOIN nc ON nc.pair_id = p.pair_id)"""


# The longest common sequence by its table, one row of the table per reference token: an entry grows by one where the
# tokens agree, and is at least every entry before it.
_ROUGE_L = """
pairs_in AS (
  SELECT u.conv_id || '-' || u.turn AS pair_id, u.text AS reference, a.text AS candidate
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
toks AS (SELECT pair_id, regexp_extract_all(lower(coalesce(reference, '')), '[a-z0-9]+') AS r,
  regexp_extract_all(lower(coalesce(candidate, '')), '[a-z0-9]+') AS c FROM pairs_in),
walk AS (
  SELECT pair_id, 0 AS i, list_transform(c, lambda x: 0) AS s FROM toks
  UNION ALL
  SELECT pair_id, i + 1, list_transform(range(1, len(v) + 1), lambda k: list_max(v[1:k])) FROM (
    SELECT w.pair_id, w.i, list_transform(range(1, len(t.c) + 1), lambda k:
      greatest(w.s[k], CASE WHEN t.c[k] = t.r[w.i + 1] THEN coalesce(w.s[k - 1], 0) + 1 ELSE 0 END)) AS v
    FROM walk w JOIN toks t USING (pair_id) WHERE w.i < len(t.r))),
pr AS (SELECT pair_id, coalesce(CAST(coalesce(s[len(c)], 0) AS DOUBLE) / nullif(len(c), 0), 0)::DOUBLE AS precision,
  coalesce(CAST(coalesce(s[len(c)], 0) AS DOUBLE) / nullif(len(r), 0), 0)::DOUBLE AS recall
  FROM toks JOIN walk USING (pair_id) WHERE i = len(r))"""


def _pair_table() -> str:
    return f"""{_SPLITS},
t AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || text_key), doc_id) - 1 AS place,
        count(*) OVER (PARTITION BY label) AS size, count(*) OVER () AS total FROM splits WHERE split = 'train'),
line AS (SELECT *, row_number() OVER (ORDER BY label, place) - 1 AS g FROM t),
apart AS (SELECT a.label, b.doc_id, row_number() OVER (PARTITION BY a.label ORDER BY b.g) - 1 AS at
  FROM (SELECT DISTINCT label FROM line) a JOIN line b ON b.label <> a.label),
turns AS (SELECT unnest([1, 2]) AS iteration)
SELECT x.doc_id AS row_1, y.doc_id AS row_2, CAST(1 AS INT) AS same, CAST(iteration AS INT) AS iteration
FROM line x, turns JOIN line y ON y.label = x.label AND y.place = (x.place + iteration) % x.size
UNION ALL
SELECT x.doc_id, y.doc_id, CAST(0 AS INT), CAST(iteration AS INT)
FROM line x, turns JOIN apart y ON y.label = x.label AND y.at = (x.place + iteration) % (x.total - x.size)"""


def _split_of(source: str, key: str) -> str:
    """``source`` (``doc_id``, ``label``, the text ``key``) with its seeded stratified split."""
    return _SPLITS[_SPLITS.index("sizes AS"):].replace("FROM firsts", f"FROM {source}").replace("'42:' || text_key", f"'42:' || {key}")


# Counts by class and hashed word; a word that a class never had weighs as much as one more of nothing.
_BAYES = f"""{_SPLITS},
words AS (SELECT doc_id, label, split, substr(md5(w), 1, 4) AS feature FROM (SELECT doc_id, label, split,
  unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM splits)),
counts AS (SELECT label, feature, CAST(count(*) AS BIGINT) AS n FROM words WHERE split = 'train' GROUP BY ALL),
priors AS (SELECT label, ln(count(*) / sum(count(*)) OVER ()) AS prior, coalesce((SELECT sum(n) FROM counts c WHERE c.label = s.label), 0) AS total
  FROM splits s WHERE split = 'train' GROUP BY label),
weights AS (SELECT label, feature, n, ln((n + 1.0::DOUBLE) / (total + 65536.0::DOUBLE)) AS weight FROM counts JOIN priors USING (label)),
asked AS (SELECT s.doc_id, s.split, s.label AS truth, p.label, p.prior, p.total FROM splits s, priors p WHERE split <> 'train'),
gains AS (SELECT w.doc_id, p.label, sum(coalesce(weight, ln(1.0::DOUBLE / (total + 65536.0::DOUBLE)))) AS gain
  FROM words w, priors p LEFT JOIN weights x ON x.label = p.label AND x.feature = w.feature WHERE w.split <> 'train' GROUP BY ALL),
guessed AS (SELECT doc_id, split, truth AS label, a.label AS predicted_label FROM asked a LEFT JOIN gains g USING (doc_id, label)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY prior + coalesce(gain, 0) DESC, a.label) = 1)"""


def _vector_bayes() -> str:
    return f"""WITH vectors AS (SELECT vec_id AS doc_id, CAST(label AS VARCHAR) AS label, CAST(vec_id AS VARCHAR) AS text_key, embedding
  FROM embeddings), {_split_of('vectors', 'text_key')},
cells AS (SELECT doc_id, label, split, unnest(range(len(embedding))) AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM splits),
known AS (SELECT label, place, avg(x) AS m, greatest(var_pop(x), 1e-9) AS v FROM cells WHERE split = 'train' GROUP BY ALL),
priors AS (SELECT label, ln(count(*) / sum(count(*)) OVER ()) AS prior FROM splits WHERE split = 'train' GROUP BY label),
sums AS (SELECT c.doc_id, c.split, c.label AS truth, k.label, sum(-(x - m) * (x - m) / (v * 2) - ln(v * 2 * pi()) / 2) AS gain
  FROM cells c JOIN known k USING (place) WHERE c.split <> 'train' GROUP BY ALL)
SELECT doc_id AS vec_id, split, truth AS label, s.label AS predicted_label, 'embedding+bayes' AS model_name_or_path
FROM sums s JOIN priors p ON p.label = s.label QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY prior + gain DESC, s.label) = 1"""


_LETTERS = "(length(page) - length(replace(page, 'e', '')))"
_STUB = """
asked AS (SELECT doc_id AS row_id, {keep} text AS page, prompt_id, k FROM {source}, (VALUES {names}) v(prompt_id, k)),
stub AS (SELECT *, {letters} AS n_e, CASE WHEN prompt_id = 'presence_1'
    THEN CASE length(page) % 3 WHEN 0 THEN 'Ja.' WHEN 1 THEN ' Nein' || chr(10) ELSE 'Unklar: ' || page END
    ELSE CASE ({letters} + k) % 5 WHEN 0 THEN '[{{"kriterium": "Preis", "maxPunkte": "' || length(page) || ' P"}}]'
      WHEN 1 THEN '[{{"kriterium": "Preis"}}]' WHEN 2 THEN '[]' WHEN 3 THEN 'Keine Angabe.'
      ELSE '[{{"kriterium": "Preis"}}, {{"kriterium": "Zusatz", "maxPunkte": "10"}}]' END END AS answer FROM asked)"""


def _stub(source: str, keep: str, ids) -> str:
    places = {p.prompt_id: k for k, p in enumerate(PROMPTS)}
    names = ", ".join(f"('{i}', {places[i]})" for i in ids)
    return _STUB.format(source=source, keep=keep, names=names, letters=_LETTERS)


def _presence_fallback() -> str:
    """Nearest of two words by the cosine of letter counts: ja is (j 1, a 1, one), nein (n 2, e 1, one)."""
    def count(c: str) -> str:
        return f"CAST(length(a) - length(replace(a, '{c}', '')) AS DOUBLE)"
    return f"""WITH {_stub('documents', '', ['presence_1'])}, said AS (SELECT row_id, answer AS a FROM stub),
counted AS (SELECT row_id, a, {count('j')} AS j, {count('n')} AS n, {count('a')} AS x, {count('e')} AS e FROM said)
SELECT row_id AS doc_id, CASE WHEN a = 'Ja.' THEN 'has_criteria' WHEN a = ' Nein' || chr(10) THEN 'has_no_criteria'
  WHEN (j + x + 1) / sqrt(3.0) >= (2 * n + e + 1) / sqrt(6.0) THEN 'has_criteria' ELSE 'has_no_criteria' END AS label_predicted
FROM counted"""


def _extraction_run() -> str:
    ids = [p.prompt_id for p in PROMPTS if p.purpose == "extract"]
    name, points = "'kriterium-Preis__'", "'kriterium-Preis__maxPunkte-' || length(page) || '__'"
    truth = f"CASE n_e % 3 WHEN 1 THEN [{name}] WHEN 2 THEN [{points}] ELSE []::VARCHAR[] END"
    found = (f"CASE (n_e + k) % 5 WHEN 0 THEN [{points}] WHEN 1 THEN [{name}] "
             f"WHEN 4 THEN [{name}, 'kriterium-Zusatz__maxPunkte-10__'] ELSE []::VARCHAR[] END")
    return f"""WITH texts AS ({TEXTS_SQL}), named AS (SELECT *, replace(label, '?', '') AS lab FROM texts),
{_stub('named', 'lab AS label,', ids)},
counted AS (SELECT *, {_counts(truth, found)} FROM stub),
scored AS (SELECT *, {_score_columns()} FROM counted),
tagged AS ({_presence('scored')})
SELECT {_PROMPT} AS "Prompt", presence AS "Criteria Presence", round(avg(f1_macro) * 100, 2) AS "Macro-F1",
  round(avg(f1_micro) * 100, 2) AS "Micro-F1", CAST(count(*) FILTER ((n_e + k) % 5 <> 3) AS BIGINT) AS "Successful",
  CAST(count(*) FILTER ((n_e + k) % 5 = 3) AS BIGINT) AS "Failed"
FROM tagged GROUP BY ALL"""


_PAGE_FILES = """WITH named AS (SELECT html, CAST(page_id AS VARCHAR) AS tender_id,
  regexp_replace(regexp_extract(url, '^[^/]*//([^/?#]*)', 1), '[^A-Za-z0-9.-]', '-', 'g') AS document FROM pages)"""


def _adaptive_search(trials: int = 12, startup: int = 4, candidates: int = 8, keep: int = 3, seed: int = 42) -> str:
    """One table per trial, each from those before: ranks, weights of the bins, candidates, and the scores of the rungs."""
    bins = {"reg": 8, "degree": 8, "centre": 3}

    def unit(t: int, name: str, k: str) -> str:
        return f"CAST('0x' || substr(md5('{seed}:{t}:{name}:' || {k}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"

    ctes = ["""
lines AS (SELECT CASE WHEN l_orderkey % 5 = 0 THEN -1 WHEN l_orderkey % 9 = 1 THEN 0 WHEN l_orderkey % 3 = 1 THEN 1 ELSE 2 END AS part,
  CAST(l_quantity AS BIGINT) AS x, CAST(round(l_extendedprice * 100) AS BIGINT) AS y FROM lineitem),
powers AS (SELECT part, y, degree, CASE degree WHEN 1 THEN x WHEN 2 THEN x * x ELSE x * x * x END AS f FROM lines, (VALUES (1), (2), (3)) d(degree)),
held AS (SELECT degree, CAST(count(*) AS DOUBLE) AS n, CAST(sum(f) AS DOUBLE) AS f, CAST(sum(y) AS DOUBLE) AS y, CAST(sum(f * f) AS DOUBLE) AS ff,
  CAST(sum(f * y) AS DOUBLE) AS fy, CAST(sum(y * y) AS DOUBLE) AS yy FROM powers WHERE part = -1 GROUP BY degree),
seen AS (SELECT rung, degree, CAST(count(*) AS DOUBLE) AS n, CAST(sum(f) AS DOUBLE) AS f, CAST(sum(y) AS DOUBLE) AS y, CAST(sum(f * f) AS DOUBLE) AS ff,
  CAST(sum(f * y) AS DOUBLE) AS fy FROM powers, (VALUES (0), (1), (2)) r(rung) WHERE part BETWEEN 0 AND rung GROUP BY rung, degree)"""]
    for t in range(trials):
        past = " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(t)) or "SELECT * FROM (SELECT 0 AS trial, 0 AS reached) WHERE false"
        if t < startup:
            units = ", ".join(f"{unit(t, name, repr('0'))} AS u_{name}" for name in bins)
            ctes.append(f"u{t} AS (SELECT {units})")
        else:
            ctes.append(f"""h{t} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY reached DESC, score DESC, trial) <= ceil({t} / 4.0) AS good
  FROM ({past}))""")
            for name, n in bins.items():
                near = "WHEN abs(p - b) = 1 THEN 0.5" if name != "centre" else ""
                place = f"least(CAST(floor(u_{name} * {n}) AS INT), {n - 1})"
                ctes.append(f"""w{t}_{name} AS MATERIALIZED (SELECT b, 1 + coalesce(sum(hit) FILTER (good), 0) AS g, 1 + coalesce(sum(hit) FILTER (NOT good), 0) AS r
  FROM (SELECT b, good, CASE WHEN p = b THEN 1.0 {near} ELSE 0.0 END AS hit FROM range({n}) x(b), (SELECT {place} AS p, good FROM h{t})) GROUP BY b),
d{t}_{name} AS MATERIALIZED (SELECT b, CAST(g AS DOUBLE) AS g, CAST(sum(g) OVER () AS DOUBLE) AS gs, CAST(r AS DOUBLE) AS r, CAST(sum(r) OVER () AS DOUBLE) AS rs,
  CAST(sum(g) OVER (ORDER BY b) AS DOUBLE) AS upto FROM w{t}_{name}),
c{t}_{name} AS (SELECT k, draw, least((SELECT count(*) FROM d{t}_{name} WHERE upto / gs <= draw), {n - 1}) AS b
  FROM (SELECT k, {unit(t, name, "k")} AS draw FROM range(1, {candidates + 1}) x(k))),
u{t}_{name} AS (SELECT (b + least((draw - (upto - g) / gs) / (g / gs), 1.0)) / {n}.0::DOUBLE AS u_{name} FROM c{t}_{name} JOIN d{t}_{name} USING (b)
  ORDER BY (g / gs) / (r / rs) DESC, k LIMIT 1)""")
            ctes.append(f"u{t} AS (SELECT * FROM {', '.join(f'u{t}_{name}' for name in bins)})")
        ctes.append(f"""p{t} AS (SELECT *, exp(ln(0.001::DOUBLE) + u_reg * (ln(1000.0::DOUBLE) - ln(0.001::DOUBLE))) AS reg,
  1 + least(CAST(floor(u_degree * 3) AS INT), 2) AS degree, [0.0, 0.5, 1.0][least(CAST(floor(u_centre * 3) AS INT), 2) + 1]::DOUBLE AS centre FROM u{t}),
f{t} AS (SELECT rung, v.*, centre * (s.y / s.n) AS c, (s.fy - centre * (s.y / s.n) * s.f) / (s.ff * (1.0 + reg)) AS w
  FROM p{t} p JOIN seen s ON s.degree = p.degree JOIN held v ON v.degree = p.degree),
s{t} AS MATERIALIZED (SELECT list(1.0 - (yy - 2.0 * c * y + n * c * c - 2.0 * w * (fy - c * f) + w * w * ff) / (yy - y * y / n) ORDER BY rung) AS s FROM f{t}),
g{t} AS (SELECT s, {", ".join(f"(SELECT count(*) FILTER (q.s{r} > x.s[{r + 1}]) < ceil((count(q.s{r}) + 1) / {keep}.0) FROM ({past}) q)" if t else "true" for r in (0, 1)) .replace(", (SELECT", " AS on0, (SELECT").replace(", true", " AS on0, true")} AS on1 FROM s{t} x),
t{t} AS MATERIALIZED (SELECT {t} AS trial, u_reg, u_degree, u_centre, reg, degree, centre, CASE WHEN NOT on0 THEN 1 WHEN NOT on1 THEN 2 ELSE 3 END AS reached,
  s[1] AS s0, CASE WHEN on0 THEN s[2] END AS s1, CASE WHEN on0 AND on1 THEN s[3] END AS s2, s[CASE WHEN NOT on0 THEN 1 WHEN NOT on1 THEN 2 ELSE 3 END] AS score
  FROM p{t}, g{t})""")
    every = " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(trials))
    return f"""WITH {','.join(ctes)} SELECT CAST(trial AS INT) AS trial, round(reg, 9) AS reg, CAST(degree AS INT) AS degree, centre, CAST(reached AS INT) AS rungs,
  round(score, 9) AS score, row_number() OVER (ORDER BY reached DESC, score DESC, trial) = 1 AS is_best FROM ({every})"""


def build() -> dict[str, str]:
    t_text, p_text = _lists(_sentence)
    span = _span_sql()
    native_number = "CASE WHEN style = 6 THEN 1 WHEN style = 8 THEN 1 ELSE 0 END"
    n_listed = "(CASE WHEN p1 THEN 1 ELSE 0 END + CASE WHEN p2 THEN 1 ELSE 0 END + CASE WHEN p3 THEN 1 ELSE 0 END)"
    scores = ", ".join(SCORE_FIELDS)
    two = ("f1_macro", "f1_micro")
    six = tuple(f"{s}_{a}" for a in ("macro", "micro") for s in ("precision", "recall", "f1"))
    out = {
        "jsonl_records": f"""{_WITH_PAGES}, raw AS (SELECT *, list_filter([
            CASE WHEN t1 THEN {_sentence('zk1', 'kr1', 'ge1', 'mp1')} END,
            CASE WHEN t2 THEN {_sentence('zk2', 'kr2', 'ge2', "''")} END,
            CASE WHEN t3 THEN {_sentence("''", "''", 'NULL', 'NULL')} END], lambda x: x IS NOT NULL) AS recs FROM clean)
            SELECT filename, label, CAST(len(recs) AS INT) AS n_records, CAST(length(list_text) AS INT) AS context_length,
            coalesce(array_to_string(list_sort(recs), ' '), '') AS records_text FROM raw""",
        "page_name_parts": """SELECT doc_id || '_' || source || '_' || lang || '.txt' AS filename,
            CAST(doc_id AS VARCHAR) AS tender_id, source || '_' || lang AS document FROM documents""",
        "stored_pages": f"""{_PAGE_FILES} SELECT tender_id || '_' || document || '.txt' AS filename, tender_id, document,
            md5(coalesce(html, '')) AS text_md5, 'has_no_criteria' AS label FROM named""",
        "pages_by_name": f"""{_PAGE_FILES} SELECT tender_id || '_' || document || '.txt' AS filename, tender_id, document,
            CAST(length(coalesce(html, '')) AS INT) AS text_length FROM named WHERE starts_with(tender_id, '1') AND contains(document, 'a')""",
        "extraction_store": f"""{_views_sql()} SELECT 'vendor/model-a' AS model, prompt_id, label_view,
            CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (NOT failed) AS BIGINT) AS n_ok,
            CAST(sum(length(y_true_as_string)) AS BIGINT) AS true_chars,
            CAST(sum(length(y_pred_as_string)) AS BIGINT) AS pred_chars FROM views GROUP BY ALL""",
        "report_from_store": _re_report(_RECORD_SCORES, two),
        "classifier_store": _side_by_side(),
        "clean_labels": f"""WITH texts AS ({TEXTS_SQL}) SELECT doc_id, filename, replace(label, '?', '') AS label,
            CAST(length(text) AS INT) AS text_length FROM texts WHERE label IS NOT NULL""",
        "mode_filter": _simple_pages(
            f"{KEY}, filename, label, label_predicted, prompt_id, list_text", "WHERE label = 'has_criteria'"),
        "parsed_rows": _simple_pages(
            f"{KEY}, CAST(CASE WHEN style = 6 THEN 1 WHEN listed THEN {n_listed} ELSE 0 END AS INT) AS n_predicted",
            "WHERE NOT failed AND prompt_id = 'prompt_1'"),
        "first_rows": f"WITH texts AS ({TEXTS_SQL}) SELECT doc_id, label FROM texts ORDER BY doc_id LIMIT 100",
        "constant_columns": f"""WITH texts AS ({TEXTS_SQL}) SELECT CAST(doc_id AS VARCHAR) AS doc_id,
            CAST(length(text) AS VARCHAR) AS text_length, 'prompt_1' AS prompt_id, '' AS error_message, 'm1' AS model
            FROM texts""",
        "binary_labels": _simple_pages(
            f"{KEY}, CAST(CASE WHEN label = 'has_criteria' THEN 1 ELSE 0 END AS INT) AS y_true, "
            "CAST(CASE WHEN label_predicted = 'has_criteria' THEN 1 ELSE 0 END AS INT) AS y_pred"),
        "decoded_classes": """WITH b AS (SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS c FROM embeddings)
            SELECT vec_id, CAST(c AS INT) AS class_id, concat('class ', c) AS class_name FROM b""",
        "display_names": _simple_pages(f"{KEY}, {_PROMPT} AS prompt_name"),
        "parsed_flags": """SELECT doc_id, ['yes', 'No', 'TRUE', 'f', '1', '0', 'y'][doc_id % 8 + 1] AS word,
            [true, false, true, false, true, false, true][doc_id % 8 + 1] AS flag FROM documents""",
        "field_views": f"{_views_sql()} SELECT {KEY}, label_view, y_true_as_string, y_pred_as_string FROM views",
        "prompt_fanout": _prompt_fanout(),
        "split_lookup": f"""{_SPLITS} SELECT n.doc_id, n.label, s.split FROM named n JOIN splits s ON n.text = s.text""",
        "split_semi_join": f"""{_SPLITS} SELECT doc_id, filename FROM texts WHERE filename IN
            (SELECT filename FROM splits WHERE split = 'validation')""",
        "re_overview_merged": _re_report(_RECORD_SCORES, two),
        "metrics_side_by_side": _side_by_side(),
        "nearest_labels": f"""WITH {_NEAREST.format(where='')} SELECT vec_id, CAST(arg_max(label, sim) AS VARCHAR) AS nearest,
            round(max(sim), 6) AS score FROM sims GROUP BY vec_id""",
        "concatenated_texts": f"""WITH texts AS ({TEXTS_SQL}) SELECT doc_id, label, CAST(length(text) AS INT) AS text_length
            FROM texts UNION ALL SELECT doc_id, label, CAST(length({_STRIPPED.format('text')}) AS INT) FROM texts""",
        "label_unions": f"""{_WITH_PAGES}, k AS (SELECT {KEY}, {_T} AS t, {_P} AS p FROM clean) SELECT {KEY},
            coalesce(array_to_string(list_sort(list_distinct(list_concat(t, p))), '|'), '') AS labels,
            CAST(len(list_intersect(list_distinct(t), list_distinct(p))) AS INT) AS n_common FROM k""",
        "context_lengths": "SELECT doc_id, CAST(length(text) AS INT) AS context_length FROM documents",
        "answer_labels": f"{_ANSWERS} SELECT conv_id, turn, {_ANSWER_CLASS} END AS label_predicted FROM low",
        "answer_labels_fallback": f"""{_ANSWERS}, {_NEAREST.format(where=' WHERE c.label IN (0, 1)')},
            best AS (SELECT vec_id, CASE arg_max(label, sim) WHEN 0 THEN 'ja' ELSE 'nein' END AS word FROM sims GROUP BY 1)
            SELECT conv_id, turn, {_ANSWER_CLASS} WHEN word = 'ja' THEN 'has_criteria' WHEN word = 'nein' THEN
            'has_no_criteria' END AS label_fixed, {_ANSWER_CLASS} ELSE word END AS label_compat
            FROM low LEFT JOIN best ON vec_id = conv_id""",
        "cleaned_answers": f"""{_WITH_PAGES}, c AS (SELECT {KEY}, replace(replace(replace(replace(replace(replace(
            answer, '`', ''), 'null', ''''''), '-' || chr(10), ''), chr(10), ' '), '] ]', ']'), ']]', ']') AS cleaned FROM clean)
            SELECT {KEY}, cleaned, CASE WHEN regexp_matches(cleaned, '\\[[^\\[\\]]*\\]') THEN
            regexp_extract(cleaned, '(\\[[^\\[\\]]*\\])', 1) ELSE cleaned END AS found_list FROM c""",
        "parse_status": _simple_pages(
            f"{KEY}, CASE WHEN failed THEN 'failed' ELSE 'ok' END AS conversion_status, failed AS has_error, "
            f"CAST(CASE WHEN style = 6 THEN 1 WHEN listed THEN {n_listed} ELSE 0 END AS INT) AS n_predicted"),
        "parse_status_native": _simple_pages(
            f"{KEY}, CASE WHEN failed_native THEN 'failed' ELSE 'ok' END AS conversion_status, failed_native AS has_error, "
            f"CAST(CASE WHEN listed AND NOT failed_native THEN {n_listed} ELSE {native_number} END AS INT) AS n_predicted"),
        "digit_values": _simple_pages(f"{KEY}, regexp_replace(list_text, '[^0-9]', '', 'g') AS digits"),
        "normalized_records": _normalized_records(),
        "records_as_text": _simple_pages(
            f"{KEY}, {_joined(t_text)} AS y_true_as_string, {_joined(p_text)} AS y_pred_as_string"),
        "records_as_json": _records_json(),
        "match_keys": _match_keys(),
        "field_values": _simple_pages(f"{KEY}, " + ", ".join(
            f"coalesce(array_to_string({_lists(_field(f))[0]}, '|'), '') AS {f}" for f in FIELDS)),
        "percent_scores": """SELECT l_orderkey, round(count(*) FILTER (l_returnflag = 'A') / count(*) * 100, 2) AS percent
            FROM lineitem GROUP BY l_orderkey""",
        "record_scores": f"{_RECORD_SCORES} SELECT {KEY}, {scores} FROM scored",
        "kv_match_rows": f"{_LONG_SCORES} SELECT l_orderkey, {scores} FROM scored",
        "span_scores_rows": f"{span} SELECT {KEY}, field, {scores} FROM scored",
        "json_pair_f1": f"""WITH lines AS ({LINES_SQL}), n AS (SELECT *, 4.0::DOUBLE AS nt,
            CASE WHEN pge IS NULL THEN 3.0 ELSE 4.0 END::DOUBLE AS ng,
            (2 + CASE WHEN kr = pkr THEN 1 ELSE 0 END + CASE WHEN pge IS NULL THEN 0 ELSE 1 END)::DOUBLE AS h
            FROM lines), pr AS (SELECT l_orderkey, CASE WHEN predicted THEN h / ng ELSE 0.0::DOUBLE END AS precision,
            CASE WHEN predicted THEN h / nt ELSE 0.0::DOUBLE END AS recall FROM n)
            SELECT l_orderkey, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE
            ELSE precision * recall * 2 / (precision + recall) END AS f1, precision, recall FROM pr""",
        "stored_page_splits": f"{_splits_of_stripped()} SELECT doc_id, label, split FROM splits",
        "search_trials": "SELECT CAST(t AS INT) AS trial, true AS in_range, true AS has_score FROM range(3) r(t)",
        "saved_model": f"""{_SPLITS} SELECT doc_id, label, 'hashed/words' AS model_name_or_path, true AS same
            FROM splits WHERE split = 'test'""",
        "presence_fallback": _presence_fallback(),
        "formatting_by_mode": f"""{_WITH_PAGES} SELECT DISTINCT label_view, prompt_id, mode FROM clean,
            (VALUES ('None'), ('zkNummer'), ('kriterium'), ('gewichtung'), ('maxPunkte')) v(label_view),
            (VALUES ('all', NULL), ('with', 'has_criteria'), ('without', 'has_no_criteria')) m(mode, c)
            WHERE NOT failed AND (c IS NULL OR label = c)""",
        "label_counts": f"{_SPLITS} SELECT split, label, CAST(count(*) AS BIGINT) AS count FROM splits GROUP BY ALL",
        "label_ids": f"{_SPLITS} SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS label_id FROM "
                     "(SELECT DISTINCT label FROM named)",
        "class_metrics": f"{_WITH_PAGES}, {_metric_sql('clean', 'label', 'label_predicted', 'prompt_id')} "
                         f"{_unpivot('prompt_id', 9)}",
        "class_report": f"""{_WITH_PAGES}, flagged AS (SELECT prompt_id, CASE WHEN label = 'has_criteria' THEN 1 ELSE 0 END
            AS t, CASE WHEN label_predicted = 'has_criteria' THEN 1 ELSE 0 END AS p FROM clean),
            {_metric_sql('flagged', 't', 'p', 'prompt_id')}, good AS ({_report_sql('prompt_id', False)}),
            compat AS ({_report_sql('prompt_id', True)}) SELECT prompt_id, "Metric", good.score AS score_right,
            compat.score AS score_compat FROM good JOIN compat USING (prompt_id, "Metric")""",
        "binary_by_scope": _binary_by_scope(),
        "metric_long": f"{_SPLITS}, test_rows AS (SELECT * FROM splits WHERE split = 'test'), "
                       f"{_metric_sql('test_rows', 'label', 'label_predicted')} {_unpivot('', 9)}",
        "validation_macro_f1": f"{_SPLITS}, val_rows AS (SELECT * FROM splits WHERE split = 'validation'), "
                               f"{_metric_sql('val_rows', 'label', 'label_predicted')} "
                               'SELECT round("macro-f1", 9) AS macro_f1 FROM wide',
        "ner_overview": f'{_ner_report()} SELECT "Prompt", "Criteria Presence", "Metric", "AC", "ID", "MNP", "W" FROM ner',
        "re_overview": _re_report(_RECORD_SCORES, two),
        "re_overview_long": _re_report(_LONG_SCORES, two),
        "formatting_overview": f"""{_WITH_PAGES}, tagged AS ({_presence('clean')}) SELECT {_PROMPT} AS "Prompt",
            presence AS "Criteria Presence", CAST(count(*) FILTER (NOT failed) AS BIGINT) AS "Successful",
            CAST(count(*) FILTER (failed) AS BIGINT) AS "Failed" FROM tagged GROUP BY ALL""",
        "ok_prompts": f"""{_WITH_PAGES} SELECT DISTINCT label_view, prompt_id FROM clean,
            (VALUES ('None'), ('zkNummer'), ('kriterium'), ('gewichtung'), ('maxPunkte')) v(label_view) WHERE NOT failed""",
        "rouge1": f"""WITH {_TURN_PAIRS} SELECT pair_id, precision, recall, CASE WHEN precision + recall = 0 THEN 0
            ELSE precision * recall * 2 / (precision + recall) END AS f1 FROM pr""",
        "rouge_l": f"""WITH RECURSIVE {_ROUGE_L} SELECT pair_id, precision, recall, CASE WHEN precision + recall = 0 THEN 0
            ELSE precision * recall * 2 / (precision + recall) END AS f1 FROM pr""",
        "dedup_texts": """SELECT doc_id, lang, source, CAST(count(*) OVER (PARTITION BY text) AS BIGINT) AS copies
            FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
        "distinct_rows": f"{_WITH_PAGES} SELECT DISTINCT label, label_predicted, prompt_id, list_text FROM clean",
        "max_flags": f"""{_ner_report()} SELECT "Prompt", "Criteria Presence", "Metric", "AC", "ID", "MNP", "W", {', '.join(
            f'"{c}" = max("{c}") OVER (PARTITION BY "Metric") AS "{c}_is_max"' for c in ('AC', 'ID', 'MNP', 'W'))} FROM ner""",
        "sorted_report": _re_report(_RECORD_SCORES, six) + ' ORDER BY "Criteria Presence", "Prompt"',
        "split_rows": f"{_SPLITS} SELECT doc_id, label, split FROM splits",
        "split_counts": f"""{_SPLITS} SELECT label, split, CAST(count(*) AS BIGINT) AS n,
            CAST(sum(doc_id) AS BIGINT) AS doc_sum FROM splits GROUP BY ALL""",
        "split_frames": f"""{_SPLITS} SELECT split AS frame, doc_id, label FROM splits
            UNION ALL SELECT 'all', doc_id, label FROM splits""",
        "prepared_data": f"{_SPLITS} SELECT doc_id, filename, label, CAST(label_id AS INT) AS label_id, split FROM splits",
        "pair_table": _pair_table(),
        "generated_answers": f"WITH {_stub('documents', '', [p.prompt_id for p in PROMPTS])} "
                             "SELECT row_id AS doc_id, prompt_id, answer FROM stub",
        "extraction_run": _extraction_run(),
        "resumed_answers": f"WITH {_stub('documents', '', [p.prompt_id for p in PROMPTS])} SELECT row_id AS doc_id, prompt_id, "
                           "CASE WHEN CAST('0x' || substr(md5(CAST(row_id AS VARCHAR)), 1, 8) AS BIGINT) % 4 < 2 THEN answer "
                           "ELSE '2: ' || answer END AS answer FROM stub",
        "indexed_neighbours": """SELECT a.vec_id, arg_max(b.vec_id, (round(s, 12), -b.vec_id)) AS nearest, round(max(s), 6) AS score
            FROM (SELECT x.vec_id, y.vec_id AS other, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS s
            FROM embeddings x JOIN embeddings y ON x.vec_id % 100 = 0 AND x.vec_id <> y.vec_id) p
            JOIN embeddings a ON a.vec_id = p.vec_id JOIN embeddings b ON b.vec_id = p.other GROUP BY a.vec_id""",
        "index_recall": "SELECT CAST(count(*) AS BIGINT) AS n, true AS nine_in_ten FROM embeddings WHERE vec_id % 100 = 0",
        "bayes_weights": f"{_BAYES} SELECT label, feature, n, round(weight, 9) AS weight FROM weights",
        "bayes_predict": f"{_BAYES} SELECT doc_id, split, label, predicted_label, 'hashed-words+bayes' AS model_name_or_path FROM guessed",
        "bayes_metrics": f"{_BAYES}, {_metric_sql('guessed', 'label', 'predicted_label', 'split')} {_unpivot('split', 9)}",
        "vector_bayes": _vector_bayes(),
        "adaptive_search": _adaptive_search(),
    }
    return {name: text.strip() for name, text in out.items()}
