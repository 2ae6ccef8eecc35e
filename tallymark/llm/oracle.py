"""DuckDB SQL for the registered training-data queries that SQL can express on whole tables."""

from __future__ import annotations

import re

from tallymark.llm import catalog, decontaminate, licenses, revisits, urls

SQL: dict[str, str] = {}


def _url_sql() -> str:
    """Rules as a list of cases, terms as a list of patterns; RE2 patterns with the letters and digits spelt out."""
    terms = ", ".join(
        f"('{t}', {w}, {str(w >= urls.STRICT_WEIGHT).lower()})" for t, w in sorted(urls.VOCABULARY.items()))
    ranked = sorted(urls.RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1]))
    rules = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'"
        for v, h, p in ranked)
    return f"""
WITH terms(term, w, strict) AS (VALUES {terms}),
parts AS (
  SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), hits AS (
  SELECT p.page_id, t.term, t.w, t.strict, len(list_filter(
    string_split(regexp_replace(lower(p.url), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x = t.term)) AS n
  FROM parts p, terms t
), sums AS (
  SELECT page_id, CAST(coalesce(sum(n) FILTER (strict), 0) AS BIGINT) AS strict_hits,
    count(*) FILTER (NOT strict AND n > 0) AS soft_hits, list(w ORDER BY term) FILTER (n > 0) AS ws
  FROM hits GROUP BY page_id
), judged AS (
  SELECT parts.page_id, host, path, CASE {rules} END AS site, strict_hits, soft_hits,
    CASE WHEN ws IS NULL THEN 0.0::DOUBLE ELSE list_reduce(ws, lambda a, b: a + b)::DOUBLE END AS weight
  FROM parts JOIN sums USING (page_id)
)
SELECT page_id, host, path, nullif(split_part(coalesce(site, ''), '|', 1), '') AS rule,
  CASE WHEN site IS NOT NULL THEN split_part(site, '|', 2)
       WHEN strict_hits >= 1 OR soft_hits >= {urls.SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict,
  strict_hits, soft_hits, weight
FROM judged
"""


SQL["op7_url_filter"] = _url_sql()


WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _template_pattern(template: str) -> str:
    """A template as a pattern over words that each end in a space."""
    out = []
    for part in re.split(r"(<<[^>]*>>)", template):
        if part == "<<beginOptional>>":
            out.append("(?:")
        elif part == "<<endOptional>>":
            out.append(")?")
        elif part.startswith("<<var"):
            least, most = re.search(r"words=(\d+)-(\d+)", part).groups()
            out.append(f"(?:[^ ]+ ){{{least},{most}}}")
        else:
            out += [f"{w} " for w in re.findall(r"[0-9a-z]+", part.lower())]
    return "".join(out)


def _license_sql() -> str:
    hits = []
    for phrase, label in licenses.PHRASES.items():
        words = phrase.split()
        same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        hits.append(
            f"list_transform(list_filter(range(1, len(w) - {len(words) - 2}), lambda i: {same}), lambda i: {{'at': i - 1, 'label': '{label}'}})")
    found = ", ".join(
        f"CASE WHEN regexp_matches(joined, ' {_template_pattern(t)}') THEN '{label}' END" for label, t in licenses.TEMPLATES.items())
    return f"""
WITH d AS (SELECT doc_id, {WORDS.format(ASCII_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
h AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS joined, flatten([{', '.join(hits)}]) AS base FROM d),
f AS (SELECT *, list_distinct(list_transform(base, lambda b: b.label)) AS base_set,
  list_filter([{found}], lambda x: x IS NOT NULL) AS templates FROM h)
SELECT doc_id, len(w) AS n_words, len(base) AS n_base, list_min(list_transform(base, lambda b: b.at)) AS first_word,
  list_max(list_transform(base, lambda b: b.at)) AS last_word, coalesce(array_to_string(list_sort(base_set), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base_set, templates))), ','), '') AS labels,
  CASE WHEN len(templates) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM f
"""


def _decontamination_sql() -> str:
    k = decontaminate.SHINGLE

    def shingles(table: str, key: str) -> str:
        return f"""SELECT {key}, unnest(CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k - 2}),
            lambda i: array_to_string(w[i:i + {k - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
            FROM (SELECT {key}, {WORDS.format("lower(coalesce(text, ''))")} AS w FROM {table})"""
    return f"""
WITH d AS ({shingles('documents', 'doc_id')}), q AS ({shingles('benchmark', 'item_id')}),
n AS (SELECT item_id, count(*) AS item_shingles FROM q GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN q USING (g) GROUP BY ALL)
SELECT doc_id, item_id, shared / item_shingles::DOUBLE AS containment, shared, item_shingles
FROM s JOIN n USING (item_id) WHERE shared >= {decontaminate.THRESHOLD} * item_shingles
"""


def _revisit_sql() -> str:
    assert {"date", "etag", "last-modified"} <= set(revisits.PERMITTED)
    return f"""
WITH captures AS ({catalog.CAPTURES_SQL.replace('AS STRING', 'AS VARCHAR')}),
a AS (SELECT *, regexp_replace(regexp_replace(coalesce(url, ''), '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM captures),
b AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\\.', ''), ':(80|443)$', '') AS h,
  regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS p,
  regexp_replace(regexp_replace(regexp_extract(rest, '^[^?]*\\?(.*)$', 1), '(^|&)(utm_[^&]*|ref=[^&]*|fbclid=[^&]*)', '', 'g'),
    '^&+', '') AS q FROM a),
c AS (SELECT *, h || p || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical_url FROM b),
f AS (SELECT r.record_id, r.canonical_url, r.etag, r.modified, r.date, arg_max(x, {{'t': x.time, 'i': x.record_id}}) AS x
  FROM c r LEFT JOIN c x ON x.status = 200 AND x.canonical_url = r.canonical_url AND x.time < r.time AND r.canonical_url <> ''
  WHERE r.status = 304 GROUP BY ALL),
o AS (SELECT *, CASE WHEN x IS NULL THEN 'no-response'
  WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(x.etag, '^W/', '') THEN 'resolved'
    ELSE 'etag-differs' END
  WHEN modified IS NOT NULL THEN CASE WHEN modified = x.modified THEN 'resolved' ELSE 'date-differs' END
  ELSE 'no-validator' END AS outcome FROM f)
SELECT record_id, canonical_url, x.record_id AS response_id, outcome, CASE WHEN outcome = 'resolved' THEN x.digest END AS digest,
  CASE WHEN outcome = 'resolved' THEN 'content-type=' || x.kind || '; date=' || date || '; etag=' || coalesce(etag, x.etag)
    || '; last-modified=' || coalesce(modified, x.modified) END AS headers
FROM o
"""


SQL["op2_licenses"] = _license_sql()
SQL["op3_decontamination"] = _decontamination_sql()
SQL["op9_revisits"] = _revisit_sql()


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """op12: each round is an assignment over the long table of parts and a floor of the mean."""
    steps = [f"""
kept AS (SELECT vec_id, label, embedding AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS place
  FROM embeddings WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
wide AS (SELECT CAST(greatest(1, ceil(max(len(v)) / {parts}.0)) AS BIGINT) AS w FROM kept),
x AS (SELECT place, part, pos, CAST(floor(1024 * coalesce(CAST(v[part * w + pos + 1] AS DOUBLE), 0)) AS BIGINT) AS x
  FROM kept, wide, (SELECT unnest(range({parts})) AS part), (SELECT unnest(range(w)) AS pos FROM wide)),
book0 AS (SELECT part, place AS entry, pos, x AS c FROM x WHERE place < {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (SELECT place, part, min(d * {entries} + entry) AS best FROM (
    SELECT place, x.part, entry, sum((x - c) * (x - c)) AS d FROM x JOIN book{k} b ON x.part = b.part AND x.pos = b.pos
    GROUP BY place, x.part, entry) GROUP BY place, part)""")
        if k < rounds:
            steps.append(f"""
mean{k} AS (SELECT x.part, best % {entries} AS entry, pos, sum(x) AS s, count(*) AS n
  FROM x JOIN near{k} USING (place, part) GROUP BY x.part, best % {entries}, pos),
book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce((s - ((s % n) + n) % n) // n, c) AS c
  FROM book{k} b LEFT JOIN mean{k} m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)""")
    last = rounds
    return f"""WITH {','.join(steps)},
coded AS (SELECT place, string_agg(printf('%02x', CAST(best % {entries} AS INT)), '' ORDER BY part) AS code,
    CAST(sum(best // {entries}) AS BIGINT) AS error FROM near{last} GROUP BY place)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{last}) AS codebooks_sha256
FROM kept JOIN coded USING (place)"""


# op13: the share of a source is a line through the sources in order of what they can take a weight: before the first that fits, all are at their cap.
_MIXING_SQL = r"""
WITH rated AS (
  SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 4.0 ELSE 1.0 END) AS w
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), docs AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(text, '')) AS digest,
    coalesce(CAST(w AS DOUBLE), 2.0) AS weight
  FROM documents d LEFT JOIN rated r ON d.doc_id = r.doc_id
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM docs GROUP BY source
), ordered AS (
  SELECT *, sum(size) OVER () - 3 * coalesce(sum(size) OVER before, 0) AS remains, sum(w) OVER (ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    - coalesce(sum(w) OVER before, 0) AS shares
  FROM sources WINDOW before AS (ORDER BY size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), line AS (
  SELECT CAST(remains AS DOUBLE) AS remains, CAST(shares AS DOUBLE) AS shares FROM ordered
  WHERE 3 * size * shares >= w * remains ORDER BY size / w, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, size AS source_size, CASE WHEN 3 * size * shares < w * remains THEN CAST(3 * size AS DOUBLE) ELSE w * remains / shares END AS target
  FROM sources, line
), keyed AS (
  SELECT doc_id, docs.source, size, source_size, target, CAST(round(target) AS BIGINT) AS budget, digest, weight,
    -ln((CAST('0x' || substr(md5(concat('42:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', digest)), 1, 13) AS BIGINT) + 0.5)
      / 4503599627370496.0::DOUBLE) / weight AS key
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source
), drawn AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs, coalesce(sum(size) OVER (
    PARTITION BY source ORDER BY key, doc_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM keyed
)
SELECT doc_id, size, source_size, target, source, CAST(epochs AS BIGINT) AS epochs,
  CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - earlier)) AS BIGINT) AS taken
FROM drawn
"""
SQL |= {"op12_codes": _codes_sql(), "op13_mixing": _MIXING_SQL}
