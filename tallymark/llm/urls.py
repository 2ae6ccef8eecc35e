"""URL filter: site rules first, then a weighted vocabulary counted by Aho-Corasick.

A rule is (verdict, host, path): it fits its host and all subdomains if the url's path starts with the rule's. The rule
with the longest text ``host + path`` wins, then ``block`` before ``allow``. Where no rule fits, the vocabulary decides: its terms are
looked up in host, path and query in one pass of the automaton; a hit counts if no ASCII letter or digit
touches it (so ``free`` is not found in ``freedom``). Terms of weight 1 or more are strict: one hit blocks. The others are
soft: their distinct hits block once there are ``SOFT_HITS`` of them.

Defined cases: a null url or one without ``://`` has empty host and path, no rule and no hit outside its text, so a
null is allowed; upper case is read as lower case in the vocabulary and the host, but paths keep their case for rules;
repeated rows are judged each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed rules: verdict, host, path.
RULES = (
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
)
# Weights of the vocabulary; 1 or more is strict.
VOCABULARY = {
    "casino": 1.0, "porn": 1.0, "spam": 1.0, "viagra": 1.0, "xxx": 1.0,
    "ads": 0.5, "bets": 0.5, "bonus": 0.4, "cheap": 0.5, "deal": 0.3, "farm": 0.3, "free": 0.4, "pills": 0.6, "poker": 0.6,
    "track": 0.4, "win": 0.3,
}
STRICT_WEIGHT = 1.0
SOFT_HITS = 2


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _winner(host: Column, path: Column, rules) -> Column:
    """Struct of rule and verdict of the winning rule, null if none fits."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, site, start in reversed(ranked):
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(site + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def vocabulary_hits(vocabulary: dict[str, float] = VOCABULARY):
    """Arrow function: struct of strict hits, distinct soft hits and the weight of the distinct terms found."""
    strict = frozenset(t for t, weight in vocabulary.items() if weight >= STRICT_WEIGHT)
    kind = "strict_hits bigint, soft_hits bigint, weight double"
    made: list = []  # one automaton per Python worker

    @F.arrow_udf(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>")
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        if not made:
            made.append(ahocorasick.Automaton())
            for term in vocabulary:
                made[0].add_word(term, term)
            made[0].make_automaton()
        plain = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        for batch in batches:
            rows = []
            for url in batch.to_pylist():
                text, n_strict, soft, weight, seen = (url or "").lower(), 0, set(), 0.0, set()
                for end, term in made[0].iter(text) if text else ():
                    start = end - len(term) + 1
                    if (start and text[start - 1] in plain) or (end + 1 < len(text) and text[end + 1] in plain):
                        continue
                    n_strict += term in strict
                    if term not in strict:
                        soft.add(term)
                    if term not in seen:
                        seen.add(term)
                weight = sum(vocabulary[t] for t in sorted(seen))
                rows.append({"strict_hits": n_strict, "soft_hits": len(soft), "weight": weight})
            yield pa.array(rows, pa.struct([("strict_hits", pa.int64()), ("soft_hits", pa.int64()), ("weight", pa.float64())]))

    return hits


def judged(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, vocabulary: dict[str, float] = VOCABULARY,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``strict_hits``, ``soft_hits``, ``weight``."""
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    rows = rows.withColumns({
        "hit": vocabulary_hits(vocabulary)(F.col("url")), "site": _winner(F.col("host"), F.col("path"), rules)})
    blocked = (F.col("hit.strict_hits") >= 1) | (F.col("hit.soft_hits") >= SOFT_HITS)
    return rows.select(
        "page_id", "host", "path", F.col("site.rule").alias("rule"),
        F.coalesce("site.verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "hit.*")
