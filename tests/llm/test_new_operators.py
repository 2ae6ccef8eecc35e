"""Spelling variants, vector codes and source mixing against brute force, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import mixing, spelling, vectors

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


# 11 ------------------------------------------------------------------------------------------------------------------

def plain_counts(rows, min_length=5, min_count=3, damage=97):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            k = h % len(run)
            counts[run if h % damage else run[:k] + run[k + 1:]] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1:] == b for k in range(len(a)))


def plain_variants(counts, factor=2):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def got_variants(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    return {tuple(r) for r in spelling.variants(spark, df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("letters", ["ab", "abcdé"])
def test_variants_against_brute_force(spark, letters):
    draw = random.Random(len(letters))
    pool = ["".join(draw.choices(letters, k=draw.randint(4, 8))) for _ in range(150)]
    rows = [(k if k % 9 else None, "-".join(draw.choices(pool, weights=range(1, 151), k=draw.randint(0, 60)))) for k in range(120)]
    rows += [(7, None), (8, ""), (9, "12 3"), (9, "ABCDÉ É× ÷"), *rows[:20]]
    want = plain_variants(plain_counts(rows, damage=13))
    assert got_variants(spark, rows, damage=13) == want
    assert len(letters) > 2 or any(r[1] and r[1] != r[2] for r in want)  # some forms are variants themselves


def test_variants_of_long_words(spark):
    """Words of thousands of letters, edits at both ends and at the half, runs of one letter, words within words."""
    draw = random.Random(3)
    long = "".join(draw.choices("abcdefgh", k=3000))
    pool = [long, long[:-1], long[1:], long[:1499] + long[1500:], long[:1500] + "z" + long[1501:], "z" + long[1:], long + "z"]
    pool += ["a" * k for k in range(5, 12)] + ["aaaab", "baaaa", "aabaa", "abcdef", "abcde", "bcdef", "xabcde", "abcxdef"]
    rows = [(k, " ".join(w for w in pool for _ in range(1 + draw.randrange(4)))) for k in range(6)]
    assert got_variants(spark, rows) == plain_variants(plain_counts(rows))


def test_variants_with_a_hot_prefix(spark):
    """A third of all words share their first half, so one node has most of the states."""
    draw = random.Random(8)
    pool = {"prefixab" + "".join(draw.choices("abc", k=7)) for _ in range(250)} | {"".join(draw.choices("abcdefg", k=9)) for _ in range(300)}
    rows = [(1, " ".join(sorted(pool) * 3)), (2, " ".join(sorted(pool)[::2]))]
    assert got_variants(spark, rows) == plain_variants(plain_counts(rows))


def test_variants_cases(spark):
    assert got_variants(spark, [(1, None), (2, "")]) == set() and got_variants(spark, []) == set()
    assert got_variants(spark, [(1, "einsam einsam einsam")]) == plain_variants(plain_counts([(1, "einsam einsam einsam")]))


def test_runs_of_a_long_text_are_whole(monkeypatch):
    monkeypatch.setattr(spelling, "_PART", 7)
    text = "abc defghijklmnop, q rs tuvwxyz é"
    assert list(spelling.runs(text)) == re.findall("[a-zé]+", text)


def test_many_held_words_are_whole(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 2)
    rows = [(k, "eins zweite dritte viertel zweite") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in spelling.word_counts(spark, df).collect()} == set(plain_counts(rows).items())


@pytest.mark.parametrize("held", [3, 200_000])
def test_counts_by_joined_checksums(spark, monkeypatch, held):
    """Runs about and above the length up to which checksums are joined, letters of two bytes, ids of many lengths, steps of a few texts."""
    monkeypatch.setattr(spelling, "HELD_WORDS", held)
    monkeypatch.setattr(spelling, "_AT_ONCE", 4)
    draw = random.Random(5)
    pool = ["".join(draw.choices("abcéÿX", k=k)) for k in (*range(1, 9), 31, 32, 33, 63, 64, 65, 66, 200) for _ in range(3)]
    rows = [(draw.choice([None, k, -k, 10**k]), draw.choice([" ", "2", "œ"]).join(draw.choices(pool, k=30))) for k in range(18)]
    rows += [(1, None), (2, ""), (3, "12 3"), *rows[:4]]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    for damage in (1, 3, 97):
        got = [tuple(r) for r in spelling.word_counts(spark, df, damage=damage).collect()]
        want = plain_counts(rows, damage=damage)
        assert len(got) == len(want) > 0 and dict(got) == want


def test_first_edits_go_on(spark):
    """No state is kept after the edit whose word's next letter begins no edge, or whose word ends where no word does."""
    draw = random.Random(6)
    pool = {"".join(draw.choices("abcd", k=draw.randint(5, 8))) for _ in range(400)}
    walks, edges, hot = spelling.trie(spark, spark.createDataFrame([(w, 3) for w in sorted(pool)], "word string, n long"))
    states = spelling._one_edit(walks, edges, hot).localCheckpoint()
    on = states.where("pos < length(text)").withColumn("first", F.expr("substring(text, pos + 1, 1)"))
    begun = edges.select("node", F.expr("substring(label, 1, 1)").alias("first"))
    assert on.count() > 0 and on.join(begun, ["node", "first"], "left_anti").isEmpty()
    assert states.where("pos = length(text) AND NOT ends").isEmpty()


# 12 ------------------------------------------------------------------------------------------------------------------

def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    ints = [[math.floor(1024 * x) for x in v] + [0] * (parts * size - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    books = [[ints[k][p * size:(p + 1) * size] for k in order[:entries]] for p in range(parts)]

    def assign():
        out = []
        for v in ints:
            out.append([min(
                (sum((a - b) ** 2 for a, b in zip(v[p * size:(p + 1) * size], e)), k) for k, e in enumerate(books[p])) for p in range(parts)])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            members = defaultdict(list)
            for v, f in zip(ints, found):
                members[f[p][1]].append(v[p * size:(p + 1) * size])
            for e, some in members.items():
                books[p][e] = [sum(c) // len(some) for c in zip(*some)]
    found = assign()
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    errors, totals = [sum(d for d, _ in f) for f in found], Counter()
    for (_, _, label), e in zip(kept, errors):
        totals[label] += e
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, totals[label], digest) for (i, _, label), f, e in zip(kept, found, errors))


def got_codes(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("x")).withColumn("v", F.lit(0))
    return Counter(map(tuple, vectors.compressed(spark, df, **more).collect()))


@pytest.mark.parametrize("entries,block", [(256, 4096), (8, 16)])
def test_codes_against_brute_force(spark, monkeypatch, entries, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    draw = random.Random(entries)
    bits = [k / 8 - 2 for k in range(33)]  # sums of few values: ties between entries
    rows = [(draw.randrange(300), [draw.choice(bits) for _ in range(8)], draw.choice([None, 1, 2])) for _ in range(400)]
    rows += [(None, rows[0][1], 1), (5, None, 1), (6, [1.0, None] * 4, 1), (7, [math.nan] * 8, 2), (8, [math.inf] * 8, 2), rows[3], rows[3]]
    rows = [(i, v and [x if x is None else float(x) for x in v], label) for i, v, label in rows]
    assert got_codes(spark, rows, entries=entries) == plain_codes(rows, entries=entries)


def test_codes_cases(spark):
    rows = [(1, [0.5, -0.001, 1e6], 1), (2, [], None), (3, [0.25] * 5, None)]
    got = got_codes(spark, rows)
    assert sorted(k[0] for k in got) == [1, 2, 3] and {k[1] for k in got} == {"00000000", "01010000", "02020200"}  # ties: the lower index
    assert {k[2] for k in got} == {0}
    assert got_codes(spark, []) == Counter() and got_codes(spark, [(1, None, 1)]) == Counter()
    small = [(i, [0.1 * i, 0.3, -0.2, 0.01 * i, 7.0, 1.0, -1.0], i % 2) for i in range(12)]
    small = [(i, np.array(v, "float32").astype(float).tolist(), label) for i, v, label in small]
    assert got_codes(spark, small, entries=3, rounds=2) == plain_codes(small, entries=3, rounds=2)
    with pytest.raises(ValueError):
        got_codes(spark, [], entries=257)


# 13 ------------------------------------------------------------------------------------------------------------------

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Round by round, as the words of the rule say it."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left, shares = total - sum(fixed.values()), sum(w[s] for s in names if s not in fixed)
        target = {s: fixed.get(s, w[s] * left / shares if shares else 0) for s in names}
        above = {s: cap * sizes[s] for s in names if s not in fixed and w[s] * left > cap * sizes[s] * shares}
        if not above:
            return target
        fixed |= above


def plain_mix(rows, seed=42):
    size = [len(SPACED.findall(t or "")) for _, t, _, _ in rows]
    sizes = Counter()
    for (_, _, s, _), n in zip(rows, size):
        sizes[s] += n
    target, out = plain_targets(dict.fromkeys((r[2] for r in rows), 0) | dict(sizes)), []
    for s in target:
        budget = math.floor(target[s] + 0.5)
        epochs = budget // sizes[s] if sizes[s] else 0
        left, line = budget - epochs * sizes[s], []
        for (doc, text, source, weight), n in zip(rows, size):
            if source == s:
                digest = hashlib.md5((text or "").encode()).hexdigest()
                u = (int(hashlib.md5(f"{seed}:{'' if doc is None else doc}:{digest}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                line.append((weight <= 0, -math.log(u) / (weight if weight > 0 else 1), str(doc), digest, doc, n))
        for *_, doc, n in sorted(line, key=lambda r: r[:4]):
            take = max(0, min(n, left))
            left -= take
            out.append((doc, n, sizes[s], target[s], epochs * n + take, s))
    return Counter(out)


def got_mix(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, w double").withColumn("key", F.lit(1)).withColumn("piece", F.lit(1))
    found = mixing.mixed(spark, mixing.measured(df, weight=F.col("w")))
    return Counter(tuple(r) for r in found.select("doc_id", "size", "source_size", "target", "taken", "source").collect())


def some_rows(draw, n=200):
    sources = ["a", "b", "Z", "é", None, "hot", "hot", "hot"]
    rows = [(k, " ".join(["w"] * int(draw.paretovariate(1))), draw.choice(sources), draw.choice([0.0, 0.25, 1.0, 4.0])) for k in range(n)]
    return rows + [(5, None, "a", 1.0), (None, " \t\n", "b", 1.0), (None, "x y\x0bz\x1cq é p ", "b", 1.0), (300, "", "empty", 1.0)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing_against_brute_force(spark, seed):
    rows = some_rows(random.Random(seed))
    assert got_mix(spark, rows) == plain_mix(rows)


def test_mixing_meets_its_targets(spark):
    rows = some_rows(random.Random(7), 400)
    got = got_mix(spark, rows)
    taken, target = Counter(), {}
    for (_, n, _, t, k, s), c in got.items():
        assert 0 <= k <= 3 * n
        taken[s] += k * c
        target[s] = t
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    assert abs(sum(target.values()) - sum(n * c for (_, n, *_), c in got.items())) < 1e-6
    again = got_mix(spark, random.Random(1).sample(rows, len(rows)))
    assert again == got


def test_heavier_documents_come_first(spark):
    rows = [(k, "w " * 10, "ab"[k % 2], 4.0 if k % 4 < 2 else 1.0) for k in range(2000)]
    sums = Counter()
    for (doc, _, _, _, k, s), _ in got_mix(spark, rows).items():
        sums[s, doc % 4 < 2] += k > 0
    assert sums["b", True] > 1.5 * sums["b", False]


def test_equal_rows_share_the_border(spark, monkeypatch):
    """Copies of one row are more than the words left: some are taken, one in part, and all are returned."""
    monkeypatch.setattr(mixing, "BLOCK", 3)
    rows = [(1, "a b c", "s", 1.0)] * 50 + [(2, "d e", "t", 1.0)] * 40
    assert got_mix(spark, rows) == plain_mix(rows)


def test_mixing_cases(spark):
    assert got_mix(spark, []) == Counter()
    empty = [(1, None, "a", 1.0), (1, "", None, 2.0)]
    assert {r[3:5] for r in got_mix(spark, empty)} == {(0.0, 0)}
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, None), (4, None, 1), (6, 1, None), (6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(k, "a", "s") for k in (1, 2, 3, 4, 5, 6, None)], "doc_id long, text string, source string")
    got = mixing.label_weights(mixing.measured(df), labels).collect()
    assert {r["doc_id"]: r["weight"] for r in got} == {1: 4.0, 2: 1.0, 3: 1.0, 4: 2.0, 5: 2.0, 6: 1.0, None: 2.0}
    nan = [(1, "a b", "s", float("nan")), (2, "a c", "s", None), (3, "a d", "t", 1.0)]
    assert got_mix(spark, nan) == plain_mix([(i, t, s, 1.0) for i, t, s, _ in nan])


def test_mixing_runs_without_python(spark):
    df = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    plan = mixing.mixed(spark, mixing.measured(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
