"""The training-data operators against brute force, and their defined cases."""

import hashlib
import math
import os
import random
import re
import threading
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallymark.llm import (
    decontaminate, hmm, licenses, minhash, packing, quality, revisits, sharding, simhash, urls,
)
from tallymark.llm.components import components
from tallymark.llm.words import LETTERED, Words, shingle_hashes, slices

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(5)
VOCABULARY = ["alpha", "Beta", "gamma,", "de", "ÉTÉ", "x", "12", "the", "of", "größe", "(zeta)"]


def text(n, draw=rng):
    return " ".join(draw.choices(VOCABULARY, k=n))


def some_texts():
    draw = random.Random(5)
    base = [text(n, draw) for n in (0, 1, 2, 4, 5, 9, 40, 200)]
    near = base[7].replace("alpha", "omega", 1)
    return base + [None, "", "  \n\t ", base[6], base[6], near, "ünï côdé " * 30, "a" * 5000, "é" * 3000 + " x"]


def documents(spark, texts=None):
    texts = some_texts() if texts is None else texts
    rows = [(i * 3, t, "en", "src0", "extra", 1.5) for i, t in enumerate(texts)]
    # Extra columns with the names that operators use inside.
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, bits string, _log_odds double").withColumnRenamed("bits", "id")


def empty(spark):
    return documents(spark, [])


# Words ---------------------------------------------------------------------------------------------------------------

def test_words_and_shingles_against_plain_python():
    texts = pa.array(some_texts())
    for table, pattern in ((None, SPACED), (LETTERED, re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))):
        got = Words(texts) if table is None else Words(texts, table)
        want = [pattern.findall((t or "").translate(LOWER)) for t in texts.to_pylist()]
        assert [[got.word(k).decode() for k in range(got.first[i], got.first[i + 1])] for i in range(len(texts))] == want
        hashes = got.hashes()
        by_word = defaultdict(set)
        for k, h in enumerate(hashes):
            by_word[got.word(k)].add(h)
        assert all(len(v) == 1 for v in by_word.values()) and len({*map(tuple, by_word.values())}) == len(by_word)
        shingles, bounds = shingle_hashes(hashes, got.first, 5)
        seen = {}
        for i, words in enumerate(want):
            runs = [tuple(words[k: k + 5]) for k in range(max(1, len(words) - 4))] if words else []
            assert len(runs) == bounds[i + 1] - bounds[i]
            for run, h in zip(runs, shingles[bounds[i]: bounds[i + 1]]):
                assert seen.setdefault(run, h) == h
        assert len(set(seen.values())) == len(seen)
    assert list(slices(pa.array(["aa", "b" * 9, None, "c"]), 4)) == [(0, 1), (1, 2), (2, 4)]


# 1 -------------------------------------------------------------------------------------------------------------------

def jaccard(a, b):
    def sets(t):
        w = SPACED.findall(t.translate(LOWER))
        return {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} if w else {None}
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b)


def test_fingerprints(spark):
    texts = some_texts()
    got = {r["doc_id"]: r for r in minhash.edited_fingerprints(spark, documents(spark)).collect()}
    assert len(got) == len(texts)
    clean = [t or "" for t in texts]
    for i, t in enumerate(clean):
        following, half, r = clean[(i + 1) % len(clean)], len(t) // 2, got[i * 3]
        edited = t[: len(t) - half] + following[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - jaccard(t, edited)) < 0.2 and abs(r["near_next"] - jaccard(t, following)) < 0.2
        for j in range(i):
            if clean[j] == t:
                assert got[j * 3]["fingerprint"] == r["fingerprint"]


def test_fingerprint_cases(spark):
    assert minhash.edited_fingerprints(spark, empty(spark)).count() == 0
    one = minhash.edited_fingerprints(spark, documents(spark, ["a b c d e f"])).first()
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(b"a b c a b c").hexdigest()
    same = spark.createDataFrame([(1, "b"), (1, "b"), (None, "a"), (2, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in minhash.edited_fingerprints(spark, same).collect()) == [
        ("1", 1), ("1", 1), ("2", 0), ("None", 1)]


def test_likeness_estimates_jaccard():
    words = [f"w{k}" for k in range(400)]
    for keep in (400, 380, 300, 100):
        other = words[:keep] + [f"v{k}" for k in range(400 - keep)]
        a, b = " ".join(words), " ".join(other)
        s = minhash.signatures(pa.array([a, b]))
        assert abs(minhash.likeness(s[:1], s[1:])[0] - jaccard(a, b)) < 0.13


def test_near_classes(spark):
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(120)) for _ in range(12)]
    texts = base + [base[0], base[0].replace(base[0].split()[60], "changed", 1), base[3] + " tail", None, ""]
    got = {r["id"]: r["class_id"] for r in minhash.near_classes(spark, documents(spark, texts)).collect()}
    want = {}
    for i, t in enumerate(texts):
        want[i * 3] = min(j * 3 for j, u in enumerate(texts) if jaccard(t or "", u or "") >= 0.8)
    assert got == want


def by_chains(texts, threshold=0.8):
    """Brute force: the least place of each text's class."""
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and jaccard(texts[i], texts[j]) >= threshold:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if k == old else k for k in label]
    return label


@pytest.mark.parametrize("block", [None, 1000])
def test_near_classes_in_template_families(spark, monkeypatch, block):
    """Pages on one template share bands but are no near copies of each other; some pairs among them are."""
    if block:
        monkeypatch.setattr(minhash, "BLOCK", block)
    draw, texts = random.Random(3), []
    for family in range(3):
        frame = [f"t{family}w{k}" for k in range(180)]
        for page in range(30):
            own = [f"f{family}p{page}w{k}" for k in range(24)]
            texts.append(" ".join(frame + own))
            if page % 3 == 0:
                texts.append(" ".join(frame + own[:12] + [f"f{family}q{page}w{k}" for k in range(12)]))
    draw.shuffle(texts)
    label = by_chains(texts)
    assert len(set(label)) == 90
    got = {r["id"]: r["class_id"] for r in minhash.near_classes(spark, documents(spark, texts)).collect()}
    assert got == {i * 3: k * 3 for i, k in enumerate(label)}


# Components ----------------------------------------------------------------------------------------------------------

def test_components(spark):
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(500, 560)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["label"] for r in components(spark, df).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x or any(find(y) == x and y != x for y in parent)}
    assert components(spark, df.where("false")).count() == 0


# 2 -------------------------------------------------------------------------------------------------------------------

def test_license_phrases_and_templates(spark):
    texts = [
        None, "", "CC BY", "cc  by. Cc-By cc by by", "All rights reserved ALL RIGHTS RESERVED.", "rights reserved all",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache Licence", "Released under the MIT License.",
        "Copyright (c) 2020 by Some Body. All rights reserved.", "Copyright all rights reserved", "x " * 9000 + "cc by",
        "Licensed under the terms of the GNU General Public License",
    ]
    got = [r for r in licenses.scanned(documents(spark, texts)).orderBy("doc_id").collect()]
    labels = [r["labels"] for r in got]
    assert labels == [
        "", "", "cc-by", "cc-by", "reserved", "", "gpl,gpl-notice", "cc-by,cc-notice", "apache-2.0-notice", "", "mit-notice",
        "copyright-notice,reserved", "reserved", "cc-by", "gpl,gpl-notice"]
    assert [(r["n_base"], r["first_word"], r["last_word"]) for r in got[:5]] == [
        (0, None, None), (0, None, None), (1, 0, 0), (3, 0, 4), (2, 0, 3)]
    assert got[13]["n_words"] == 9002 and got[13]["first_word"] == 9000
    assert all(0 <= r["score"] <= 1 for r in got) and got[6]["spans"][0]["first"] == 0 and got[6]["spans"][0]["words"] == 12
    assert licenses.scanned(empty(spark)).count() == 0


def test_automaton_against_expansion():
    """Every text that a small template allows, and every near miss by one word."""
    automaton = licenses.Automaton("a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>><<var;words=1-2>> d")
    allowed = {tuple(m + v + ["d"]) for m in (["a"], ["a", "b"], ["a", "b", "c"]) for v in (["x"], ["x", "y"], ["b"], ["d"], ["b", "c"], ["b", "x"], ["c"], ["c", "x"], ["d", "x"], ["d", "d"], ["x", "d"])}
    for words in allowed:
        run = [w.encode() for w in words]
        assert automaton.length_at(lambda k: run[k], 0, len(run)) == len(run), words
    for bad in (["a", "d"], ["b", "x", "d"], ["a", "x", "y", "z", "d"], ["a", "x"]):
        run = [w.encode() for w in bad]
        assert automaton.length_at(lambda k: run[k], 0, len(run)) == 0
    for wrong in ("<<beginOptional>>a<<endOptional>>", "<<var;words=1-2>> a", "a <<endOptional>>", "<<beginOptional>> a"):
        with pytest.raises(ValueError):
            licenses.Automaton(wrong)


# 3 -------------------------------------------------------------------------------------------------------------------

def test_decontamination_against_brute_force(spark):
    pool = [f"w{k}" for k in range(3000)]
    items = [" ".join(rng.choices(pool, k=n)) for n in (5, 6, 8, 13, 20, 33, 50, 64, 120)] + [None, "", "two words", "x y z"]
    texts = [" ".join(rng.choices(pool, k=n)) for n in (0, 3, 30, 400, 5000)]
    texts += ["Start. " + items[k].upper().replace(" ", ", ") + " " + texts[3] for k in range(9)]
    texts += [texts[4] + " " + items[5] + " " + texts[3], " ".join(items[6].split()[:44]), " ".join(items[6].split()[:20])]
    texts += ["Two, words!", "some two words here", None, texts[5]]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def sets(t):
        w = word.findall((t or "").lower())
        return {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    want = set()
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            q = sets(item)
            if q and len(q & sets(t)) >= 0.8 * len(q):
                want.add((i * 3, j, len(q & sets(t)), len(q)))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, texts)
    got = {(r["doc_id"], r["item_id"], r["shared"], r["item_shingles"]) for r in decontaminate.contaminated(spark, docs, table).collect()}
    assert got == want and len(want) >= 12
    kept = decontaminate.without_items(spark, docs, table)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {i * 3 for i in range(len(texts))} - {w[0] for w in want}
    assert decontaminate.contaminated(spark, empty(spark), table).count() == 0
    assert decontaminate.contaminated(spark, docs, table.where("false")).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 4)
    items = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(12))) for k in range(20)], "item_id long, text string")
    texts = ["pre " + r["text"] + " post" for r in items.collect()]
    got = decontaminate.contaminated(spark, documents(spark, texts), items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(k * 3, k) for k in range(20)]


# 4 -------------------------------------------------------------------------------------------------------------------

def labelled_corpus(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        words = rng.choices([f"g{k}" for k in range(300)], k=60)
        if bad and i % 2:
            words = [w + "###" for w in words]
        elif bad:
            words[rng.randrange(60)] = "moron"
        rows.append((i, " ".join(words), "en" if i % 2 else None, "big" if i % 3 else f"host{i % 40}"))
        labels.append((i, 0 if bad and i % 2 else 1, 1 if bad and not i % 2 else 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("p", F.lit("x"))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_documents_it_has_not_seen(spark):
    docs, labels = labelled_corpus(spark)
    got = quality.judged(spark, docs, labels.where("doc_id % 2 = 0 OR doc_id % 3 = 1 AND doc_id % 9 <> 1 OR doc_id % 9 = 3"))
    rows = {r["doc_id"]: r for r in got.collect()}
    unseen = [i for i in range(600) if not (i % 2 == 0 or i % 3 == 1 and i % 9 != 1 or i % 9 == 3)]
    assert len(rows) == 600 and len(unseen) > 100
    assert sum(rows[i]["accepted"] == (i % 3 != 0) for i in unseen) >= 0.97 * len(unseen)
    kept = quality.accepted(spark, docs, labels)
    assert kept.columns == docs.columns
    assert sum(r["doc_id"] % 3 != 0 for r in kept.collect()) >= 395


def test_sparse_sites_keep_their_parents_share(spark):
    rows = [("big", "p", 0.9)] * 400 + [("big", "q", 0.5)] * 400 + [("other", "p", 0.1)] * 300 + [("tiny", "p", 0.0)]
    shares, strength = quality.site_shares(spark.createDataFrame(rows, "host string, path string, p double"))
    by_host = {r["host"]: r["host_share"] for r in shares.collect()}
    assert abs(by_host["big"] - 0.7) < 0.02 and abs(by_host["other"] - 0.1) < 0.02
    assert by_host["tiny"] > 0.2 and strength > 0  # one document says little about its host


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001/pages.parquet") and not os.path.isfile("/root/testdata/sf0.001/pages.parquet"), reason="no test tables")
def test_quality_by_hosts_and_paths_of_pages(spark):
    """Sites are the hosts and paths of real urls; a document's own share is left out of its path's."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(
        F.col("page_id").alias("doc_id"), F.col("html").alias("text"), F.expr("parse_url(url, 'HOST')").alias("host"),
        F.regexp_extract("url", "^[a-z]+://[^/]*(/[^/?]*)", 1).alias("path"))
    labels = pages.select("doc_id", F.when(F.col("path") == "/en", 1).otherwise(0).alias("quality"), F.lit(0).alias("toxic"))
    got = quality.judged(spark, pages, labels, host_col="host", path_col="path").collect()
    want = {r["doc_id"]: (r["host"], r["path"]) for r in pages.collect()}
    assert len({h for h, _ in want.values()}) > 1 and len({p for _, p in want.values()}) > 1
    assert {r["doc_id"]: (r["host"], r["path"]) for r in got} == want and len(got) == len(want)
    assert all(0 < r["site_share"] < 1 for r in got)
    offsets = defaultdict(set)
    for r in got:
        offsets[r["host"], r["path"]].add(round(r["site_share"], 12))
    assert len(set.union(*offsets.values())) > 1


def test_quality_cases(spark):
    docs, labels = labelled_corpus(spark, 60)
    odd = docs.unionByName(docs.limit(1)).unionByName(spark.createDataFrame(
        [(None, None, None, None, "x"), (1, "", None, "", "x")], docs.schema))
    assert quality.judged(spark, odd, labels).count() == odd.count()
    nothing = quality.judged(spark, docs, labels.where("false")).collect()
    assert len(nothing) == 60 and all(r["accepted"] for r in nothing)
    assert quality.judged(spark, docs.where("false"), labels).count() == 0
    assert quality.accepted(spark, documents(spark), labels).columns == documents(spark).columns


# 5 -------------------------------------------------------------------------------------------------------------------

def test_base_scores_against_plain_python(spark):
    texts = some_texts() + [text(30) for _ in range(60)]
    got = {r["doc_id"]: r for r in hmm.scored(spark, documents(spark, texts)).collect()}
    tokens = {i * 3: [*SPACED.findall((t or "").translate(LOWER)), None] for i, t in enumerate(texts)}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(t for i, ts in tokens.items() if not out[i] for t in ts)
    n, v = sum(counts.values()), len(counts)
    for i, ts in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            out[i], len(ts), sum(counts[t] > 0 for t in ts), n)
        assert abs(r["base_score"] - sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)) < 1e-8
        assert r["score"] < 0


def test_forward_is_the_sum_over_all_paths():
    random_ = np.random.default_rng(0)
    share = lambda *shape: (lambda x: x / x.sum(-1, keepdims=True))(random_.random(shape))
    chain = hmm.Chain(share(3), share(3, 3), share(3, 5))
    texts = [random_.integers(0, 5, n) for n in (6, 4, 4, 1)]
    logs = chain.forward(texts)
    for t, log in zip(texts, logs):
        total = 0.0
        for path in np.ndindex(*[3] * len(t)):
            p = chain.start[path[0]] * chain.emit[path[0], t[0]]
            for k in range(1, len(t)):
                p *= chain.move[path[k - 1], path[k]] * chain.emit[path[k], t[k]]
            total += p
        assert abs(math.log(total) - log) < 1e-9
    # Expected counts add up to the number of texts, transitions and tokens, and training never lowers the likelihood.
    before, like = chain, []
    for _ in range(8):
        start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
        before.expected(texts, start, move, emit)
        assert np.allclose([start.sum(), move.sum(), emit.sum()], [4, 11, 15])
        like.append(before.forward(texts).sum())
        before = hmm.Chain(*(x / x.sum(-1, keepdims=True) for x in (start, move, emit)))
    assert all(b >= a - 1e-9 for a, b in zip(like, like[1:])) and like[-1] > like[0]


def test_states_help_on_unseen_texts(spark):
    """Two kinds of sentences that never mix: knowing the kind helps, which single words can't tell."""
    kinds = [[f"a{k}" for k in range(8)], [f"b{k}" for k in range(8)]]
    texts = [" ".join(rng.choices(rng.choice(kinds), k=60)) for _ in range(250)]
    rows = hmm.scored(spark, documents(spark, texts)).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_scores_cases(spark):
    assert hmm.scored(spark, empty(spark)).count() == 0
    same = spark.createDataFrame([(1, "b c"), (1, "b c"), (None, "a"), (2, None)], "doc_id long, text string")
    got = hmm.scored(spark, same).collect()
    assert len(got) == 4 and sorted(r["n_tokens"] for r in got) == [1, 2, 3, 3]


# 6 -------------------------------------------------------------------------------------------------------------------

def test_shards(spark):
    df = documents(spark, some_texts() * 12)
    got = sharding.sharded(df).collect()
    texts = some_texts() * 12
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r["doc_id"] // 3] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 40
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.sharded(df.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in got}
    assert sorted(r["row_number"] for r in got) == list(range(len(texts)))
    back = sharding.sharded(df).withColumn("n", sharding.row_number_at(F.col("shard"), F.col("slot"), len(texts)))
    assert back.where("n <> row_number").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 16, 17, 101, 1000])
def test_permutation_of_every_size(spark, n):
    got = spark.range(n).select("id", sharding.permuted(F.col("id"), n).alias("p")).withColumn(
        "b", sharding.permuted(F.col("p"), n, back=True)).collect()
    assert sorted(r["p"] for r in got) == list(range(n)) and all(r["b"] == r["id"] for r in got)


def test_shard_cases(spark):
    assert sharding.sharded(empty(spark)).count() == 0
    same = spark.createDataFrame([(1, "b"), (1, "b"), (None, "a"), (None, None)], "doc_id long, text string")
    assert sorted(r["row_number"] for r in sharding.sharded(same).collect()) == [0, 1, 2, 3]
    plan = sharding.sharded(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 7 -------------------------------------------------------------------------------------------------------------------

def test_urls(spark):
    cases = {
        "http://a.net/": ("a.net", "/", "net/", "block"), "http://EXAMPLE.net/en/x?q": ("example.net", "/en/x", "example.net/en/", "allow"),
        "http://a.example.com/de/": ("a.example.com", "/de/", "example.com/de/", "block"), "http://x.org/fr/1": ("x.org", "/fr/1", "org/fr/", "allow"),
        "http://a.net": ("a.net", "", None, "allow"), "http://anet/": ("anet", "/", None, "allow"), "nothing": ("", "", None, "allow"),
        "http://spam-farm.example.org/en": ("spam-farm.example.org", "/en", None, "block"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "https://freedom.org/x": ("freedom.org", "/x", None, "allow"), "https://free.org/free": ("free.org", "/free", None, "allow"),
        "https://free-bets.org/": ("free-bets.org", "/", None, "block"), "http://x.org/EN/?a=http://y.net/": ("x.org", "/EN/", None, "allow"),
        "http://h#f": ("h", "", None, "allow"), "x" * 9000 + "://spam.org/": ("spam.org", "/", None, "block"),
    }
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = urls.judged(df).orderBy("page_id").collect()
    for r, (url, want) in zip(got, cases.items()):
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want, url
    assert urls.judged(df.where("false")).count() == 0 and urls.judged(df.union(df)).count() == 2 * len(cases)


# 8 -------------------------------------------------------------------------------------------------------------------

def plain_simhash(t):
    words = SPACED.findall((t or "").translate(LOWER))
    runs = [" ".join(words[k: k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_against_brute_force(spark):
    texts = some_texts()
    got = simhash.near_duplicates(spark, documents(spark)).orderBy("doc_id").collect()
    values = [plain_simhash(t) for t in texts]
    assert [r["fingerprint"] for r in got] == [f"{v:016x}" for v in values]
    assert [r["component_id"] for r in got] == [3 * c for c in brute_components(values, 2)]


@pytest.mark.parametrize("small", [2, 32])
@pytest.mark.parametrize("radius", [2, 4])
def test_links_join_all_within_the_radius(spark, monkeypatch, small, radius):
    monkeypatch.setattr(simhash, "SMALL", small)
    values = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        v = rng.choice(values)
        for _ in range(rng.randint(0, radius + 2)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    values = list(dict.fromkeys(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "node long, bits long")
    edges = [(r["a"], r["b"]) for r in simhash.links(spark, nodes, radius).collect()]
    joined = {r["node"]: r["label"] for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert [joined.get(i, i) for i in range(len(values))] == brute_components(values, radius)


def test_masks_cover(spark):
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(i):
            assert any(not m & (1 << i | 1 << j) for m in (m & (2**64 - 1) for m in masks))


def test_simhash_cases(spark):
    assert simhash.near_duplicates(spark, empty(spark)).count() == 0
    same = spark.createDataFrame([(5, "b c"), (4, "b c"), (None, "b c"), (None, "lonely one here"), (2, None), (7, " ")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(spark, same).collect()}
    assert got == {(5, 4), (4, 4), (None, 4), (None, None), (2, 2), (7, 2)}


# 9 -------------------------------------------------------------------------------------------------------------------

SCHEMA = "record_id long, url string, time long, status int, headers map<string,string>, digest string"


def test_revisits(spark):
    rows = [
        (1, "http://www.a.org/x/", 10, 200, {"ETag": '"1"', "Last-Modified": "m", "Content-Type": "t", "Date": "d1"}, "D1"),
        (2, "https://a.org/x#f", 20, 304, {"ETag": 'W/"1"', "Date": "d2", "Content-Type": "evil"}, None),
        (3, "http://a.org/x?utm_source=q", 30, 200, {"etag": '"2"'}, "D3"), (4, "http://a.org/x", 30, 304, {"Last-Modified": "m"}, None),
        (5, "http://a.org/x", 31, 304, {"ETag": '"1"'}, None), (6, "http://a.org/x", 9, 304, {"ETag": '"1"'}, None),
        (7, "http://a.org/x", 99, 304, None, None), (8, None, 50, 304, {"ETag": "e"}, None), (9, "http://a.org/x", None, 304, {}, None),
        (10, "http://b.org", 5, 301, {}, None), (11, "http://A.org:80/x", 40, 304, {"ETag": '"2"', "Vary": None}, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("slot", F.lit(1)).withColumn("response", F.lit("x"))
    got = {r["record_id"]: r for r in revisits.resolved(spark, df).collect()}
    assert {k: (r["response_id"], r["outcome"]) for k, r in got.items()} == {
        2: (1, "resolved"), 4: (1, "resolved"), 5: (3, "etag-differs"), 6: (None, "no-response"), 7: (3, "no-validator"),
        8: (None, "no-response"), 9: (None, "no-response"), 11: (3, "resolved")}
    assert got[2]["headers"] == {"etag": 'W/"1"', "last-modified": "m", "content-type": "t", "date": "d2"} and got[2]["digest"] == "D1"
    assert got[5]["headers"] is None and got[11]["headers"] == {"etag": '"2"'}
    assert revisits.resolved(spark, df.where("false")).count() == 0


def test_revisits_against_brute_force(spark):
    rows = []
    for i in range(600):
        status = rng.choice([200, 304])
        url = "http://hot.org/" if rng.random() < 0.4 else f"http://s{rng.randrange(20)}.org/p"
        rows.append((i, url, rng.randrange(3000), status, {"ETag": str(rng.randrange(3))}, f"d{i}" if status == 200 else None))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["record_id"]: (r["response_id"], r["outcome"]) for r in revisits.resolved(spark, df).collect()}
    for i, url, time, status, headers, _ in rows:
        if status == 304:
            before = max(((r[2], r[0], r[4]["ETag"]) for r in rows if r[3] == 200 and r[1] == url and r[2] < time), default=None)
            want = (None, "no-response") if before is None else (before[1], "resolved" if before[2] == headers["ETag"] else "etag-differs")
            assert got[i] == want


# 10 ------------------------------------------------------------------------------------------------------------------

def test_ids_are_the_tokenizers_own():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    theirs.encode_special_tokens = True
    ours = packing.TextIds(path)
    alphabet = "aeio nrst  \n\t'sß漢😀é0129,.!|<>- "
    texts = [t or "" for t in some_texts()] + ["".join(rng.choices(alphabet, k=rng.randint(0, 300))) for _ in range(300)]
    texts += ["<|endoftext|> x", " " * 5000, "don't we'll I'M"]
    for t, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        assert ours.ids(t) == np.array(e.ids, "<u4").tobytes()


def test_packing_is_whole(spark):
    import public_tokenizers

    texts = some_texts() + [text(rng.randint(1, 900)) for _ in range(80)] + [text(4000)]
    ids = packing.TextIds(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.packed(spark, documents(spark, texts)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert len(by_doc) == len(texts)
    for doc, parts in by_doc.items():
        whole = ids.ids(texts[doc // 3] or "") + bytes(4)
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(whole) // 4
            assert r["ids_crc32"] == zlib.crc32(whole[4 * at: 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(whole) // 4
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    tokens = sum(r["length"] for r in rows)
    assert len(by_sequence) <= 1.02 * tokens / 1024 + 1


def test_patterns_serve_every_piece():
    for trial in range(20):
        histogram = {rng.randint(1, 100): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
        plan = packing.patterns_of(histogram, 100)
        made = Counter()
        for times, pattern in plan:
            assert times > 0 and sum(s * c for s, c in pattern.items()) <= 100
            for s, c in pattern.items():
                made[s] += times * c
        assert made == histogram
        assert sum(t for t, _ in plan) >= sum(s * n for s, n in histogram.items()) / 100


def test_column_generation_reaches_the_optimum():
    # 3 pieces of 44 or 2 of 55 fill little; 44 + 55 fills 99: the program must find the mix.
    sizes, demand = np.array([44, 55]), np.array([30.0, 30.0])
    columns, used = packing.column_generation(sizes, demand, 100, gap=0)
    assert np.allclose(columns @ used, demand) and abs(used.sum() - 30) < 1e-6
    worth, pattern = packing.best_pattern(sizes, np.array([0.44, 0.6]), 100)
    assert abs(worth - 1.04) < 1e-9 and pattern.tolist() == [1, 1]


def test_first_basis_is_inverted():
    draw = np.random.default_rng(3)
    for m, length in ((1, 10), (30, 100), (209, 1024), (500, 1024)):
        sizes = np.sort(draw.choice(np.arange(1, length + 1), m, replace=False))
        columns, used, order = packing._first_columns(sizes, draw.integers(1, 400, m).astype(float), length)
        assert sorted(order) == list(range(m))
        inverse = packing.triangular_inverse(columns, order)
        at = draw.integers(0, m, 20)
        assert np.allclose((inverse[at][:, :, None] * columns[None]).sum(axis=1), np.eye(m)[at])


def test_many_lengths_are_planned_beside_a_session(spark):
    """Some hundred lengths, on the driver of a running session, without a limit of threads: it must not stand still."""
    assert spark.range(10).count() == 10
    draw = np.random.default_rng(5)
    histogram = {int(s): int(n) for s, n in zip(draw.choice(np.arange(1, 1025), 500, replace=False), draw.integers(1, 300, 500))}
    found = []
    work = threading.Thread(target=lambda: found.append(packing.patterns_of(histogram)), daemon=True)
    work.start()
    work.join(120)
    assert found, "planning did not end"
    made = Counter()
    for times, pattern in found[0]:
        for size, n in pattern.items():
            made[size] += times * n
    assert made == histogram


def test_packing_cases(spark):
    assert packing.packed(spark, empty(spark)).count() == 0
    same = spark.createDataFrame([(1, "b c"), (1, "b c"), (None, "a"), (2, None)], "doc_id long, text string")
    rows = packing.packed(spark, same).collect()
    assert len(rows) == 4 and {r["sequence_id"] for r in rows} == {0}
    assert sorted(r["offset"] for r in rows) == sorted(np.cumsum([0, *sorted((r["length"] for r in rows), reverse=True)])[:4].tolist())
