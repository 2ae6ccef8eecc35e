"""The pipeline's stages on a small corpus with planted cases, and the registered queries on the smallest test tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallymark.llm import catalog, minhash, oracle, simhash
from tools.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
rng = random.Random(9)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents 0-399 clean; then junk, toxic, exact copies, and documents with a test item."""
    path = str(tmp_path_factory.mktemp("sf"))
    pool = [f"g{k}" for k in range(400)]
    clean = [" ".join(rng.choices(pool, k=rng.randint(40, 300))) for _ in range(400)]
    junk = [" ".join(w + "###" for w in rng.choices(pool, k=60)) for _ in range(60)]
    toxic = [" ".join([*rng.choices(pool, k=80), "moron"]) for _ in range(60)]
    items = [" ".join(rng.choices(pool, k=20)) for _ in range(5)]
    leaks = [f"{clean[k]} {items[k]} {clean[k + 5]}" for k in range(5)]
    texts = [*clean, *junk, *toxic, *clean[:20], *leaks, None, ""]
    docs = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0 if 400 <= i < 460 else 1, int(460 <= i < 520)) for i in range(520) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, folder)
        assert at.columns == docs.columns
        at = spark.createDataFrame(at.collect(), docs.schema)
        kept[name] = {r["doc_id"] for r in at.collect()}
    assert len(set(range(400)) - kept["quality"]) <= 6 and len(kept["quality"] & set(range(400, 520))) <= 6  # few labels
    good = set(range(400)) & kept["quality"]
    assert good <= kept["near_dedup"] and not kept["near_dedup"] & set(range(520, 540))
    assert good <= kept["decontamination"] and not kept["decontamination"] & set(range(540, 545))
    packed = corpus_pipeline.STAGES[-1][1](spark, at, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept["decontamination"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()} == kept["decontamination"]


def test_stages_on_odd_rows(spark, folder):
    """Nulls in any column, repeated rows, no rows, and further columns with names the operators use."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.limit(40).unionByName(docs.limit(3)).unionByName(spark.createDataFrame(
        [(None, None, None, None, None), (None, "x y z", None, None, None), (1, "other text of one", None, None, 0)], docs.schema))
    odd = odd.withColumn("bits", F.lit("b")).withColumn("_log_odds", F.lit(1)).withColumn("c0", F.lit(None).cast("string"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns
        assert out.count() > 0 and stage(spark, odd.where("false"), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, folder).count() >= odd.count()
    assert corpus_pipeline.STAGES[-1][1](spark, odd.where("false"), folder).count() == 0
    near = corpus_pipeline.near_dedup(spark, odd, folder)
    # Both texts of id 1 stay; of the rows without an id the one without a text and the one of three words.
    assert near.where("doc_id = 1").count() == 2 and near.where("doc_id IS NULL").count() == 2


def test_near_dedup_against_brute_force(spark):
    """One row of each component of fingerprints within two bits stays: that of the smallest id. Distances from 0 to 8 occur."""
    draw = random.Random(4)
    rows = []
    for k in range(60):
        first = [f"w{draw.randrange(5000)}" for _ in range(draw.choice([3, 30, 400, 1500]))]
        rows.append(" ".join(first))
        for edits in draw.sample(range(4), draw.randrange(3)):
            second = list(first)
            for e in range(edits):
                second[draw.randrange(len(second))] = f"e{e}"
            rows.append(" ".join(second))
    rows += [None, "", " \t"]
    draw.shuffle(rows)
    bits = [simhash.fingerprint(t) for t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == [i for i in range(len(rows)) if find(i) == i]
    assert 60 < len(kept) < len(rows) - 10


def test_near_copies_of_minhash(spark):
    """Near copies of a Jaccard of 0.8 to 0.97 are one class, those below 0.8 are not."""
    draw = random.Random(4)
    texts, kept = [], []
    for k, (words, edits) in enumerate([(300, 1), (300, 3), (300, 5), (300, 6), (120, 1), (120, 2), (300, 9), (120, 4)] * 5):
        first = [f"w{draw.randrange(5000)}" for _ in range(words)]
        second = [f"e{k}" if i % (words // (edits + 1)) == 0 and 0 < i // (words // (edits + 1)) <= edits else w for i, w in enumerate(first)]
        a, b = ({tuple(t[i: i + 5]) for i in range(words - 4)} for t in (first, second))
        kept += [len(texts)] + [len(texts) + 1] * (len(a & b) < 0.8 * len(a | b))
        texts += [" ".join(first), " ".join(second)]
    assert len(kept) == 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keep = minhash.representatives(spark, docs)
    found = docs.join(keep, (F.xxhash64("doc_id") == keep["place"]) & (minhash.copy_key(F.col("text")) == keep["copy"]), "left_semi")
    assert sorted(r["doc_id"] for r in found.collect()) == kept


def test_repeated_and_null_ids_lose_no_text(spark):
    """Id 5 has a copy of document 3 and a text of its own, which stays; copies under null ids are dropped."""
    own = [" ".join(f"{name}{k}" for k in range(60)) for name in "abcdefg"]
    rows = [(3, own[0]), (5, own[0]), (5, own[1]), (5, own[1]), (6, own[2]), (None, own[3]), (None, own[3]), (None, own[0]), (None, own[4])]
    rows += [(7, own[k]) for k in (5, 6)] * 20
    docs = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted([
        ("3", own[0]), ("5", own[1]), ("6", own[2]), ("7", own[5]), ("7", own[6]), ("None", own[3]), ("None", own[4])])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_matches_sql(spark, name):
    assert differences(catalog.QUERIES[name](spark, FOLDER), connect(FOLDER), oracle.SQL[name]) == []
