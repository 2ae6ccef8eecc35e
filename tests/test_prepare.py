import hashlib
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tallymark.operators import pairs, prepare, skew

rng = random.Random(11)
# One text makes up a third of the rows, one class most of them.
ROWS = [
    (i, f"f{i % 7}.txt", "hot" if i % 3 == 0 else f"text {rng.randint(0, 150)}", None if i % 31 == 0 else
     ("b?" if i % 5 == 0 else "b") if i % 9 != 1 else "a")
    for i in range(900)
]
SCHEMA = "row_idx long, filename string, text string, label string"


def firsts():
    seen = {}
    for i, f, text, label in ROWS:
        if label is not None:
            seen.setdefault(text, (i, f, label.replace("?", "")))
    return seen


def deal(sizes: dict, aside: float) -> dict:
    total = sum(sizes.values())
    draws = total - math.ceil(aside * total)
    quota = {c: n * draws // total for c, n in sizes.items()}
    order = sorted(sizes, key=lambda c: (-(sizes[c] * draws % total), c))
    for c in order[: draws - sum(quota.values())]:
        quota[c] += 1
    return quota


def expected_splits():
    by_class = {}
    for text, (i, _, label) in firsts().items():
        key = hashlib.sha256(text.encode()).hexdigest()
        by_class.setdefault(label, []).append((hashlib.md5(f"42:{key}".encode()).hexdigest(), i))
    sizes = {c: len(v) for c, v in by_class.items()}
    train = deal(sizes, 0.8)
    validation = deal({c: sizes[c] - train[c] for c in sizes}, 0.5)
    out = {}
    for c, members in by_class.items():
        for place, (_, i) in enumerate(sorted(members)):
            out[i] = "train" if place < train[c] else "validation" if place < train[c] + validation[c] else "test"
    return out


def test_keep_first_with_a_hot_text(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = prepare.keep_first(prepare.labelled(df, "text"), ("row_idx", "filename", "label")).collect()
    assert {(r["row_idx"], r["filename"], r["label"]) for r in got} == set(firsts().values())
    copies = Counter(text for _, _, text, label in ROWS if label is not None)
    assert sorted(r["copies"] for r in got) == sorted(copies.values())


def test_split_against_brute_force(spark):
    got = prepare.prepare(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert {r["row_idx"]: r["split"] for r in got} == expected_splits()
    assert {(r["label"], r["label_id"]) for r in got} == {("a", 0), ("b", 1)}
    assert prepare.prepare(spark.createDataFrame(ROWS, SCHEMA), seed=43).filter("split = 'train'").count() == \
        sum(s == "train" for s in expected_splits().values())


def test_every_copy_finds_its_split(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    splits = prepare.prepare(df)
    by_text = {text: expected_splits()[i] for text, (i, _, _) in firsts().items()}
    got = prepare.look_up_split(df, splits).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r["split"] == by_text.get(r["text"])


def test_quotas_for_many_classes(spark):
    for trial in range(5):
        sizes = {f"c{k}": random.Random(trial * 10 + k).randint(1, 40) for k in range(1 + trial)}
        got = prepare.split_quotas(spark.createDataFrame(list(sizes.items()), "label string, n long")).collect()
        train = deal(sizes, 0.8)
        validation = deal({c: sizes[c] - train[c] for c in sizes}, 0.5)
        assert {r["label"]: (r["n_train"], r["n_validation"]) for r in got} == {
            c: (train[c], validation[c]) for c in sizes}


def test_label_ids_counts_and_frames(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "label string")
    assert {(r[0], r[1]) for r in prepare.label_ids(df).collect()} == {("a", 0), ("b", 1)}
    assert {(r[0], r[1]) for r in prepare.count_labels(df).collect()} == {("a", 1), ("b", 2), (None, 1)}
    frame = spark.createDataFrame([(1, "train"), (2, "test")], "i int, split string")
    assert [tuple(r) for r in prepare.split_of(frame, "test").collect()] == [(2,)]
    assert prepare.split_of(frame, "all").columns == ["i", "split"]


def test_rows_without_text_are_one_text(spark):
    df = spark.createDataFrame([(1, "f", None, "a"), (2, "f", None, "a"), (3, "f", "x", "a")], SCHEMA)
    splits = prepare.prepare(df)
    assert sorted(r["row_idx"] for r in splits.collect()) == [1, 3]
    assert all(r["split"] for r in prepare.look_up_split(df, splits).collect())


def test_first_rows(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "row_idx int, x string")
    assert [r["x"] for r in prepare.first_rows(df, 2).collect()] == ["a", "b"]


def test_hot_keys_and_salted_join(spark):
    left = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    right = spark.range(-1, 1500).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert [r["k"] for r in skew.hot_keys(left, "k").collect()] == [-1]
    for how in ("left", "inner", "left_semi"):
        want = sorted(map(tuple, left.join(right, "k", how).select("id", "k").collect()))
        got = skew.salted_lookup(left, right, "k", "id", how)
        assert sorted(map(tuple, got.select("id", "k").collect())) == want


def test_hash_rank_is_exact(spark):
    rows = [(i, "big" if i % 4 else "small", hashlib.md5(str(i // 2).encode()).hexdigest()) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, g string, h string")
    got = skew.hash_rank(df, "g", "h", "i", skew.bucket_counts(df, "g", "h")).collect()
    for group in ("big", "small"):
        order = sorted((h, i) for i, g, h in rows if g == group)
        place = {i: n + 1 for n, (_, i) in enumerate(order)}
        assert {r["i"]: r["rank"] for r in got if r["g"] == group} == place


def test_pairs(spark):
    splits = prepare.prepare(spark.createDataFrame(ROWS, SCHEMA))
    train = splits.where("split = 'train'")
    label = {r["row_idx"]: r["label"] for r in train.collect()}
    got = pairs.pair_table(train, 3).collect()
    assert len(got) == len(label) * 6
    sizes = Counter(label.values())
    for r in got:
        assert (label[r["row_1"]] == label[r["row_2"]]) == bool(r["same"])
    partners = {}
    for r in got:
        partners.setdefault((r["row_1"], r["same"]), set()).add(r["row_2"])
    for (row, same), found in partners.items():
        others = sizes[label[row]] if same else len(label) - sizes[label[row]]
        assert len(found) == min(3, others)
        if same and sizes[label[row]] > 3:
            assert row not in found


def test_pairs_of_a_single_class(spark):
    df = spark.createDataFrame([("x", 1, "a")], "text_key string, row_idx long, label string")
    assert [tuple(r) for r in pairs.pair_table(df).collect()] == [(1, 1, 1, 1)]


def test_rows_without_a_class_are_a_class(spark):
    rows = spark.createDataFrame([(i, str(i), None if i % 5 == 0 else "a") for i in range(20)], "row_idx int, text_key string, label string")
    got = prepare.stratified_split(rows).collect()
    assert sorted(r["row_idx"] for r in got) == list(range(20))


def test_a_hot_unlabelled_text_is_spread(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"t{i}") for i in range(3000)], "row_idx int, text string")
    splits = spark.createDataFrame([("x", "train")], "text string, split string").select(
        skew.text_key(F.col("text")).alias("text_key"), "split")
    got = prepare.look_up_split(df, splits)
    assert got.count() == 3000
    hot = skew.hot_keys(df, "text").collect()
    assert [r["text"] for r in hot] == ["hot"] and 0.6 < hot[0]["_part"] < 0.7


def test_pairs_of_uneven_classes(spark):
    from tallymark.operators import pairs

    rows = spark.createDataFrame([(i, str(i), "b" if i == 7 else "a") for i in range(2000)], "row_idx int, text_key string, label string")
    got = pairs.pair_table(rows).where("same = 0").collect()
    assert len(got) == 2000 and {r["row_2"] for r in got if r["row_1"] != 7} == {7}
