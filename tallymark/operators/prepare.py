"""Labelled texts: clean, keep first copies, split by class, number the classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.text import clean_label
from tallymark.operators.skew import bucket_counts, hash_rank, join_same, salted_lookup, text_key
from tallymark.session import written

SPLITS = ("train", "validation", "test")


def labelled(df: DataFrame, text: str = "text_original", keep: tuple[str, ...] = ("row_idx", "filename")) -> DataFrame:
    """Rows with a label, the label without question marks, the chosen text column as ``text``."""
    return df.where(F.col("label").isNotNull()).select(
        *keep, F.col(text).alias("text"), clean_label(F.col("label")).alias("label")
    )


def keep_first(df: DataFrame, keep: tuple[str, ...], text: str = "text", order: str = "row_idx") -> DataFrame:
    """One row per text, the first by ``order``, with the columns of ``keep`` and its ``text_key`` and ``copies``.

    A hash aggregate over short columns finds the first ``order`` value and the number of copies; copies of a text
    collapse before the shuffle, so a text that makes up a third of the table reaches its reducer as one row per map
    task. The other columns are then fetched by that value, which must be a key of the rows; the text travels only if ``keep`` names
    it, and only for first copies.
    """
    firsts = df.groupBy(text_key(F.col(text)).alias("text_key")).agg(
        F.min(order).alias("_first"), F.count(F.lit(1)).alias("copies"))
    rest = [c for c in dict.fromkeys(keep) if c != order]
    found = firsts if not rest else firsts.join(df.select(F.col(order).alias("_first"), *rest), "_first")
    named = [F.col("_first").alias(order) if c == order else F.col(c) for c in dict.fromkeys(keep)]
    return found.select("text_key", "copies", *named)


def first_rows(df: DataFrame, n: int, order: str = "row_idx") -> DataFrame:
    """The first n rows in file order."""
    return df.orderBy(order).limit(n)


def count_labels(df: DataFrame, by: tuple[str, ...] = ("label",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def label_ids(df: DataFrame, label: str = "label") -> DataFrame:
    """Classes numbered from 0 in sorted order. The window runs over the distinct classes only."""
    classes = df.select(label).where(F.col(label).isNotNull()).distinct()
    return classes.withColumn("label_id", F.row_number().over(Window.orderBy(label)) - 1)


def split_quotas(class_counts: DataFrame, held_out: float = 0.8, test_share: float = 0.5) -> DataFrame:
    """Rows per class (``label, n``) that go to train and to validation, the others being for test, and ``label_id``.

    Input and output have one row per class, so the windows over all of it stay small.
    """
    rest = _with_quota(class_counts, "n", held_out, "n_train").withColumn("_rest", F.col("n") - F.col("n_train"))
    return _with_quota(rest, "_rest", test_share, "n_validation").withColumn(
        "label_id", F.row_number().over(Window.orderBy("label")) - 1
    ).drop("_rest")


def _with_quota(df: DataFrame, size: str, set_aside: float, out: str) -> DataFrame:
    """Deal the rows that are not set aside over the classes: whole shares, then one each by largest remainder."""
    everything = Window.partitionBy()
    by_remainder = Window.orderBy(F.col("_remainder").desc(), F.col("label"))
    return (
        df.withColumn("_all", F.sum(size).over(everything))
        .withColumn("_draws", F.col("_all") - F.ceil(F.col("_all").cast("double") * F.lit(set_aside)))
        .withColumn("_product", F.col(size).cast("decimal(19,0)") * F.col("_draws").cast("decimal(19,0)"))
        .withColumn("_whole", F.expr("coalesce(_product div nullif(_all, 0), 0)"))
        .withColumn("_remainder", F.col("_product") - F.col("_whole") * F.col("_all"))
        .withColumn("_open", F.col("_draws") - F.sum("_whole").over(everything))
        .withColumn(
            out,
            (F.col("_whole") + (F.row_number().over(by_remainder) <= F.col("_open")).cast("long")).cast("long"),
        )
        .drop("_all", "_draws", "_product", "_whole", "_remainder", "_open")
    )


def seeded_hash(key: str, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))


def stratified_split(
    df: DataFrame, seed: int = 42, key: str = "text_key", tie: str = "row_idx",
    held_out: float = 0.8, test_share: float = 0.5,
) -> DataFrame:
    """Add ``split`` so that every class is spread over train, validation and test by the same shares, and ``label_id``.

    ``df`` holds one row per text. Rows are taken in the order of a seeded hash of their key, so the same rows always
    land in the same split. The defaults give 20, 40 and 40 percent. Rows without a label are a class of their own.
    """
    hashed = df.withColumn("_hash", seeded_hash(key, seed))
    buckets = bucket_counts(hashed, "label", "_hash")
    quotas = split_quotas(buckets.groupBy("label").agg(F.sum("_n").alias("n")), held_out, test_share)
    ranked = hash_rank(hashed, "label", "_hash", tie, join_same(buckets, quotas.drop("n"), ["label"]))
    last_validation = F.col("n_train") + F.col("n_validation")
    split = (
        F.when(F.col("rank") <= F.col("n_train"), F.lit("train"))
        .when(F.col("rank") <= last_validation, F.lit("validation"))
        .otherwise(F.lit("test"))
    )
    return ranked.withColumn("split", split).drop("_hash", "rank", "n_train", "n_validation")


def split_of(df: DataFrame, split: str) -> DataFrame:
    """The rows of one split, or of ``all`` with the split kept."""
    if split == "all":
        return df
    return df.where(F.col("split") == split).drop("split")


def look_up_split(df: DataFrame, splits: DataFrame, text: str = "text", spread_by: str = "row_idx") -> DataFrame:
    """Add the split of each row's text from the split table of ``keep_first`` and ``stratified_split``.

    Only text keys are compared. Which texts are hot is counted on ``df`` itself, which need not be the table that the splits
    were made from.
    """
    keyed = df.withColumn("text_key", text_key(F.col(text)))
    return salted_lookup(keyed, splits.select("text_key", "split"), "text_key", spread_by, "left")


def prepare(
    df: DataFrame, keep: tuple[str, ...] = ("row_idx", "filename"), seed: int = 42, text: str = "text",
) -> DataFrame:
    """From raw rows to one row per text: ``keep``, ``label``, ``label_id``, ``split``, ``text_key`` and ``copies``. ``text`` names
    the text column, such as ``text_original`` of stored pages.

    The first copies are stored before they are split: the texts are read and hashed once, and the counting and ranking
    that follow read only short columns of the stored table.
    """
    columns = tuple(dict.fromkeys((*keep, "row_idx", "label")))
    source = tuple(c for c in columns if c not in ("label", "text"))
    firsts = written(df.sparkSession, keep_first(labelled(df, text, source), columns), "first-copies")
    return stratified_split(firsts, seed)
