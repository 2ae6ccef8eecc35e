"""Registered queries: name -> function of a session and a folder of test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.fixed import DISPLAY_NAMES, FIELDS, MATCH_FIELDS, NEGATIVE, NO, OK, POSITIVE, SCORE_FIELDS, YES
from tallymark.functions import answers as A
from tallymark.functions import records as R
from tallymark.functions import scores as S
from tallymark.functions import text as X
from tallymark.functions.parse import cleaned_answer, first_list, with_parsed_answer
from tallymark.functions.vectors import label_catalogue, nearest_label
from tallymark.operators import (
    bayes, classify, contrastive, metrics, nearest, pairs, prepare, prompting, reports, resume, scoring, search,
)
from tallymark.plans import inputs
from tallymark.operators.prompting import stub_generate
from tallymark.plans.inputs import PAGE_KEY
from tallymark.session import scratch_path, written
from tallymark.sources import pages as page_files
from tallymark.sources import records as record_files
from tallymark.sources import results
from tallymark.sources.prompts import PROMPTS, select_prompts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEED = 42


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# Inputs shared by several queries -----------------------------------------------------------------------------------

def _parsed(spark: SparkSession, sf: str, mode: str = "exact") -> DataFrame:
    return inputs.with_truth(with_parsed_answer(inputs.pages(spark, sf), mode=mode))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.with_scores(_parsed(spark, sf))


def _splits(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Deduplicated labelled texts with their split."""
    return prepare.prepare(inputs.texts(spark, sf), ("row_idx", "filename", *more), SEED)


def _stored_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a stored table, for queries that read it more than once."""
    return written(spark, _splits(spark, sf), "splits")


def _page_rows(df: DataFrame, *columns) -> DataFrame:
    return df.select(*PAGE_KEY, *columns)


def _long_record_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Record scores per order, from one row per line."""
    lines = inputs.lines(spark, sf).select("l_orderkey", *[
        F.when(F.col(c).isNotNull(), R.match_key(R.normalized(F.array(c))[0])).alias(c) for c in ("truth", "found")
    ])
    keys = scoring.key_rows(lines, "l_orderkey", F.col("truth"), F.col("found"))
    return scoring.long_scores(inputs.orders(spark, sf), keys, "l_orderkey")


# Sources, sinks, catalogue ------------------------------------------------------------------------------------------

@query
def jsonl_records(spark, sf):
    """Write annotated pages as JSON lines, scan them back with the declared schema."""
    path = scratch_path(spark, "records")
    pages = inputs.pages(spark, sf)
    record_files.write_records(pages.select(
        "filename", F.col("list_text").alias("text_original"), F.lit(None).cast("string").alias(
            "text_stripped_empty_spaces"), "label", F.col("list_text").alias("context"), "criteria_info",
    ), path)
    df = record_files.read_records(spark, path)
    return df.select(
        "filename", "label", F.size("criteria_info").alias("n_records"), F.length("context").alias("context_length"),
        R.records_text(F.col("criteria_info")).alias("records_text"),
    )


@query
def page_name_parts(spark, sf):
    """Tender number and document out of a page file name."""
    docs = inputs.table(spark, sf, "documents")
    name = F.concat_ws("_", F.col("doc_id").cast("string"), "source", F.concat("lang", F.lit(".txt")))
    return docs.select(name.alias("filename")).select(
        "filename", page_files.tender_id(F.col("filename")).alias("tender_id"),
        page_files.document_name(F.col("filename")).alias("document"),
    )


def _stored_pages(spark, sf) -> str:
    path = scratch_path(spark, "page-files")
    host = F.regexp_replace(F.regexp_extract("url", "^[^/]*//([^/?#]*)", 1), "[^A-Za-z0-9.-]", "-")
    name = F.concat(F.col("page_id").cast("string"), F.lit("_"), host, F.lit(".txt"))
    page_files.write_page_folder(inputs.table(spark, sf, "pages").select(name.alias("filename"), F.col("html").alias("text")), path)
    return path


@query
def stored_pages(spark, sf):
    """Pages written as one file each by name, and read back with the parts of their names."""
    found = page_files.page_folder(spark, _stored_pages(spark, sf), NEGATIVE)
    return found.select("filename", "tender_id", "document", F.md5(F.col("text").cast("binary")).alias("text_md5"), "label")


@query
def pages_by_name(spark, sf):
    """Stored pages whose name is asked for; the filter is answered from the folder's list, before files are opened."""
    found = page_files.page_folder(spark, _stored_pages(spark, sf))
    some = found.where(F.col("tender_id").startswith("1") & F.col("document").contains("a"))
    return some.select("filename", "tender_id", "document", F.length("text").alias("text_length"))


@query
def stored_page_splits(spark, sf):
    """Pages written as JSON lines, read back, cleaned by the stripped text and split."""
    path = scratch_path(spark, "stored-pages")
    texts = inputs.texts(spark, sf).where("text IS NOT NULL")
    record_files.write_records(texts.select(
        F.col("row_idx").cast("string").alias("filename"), F.col("text").alias("text_original"),
        X.stripped(F.col("text")).alias("text_stripped_empty_spaces"), "label", F.col("text").alias("context"),
        R.empty_records().alias("criteria_info")), path)
    pages = record_files.read_records(spark, path).withColumn("row_idx", F.col("filename").cast("long"))
    return prepare.prepare(pages, ("row_idx",), SEED, "text_stripped_empty_spaces").select(
        F.col("row_idx").alias("doc_id"), "label", "split")


@query
def extraction_store(spark, sf):
    """Store a scored run by model, prompt and label view, count what lies in every part."""
    path = scratch_path(spark, "extraction")
    results.write_extraction(scoring.with_texts(_scored(spark, sf)), path, "vendor/model-a", PAGE_KEY)
    views = results.read_extraction(spark, path, "views")
    return views.groupBy("model", "prompt_id", "label_view").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("conversion_status") == OK).alias("n_ok"),
        F.sum(F.length("y_true_as_string")).alias("true_chars"),
        F.sum(F.length("y_pred_as_string")).alias("pred_chars"),
    )


@query
def report_from_store(spark, sf):
    """The record report of one model from its newest whole run, found by the manifest; a run that broke off beside it is not seen."""
    path = scratch_path(spark, "stored")
    scored = scoring.with_texts(_scored(spark, sf))
    results.publish_extraction(scored.where(F.col("prompt_id") == "prompt_1"), path, "vendor/model-a", PAGE_KEY)
    results.publish_extraction(scored, path, "vendor/model-a", PAGE_KEY)
    newest = results.published(spark, path, "scored", ["vendor/model-a"])
    newest.limit(1).write.parquet(f"{path}/{results.RUNS}/broken/scored")  # no row of the manifest names it
    return reports.re_overview(newest)


@query
def classifier_store(spark, sf):
    """Publish predictions and metrics of both splits as one run, read the combined sheet back."""
    path = scratch_path(spark, "classifier")
    rows = written(spark, _with_predictions(spark, sf), "predictions")
    results.publish(spark, path, "classifier", results.classifier_sheets(rows, {"max_iter": 100, "seed": SEED}))
    return results.published(spark, path, "scores_validation_and_test_set")


def _with_predictions(spark, sf) -> DataFrame:
    return _splits(spark, sf, "label_predicted").withColumnRenamed("label_predicted", "predicted_label")


# Projections and filters --------------------------------------------------------------------------------------------

@query
def clean_labels(spark, sf):
    """Labelled rows, label without question marks."""
    return prepare.labelled(inputs.texts(spark, sf), "text").select(
        F.col("row_idx").alias("doc_id"), "filename", "label", F.length("text").alias("text_length"))


@query
def mode_filter(spark, sf):
    """Pages of one class."""
    return inputs.pages(spark, sf).where(F.col("label") == POSITIVE).drop("criteria_info", "pred_output_as_string")


@query
def parsed_rows(spark, sf):
    """Parsed answers of one prompt."""
    pages = inputs.with_truth(inputs.pages(spark, sf)).where(F.col("prompt_id") == "prompt_1")
    parsed = with_parsed_answer(pages).where(F.col("conversion_status") == OK)
    return _page_rows(parsed, F.size("y_pred").alias("n_predicted"))


@query
def first_rows(spark, sf):
    """The first 100 labelled rows in file order."""
    return prepare.first_rows(inputs.texts(spark, sf), 100).select(F.col("row_idx").alias("doc_id"), "label")


@query
def constant_columns(spark, sf):
    """Constant columns beside the data, everything as text."""
    df = inputs.texts(spark, sf).select(
        F.col("row_idx").alias("doc_id"), F.length("text").alias("text_length"),
        F.lit("prompt_1").alias("prompt_id"), F.lit("").alias("error_message"), F.lit("m1").alias("model"),
    )
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query
def binary_labels(spark, sf):
    """1 for the positive class, 0 for all else."""
    return _page_rows(
        inputs.pages(spark, sf), A.is_positive(F.col("label")).alias("y_true"),
        A.is_positive(F.col("label_predicted")).alias("y_pred"),
    )


@query
def decoded_classes(spark, sf):
    """Class of the largest probability, and its name."""
    vectors = inputs.table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("probability"))
    best = A.best_class(F.col("probability"))
    return vectors.select(
        "vec_id", best.alias("class_id"), A.decode_class(best, {k: f"class {k}" for k in range(64)}).alias("class_name"))


@query
def display_names(spark, sf):
    """Report names of prompts."""
    return _page_rows(
        inputs.pages(spark, sf), X.display_name(F.col("prompt_id"), DISPLAY_NAMES).alias("prompt_name"))


@query
def parsed_flags(spark, sf):
    """Spelled booleans."""
    words = F.array(*[F.lit(w) for w in ("yes", "No", "TRUE", "f", "1", "0", "y")])
    docs = inputs.table(spark, sf, "documents").select(
        "doc_id", F.get(words, (F.col("doc_id") % 8).cast("int")).alias("word"))
    return docs.select("doc_id", "word", X.parse_flag(F.col("word")).alias("flag"))


@query
def field_views(spark, sf):
    """Record texts of every label view."""
    views = scoring.with_field_views(_parsed(spark, sf))
    return _page_rows(views, "label_view", "y_true_as_string", "y_pred_as_string")


# Joins --------------------------------------------------------------------------------------------------------------

@query
def prompt_fanout(spark, sf):
    """Every extraction prompt with every document, rendered."""
    docs = inputs.table(spark, sf, "documents").select("doc_id", F.col("text").alias("context"))
    asked = prompting.render(prompting.fan_out(docs, select_prompts("extract")))
    return asked.select(
        "doc_id", "prompt_id", F.length("instruction").alias("instruction_length"),
        F.md5("instruction").alias("instruction_md5"))


@query
def split_lookup(spark, sf):
    """The split of every labelled row by its text, copies included."""
    rows = prepare.labelled(inputs.texts(spark, sf), "text")
    found = prepare.look_up_split(rows, _stored_splits(spark, sf))
    return found.select(F.col("row_idx").alias("doc_id"), "label", "split")


@query
def split_semi_join(spark, sf):
    """Labelled rows whose file name occurs in the validation split."""
    rows = inputs.texts(spark, sf).select("row_idx", "filename", "label")
    return metrics.rows_of_split(rows, _stored_splits(spark, sf), "validation").select(
        F.col("row_idx").alias("doc_id"), "filename")


@query
def re_overview_merged(spark, sf):
    """Macro and micro record report side by side, both from one stored run."""
    scored = written(spark, _scored(spark, sf).select("prompt_id", "label", "key_value_eval"), "scored")
    return reports.merged(
        reports.re_overview(scored, averages=("macro",)), reports.re_overview(scored, averages=("micro",)))


@query
def metrics_side_by_side(spark, sf):
    """Validation and test scores by metric name."""
    rows = _with_predictions(spark, sf)
    long = metrics.long_metrics(metrics.wide_metrics(rows, "label", "predicted_label", ("split",)), ("split",))
    return metrics.side_by_side(long.where(F.col("split") == "validation"), long.where(F.col("split") == "test"))


@query
def nearest_labels(spark, sf):
    """Nearest label of every vector by cosine."""
    vectors = inputs.table(spark, sf, "embeddings")
    catalogue = label_catalogue(
        vectors.select(F.col("label").cast("string").alias("label"), "embedding", "vec_id"),
        "label", "embedding", "vec_id", [str(k) for k in range(10)])
    best = vectors.select("vec_id", nearest_label(F.col("embedding"), catalogue).alias("best"))
    return best.select("vec_id", F.col("best.label").alias("nearest"), F.round("best.score", 6).alias("score"))


@query
def concatenated_texts(spark, sf):
    """Original and stripped texts as one table."""
    both = F.explode(F.array("text", X.stripped(F.col("text")))).alias("text")
    return inputs.texts(spark, sf).select("row_idx", "label", both).select(
        F.col("row_idx").alias("doc_id"), "label", F.length("text").alias("text_length"))


@query
def label_unions(spark, sf):
    """Sorted union and overlap of true and predicted record keys."""
    parsed = _parsed(spark, sf)
    truth = R.match_keys(F.col("y_true"))
    found = R.match_keys(F.coalesce(F.col("y_pred"), R.empty_records()))
    keyed = parsed.select(*PAGE_KEY, truth.alias("t"), found.alias("p"))
    return _page_rows(
        keyed, F.array_join(R.merged_lists(F.col("t"), F.col("p")), "|").alias("labels"),
        S.overlap_size(F.col("t"), F.col("p")).alias("n_common"))


# Scalars ------------------------------------------------------------------------------------------------------------

@query
def context_lengths(spark, sf):
    """Length of every document in characters."""
    docs = inputs.table(spark, sf, "documents")
    return docs.select("doc_id", X.text_length(F.col("text")).alias("context_length"))


@query
def answer_labels(spark, sf):
    """T4, T5: class of a yes/no answer by its first word."""
    answers = inputs.answers(spark, sf)
    return answers.select("conv_id", "turn", A.presence_label(F.col("answer")).alias("label_predicted"))


@query
def answer_labels_fallback(spark, sf):
    """T5 with J6: answers that say neither get the class of the nearest of two label vectors."""
    vectors = inputs.table(spark, sf, "embeddings")
    named = vectors.select(
        F.when(F.col("label") == 0, F.lit(YES)).when(F.col("label") == 1, F.lit(NO)).alias("label"),
        "embedding", "vec_id").where(F.col("label").isNotNull())
    catalogue = label_catalogue(named, "label", "embedding", "vec_id", (YES, NO))
    answers = inputs.answers(spark, sf).join(
        vectors.select(F.col("vec_id").alias("conv_id"), "embedding"), "conv_id", "left")
    nearest = nearest_label(F.col("embedding"), catalogue)["label"]
    return answers.select(
        "conv_id", "turn", A.presence_label(F.col("answer"), nearest).alias("label_fixed"),
        A.presence_label(F.col("answer"), nearest, "compat").alias("label_compat"))


@query
def cleaned_answers(spark, sf):
    """Cleaned answer and its first list."""
    pages = inputs.pages(spark, sf).withColumn("cleaned", cleaned_answer(F.col("pred_output_as_string")))
    return _page_rows(pages, "cleaned", first_list(F.col("cleaned")).alias("found_list"))


@query
def parse_status(spark, sf):
    """T8, T9 exact: state, error flag and number of records of every answer."""
    return _parse_rows(spark, sf, "exact")


@query
def parse_status_native(spark, sf):
    """T8, T9 native: the same with the JSON parser alone."""
    return _parse_rows(spark, sf, "native")


def _parse_rows(spark, sf, mode) -> DataFrame:
    return _page_rows(
        _parsed(spark, sf, mode), "conversion_status", (F.col("error_message") != "").alias("has_error"),
        F.coalesce(F.size("y_pred"), F.lit(0)).alias("n_predicted"))


@query
def digit_values(spark, sf):
    """Digits of mixed texts."""
    pages = inputs.pages(spark, sf)
    return _page_rows(pages, X.digits_only(F.col("list_text")).alias("digits"))


@query
def normalized_records(spark, sf):
    """Every predicted record after cleaning, one row each."""
    found = _parsed(spark, sf).select(*PAGE_KEY, F.posexplode_outer("y_pred").alias("pos", "r"))
    found = found.where(F.col("pos").isNotNull())
    return _page_rows(found, "pos", *[F.col("r")[f].alias(f) for f in FIELDS])


@query
def records_as_text(spark, sf):
    """Both record lists as sorted sentences."""
    return _page_rows(scoring.with_texts(_parsed(spark, sf)), "y_true_as_string", "y_pred_as_string")


@query
def records_as_json(spark, sf):
    """Annotated records as nested JSON texts."""
    return _page_rows(
        inputs.with_truth(inputs.pages(spark, sf)), R.records_json(F.col("y_true")).alias("y_true_as_json"))


@query
def match_keys(spark, sf):
    """Comparison key of every annotated record."""
    df = inputs.with_truth(inputs.pages(spark, sf))
    return df.select(*PAGE_KEY, F.posexplode(R.match_keys(F.col("y_true"))).alias("pos", "match_key"))


@query
def field_values(spark, sf):
    """Present values of every field over the annotated records."""
    df = inputs.with_truth(inputs.pages(spark, sf))
    return _page_rows(
        df, *[F.array_join(R.field_values(F.col("y_true"), f), "|").alias(f) for f in FIELDS])


@query
def percent_scores(spark, sf):
    """Ratios as percent."""
    return inputs.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        X.as_percent(F.sum((F.col("l_returnflag") == "A").cast("int")) / F.count(F.lit(1))).alias("percent"))


# Scores, metrics, reports -------------------------------------------------------------------------------------------

def _score_columns(column: str) -> list:
    return [F.col(f"{column}.{m}").alias(m) for m in SCORE_FIELDS]


@query
def record_scores(spark, sf):
    """The eleven record scores of every page."""
    return _page_rows(_scored(spark, sf), *_score_columns("key_value_eval"))


@query
def kv_match_rows(spark, sf):
    """A6, A7 for records in rows: the eleven record scores of every order."""
    return _long_record_scores(spark, sf).select("l_orderkey", *_score_columns("score"))


@query
def span_scores_rows(spark, sf):
    """The eleven scores of every page and field."""
    fields = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"span_scores.{f}").alias("score")) for f in MATCH_FIELDS
    ])
    rows = _scored(spark, sf).select(*PAGE_KEY, F.explode(fields).alias("s"))
    return rows.select(*PAGE_KEY, "s.field", "s.score.*")


@query
def json_pair_f1(spark, sf):
    """Key-value F1 of the annotated and the predicted record of a line."""
    scored = inputs.lines(spark, sf).select("l_orderkey", S.pair_scores(F.col("truth"), F.col("found")).alias("s"))
    return scored.select("l_orderkey", "s.*")


@query
def label_counts(spark, sf):
    """A1: rows per class and split."""
    return prepare.count_labels(_splits(spark, sf), ("split", "label"))


@query
def label_ids(spark, sf):
    """A2: classes numbered in sorted order."""
    return prepare.label_ids(prepare.labelled(inputs.texts(spark, sf), "text"))


@query
def class_metrics(spark, sf):
    """A3: classification metrics per prompt."""
    return metrics.long_metrics(
        metrics.wide_metrics(inputs.pages(spark, sf), "label", "label_predicted", ("prompt_id",)), ("prompt_id",)
    ).withColumn("score", F.round("score", 9))


@query
def class_report(spark, sf):
    """A4: report table of presence detection per prompt, recall rows corrected and as older tables had them."""
    binary = inputs.pages(spark, sf).select(
        "prompt_id", A.is_positive(F.col("label")).alias("t"), A.is_positive(F.col("label_predicted")).alias("p"))
    # Both reports come from one stored table of counts per prompt and pair of classes, read once each.
    binary = written(spark, binary, "binary")
    right = metrics.report(binary, "t", "p", ("prompt_id",)).withColumnRenamed("score", "score_right")
    compat = metrics.report(binary, "t", "p", ("prompt_id",), compat=True).withColumnRenamed("score", "score_compat")
    return right.join(compat, ["prompt_id", "Metric"])


@query
def binary_by_scope(spark, sf):
    """Presence detection metrics for Validation, Test and All."""
    rows = inputs.texts(spark, sf).where(F.col("label").isNotNull()).select(
        "row_idx", "filename", X.clean_label(F.col("label")).alias("label"), "label_predicted")
    return metrics.binary_report(rows, _stored_splits(spark, sf))


@query
def metric_long(spark, sf):
    """One row per metric of the test split."""
    rows = _with_predictions(spark, sf).where(F.col("split") == "test")
    return metrics.long_metrics(metrics.wide_metrics(rows, "label", "predicted_label")).withColumn(
        "score", F.round("score", 9))


@query
def validation_macro_f1(spark, sf):
    """The number a model is chosen by."""
    rows = _with_predictions(spark, sf).where(F.col("split") == "validation")
    return metrics.macro_f1(rows, "label", "predicted_label").select(F.round("macro_f1", 9).alias("macro_f1"))


@query
def ner_overview(spark, sf):
    """Mean field scores by prompt, presence and metric."""
    return reports.ner_overview(_scored(spark, sf))


@query
def re_overview(spark, sf):
    """Mean record scores by prompt and presence, from one row per page."""
    return reports.re_overview(_scored(spark, sf))


@query
def re_overview_long(spark, sf):
    """Mean record scores by prompt and presence, from records in rows of their own."""
    return reports.re_overview(_long_record_scores(spark, sf).withColumnRenamed("score", "key_value_eval"))


@query
def formatting_overview(spark, sf):
    """Parsed and failed answers by prompt and presence."""
    return reports.formatting_overview(_parsed(spark, sf))


@query
def ok_prompts(spark, sf):
    """Label views and prompts with a parsed answer."""
    return reports.parsed_prompts(_parsed(spark, sf))


@query
def rouge1(spark, sf):
    """Unigram overlap of a user turn and the answer to it."""
    return scoring.rouge1(_turn_pairs(spark, sf), "pair_id", "reference", "candidate")


@query
def rouge_l(spark, sf):
    """Longest common token sequence of a user turn and the answer to it."""
    return scoring.rouge_l(_turn_pairs(spark, sf), "pair_id", "reference", "candidate")


def _turn_pairs(spark, sf) -> DataFrame:
    turns = inputs.table(spark, sf, "conversations")
    user = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("reference"))
    reply = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("candidate"))
    pair = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return user.join(reply, ["conv_id", "turn"]).withColumn("pair_id", pair)


# Windows, dedup, splits ---------------------------------------------------------------------------------------------

@query
def dedup_texts(spark, sf):
    """The first row of every text, over all documents."""
    docs = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), "text", "lang", "source")
    first = prepare.keep_first(docs, ("row_idx", "lang", "source"))
    return first.select(F.col("row_idx").alias("doc_id"), "lang", "source", "copies")


@query
def distinct_rows(spark, sf):
    """Whole-row distinct."""
    return inputs.pages(spark, sf).select("label", "label_predicted", "prompt_id", "list_text").distinct()


@query
def max_flags(spark, sf):
    """The column maxima of the field report, per metric."""
    return reports.with_max_flags(reports.ner_overview(_scored(spark, sf)), ("Metric",))


@query
def sorted_report(spark, sf):
    """The record report in print order, with its place."""
    return reports.sorted_table(reports.re_overview(_scored(spark, sf), scores=("precision", "recall", "f1")))


@query
def split_rows(spark, sf):
    """Split of every deduplicated labelled text."""
    return _splits(spark, sf).select(F.col("row_idx").alias("doc_id"), "label", "split")


@query
def split_counts(spark, sf):
    """W6 checked by sums: rows and document numbers per class and split."""
    return _splits(spark, sf).groupBy("label", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("row_idx").alias("doc_sum"))


@query
def split_frames(spark, sf):
    """The named frames train, validation, test and all."""
    rows = _stored_splits(spark, sf)
    frames = [
        prepare.split_of(rows, s).select(F.lit(s).alias("frame"), F.col("row_idx").alias("doc_id"), "label")
        for s in (*prepare.SPLITS, "all")
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


# Classification and generation --------------------------------------------------------------------------------------

@query
def prepared_data(spark, sf):
    """M1: split rows with class numbers."""
    return _splits(spark, sf).select(
        F.col("row_idx").alias("doc_id"), "filename", "label", "label_id", "split")


@query
def pair_table(spark, sf):
    """M7: two same-class and two other-class partners for every training text."""
    rows = _stored_splits(spark, sf).where(F.col("split") == "train").select("text_key", "row_idx", "label")
    return pairs.pair_table(rows, 2, SEED)


def _contrastive(spark, rows: DataFrame):
    train = _split(rows, "train")
    partners = pairs.pair_table(train.select("text_key", "row_idx", "label"), 2, SEED)
    stored = contrastive.vector_pairs(spark, partners, train)
    width = train.select(F.max(F.size("embedding"))).first()[0]
    return contrastive.train(stored, contrastive.first_projection(width, 16, SEED), rounds=8)


@query
def contrastive_rounds(spark, sf):
    """M7 and the training it feeds: pairs and mean cost of every round of a projection of stored vectors; the cost falls."""
    _, history = _contrastive(spark, _vector_rows(spark, sf))
    return spark.createDataFrame(
        [(r.number, r.pairs, r.loss, r.number == 0 or r.loss < history[k - 1].loss) for k, r in enumerate(history)],
        "round int, pairs long, loss double, falls boolean")


@query
def contrastive_heads(spark, sf):
    """M3, M7: the same closed-form head on plain vectors and on projected ones: metrics on validation and test."""
    rows = _vector_rows(spark, sf)
    w, _ = _contrastive(spark, rows)
    after = written(spark, rows.withColumn("embedding", contrastive.projected(F.col("embedding"), w)), "projected", ("split",))
    frames = []
    for name, some in (("plain", rows), ("projected", after)):
        model = bayes.train_vectors(spark, _split(some, "train"))
        found = bayes.predict(model, some.where(F.col("split") != "train"), "row_idx", "embedding", name, ("split", "label"))
        frames.append(metrics.long_metrics(metrics.wide_metrics(found, "label", "predicted_label", ("split",)), ("split",)).withColumn("head", F.lit(name)))
    return frames[0].unionByName(frames[1])


def _training_rows(spark, sf) -> DataFrame:
    """Split texts, stored once because training reads them many times."""
    return written(spark, _splits(spark, sf, "text"), "training", ("split",))


def _split(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)


@query
def train_predict(spark, sf):
    """M2, M3, M4, M6: train on words, predict validation and test."""
    rows = _training_rows(spark, sf)
    model = classify.train(_split(rows, "train"), {"reg_param": 0.01})
    found = classify.predict(
        model, rows.where(F.col("split") != "train"), classify.class_table(rows), "hashed-words+logistic")
    return found.select(F.col("row_idx").alias("doc_id"), "split", "label", "predicted_label", "model_name_or_path")


def _bayes_predictions(spark, sf) -> DataFrame:
    rows = _training_rows(spark, sf)
    model = bayes.train_texts(spark, _split(rows, "train"))
    held_out = rows.where(F.col("split") != "train")
    return bayes.predict(model, held_out, "row_idx", "text", "hashed-words+bayes", ("split", "label"))


@query
def bayes_weights(spark, sf):
    """M3, M4: the whole text model: count and weight of every class and feature, out of one grouped aggregation."""
    model = bayes.train_texts(spark, _split(_training_rows(spark, sf), "train"))
    return model.features.select("label", "feature", "n", F.round("weight", 9).alias("weight"))


@query
def bayes_predict(spark, sf):
    """M2, M3, M4, M6: train on words in closed form, predict validation and test."""
    return _bayes_predictions(spark, sf).withColumnRenamed("row_idx", "doc_id")


@query
def bayes_metrics(spark, sf):
    """M4, M6, A3: metrics of the text model on validation and test."""
    found = written(spark, _bayes_predictions(spark, sf), "predictions")
    return metrics.long_metrics(metrics.wide_metrics(found, "label", "predicted_label", ("split",)), ("split",)).withColumn(
        "score", F.round("score", 9))


def _vector_rows(spark, sf) -> DataFrame:
    rows = inputs.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_idx"), F.col("vec_id").cast("string").alias("text_key"),
        F.col("label").cast("string").alias("label"), "embedding")
    return written(spark, prepare.stratified_split(rows, SEED), "vectors", ("split",))


@query
def vector_bayes(spark, sf):
    """M2, M3, M4, M6 on stored embeddings: means and variances by class, predictions of a model that was saved and loaded."""
    rows, path = _vector_rows(spark, sf), scratch_path(spark, "bayes")
    bayes.train_vectors(spark, _split(rows, "train")).save(path)
    found = bayes.predict(
        bayes.BayesModel.load(spark, path), rows.where(F.col("split") != "train"), "row_idx", "embedding", "embedding+bayes", ("split", "label"))
    return found.withColumnRenamed("row_idx", "vec_id")


@query
def vector_classifier(spark, sf):
    """M2, M3, M6 on stored embeddings, with metrics per split."""
    rows = classify.vector_features(_vector_rows(spark, sf), "embedding")
    model = classify.train(_split(rows, "train"), {"reg_param": 0.01}, text=None)
    found = classify.predict(
        model, rows.where(F.col("split") != "train"), classify.class_table(rows), "embedding+logistic")
    return metrics.long_metrics(metrics.wide_metrics(found, "label", "predicted_label", ("split",)), ("split",))


@query
def param_search(spark, sf):
    """M5: seeded random search, best macro F1 on validation, metrics of the chosen model on test."""
    rows = _training_rows(spark, sf)
    model, best, _ = classify.search(_split(rows, "train"), _split(rows, "validation"), n_trials=3, seed=SEED)
    found = classify.predict(model, _split(rows, "test"), classify.class_table(rows), "hashed-words+logistic")
    return metrics.long_metrics(metrics.wide_metrics(found, "label", "predicted_label")).select(
        "metric", "score", F.lit(best["max_iter"]).alias("max_iter"), F.lit(best["reg_param"]).alias("reg_param"))


@query
def search_trials(spark, sf):
    """M5: every trial of the search: whether its parameters lie in their ranges and whether it has a score."""
    rows = _training_rows(spark, sf)
    _, _, trials = classify.search(_split(rows, "train"), _split(rows, "validation"), n_trials=3, seed=SEED)
    low, high = classify.SPACE["reg_param"][1:]
    return spark.createDataFrame(
        [(t["trial"], low <= t["reg_param"] <= high, 0 <= t["macro_f1"] <= 1) for t in trials],
        "trial int, in_range boolean, has_score boolean")


# What the closed-form search draws from: shrinkage, power of the quantity, and how much of the mean price is taken off first.
FIT_SPACE = {"reg": ("log", 1e-3, 1e3), "degree": ("int", 1, 3), "centre": ("choice", (0.0, 0.5, 1.0))}
FIT_TRIALS = 12


def _fit_sums(spark, sf) -> dict:
    """Sums of powers of quantity and of price in cents, by part of the lines: each rung of the training lines holds the one before."""
    order = F.col("l_orderkey")
    part = F.when(order % 5 == 0, F.lit(-1)).when(order % 9 == 1, F.lit(0)).when(order % 3 == 1, F.lit(1)).otherwise(F.lit(2))
    lines = inputs.table(spark, sf, "lineitem").select(
        part.alias("part"), F.col("l_quantity").cast("long").alias("x"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("y"),
        F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("degree"))
    f = F.when(F.col("degree") == 1, F.col("x")).when(F.col("degree") == 2, F.col("x") * F.col("x")).otherwise(F.col("x") * F.col("x") * F.col("x"))
    lines = lines.select("part", "degree", "y", f.alias("f"))
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    rows = lines.groupBy("part", "degree").agg(
        F.count(F.lit(1)).alias("n"), exact(F.col("f")).alias("f"), exact(F.col("y")).alias("y"), exact(F.col("f") * F.col("f")).alias("ff"),
        exact(F.col("f") * F.col("y")).alias("fy"), exact(F.col("y") * F.col("y")).alias("yy"))
    return {(r["part"], r["degree"]): {k: int(r[k]) for k in ("n", "f", "y", "ff", "fy", "yy")} for r in rows.collect()}  # 12 rows


@query
def adaptive_search(spark, sf):
    """M5: a search that learns from its trials, for a shrunken fit of price by quantity; its score, the explained share of the variance of the
    held-out lines, follows from sums that one aggregation gives. Every trial with its parameters, its rungs and its score."""
    sums = _fit_sums(spark, sf)

    def objective(params, rung):
        rows = [sums[k, params["degree"]] for k in range(rung + 1) if (k, params["degree"]) in sums]
        t = {k: float(sum(r[k] for r in rows)) for k in ("n", "f", "y", "ff", "fy")}
        v = {k: float(x) for k, x in sums[-1, params["degree"]].items()}
        c = params["centre"] * (t["y"] / t["n"])
        w = (t["fy"] - c * t["f"]) / (t["ff"] * (1.0 + params["reg"]))
        loss = v["yy"] - 2.0 * c * v["y"] + v["n"] * c * c - 2.0 * w * (v["fy"] - c * v["f"]) + w * w * v["ff"]
        return 1.0 - loss / (v["yy"] - v["y"] * v["y"] / v["n"])

    history = search.run_search(objective, FIT_SPACE, FIT_TRIALS, rungs=3, seed=SEED)
    best = search.best_trial(history)
    return spark.createDataFrame([
        (t.number, round(t.params["reg"], 9), t.params["degree"], t.params["centre"], len(t.scores), round(t.scores[-1], 9), t is best)
        for t in history], "trial int, reg double, degree int, centre double, rungs int, score double, is_best boolean")


@query
def saved_model(spark, sf):
    """Predictions of a model that was saved and loaded, and whether they are those of the model itself."""
    rows = _training_rows(spark, sf)
    path = scratch_path(spark, "models")
    trained = classify.train(_split(rows, "train"), {"reg_param": 0.01})
    classify.save_model(trained, path, "criteria_relevance", "hashed/words")
    loaded = classify.load_model(path, "criteria_relevance", "hashed/words")
    found, again = (
        classify.predict(m, _split(rows, "test"), classify.class_table(rows), "hashed/words") for m in (trained, loaded))
    pairs_of = found.join(again.select("row_idx", F.col("predicted_label").alias("_again")), "row_idx")
    return pairs_of.select(
        F.col("row_idx").alias("doc_id"), "label", "model_name_or_path",
        F.col("predicted_label").eqNullSafe(F.col("_again")).alias("same"))


@query
def generated_answers(spark, sf):
    """M8: a batch generator over every document and prompt, here with the deterministic stub."""
    docs = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), F.col("text").alias("context"))
    found = prompting.generate(docs, PROMPTS, prompting.stub_generate)
    return found.select(F.col("row_idx").alias("doc_id"), "prompt_id", "answer")


def _marked_stub(instructions):
    """The stand-in model of a second run, whose answers can be told from those of the first. It names the function, not its module: what
    travels to tasks travels by value, and a module holds handles of the session once its queries have run."""
    return [f"2: {answer}" for answer in stub_generate(instructions)]


@query
def resumed_answers(spark, sf):
    """M8: a run that ends after half of the parts, and one that goes on: the second asks only what the first left open."""
    docs = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), F.col("text").alias("context"))
    path = scratch_path(spark, "answers")
    resume.generate_on(spark, docs, PROMPTS, prompting.stub_generate, path, parts=4, most_parts=2)
    found = resume.generate_on(spark, docs, PROMPTS, _marked_stub, path, parts=4)
    return found.select(F.col("row_idx").alias("doc_id"), "prompt_id", "answer")


def _vector_searches(spark, sf):
    vectors = inputs.table(spark, sf, "embeddings")
    index = nearest.build_index(spark, vectors, "vec_id", "embedding")
    return index, vectors.where(F.col("vec_id") % 100 == 0)


@query
def indexed_neighbours(spark, sf):
    """J6 for a large catalogue: the nearest other vector of every hundredth one, by lists, with the second pass that makes it exact."""
    index, asked = _vector_searches(spark, sf)
    found = nearest.nearest(spark, index, asked, "vec_id", "embedding", exact=True, others_only=True)
    return found.select(F.col("name").alias("vec_id"), F.col("found").alias("nearest"), F.round("score", 6).alias("score"))


@query
def index_recall(spark, sf):
    """How many of the same searches find the nearest vector with bounded probes alone, and whether that is nine in ten."""
    index, asked = _vector_searches(spark, sf)
    quick, exact = (
        nearest.nearest(spark, index, asked, "vec_id", "embedding", exact=e, others_only=True).select("name", F.col("score").alias(f"s{int(e)}"))
        for e in (False, True))
    both = exact.join(quick, "name", "left")
    return both.agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("s0") >= F.col("s1")) >= F.count(F.lit(1)) * 0.9).alias("nine_in_ten"))


@query
def extraction_run(spark, sf):
    """Labelled documents from prompts to the reports. The answers are stored before two
    reports read them, so that the generator runs once."""
    letters = F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))
    name, points = (F.lit("kriterium"), F.lit("Preis")), (F.lit("maxPunkte"), F.length("text").cast("string"))
    truth = F.when(letters % 3 == 1, F.array(F.create_map(*name))) \
        .when(letters % 3 == 2, F.array(F.create_map(*name, *points))).otherwise(R.empty_records())
    docs = inputs.texts(spark, sf).select(
        "row_idx", X.clean_label(F.col("label")).alias("label"), F.col("text").alias("context"), truth.alias("y_true"))
    found = prompting.apply_prompts(docs, prompting.stub_generate, keep=("row_idx", "label", "y_true"))
    found = written(spark, found, "answers")
    scored = scoring.with_scores(found.withColumn("y_true", R.normalized(F.col("y_true"))))
    return reports.merged(reports.re_overview(scored), reports.formatting_overview(scored))


@query
def presence_fallback(spark, sf):
    """Presence answers of which a third says neither yes nor no; their class is that of the nearest word."""
    docs = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), F.col("text").alias("context"))
    found = prompting.apply_prompts(
        docs, prompting.PerTask(prompting.stub_model), "prompt_1", presence_prompt="presence_1",
        embed_fn=prompting.PerTask(prompting.stub_encoder))
    return found.select(F.col("row_idx").alias("doc_id"), "label_predicted")


@query
def formatting_by_mode(spark, sf):
    """Parsed and failed prompts over all pages and over the pages of each class."""
    parsed = written(spark, _parsed(spark, sf).select("label", "prompt_id", "conversion_status"), "parsed")
    modes = {"all": parsed, "with": parsed.where(F.col("label") == POSITIVE), "without": parsed.where(F.col("label") == NEGATIVE)}
    frames = [reports.parsed_prompts(df).withColumn("mode", F.lit(mode)) for mode, df in modes.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])
