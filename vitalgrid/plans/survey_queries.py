"""Queries over the raw and the clean survey: cleaning, numbering, decoding, splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalgrid.codebook import FEATURES, TARGET
from vitalgrid.functions.decode import slug
from vitalgrid.functions.numeric import number_text, whole_code
from vitalgrid.operators import clean, lookups, numbering, split, summary
from vitalgrid.operators.contributions import missing_features, to_long
from vitalgrid.plans.derived import raw_survey, survey, table
from vitalgrid.sources import dimensions as dim
from vitalgrid.sources import survey as source
from vitalgrid.sources.artifacts import write_csv
from vitalgrid.session import run_folder

NUMBER = numbering.NUMBER


def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.class_summary(clean.training_clean(raw_survey(spark, sf_dir)).valid)


def clean_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.training_clean(raw_survey(spark, sf_dir)).valid


def clean_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = clean.strict_load(raw_survey(spark, sf_dir)).tagged
    return tagged.select(
        "rid", "dropped", F.array_join("violations", ",").alias("violations"), F.col(TARGET).alias("target")
    )


def clean_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = clean.import_clean(raw_survey(spark, sf_dir)).tagged
    return tagged.filter("NOT dropped").select(
        "rid", *FEATURES, TARGET, F.array_join("violations", ",").alias("violations")
    )


def import_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {**clean.import_rules(), f"{TARGET}:label": clean.label_rule()}
    return clean.rule_counts(clean.import_clean(raw_survey(spark, sf_dir)), rules)


def single_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's survey rows as one uploaded file."""
    uploads = raw_survey(spark, sf_dir, ("o_custkey",)).select(
        F.concat(F.lit("profile-"), F.col("o_custkey").cast("string"), F.lit(".csv")).alias("source_name"), *FEATURES
    )
    source.require_exact_columns(uploads, ("source_name",))
    return clean.single_profiles(uploads)


def csv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw survey through plain CSV files of two column orders in one folder, numbered in file order.

    The files have no row id; ``respondent`` is a column like any other, and each
    file is sorted by it, so that positions in a file can be compared with it.
    ``in_order`` says whether a row's position follows the one before it.
    """
    folder = run_folder(spark)
    rows = raw_survey(spark, sf_dir).withColumnRenamed("rid", "respondent")
    for part, columns in ((0, [TARGET, "respondent", *reversed(FEATURES)]), (1, [*FEATURES, "respondent", TARGET])):
        half = rows.filter(F.col("respondent") % 2 == part).select(columns)
        write_csv(half.repartitionByRange("respondent").sortWithinPartitions("respondent"), folder, mode="append")
    files = source.read_uploads(spark, folder, row_ids=True)
    kept = clean.import_clean(files, keep=("rid", "source_name", "source_row", "respondent")).valid
    before = Window.partitionBy("source_name").orderBy(F.col("respondent").cast("bigint"))
    ordered = F.coalesce(F.lag("source_row").over(before) < F.col("source_row"), F.lit(True))
    return kept.select(
        F.col("respondent").cast("bigint").alias("rid"), *FEATURES, TARGET,
        F.endswith("source_name", F.lit(".csv")).alias("named"), (ordered & (F.col("rid") >= F.col("source_row"))).alias("in_order"),
    )


def _upload_folders(spark: SparkSession, sf_dir: str) -> list[str]:
    """Uploads of four kinds: features in another order, with the target, without two columns, and a header alone."""
    base, rows = run_folder(spark), survey(spark, sf_dir)
    kinds = {
        "features": (rows.filter("rid % 3 = 0"), [*reversed(FEATURES)]),
        "labelled": (rows.filter("rid % 3 = 1"), [TARGET, *FEATURES]),
        "lacking": (rows.filter("rid % 3 = 2"), [f for f in FEATURES if f not in ("BMI", "Age")]),
        "headers": (rows.limit(0), FEATURES),
    }
    for kind, (part, columns) in kinds.items():
        write_csv(part.select(columns), f"{base}/{kind}")
    return [f"{base}/{kind}" for kind in kinds]


def upload_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all uploaded files when columns must be exactly the features, by kind of upload."""
    audit = source.audit_files(spark, _upload_folders(spark, sf_dir), exact=True)
    kind = F.element_at(F.split("file", "/"), -2).alias("kind")
    return audit.filter("n_rows > 0 OR verdict <> 'ok'").groupBy(
        kind, "verdict", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra")
    ).agg(F.sum("n_rows").alias("n_rows")).filter("n_rows > 0 OR kind = 'headers'")


def audited_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the uploads that pass, counted by everything they say; those of bad files stay out."""
    rows, _ = source.read_audited(spark, _upload_folders(spark, sf_dir))
    numbers = [F.col(f).cast("double").alias(f) for f in [*FEATURES, TARGET]]
    return rows.select(numbers).groupBy(*FEATURES, TARGET).agg(F.count(F.lit(1)).alias("n_rows"))


def import_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete rows of the raw survey, and which guards refuse it: a cap below and at their number, and no row at all."""
    raw = raw_survey(spark, sf_dir)
    complete = clean.import_clean(raw).tagged.filter(~F.col("dropped")).count()

    def refused(load) -> bool:
        try:
            load()
        except ValueError:
            return True
        return False

    outcomes = [
        ("cap below", complete, refused(lambda: clean.import_clean(raw, max_rows=complete - 1))),
        ("cap reached", complete, refused(lambda: clean.import_clean(raw, max_rows=complete))),
        ("no complete row", 0, refused(lambda: clean.require_rows(clean.import_clean(raw.filter("BMI IS NULL"))))),
        ("some complete rows", complete, refused(lambda: clean.require_rows(clean.import_clean(raw)))),
    ]
    return spark.createDataFrame(outcomes, "guard string, n_complete bigint, refused boolean")


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = clean.import_clean(raw_survey(spark, sf_dir)).tagged
    return summary.counts_where(
        tagged,
        {
            "n_complete": ~F.col("dropped"),
            "n_valid": ~F.col("dropped") & (F.size("violations") == 0),
            "n_labelled": F.col(TARGET).isNotNull(),
        },
    )


def unknown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = clean.coerced(raw_survey(spark, sf_dir).select("rid", TARGET), [TARGET]).filter(F.col(TARGET).isNotNull())
    return summary.unknown_labels(numbers, TARGET, dim.class_labels(spark))


def missing_in_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = clean.coerced(raw_survey(spark, sf_dir), FEATURES)
    named = numbers.select("rid", missing_features().alias("m"))
    return named.filter(F.size("m") > 0).select("rid", F.array_join("m", ",").alias("missing"))


# --- numbering ------------------------------------------------------------------


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rid"))
    valid = clean.import_clean(raw_survey(spark, sf_dir)).valid
    return numbering.number_respondents(valid, bounds_from=ids)


def number_respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).select("rid", NUMBER)


def recorded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.with_recorded_label(_numbered(spark, sf_dir)).select(NUMBER, "actual_label")


def neighbour_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbered(spark, sf_dir)
    return numbering.neighbour_windows(rows, rows.select(NUMBER))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Respondent numbers asked for by line items; some lie beyond the table."""
    items = table(spark, sf_dir, "lineitem")
    return items.select((F.col("l_orderkey") + F.col("l_partkey") + 1).alias(NUMBER))


def lookup_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = numbering.lookup(_numbered(spark, sf_dir), _requests(spark, sf_dir))
    return found.select(NUMBER, "rid", *FEATURES)


def out_of_range_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.out_of_range(_numbered(spark, sf_dir), _requests(spark, sf_dir))


# --- decoding -------------------------------------------------------------------


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir).withColumn("shap", F.lit(None).cast("array<double>"))
    return to_long(rows, ["rid"]).drop("shap_value")


def decode_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.with_value_text(lookups.with_meaning(_long(spark, sf_dir))).select(
        "rid", "feature", "value_text", "state"
    )


def attribute_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions in display order with what respondents answered."""
    counts = summary.value_counts(survey(spark, sf_dir), FEATURES)
    answered = counts.groupBy("feature").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum(F.col("n_rows") * F.col("value")).alias("value_sum"),
        F.count(F.lit(1)).alias("n_values"),
    )
    return (
        lookups.with_definitions(answered)
        .select("display_order", "feature", "label", "kind", "domain", "domain_label", "n_rows", "n_values", "value_sum")
        .orderBy("display_order")
    )


def value_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 60 value definitions with the number of respondents per code."""
    counts = summary.value_counts(survey(spark, sf_dir), [f for f in FEATURES if f not in ("BMI", "MentHlth", "PhysHlth")])
    codes = counts.select("feature", whole_code(F.col("value")).alias("code"), "n_rows")
    return dim.value_definitions(spark).join(codes, ["feature", "code"], "left").select(
        "value_id", "feature", "code", "label", F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


def bmi_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookups.with_bmi_category(survey(spark, sf_dir).select("BMI"), F.col("BMI"))
    return rows.groupBy("category_id", "category_code", "category_label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("BMI").alias("min_bmi"), F.max("BMI").alias("max_bmi")
    )


def field_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form metadata beside the smallest and largest answer."""
    seen = (
        summary.value_counts(survey(spark, sf_dir), FEATURES)
        .groupBy("feature")
        .agg(F.min("value").alias("seen_min"), F.max("value").alias("seen_max"))
    )
    return seen.join(F.broadcast(dim.field_definitions(spark)), "feature")


def definition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features answered and features defined, with the side each appears on."""
    answered = _long(spark, sf_dir).groupBy("feature").agg(F.count(F.lit(1)).alias("n_answers"))
    defined = dim.attributes(spark).select("feature", F.lit(True).alias("defined"))
    return answered.join(defined, "feature", "full_outer").select(
        "feature", F.coalesce("n_answers", F.lit(0)).alias("n_answers"), F.coalesce("defined", F.lit(False)).alias("defined")
    )


def whole_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age codes, some of them made fractional; those have no code."""
    value = F.col("Age") + F.when(F.col("rid") % 7 == 0, 0.5).otherwise(0.0)
    return survey(spark, sf_dir).select("rid", value.alias("value")).select(
        "rid", "value", whole_code(F.col("value")).alias("code")
    )


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", slug(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("slug")
    )


def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        number_text(F.col("o_totalprice")).alias("price_text"),
        number_text(F.floor("o_totalprice").cast("double")).alias("whole_text"),
        number_text(F.col("o_totalprice") / 4096 + 10).alias("small_text"),
    )


# --- splitting ------------------------------------------------------------------


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split(survey(spark, sf_dir)).select("rid", TARGET, "is_test")


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.stratified_split(survey(spark, sf_dir))
    return rows.groupBy(TARGET).agg(
        F.count_if("is_test").alias("n_test"), F.count_if(~F.col("is_test")).alias("n_train")
    )


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.class_weights(survey(spark, sf_dir))


def first_high_test_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first held-out respondent of the highest class, in test order."""
    held_out = split.stratified_split(survey(spark, sf_dir)).filter(F.col("is_test") & (F.col(TARGET) == 2))
    order = F.struct(split.row_digest(42, "rid").alias("digest"), F.col("rid").alias("rid"))
    return held_out.agg(F.min(order).alias("first")).select(F.col("first.rid").alias("rid"))


def sampled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 1,000 respondents, labels aligned by row id."""
    rows = survey(spark, sf_dir)
    sample = split.hash_sample(rows.select("rid", *FEATURES), 1000)
    return sample.select("rid").join(rows.select("rid", TARGET), "rid")


QUERIES = {
    f.__name__: f
    for f in (
        class_summary, clean_training, clean_strict, clean_import, import_rule_counts, single_profiles,
        csv_import, upload_audit, audited_import, import_guards, row_counts, unknown_labels, missing_in_profile, number_respondents, recorded_labels,
        neighbour_windows, lookup_by_number, out_of_range_requests, decode_profiles, attribute_overview,
        value_usage, bmi_categories, field_limits, definition_check, whole_codes, slugs, number_texts,
        stratified_split, split_counts, class_weights, first_high_test_row, sampled_labels,
    )
}
