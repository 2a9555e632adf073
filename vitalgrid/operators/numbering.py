"""Respondent numbers, lookups by number and windows of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalgrid.codebook import TARGET
from vitalgrid.functions.risk import recorded_label, sex_word
from vitalgrid.operators.ordering import BUCKET, numbered, range_bucket

NUMBER = "patient_number"


def number_respondents(
    df: DataFrame, key: str = "rid", buckets: int | None = None, bounds_from: DataFrame | None = None
) -> DataFrame:
    """Add ``patient_number`` 1..N in ``key`` order.

    Input is the cleaned table, so numbers close up over rows cleaning removed.
    The rows are written once, by ranges of the number and sorted within them, so
    a stored copy lets later lookups by number skip most files.
    """
    ranged = range_bucket(df, key, buckets, bounds_from)
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # whole ranges lie together and in order: the window below needs no other shuffle
    dealt = ranged.repartitionById(count, BUCKET)
    return numbered(dealt, [F.col(key)], NUMBER).drop(BUCKET)


def lookup(numbered_rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows for the requested numbers (a request table with ``patient_number``)."""
    return numbered_rows.join(requests.select(NUMBER).distinct(), NUMBER, "left_semi")


def out_of_range(numbered_rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested numbers that are no respondent's."""
    return requests.select(NUMBER).distinct().join(numbered_rows.select(NUMBER), NUMBER, "left_anti")


def with_recorded_label(df: DataFrame) -> DataFrame:
    if TARGET not in df.columns:
        from vitalgrid.codebook import NOT_SUPPLIED

        return df.withColumn("actual_label", F.lit(NOT_SUPPLIED))
    return df.withColumn("actual_label", recorded_label(F.col(TARGET)))


#: Respondent numbers of one range of ``neighbour_windows``.
SPAN = 4096


def bordered(rows: DataFrame, size: int) -> DataFrame:
    """Add ``_own``, the range of a row's number, and ``_range``: its own, and a neighbouring one that needs it as border."""
    span, reach = max(SPAN, size), size - 1
    own, *near = [F.floor((F.col(NUMBER) - 1 + step) / span) for step in (0, -reach, reach)]
    return rows.withColumn("_own", own).withColumn("_range", F.explode(F.array_distinct(F.array("_own", *near))))


def neighbour_windows(numbered_rows: DataFrame, requests: DataFrame, size: int = 9) -> DataFrame:
    """The ``size`` consecutive respondents around each requested number.

    The window is moved inward at both ends of the table. Numbers are cut into
    ranges of ``SPAN``; a range also gets the ``size - 1`` rows on either side of
    it, so it has all it needs: rows move once, plus two borders per range,
    however many numbers are asked for. Requests meet the rows in the same
    exchange. Numbers that are no respondent's are left out.
    """
    reach, span = size - 1, max(SPAN, size)
    n = numbered_rows.agg(F.max(NUMBER)).scalar()
    place = F.floor((F.col(NUMBER) - 1) / span)
    shown = with_recorded_label(numbered_rows).select(
        NUMBER,
        F.col("BMI").alias("bmi"),
        F.col("Age").cast("int").alias("age"),
        sex_word(F.col("Sex"), "Male", "Female").alias("sex"),
        "actual_label",
    )
    rows = bordered(shown.select(NUMBER, F.struct(*shown.columns).alias("_row")), size).withColumn("_asked", F.lit(False))
    asked = requests.select(F.col(NUMBER).cast(shown.schema[NUMBER].dataType).alias(NUMBER)).distinct().filter(F.col(NUMBER).isNotNull())
    marks = asked.select(
        NUMBER, F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), place.alias("_own"), place.alias("_range"), F.lit(True).alias("_asked")
    )
    one = Window.partitionBy("_range", NUMBER)
    around = Window.partitionBy("_range").orderBy(NUMBER).rowsBetween(-reach, reach)
    both = rows.unionByName(marks).withColumn("_wanted", F.max("_asked").over(one)).filter("NOT _asked")
    near = both.withColumn("_near", F.collect_list("_row").over(around)).filter("_wanted AND _range = _own").withColumn("_n", n)
    start = F.greatest(F.lit(0), F.least(F.col(NUMBER) - 1 - size // 2, F.col("_n") - size))
    inside = F.filter("_near", lambda r: (r[NUMBER] > start) & (r[NUMBER] <= start + size))
    return near.select(F.col(NUMBER).alias("requested"), F.inline(inside))
