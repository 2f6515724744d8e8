"""Feature columns: every function maps columns to a column, so Catalyst sees plain expressions.

``dates="compat"`` keeps the established day arithmetic, whose year and seconds are off
around leap years and whose month is a 30-day count; ``dates="calendar"`` is exact.
Nothing here depends on the session time zone.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.functions.vocab import AGES, GENDERS, GENRES, OCCUPATIONS, YEARS

DAY = 86_400


def rating01(rating: Column) -> Column:
    return (rating - 1) / 4


def rating_from01(scaled: Column) -> Column:
    return F.round(scaled * 4 + 1)


def code(value: Column, values: tuple) -> Column:
    """Position of a value in a fixed list, -1 for unknown or null."""
    return F.coalesce(F.array_position(F.array(*(F.lit(v) for v in values)), value) - 1, F.lit(-1))


def gender_code(gender: Column) -> Column:
    return code(gender, GENDERS)


def age_scaled(age: Column) -> Column:
    return code(age, AGES) / 6


def genre_names(genres: Column) -> Column:
    return F.split(F.replace(genres, F.lit("Children's"), F.lit("Children")), "[|]")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once and not again for every element that a lambda inside visits."""
    return F.get(F.transform(F.array(value), body), 0)


def multi_hot(tokens: Column, vocab: tuple = GENRES) -> Column:
    """How often each name of the vocabulary occurs."""
    names = F.array(*(F.lit(v) for v in vocab))
    return _once(tokens, lambda own: F.transform(names, lambda v: F.size(F.filter(own, lambda t: t == v))))


def multi_hot_scaled(tokens: Column, vocab: tuple = GENRES) -> Column:
    """Counts that sum to 1; an array of nulls where no name is known."""
    with_total = _once(multi_hot(tokens, vocab), lambda c: F.struct(c.alias("c"), F.aggregate(c, F.lit(0), lambda a, x: a + x).alias("n")))
    return _once(with_total, lambda p: F.transform(p["c"], lambda x: F.try_divide(x, p["n"]).cast("float")))


def flags(weights: Column) -> Column:
    return F.transform(weights, lambda x: F.ceil(x).cast("int"))


def names_of(weights: Column, vocab: tuple = GENRES) -> Column:
    """The names whose weight is above zero."""
    named = F.zip_with(F.array(*(F.lit(v) for v in vocab)), weights, lambda v, w: F.when(w > 0, v))
    return F.filter(named, lambda v: v.isNotNull())


def spread(values: Column, names: tuple) -> list[Column]:
    """One column for each array element."""
    return [F.get(values, i).alias(n) for i, n in enumerate(names)]


def one_hot(value: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == value).cast("int"))


def cyclical(value: Column, period: float) -> Column:
    angle = value * (2 * math.pi / period)
    return F.array(F.sin(angle), F.cos(angle))


def clip_id(value: Column, offset: int, n: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), value - offset))


def concat_vectors(*vectors: Column) -> Column:
    """One vector of the values of several, in their order; null if one of them is."""
    return F.concat(*vectors)


def append_bias(vector: Column, bias: Column) -> Column:
    return F.array_append(vector, bias)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def occupation_label(value: Column) -> Column:
    """The label of a code; unknown codes pass through as text."""
    return F.coalesce(F.try_element_at(F.array(*(F.lit(x) for x in OCCUPATIONS)), F.when(value >= 0, value.cast("int") + 1)), value.cast("string"))


def sentiment(rating: Column) -> Column:
    return F.when(rating > 3, "liked").when(rating == 3, "neutral").when(rating < 3, "disliked")


def itemset_label(items: Column) -> Column:
    return F.to_json(items)


def pattern_label(sequence: Column) -> Column:
    """A sequence of itemsets as ``(a,b) -> (c)``."""
    return F.array_join(F.transform(sequence, lambda s: F.concat(F.lit("("), F.array_join(F.transform(s, lambda x: x.cast("string")), ","), F.lit(")"))), " -> ")


def singles(items: Column) -> Column:
    """A sequence of items as a sequence of one-item sets."""
    return F.transform(items, lambda x: F.array(x))


def _days(ts: Column) -> Column:
    return F.floor(ts / DAY)


def hour(ts: Column) -> Column:
    return F.pmod(F.floor(ts / 3600), F.lit(24))


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.pmod(_days(ts) + 3, F.lit(7))


def hour_of_week(ts: Column) -> Column:
    return weekday(ts) * 24 + hour(ts)


def _leap_counts(ts: Column) -> tuple[Column, Column]:
    since = _days(ts) - 730
    leap = 1 + F.floor(since / 1461)
    return leap, F.floor((since - leap * 366) / 365)


def _date(ts: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), _days(ts).cast("int"))


def year(ts: Column, dates: str = "compat") -> Column:
    if dates == "calendar":
        return F.year(_date(ts)).cast("long")
    leap, other = _leap_counts(ts)
    return 1972 + leap + other


def year_scaled(ts: Column, dates: str = "compat") -> Column:
    low, high = YEARS
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (year(ts, dates) - low) / (high - low)))


def seconds_into_year(ts: Column, dates: str = "compat") -> Column:
    if dates == "calendar":
        return ts - F.unix_date(F.trunc(_date(ts), "year")).cast("long") * DAY
    leap, other = _leap_counts(ts)
    return ts - (366 * leap + 365 * (other + 2)) * DAY


def month(ts: Column, dates: str = "compat") -> Column:
    """Zero-based."""
    if dates == "calendar":
        return (F.month(_date(ts)) - 1).cast("long")
    return F.pmod(F.floor(_days(ts) / 30), F.lit(12))


def timestamp_of(yr: Column, seconds: Column) -> Column:
    """The time that lies so many seconds into a year (no time zone)."""
    start = F.make_timestamp_ntz(yr.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def featurize(df: DataFrame, vocab: tuple = GENRES, dates: str = "compat", keep: tuple[str, ...] = ()) -> DataFrame:
    """Joined ratings to the feature table: ids as longs, floats, and ``genres`` as an array of weights.

    Ids and the seconds into the year exceed what a float can tell apart, so they are long and
    double. ``keep`` names columns that are carried along.
    """
    ts = F.col("timestamp")
    scalars = {
        "rating": rating01(F.col("rating")),
        "gender": gender_code(F.col("gender")),
        "age": age_scaled(F.col("age")),
        "occupation": F.col("occupation"),
        "hr": hour(ts),
        "weekday": weekday(ts),
        "hr_wk": hour_of_week(ts),
        "month": month(ts, dates),
        "yr": year(ts, dates),
        "yr_z": year_scaled(ts, dates),
    }
    ids = [F.col(c).cast("long").alias(c) for c in ("user_id", "movie_id")]
    return df.select(*ids, seconds_into_year(ts, dates).cast("double").alias("sec_into_yr"), *(c.cast("float").alias(n) for n, c in scalars.items()), multi_hot_scaled(genre_names(F.col("genres")), vocab).alias("genres"), *keep)


def metadata_features(df: DataFrame, vocab: tuple = GENRES) -> DataFrame:
    return df.select(F.col("movie_id").cast("long").alias("movie_id"), rating01(F.col("rating")).cast("float").alias("rating"), multi_hot_scaled(genre_names(F.col("genres")), vocab).alias("genres"))


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing columns are added and nulls filled; values are literals or columns (such as a time for "now")."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.withColumns({c: F.coalesce(F.col(c), value(v)) if c in df.columns else value(v) for c, v in defaults.items()})
