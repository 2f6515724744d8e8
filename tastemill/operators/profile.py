"""Profiles, constraints, histograms and dependence measures."""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StringType

from tastemill.operators.dependence import distance_pairs
from tastemill.operators.ranks import running

CONSTRAINTS = "feature string, type string, min_fraction double, min_count long, shape int, domain array<string>"


def frequencies(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def exact_percentiles(df: DataFrame, value: str, ps: list[float], by: tuple[str, ...] = (), name: str = "q") -> DataFrame:
    """(*by, n, ``name``): exact percentiles (shares ps) of each group's values with linear interpolation, as an array; n counts the values.

    Equal values are counted first, once; the counts are summed up in the order of the values
    (see ranks.running), so no buffer holds a group's values.
    """
    groups = [f"__g{i}" for i in range(len(by))]
    keys = [F.col(c).alias(g) for c, g in zip(by, groups, strict=True)]
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    placed = running(counts, [*groups, "__v"], {"__before": F.col("__n")})
    sizes = placed.groupBy(*(F.col(g).alias(f"{g}_") for g in groups)).agg(F.min("__before").alias("__start"), F.sum("__n").alias("__total"))
    # without groups there is one row of sizes
    rows = placed.join(sizes, [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in groups]) if groups else placed.crossJoin(F.broadcast(sizes))
    rows = rows.withColumn("__end", F.col("__before") - F.col("__start") + F.col("__n"))
    first, found = F.col("__end") - F.col("__n"), []
    for i, p in enumerate(ps):
        at = F.lit(p) * (F.col("__total") - 1)
        holds = lambda k: F.max(F.when((first <= k) & (k < F.col("__end")), F.col("__v")))
        found += [holds(F.floor(at)).alias(f"__lo{i}"), holds(F.ceil(at)).alias(f"__hi{i}"), F.max(at - F.floor(at)).alias(f"__at{i}")]
    out = rows.groupBy(*groups).agg(F.max("__total").alias("n"), *found)
    q = F.array(*(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__at{i}") for i in range(len(ps))))
    return out.select(*(F.col(g).alias(c) for c, g in zip(by, groups, strict=True)), "n", q.alias(name))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, mean, std, min, q25, q50, q75, max) of numeric columns; those without values are left out."""
    one = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns)))
    long = df.select(one.alias("x")).select("x.*")
    q = exact_percentiles(long, "value", [0.25, 0.5, 0.75], ("feature",)).select(F.col("feature").alias("__f"), "q")
    rows = long.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return rows.join(q, F.col("feature") == F.col("__f")).select("feature", "n", "mean", "std", "min", *(F.get("q", i).alias(c) for i, c in enumerate(("q25", "q50", "q75"))), "max")


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0 .. bins - 1; the last bin holds the maximum; one bin where all values are equal."""
    return F.least(F.coalesce(F.floor(F.try_divide(value - low, (high - low) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n) of equal-width bins; empty bins are left out."""
    ends = df.agg(F.min(column).cast("double").alias("__lo"), F.max(column).cast("double").alias("__hi"))  # one row
    b = _bin(F.col(column), F.col("__lo"), F.col("__hi"), bins)
    width = (F.col("__hi") - F.col("__lo")) / bins
    out = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(b.alias("bin"), "__lo", "__hi").agg(F.count("*").alias("n"))
    return out.select("bin", (F.col("__lo") + F.col("bin") * width).alias("low"), (F.col("__lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def histogram2d(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    ends = df.agg(*(f(c).cast("double").alias(f"__{n}{c}") for c in (x, y) for f, n in ((F.min, "lo"), (F.max, "hi"))))  # one row
    bin_of = lambda c: _bin(F.col(c), F.col(f"__lo{c}"), F.col(f"__hi{c}"), bins)
    return df.crossJoin(F.broadcast(ends)).groupBy(bin_of(x).alias("x_bin"), bin_of(y).alias("y_bin")).agg(F.count("*").alias("n"))


def percentiles(df: DataFrame, column: str, ps: list[float]) -> DataFrame:
    """(p, value): exact percentiles with linear interpolation, one row each."""
    found = exact_percentiles(df, column, [p / 100 for p in ps])
    return found.select(F.explode(F.arrays_zip(F.array(*(F.lit(float(p)) for p in ps)).alias("p"), F.col("q").alias("value"))).alias("z")).select(F.col("z.p").alias("p"), F.col("z.value").alias("value"))


def box_stats(df: DataFrame, value: str, by: list[str], exact: bool = True) -> DataFrame:
    """Minimum, quartiles and maximum of each group's values, and their number."""
    at = [0.0, 0.25, 0.5, 0.75, 1.0]
    if exact:
        out = exact_percentiles(df, value, at, tuple(by))
    else:
        out = df.groupBy(*by).agg(F.percentile_approx(value, F.array(*(F.lit(p) for p in at))).alias("q"), F.count(value).alias("n"))
    return out.select(*by, *(F.get("q", i).cast("double").alias(n) for i, n in enumerate(("low", "q25", "q50", "q75", "high"))), "n")


def cooccurrence(df: DataFrame, items: str) -> DataFrame:
    """(item_a, item_b, n) over rows with an array of items; pairs are made inside a row, so nothing is joined."""
    once = F.array_distinct(F.col(items))
    pairs = df.select(F.explode(once).alias("item_a"), once.alias("__all")).select("item_a", F.explode("__all").alias("item_b"))
    return pairs.groupBy("item_a", "item_b").agg(F.count("*").alias("n"))


def distance_correlation(df: DataFrame, x: str, y: str, grid: int | None = None) -> DataFrame:
    """(x, y, n, cells, dcov, dcor) of two numeric columns (see dependence.distance_pairs)."""
    return distance_pairs(df, [(x, y)], grid)


def distance_matrix(df: DataFrame, columns: list[str], grid: int | None = None) -> DataFrame:
    """The same for every pair of columns, the earlier one as x, all pairs in the same jobs."""
    return distance_pairs(df, list(combinations(columns, 2)), grid)


def independence(df: DataFrame, x: str, y: str, threshold: float = 3.841459, grid: int | None = None) -> DataFrame:
    """Adds ``dependent``: n times the squared distance covariance reaches the threshold (one degree of freedom)."""
    out = distance_correlation(df, x, y, grid)
    return out.withColumn("dependent", F.col("n") * F.col("dcov") ** 2 >= threshold)


def feature_stats(df: DataFrame, by: str | None = "split", columns: list[str] | None = None) -> DataFrame:
    """(split, feature, n, missing, distinct, mean, std, min, max, zeros, median) in one pass over all columns."""
    keep = [f for f in df.schema if f.name != by and (columns is None or f.name in columns)]
    numeric = {f.name: isinstance(f.dataType, NumericType) for f in keep}
    cells = F.array(*(F.struct(F.lit(f.name).alias("feature"), F.col(f.name).cast("string").alias("text"), (F.col(f.name).cast("double") if numeric[f.name] else F.lit(None).cast("double")).alias("value")) for f in keep))
    group = [by] if by else []
    long = df.select(*group, F.explode(cells).alias("c")).select(*group, "c.*")
    return long.groupBy(*group, "feature").agg(
        F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("missing"), F.approx_count_distinct("text").alias("distinct"), F.avg("value").alias("mean"), F.stddev("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.count_if(F.col("value") == 0).alias("zeros"), F.percentile_approx("value", 0.5).alias("median"),
    )


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    return frequencies(df, column).orderBy(F.desc("n"), column).limit(n)


def infer_constraints(df: DataFrame, max_domain: int = 20) -> DataFrame:
    """(feature, type, min_fraction, min_count, shape, domain) as the data suggest: small string domains are listed.

    Two scans, whatever the number of columns: distinct values are estimated first, and
    collected only where they are few.
    """
    kinds = {f.name: "array" if isinstance(f.dataType, ArrayType) else "string" if isinstance(f.dataType, StringType) else "float" if f.dataType.simpleString() in ("float", "double") else "int" for f in df.schema}
    text = [c for c, k in kinds.items() if k == "string"]
    about = df.agg(*(F.approx_count_distinct(c).alias(c) for c in text)).first() if text else None
    few = [c for c in text if about[c] <= 2 * max_domain]
    one = df.agg(
        F.count("*").alias("n"),
        *(F.count(c).alias(f"present:{c}") for c in kinds),
        *(F.max(F.size(c)).alias(f"shape:{c}") for c, k in kinds.items() if k == "array"),
        *(F.slice(F.array_sort(F.collect_set(c)), 1, max_domain + 1).alias(f"domain:{c}") for c in few),
    ).first()  # one row
    rows = []
    for c, kind in kinds.items():
        present, domain = one[f"present:{c}"], one[f"domain:{c}"] if c in few else None
        rows.append((c, kind, present / one["n"] if one["n"] else 0.0, min(present, 1), one[f"shape:{c}"] if kind == "array" else 1, domain if domain is not None and len(domain) <= max_domain else None))
    return df.sparkSession.createDataFrame(rows, CONSTRAINTS)


def load_constraints(text: str) -> list[dict]:
    """A reviewed schema from JSON: a list of objects with the names of infer_constraints."""
    out = []
    for row in json.loads(text):
        if "feature" not in row or row.get("type") not in ("int", "float", "string", "array"):
            raise ValueError(f"constraint without feature or with unknown type: {row}")
        out.append({"min_fraction": 0.0, "min_count": 0, "shape": 1, "domain": None} | row)
    return out


def anomalies(df: DataFrame, constraints: list[dict]) -> DataFrame:
    """(feature, problem, n): violated constraints, found in a single aggregation over the data."""
    kinds = {"int": ("tinyint", "smallint", "int", "bigint", "boolean"), "float": ("float", "double"), "string": ("string",)}
    types, found, fixed = dict(df.dtypes), [F.count("*").alias("__n")], []
    for c in constraints:
        name = c["feature"]
        if name not in types:
            fixed.append((name, "missing column", 1))
            continue
        kind = c["type"]
        if (kind == "array") != types[name].startswith("array") or kind != "array" and types[name] not in kinds[kind]:
            fixed.append((name, "wrong type", 1))
            continue
        found.append(F.count(name).alias(f"present:{name}"))
        if c.get("domain") is not None:
            found.append(F.count_if(~F.col(name).isin(*c["domain"])).alias(f"out of domain:{name}"))
        if kind == "array":
            found.append(F.count_if(F.size(name) != c["shape"]).alias(f"wrong shape:{name}"))
    known = {c["feature"] for c in constraints}
    fixed += [(n, "unexpected column", 1) for n in df.columns if n not in known]
    counts = df.agg(*found).first().asDict()  # one row
    n = counts.pop("__n")
    rows = list(fixed)
    for key, value in counts.items():
        problem, _, name = key.partition(":")
        c = next(c for c in constraints if c["feature"] == name)
        if problem == "present":
            if n and value / n < c["min_fraction"] or value < c["min_count"]:
                rows.append((name, "missing values", n - value))
        elif value:
            rows.append((name, problem, value))
    return df.sparkSession.createDataFrame(rows, "feature string, problem string, n long")


def split_counts(df: DataFrame, by: str = "split") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))
