"""Frequent itemsets, association rules and sequential patterns."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth, FPGrowthModel, PrefixSpan
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.functions.features import itemset_label, pattern_label, singles


def baskets(df: DataFrame, user: str, item: str) -> DataFrame:
    """(user, items): the distinct items of each user, sorted."""
    return df.groupBy(user).agg(F.sort_array(F.collect_set(item)).alias("items"))


def fit_itemsets(baskets_: DataFrame, min_support: float = 0.005, min_confidence: float = 0.6) -> FPGrowthModel:
    return FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets_)


def frequent_itemsets(model: FPGrowthModel, transactions: int, min_size: int = 1) -> DataFrame:
    """(items, freq, support, label) of itemsets with at least ``min_size`` items, the longest first."""
    out = model.freqItemsets.where(F.size("items") >= min_size).withColumn("items", F.sort_array("items"))
    return out.select("items", "freq", (F.col("freq") / transactions).alias("support"), itemset_label(F.col("items")).alias("label")).orderBy(F.desc(F.size("items")), F.desc("support"), "label")


def association_rules(model: FPGrowthModel, min_confidence: float = 0.6, min_antecedent: int = 2) -> DataFrame:
    """Rules by lift; short antecedents and low confidence are left out."""
    rules = model.associationRules.where((F.col("confidence") >= min_confidence) & (F.size("antecedent") >= min_antecedent))
    rules = rules.withColumn("antecedent", F.sort_array("antecedent"))
    return rules.orderBy(F.desc("lift"), itemset_label(F.col("antecedent")), itemset_label(F.col("consequent")))


def apply_rules(model: FPGrowthModel, baskets_: DataFrame, min_antecedent: int = 1) -> DataFrame:
    """Adds ``prediction``: the consequents that a basket's items lead to and that it does not hold, by rules of at least ``min_antecedent`` items."""
    rules = model.associationRules.where(F.size("antecedent") >= min_antecedent).groupBy("antecedent").agg(F.flatten(F.collect_set("consequent")).alias("__to"))
    rules = rules.withColumn("__key", F.element_at("antecedent", 1))
    items = F.col(model.getItemsCol())
    # equal baskets are worked out once, and meet only the rules whose first item they hold
    distinct = baskets_.select(items.alias("__items")).distinct()
    met = distinct.withColumn("__key", F.explode(F.array_distinct("__items"))).join(rules, "__key").where(F.size(F.array_except("antecedent", "__items")) == 0)
    new = met.select("__items", F.explode(F.array_except("__to", "__items")).alias("__new")).groupBy("__items").agg(F.collect_set("__new").alias("__new"))
    out = baskets_.join(new, items == F.col("__items"), "left")
    return out.withColumn("prediction", F.coalesce("__new", F.array_except(items, items), F.array())).drop("__items", "__new")


def save_model(model: FPGrowthModel, path: str) -> FPGrowthModel:
    model.write().overwrite().save(path)
    return FPGrowthModel.load(path)


def sequences(df: DataFrame, user: str, item: str, order_by: list[str]) -> DataFrame:
    """(user, sequence): each user's items in order, as one-item sets."""
    ordered = F.sort_array(F.collect_list(F.struct(*order_by, F.col(item).alias("__item"))))
    return df.groupBy(user).agg(F.transform(ordered, lambda x: x["__item"]).alias("items")).select(user, singles(F.col("items")).alias("sequence"))


def sequential_patterns(df: DataFrame, user: str, item: str, order_by: list[str], min_support: float = 0.005, max_len: int = 20) -> DataFrame:
    """(sequence, freq, length, label), the longest first."""
    found = PrefixSpan(minSupport=min_support, maxPatternLength=max_len).findFrequentSequentialPatterns(sequences(df, user, item, order_by))
    return found.select("sequence", "freq", F.size("sequence").alias("length"), pattern_label(F.col("sequence")).alias("label")).orderBy(F.desc("length"), F.desc("freq"), "label")


def patterns_by_length(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("length").agg(F.count("*").alias("patterns"), F.max("freq").alias("max_freq"))
