"""Itemsets, rules and sequences mined on vertical lists: what an item occurs in, not what a basket holds.

No basket is an array and no owner's rows have to fit a task. Itemsets intersect bitmaps of
64 owners a row within classes of equal prefixes; sequences join position lists by time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.operators.ranks import running
from tastemill.sources.folders import kept


def _numbered(df: DataFrame, group: list[str], owner: str, item: str, order_by: list[str] = []) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """(rows (class, tid, item, order columns), classes (class, group columns, owners)): numbers for owners and groups.

    A group has rows of its own, but ``class`` and the owner's number are what later joins use.
    Rows with a null owner or item don't count.
    """
    rows = df.where(F.col(owner).isNotNull() & F.col(item).isNotNull()).select(*(F.col(c).alias(f"g{i}") for i, c in enumerate(group)), F.col(owner).alias("o"), F.col(item).alias("item"), *(F.col(c).alias(f"t{i}") for i, c in enumerate(order_by)))
    keys = [f"g{i}" for i in range(len(group))]
    owners = running(rows.select(*keys, "o").distinct(), [*keys, "o"]).withColumnRenamed("__rn", "tid")
    classes = kept(owners.groupBy(*keys).agg(F.count("*").alias("owners")).withColumn("class", F.monotonically_increasing_id()), "mining-classes")
    same = lambda a, b, names: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
    named = owners.alias("p").join(classes.alias("c"), same("p", "c", keys)) if keys else owners.crossJoin(F.broadcast(classes.select("class")))
    named = named.select(*(F.col(f"p.{c}" if keys else c).alias(c) for c in [*keys, "o", "tid"]), "class")
    out = rows.alias("r").join(named.alias("n"), same("r", "n", [*keys, "o"])).select("class", "tid", "item", *(f"t{i}" for i in range(len(order_by))))
    return out, classes.select("class", *(F.col(k).alias(c) for k, c in zip(keys, group, strict=True)), "owners")


def frequent_sets(df: DataFrame, group: list[str], owner: str, item: str, min_support: float = 0.005, max_size: int | None = None) -> DataFrame:
    """(*group, items, size, freq, support): the sets of items that at least ``min_support`` of a group's owners hold.

    An owner's repeated items count once. Level by level, sets of one size with the same
    items but for the last are joined on 64 owners at a time; the counts of the candidates
    are aggregated first, and bitmaps are made for those that are frequent.
    """
    rows, classes = _numbered(df, group, owner, item)
    words = rows.groupBy("class", "item", F.shiftright("tid", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(tid & 63 as int))")).alias("bits"))
    words = kept(words, "sets-words")
    enough = classes.select(F.col("class").alias("class_"), F.ceil(F.col("owners") * F.lit(min_support) - 1e-9).alias("least"))
    counted = words.groupBy("class", "item").agg(F.sum(F.bit_count("bits")).alias("freq"))
    found = counted.join(enough, F.col("class") == F.col("class_")).where("freq >= least")
    # a set has a number; its class of equal prefixes is named by the number of the prefix
    sets = kept(found.select("class", F.col("class").alias("prefix"), F.col("item").alias("last"), F.array("item").alias("items"), "freq").withColumn("set", F.monotonically_increasing_id()), "sets-1")
    words = words.join(sets.select(F.col("class").alias("k"), F.col("last").alias("l"), "prefix", "set"), (F.col("class") == F.col("k")) & (F.col("item") == F.col("l"))).select("prefix", "set", F.col("item").alias("last"), "word", "bits")
    out, size = sets, 1
    while (max_size is None or size < max_size) and not sets.isEmpty():
        words = kept(words, f"sets-words-{size}")
        a, b = words.alias("a"), words.alias("b")
        met = a.join(b, (F.col("a.prefix") == F.col("b.prefix")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.last") < F.col("b.last")))
        both = F.col("a.bits").bitwiseAND(F.col("b.bits"))
        counts = met.where(both != 0).groupBy(F.col("a.set").alias("prefix"), F.col("b.set").alias("other")).agg(F.sum(F.bit_count(both)).alias("freq"))
        first = sets.select("class", F.col("set").alias("s"), "items").join(enough, F.col("class") == F.col("class_"))
        last = sets.select(F.col("set").alias("s2"), "last")
        found = counts.join(first, F.col("prefix") == F.col("s")).where("freq >= least").join(last, F.col("other") == F.col("s2"))
        new = kept(found.select("class", "prefix", "other", "last", F.array_append("items", F.col("last")).alias("items"), "freq").withColumn("set", F.monotonically_increasing_id()), f"sets-{size + 1}")
        named = new.select("prefix", "other", F.col("set").alias("new"), "last")
        half = named.alias("n").join(words.alias("a"), F.col("n.prefix") == F.col("a.set")).select("n.*", F.col("a.word").alias("word"), F.col("a.bits").alias("bits"))
        pairs = half.alias("h").join(words.alias("b"), (F.col("h.other") == F.col("b.set")) & (F.col("h.word") == F.col("b.word")))
        both = F.col("h.bits").bitwiseAND(F.col("b.bits"))
        words = pairs.where(both != 0).select(F.col("h.prefix").alias("prefix"), F.col("h.new").alias("set"), F.col("h.last").alias("last"), F.col("h.word").alias("word"), both.alias("bits"))
        out, sets, size = out.unionByName(new.drop("other")), new.drop("other"), size + 1
    return out.join(classes.withColumnRenamed("class", "class_"), F.col("class") == F.col("class_")).select(*group, "items", F.size("items").alias("size"), "freq", (F.col("freq") / F.col("owners")).alias("support"))


def set_rules(sets: DataFrame, group: list[str], min_confidence: float = 0.6, min_antecedent: int = 1) -> DataFrame:
    """(*group, antecedent, consequent, confidence, lift, support) of rules to one item, from frequent_sets."""
    sets = kept(sets, "rules-sets")
    one = sets.where(F.col("size") > min_antecedent).select(*group, "items", "freq", "support", F.explode("items").alias("consequent"))
    one = one.withColumn("antecedent", F.array_remove("items", F.col("consequent")))
    before = sets.select(*(F.col(c).alias(f"{c}_") for c in group), F.col("items").alias("items_"), F.col("freq").alias("freq_"))
    after = sets.where("size = 1").select(*(F.col(c).alias(f"{c}__") for c in group), F.get("items", F.lit(0)).alias("item__"), F.col("support").alias("support__"))
    same = lambda tail: [F.col(c).eqNullSafe(F.col(f"{c}{tail}")) for c in group]
    both = one.join(before, [*same("_"), F.col("antecedent") == F.col("items_")]).join(after, [*same("__"), F.col("consequent") == F.col("item__")])
    both = both.withColumn("confidence", F.col("freq") / F.col("freq_")).where(F.col("confidence") >= min_confidence)
    return both.select(*group, "antecedent", "consequent", "confidence", (F.col("confidence") / F.col("support__")).alias("lift"), "support")


def frequent_sequences(df: DataFrame, group: list[str], owner: str, item: str, order_by: list[str], min_support: float = 0.005, max_length: int | None = None) -> DataFrame:
    """(*group, items, length, freq, support): sequences of items, in order but not side by side, of enough of a group's owners.

    ``order_by`` makes an owner's rows unique. A pattern's list has, for each owner, where its
    first occurrence ends. Patterns with the same items but for the last extend each other:
    the end is that of the other pattern where it lies behind, else the other item's next
    position, which is looked up in the owner's list of that item.
    """
    rows, classes = _numbered(df, group, owner, item, order_by)
    times = [f"t{i}" for i in range(len(order_by))]
    places = running(rows, ["tid", *times, "item"]).withColumnRenamed("__rn", "place")
    places = kept(places.select("class", "tid", "item", "place"), "sequences-places")
    enough = classes.select(F.col("class").alias("class_"), F.ceil(F.col("owners") * F.lit(min_support) - 1e-9).alias("least"))
    firsts = places.groupBy("class", "item", "tid").agg(F.min("place").alias("end"))
    counted = firsts.groupBy("class", "item").agg(F.count("*").alias("freq")).join(enough, F.col("class") == F.col("class_")).where("freq >= least")
    patterns = kept(counted.select("class", F.col("class").alias("prefix"), F.col("item").alias("last"), F.array("item").alias("items"), "freq").withColumn("pattern", F.monotonically_increasing_id()), "sequences-1")
    lists = firsts.join(patterns.select(F.col("class").alias("k"), F.col("last").alias("l"), "prefix", "pattern"), (F.col("class") == F.col("k")) & (F.col("item") == F.col("l"))).select("prefix", "pattern", F.col("item").alias("last"), "tid", "end")
    often = patterns.select(F.col("class").alias("k"), F.col("last").alias("l"))
    places = kept(places.join(often, (F.col("class") == F.col("k")) & (F.col("item") == F.col("l")), "left_semi").select("tid", "item", "place"), "sequences-often")
    out, length = patterns, 1
    while (max_length is None or length < max_length) and not patterns.isEmpty():
        lists = kept(lists, f"sequences-lists-{length}")
        a, b = lists.alias("a"), lists.alias("b")
        met = a.join(b, (F.col("a.prefix") == F.col("b.prefix")) & (F.col("a.tid") == F.col("b.tid")))
        met = kept(met.select(F.col("a.pattern").alias("prefix"), F.col("b.pattern").alias("other"), F.col("b.last").alias("last"), F.col("a.tid").alias("tid"), F.col("a.end").alias("from"), F.col("b.end").alias("end")), f"sequences-met-{length}")
        behind = met.where(F.col("end") > F.col("from")).select("prefix", "other", "last", "tid", "end")
        asked = met.where(F.col("end") <= F.col("from"))
        # the next position of an item: rows of an owner and an item from the last to the first, questions before an equal position
        both = asked.select("tid", F.col("last").alias("item"), F.col("from").alias("place")).distinct().withColumn("at", F.lit(None).cast("long")).unionByName(places.withColumn("at", F.col("place")))
        later = Window.partitionBy("tid", "item").orderBy(F.desc("place"), F.col("at").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
        answers = both.withColumn("next", F.min("at").over(later)).where("at is null and next is not null").select(F.col("tid").alias("tid_"), F.col("item").alias("item_"), F.col("place").alias("place_"), "next")
        looked = asked.join(answers, (F.col("tid") == F.col("tid_")) & (F.col("last") == F.col("item_")) & (F.col("from") == F.col("place_"))).select("prefix", "other", "last", "tid", F.col("next").alias("end"))
        longer = kept(behind.unionByName(looked), f"sequences-longer-{length}")
        counts = longer.groupBy("prefix", "other", "last").agg(F.count("*").alias("freq"))
        first = patterns.select("class", F.col("pattern").alias("p"), "items").join(enough, F.col("class") == F.col("class_"))
        new = counts.join(first, F.col("prefix") == F.col("p")).where("freq >= least")
        new = kept(new.select("class", "prefix", "other", "last", F.array_append("items", F.col("last")).alias("items"), "freq").withColumn("pattern", F.monotonically_increasing_id()), f"sequences-{length + 1}")
        named = new.select(F.col("prefix").alias("p"), F.col("other").alias("o"), "pattern")
        lists = longer.join(named, (F.col("prefix") == F.col("p")) & (F.col("other") == F.col("o"))).select("prefix", "pattern", "last", "tid", "end")
        out, patterns, length = out.unionByName(new.drop("other")), new.drop("other"), length + 1
    return out.join(classes.withColumnRenamed("class", "class_"), F.col("class") == F.col("class_")).select(*group, "items", F.size("items").alias("length"), "freq", (F.col("freq") / F.col("owners")).alias("support"))
