"""References to records that don't exist, or didn't at the time of the reference.

Keys become integers, the target's sorted keys are compressed into runs of consecutive integers, and each reference is
matched as of the start of the run before it: a key beyond that run's end is missing. The times of the keys that do
exist are judged by the same match, with the stretches in which a target row is live as runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cuts import cut
from .skew import attach_groups

#: Bits of a key integer below the part by which runs are spread over tasks: a task's group has at most 2^20 keys.
RUN_BITS = 20
#: Times of keys with gaps are spread over tasks by key and day, and a day's references over parts of so many.
BLOCK_US = 86_400_000_000
PART_ROWS = 100_000
FOREVER = 1 << 62
#: By rule: all that Unicode or ASCII counts as white space.
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def clean_key(key: Column) -> Column:
    """The key in upper case without surrounding white space; null where nothing is left."""
    bare = F.upper(F.btrim(key, F.lit(WHITE_SPACE)))
    return F.when(bare != "", bare)


def key_parts(clean: Column) -> tuple[Column, Column]:
    """(rest, integer) of a clean key, different for different keys.

    Up to 11 letters and digits are read in base 36 behind a leading 1, which keeps leading zeros apart. Any other key
    stays whole in `rest`, with integer 0.
    """
    plain = clean.rlike("^[0-9A-Z]{1,11}$")
    return F.when(plain, F.lit("")).otherwise(clean), F.when(plain, F.conv(F.concat(F.lit("1"), clean), 36, 10).cast("long")).otherwise(F.lit(0))


def key_runs(keys: DataFrame) -> DataFrame:
    """Runs of consecutive integers among distinct keys (rest, num): columns rest, part, run_from, run_to."""
    ordered = Window.partitionBy("rest", "part").orderBy("num")
    return (
        keys.withColumn("part", F.shiftright("num", RUN_BITS))
        .withColumn("run", F.col("num") - F.row_number().over(ordered))
        .groupBy("rest", "part", "run").agg(F.min("num").alias("run_from"), F.max("num").alias("run_to"))
        .drop("run")
    )


def missing_keys(referred: DataFrame, existing: DataFrame) -> DataFrame:
    """`referred` (distinct rest, num) with `missing`: the key lies beyond the end of the run that starts at or before it."""
    runs = key_runs(existing).select("rest", "part", F.col("run_from").alias("num"), "run_to", F.lit(0).alias("what"))
    asked = referred.select("rest", F.shiftright("num", RUN_BITS).alias("part"), "num", F.lit(None).cast("long").alias("run_to"), F.lit(1).alias("what"))
    before = Window.partitionBy("rest", "part").orderBy("num", "what").rowsBetween(Window.unboundedPreceding, 0)
    matched = runs.unionByName(asked).withColumn("end", F.last("run_to", ignorenulls=True).over(before))
    return matched.filter("what = 1").select("rest", "num", F.coalesce(F.col("num") > F.col("end"), F.lit(True)).alias("missing"))


def find_orphans(refs: DataFrame, target: DataFrame) -> DataFrame:
    """Orphans among `refs` (row_id long, key string, at_us long), with their `kind`.

    `target` has key string, from_us and to_us long: a row is live from from_us until just before to_us, for good where
    to_us is null. Kinds: `missing` if no target row has the key; otherwise, where the reference has a time and no row
    with the key is live then, `late` before the key's first start, else `deleted`.

    Keys compare trimmed and in upper case. Null and blank keys refer to nothing and give no row; target rows with one
    are ignored, and a target row without from_us only makes its key exist. Every row of `refs` is judged on its own, so
    repeated rows come out as often as they stand there. With an empty target all references are missing.

    Most references are settled by their key: it is missing, or the stretches in which it is live have a moment in common
    and so make one stretch. Counts per key tell the hot ones, whose rows stay where they are. Only references to a key
    with stretches apart are matched in order of time, by key and day, in parts of PART_ROWS, with what earlier days leave
    behind carried over in one row per key, day and part.
    """
    rest, num = key_parts(F.col("key"))
    r = refs.filter("key is not null").select("row_id", "key", "at_us")
    t = target.select(clean_key(F.col("key")).alias("key"), "from_us", "to_us").filter("key is not null").select(rest.alias("rest"), num.alias("num"), "from_us", F.coalesce("to_us", F.lit(FOREVER)).alias("to_us"))
    k = ["rest", "num"]
    stretch = F.when(F.col("from_us").isNotNull(), F.col("to_us"))
    lives = t.groupBy(*k).agg(F.min("from_us").alias("first"), F.max("from_us").alias("last_from"), F.min(stretch).alias("soonest"), F.max(stretch).alias("end"))
    # keys are cleaned once per spelling, and rows find their key's verdict by its spelling
    spelt = r.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", "n", clean_key(F.col("key")).alias("clean")).filter("clean is not null")
    clean_rest, clean_num = key_parts(F.col("clean"))
    asked = cut(spelt.select("key", "n", clean_rest.alias("rest"), clean_num.alias("num")), "asked")
    verdict = missing_keys(asked.select(*k).distinct(), lives.select(*k))
    keys = asked.join(verdict, k).join(lives, k, "left").select("key", *k, "n", "missing", "first", "end", F.coalesce(F.col("last_from") > F.col("soonest"), F.lit(False)).alias("apart"))
    keys = cut(keys, "keys")

    at = F.col("at_us")
    kind = (
        F.when(F.col("missing"), "missing")
        .when(at.isNull(), F.lit(None))
        .when(F.col("first").isNull() | (at < F.col("first")), "late")
        .when(at >= F.col("end"), "deleted")
    )
    kind = F.when(F.col("apart") & at.isNotNull(), "open").otherwise(kind)
    judged = cut(attach_groups(r, keys, ["key"], "n").select(*k, "row_id", "at_us", kind.alias("kind")).filter("kind is not null"), "judged")
    settled = judged.filter("kind <> 'open'").select("row_id", "at_us", "kind")
    return settled.unionByName(_between_stretches(judged.filter("kind = 'open'").select(*k, "row_id", "at_us"), t))


def _between_stretches(refs: DataFrame, target: DataFrame) -> DataFrame:
    """(row_id, at_us, kind) of the references (rest, num, row_id, at_us) at whose time no stretch of their key is live."""
    block = lambda at: F.floor(at / F.lit(BLOCK_US))
    nothing = F.lit(None).cast("long")
    r = refs.withColumn("block", block(F.col("at_us")))
    live = target.filter("from_us is not null").groupBy("rest", "num", "from_us").agg(F.max("to_us").alias("to_us")).withColumn("block", block(F.col("from_us")))
    asked = r.groupBy("rest", "num", "block").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART_ROWS)).cast("int").alias("parts"))
    live = live.join(asked.select("rest", "num").distinct(), ["rest", "num"], "left_semi")
    days = live.groupBy("rest", "num", "block").agg(F.max("to_us").alias("to_us"), F.lit(None).cast("int").alias("parts"))
    days = days.unionByName(asked.withColumn("to_us", nothing))
    earlier = Window.partitionBy("rest", "num").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    carried = days.withColumn("carried", F.max("to_us").over(earlier)).filter("parts is not null")
    each_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    started = live.join(asked, ["rest", "num", "block"]).select("rest", "num", "block", each_part, F.col("from_us").alias("at_us"), F.lit(1).alias("what"), nothing.alias("row_id"), "to_us")
    rows = (
        carried.select("rest", "num", "block", each_part, F.lit(-(1 << 62)).alias("at_us"), F.lit(0).alias("what"), nothing.alias("row_id"), F.col("carried").alias("to_us"))
        .unionByName(started)
        .unionByName(r.join(asked, ["rest", "num", "block"]).select("rest", "num", "block", F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int").alias("part"), "at_us", F.lit(2).alias("what"), "row_id", nothing.alias("to_us")))
    )
    sofar = Window.partitionBy("rest", "num", "block", "part").orderBy("at_us", "what").rowsBetween(Window.unboundedPreceding, 0)
    reached = rows.select("what", "row_id", "at_us", F.max("to_us").over(sofar).alias("reach")).filter("what = 2")
    kind = F.when(F.col("reach").isNull(), "late").when(F.col("at_us") >= F.col("reach"), "deleted")
    return reached.select("row_id", "at_us", kind.alias("kind")).filter("kind is not null")


def epoch_us(value: Column) -> Column:
    """Microseconds of a time in milliseconds, or in seconds where it is at most 1e11."""
    return F.when(value > 100_000_000_000, value * 1000).otherwise(value * 1_000_000)


def year_of_us(us: Column) -> Column:
    """UTC year, 0 without a time."""
    return F.coalesce(F.year(F.timestamp_micros(us)).cast("long"), F.lit(0).cast("long"))
