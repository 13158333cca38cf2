"""Positions, quotas and samples: order-dependent operators without single-task windows.

Random orders are hash orders (seed and key), so every draw is the same on any
cluster and in SQL. ``global_rank`` numbers all rows of a table by ranking
within ordered buckets and adding the sizes of the buckets before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions.hashing import hash_order


def id_bucket(df: DataFrame, key: str, buckets: int = 256) -> tuple[DataFrame, Column]:
    """``df`` with the range of an integer key, and a bucket that never decreases with it."""
    span = df.agg(F.min(key).alias("__lo"), F.max(key).alias("__hi"))
    ranged = df.crossJoin(F.broadcast(span))  # one row
    width = (F.col("__hi") - F.col("__lo") + 1).cast("double")
    return ranged, F.least(F.floor((F.col(key) - F.col("__lo")) * buckets / width), F.lit(buckets - 1)).cast("int")


def global_rank(df: DataFrame, order: Sequence[Column], bucket: Column, name: str = "position") -> DataFrame:
    """``df`` with positions from 0 in ``order``; ``bucket`` must not decrease along it."""
    put = df.withColumn("__bucket", bucket)
    sizes = put.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))  # a row for each bucket
    base = sizes.select("__bucket", F.coalesce(before, F.lit(0)).alias("__base"))
    own = F.row_number().over(W.partitionBy("__bucket").orderBy(*order)) - 1
    ranked = put.withColumn("__own", own).join(F.broadcast(base), "__bucket")
    return ranked.withColumn(name, F.col("__base") + F.col("__own")).drop("__bucket", "__own", "__base", "__n", "__lo", "__hi")


def rank_by_id(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """Positions by an integer key."""
    ranged, bucket = id_bucket(df, key)
    return global_rank(ranged, [F.col(key)], bucket, name)


def rank_by_hash(df: DataFrame, seed: int | str, key: str, name: str = "position") -> DataFrame:
    """Positions in a seeded random order."""
    h = hash_order(seed, F.col(key))
    ordered = df.withColumn("__h", h)
    return global_rank(ordered, [F.col("__h"), F.col(key)], F.conv(F.substring("__h", 1, 2), 16, 10).cast("int"), name).drop("__h")


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group; groups shrink before the shuffle."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def take_per_group(df: DataFrame, by: Sequence[str], seed: int | str, key: str, quota: Column | int) -> DataFrame:
    """The first ``quota`` rows of each group in hash order, with their rank."""
    w = W.partitionBy(*by).orderBy(hash_order(seed, F.col(key)), F.col(key))
    return df.withColumn("bucket_rank", F.row_number().over(w)).filter(F.col("bucket_rank") <= quota)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def balance(df: DataFrame, key: str, target: int, fake_share: float = 0.5, seed: int = 1729, groups: int = 3) -> DataFrame:
    """A balanced pool of ``target`` rows(verdict, candidate, key): quotas for each verdict and candidate, topped up from the rest.

    ``reason`` tells the step that chose a row. The result is a fixed-size report.
    """
    n_fake, n_real = int(target * fake_share), int(target * (1 - fake_share) * 0.85)
    n_open = target - n_fake - n_real
    quota = {"FAKE": max(1, n_fake // groups), "REAL": max(1, n_real // groups)}
    h = hash_order(seed, F.col(key))
    # no row beyond these can be chosen; groups are cut to them before the shuffle
    few = take_per_group(df, ["verdict", "candidate"], seed, key, 2 * target).drop("bucket_rank")
    ranked = few.withColumn("__h", h).withColumn("__r", F.row_number().over(W.partitionBy("verdict", "candidate").orderBy(F.col("__h"), F.col(key))))
    opens = ranked.withColumn("__u", F.row_number().over(W.partitionBy("verdict").orderBy(F.col("__h"), F.col(key))))
    step = (
        F.when((F.col("verdict") == "FAKE") & (F.col("__r") <= quota["FAKE"]), 0)
        .when((F.col("verdict") == "REAL") & (F.col("__r") <= quota["REAL"]), 0)
        .when((F.col("verdict") == "UNCERTAIN") & (F.col("__u") <= n_open), 1)
        .otherwise(2)
    )
    chosen = opens.withColumn("step", step).orderBy("step", "__h", key).limit(target)
    return chosen.withColumn("reason", F.element_at(F.array(F.lit("quota"), F.lit("uncertain"), F.lit("top_up")), F.col("step") + 1)).drop("__h", "__r", "__u", "step")


def curate(df: DataFrame, key: str, target: int, min_real: float = 0.35, max_open: float = 0.10, seed: int = 1729) -> DataFrame:
    """A pool of ``target`` rows: a reserve of REAL, a cap on UNCERTAIN, FAKE for the rest, then leftovers; pool_index from 0."""
    n_real, n_open = max(1, int(target * min_real)), max(1, int(target * max_open))
    h = hash_order(seed, F.col(key))
    w = W.partitionBy("verdict").orderBy(F.col("__h"), F.col(key))
    few = take_per_group(df, ["verdict"], seed, key, 2 * target).drop("bucket_rank")  # no row beyond these can be chosen
    ranked = few.withColumn("__h", h).withColumn("__r", F.row_number().over(w))
    sizes = df.agg(
        F.least(F.count_if(F.col("verdict") == "REAL"), F.lit(n_real)).alias("__a"), F.least(F.count_if(F.col("verdict") == "UNCERTAIN"), F.lit(n_open)).alias("__b")
    )
    ranked = ranked.crossJoin(F.broadcast(sizes))  # one row
    step = (
        F.when((F.col("verdict") == "REAL") & (F.col("__r") <= n_real), 1)
        .when((F.col("verdict") == "UNCERTAIN") & (F.col("__r") <= n_open), 2)
        .when((F.col("verdict") == "FAKE") & (F.col("__r") <= target - F.col("__a") - F.col("__b")), 3)
        .otherwise(4)
    )
    chosen = ranked.withColumn("step", step).orderBy("step", "__h", key).limit(target)
    index = F.row_number().over(W.orderBy("step", "__h", key)) - 1  # over the target rows alone
    return chosen.withColumn("pool_index", index).drop("__h", "__r", "__a", "__b")


def split(df: DataFrame, key: str, label: str, shares: Sequence[tuple[str, float]] = (("train", 0.70), ("val", 0.15), ("test", 0.15)), seed: int = 42) -> DataFrame:
    """Stratified splits: in hash order, the first share of each label goes to the first split, and so on."""
    h = hash_order(seed, F.col(key))
    part = F.conv(F.substring(F.col("__h"), 1, 2), 16, 10).cast("int")
    put = df.withColumn("__h", h).withColumn("__part", part)
    sizes = put.groupBy(label, "__part").agg(F.count("*").alias("__n"))  # 256 rows a label
    by_label = W.partitionBy(label)
    base = sizes.select(label, "__part", F.coalesce(F.sum("__n").over(by_label.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"), F.sum("__n").over(by_label).alias("__all"))
    base = base.withColumnRenamed(label, "__label").withColumnRenamed("__part", "__p")
    own = F.row_number().over(W.partitionBy(label, "__part").orderBy("__h", key)) - 1
    ranked = put.withColumn("__own", own).join(base, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__part") == F.col("__p")))
    at = F.col("__base") + F.col("__own")
    out, reach = None, 0.0
    for name, share in shares[:-1]:
        reach += share
        test = at < F.floor(F.col("__all") * F.lit(round(reach, 9)))
        out = F.when(test, name) if out is None else out.when(test, name)
    return ranked.withColumn("split", out.otherwise(shares[-1][0])).drop("__h", "__part", "__label", "__p", "__base", "__all", "__own")


def apportion(counts: DataFrame, key: str, count: str, slots: int) -> DataFrame:
    """(key, slots): ``slots`` seats in proportion to counts by largest remainder, ties to the larger key. One row a key."""
    total = F.sum(count).over(W.partitionBy())
    raw = counts.withColumn("__raw", F.lit(slots) * F.col(count) / total).withColumn("__floor", F.floor("__raw"))
    left = F.lit(slots) - F.sum("__floor").over(W.partitionBy())
    rank = F.row_number().over(W.orderBy(F.desc(F.col("__raw") - F.col("__floor")), F.desc(key)))
    return raw.select(key, (F.col("__floor") + (rank <= left).cast("int")).cast("int").alias("slots"))


def chunk(df: DataFrame, tokens: str, size: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Fixed-size chunks of the concatenated tokens of each group; the incomplete tail goes."""
    lengths = df.withColumn("__n", F.size(tokens))
    start = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = lengths.withColumn("__start", start).select(*by, "__start", F.posexplode(tokens).alias("__k", "token"))
    at = F.col("__start") + F.col("__k")
    put = each.select(*by, F.floor(at / size).alias("chunk"), (at % size).alias("__at"), "token")
    whole = put.groupBy(*by, "chunk").agg(F.array_sort(F.collect_list(F.struct("__at", "token"))).alias("__t"))
    return whole.filter(F.size("__t") == size).select(*by, "chunk", F.transform("__t", lambda x: x["token"]).alias("tokens"))


def last_before(df: DataFrame, by: Sequence[str], order: Sequence[str], condition: Column, value: Column, name: str) -> DataFrame:
    """The value of the last row at or before each row where the condition held (a backward as-of join)."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.last_value(F.when(condition, value), F.lit(True)).over(w))


def best_run(df: DataFrame, by: Sequence[str], metrics: Sequence[str], key: str) -> DataFrame:
    """The row of each group that is largest by the metrics in turn, ties to the smaller key."""
    order = [F.desc_nulls_last(m) for m in metrics] + [F.asc(key)]
    return keep_first(df, by, order)


def first_appearance(items: DataFrame, entity: str, order: Sequence[str], category: str | None = None) -> DataFrame:
    """(entity[, category], index): entities numbered from 0 by first appearance, within each category.

    The numbering is over distinct entities only, one row each. Where the first
    column of the order is an integer, its range is cut into buckets that are
    ranked on their own, so that no task numbers all entities.
    """
    by = [entity] + ([category] if category else [])
    first = items.groupBy(*by).agg(F.min(F.struct(*order)).alias("first_at"))
    keys = [category] if category else []
    if items.schema[order[0]].dataType.typeName() not in ("long", "integer", "short", "byte"):
        w = W.partitionBy(*keys).orderBy("first_at")
        return first.withColumn("index", F.row_number().over(w) - 1)
    ranged, bucket = id_bucket(first.withColumn("__at", F.col(f"first_at.{order[0]}")), "__at")
    put = ranged.withColumn("__bucket", F.coalesce(bucket, F.lit(-1))).drop("__at", "__lo", "__hi")  # a null comes first
    sizes = put.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))  # a row for each bucket
    base = sizes.select(F.col("__bucket").alias("__b"), *[F.col(k).alias("__c") for k in keys], F.coalesce(before, F.lit(0)).alias("__base"))
    own = F.row_number().over(W.partitionBy(*keys, "__bucket").orderBy("first_at")) - 1
    same = F.col("__bucket") == F.col("__b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("__c"))
    ranked = put.withColumn("__own", own).join(base, same)
    return ranked.withColumn("index", F.col("__base") + F.col("__own")).select(*by, "first_at", "index")


def draw_decks(pool: DataFrame, users: DataFrame, days: int, per_day: int, real_per_day: int, open_share: float = 0.15) -> DataFrame:
    """(user_id, day, slot, id, verdict, counter_id): a reproducible deck for each user.

    ``pool``(id, verdict) and ``users``(user_id, seed). Each user's order of a
    stratum is a hash order; REAL, UNCERTAIN and FAKE ranks are dealt to days by
    quota, and a stratum that runs short is filled from the others' leftovers.
    counter_id is the last REAL that the user has seen by then. Only the first
    days * per_day of each stratum can be dealt, so ranks beyond go before the
    rows meet. The pool is a curated, fixed-size table.
    """
    n = days * per_day
    opens = int(per_day * open_share)
    order = hash_order("deck", F.col("seed"), F.col("id"))
    each = users.crossJoin(F.broadcast(pool.select("id", "verdict"))).withColumn("__h", order)
    rank = F.row_number().over(W.partitionBy("user_id", "verdict").orderBy("__h", "id"))
    ranked = each.withColumn("__r", rank).filter(F.col("__r") <= n)
    quota = F.when(F.col("verdict") == "REAL", real_per_day).when(F.col("verdict") == "UNCERTAIN", opens).otherwise(per_day - real_per_day - opens)
    within = F.col("__r") <= quota * days
    filled = ranked.withColumn("__p", F.when(within, 0).otherwise(F.when(F.col("verdict") == "FAKE", 1).when(F.col("verdict") == "UNCERTAIN", 2).otherwise(3)))
    place = F.row_number().over(W.partitionBy("user_id").orderBy("__p", "__h", "id"))
    chosen = filled.withColumn("__place", place).filter(F.col("__place") <= n)
    own_day = F.when(F.col("__p") == 0, F.ceil(F.col("__r") / F.greatest(quota, F.lit(1))).cast("int"))
    dated = chosen.withColumn("__day", own_day)
    # rows without a day of their own fill the days in turn
    spot = F.row_number().over(W.partitionBy("user_id").orderBy(F.col("__day").asc_nulls_last(), "__h", "id"))
    dealt = dated.withColumn("day", F.ceil(F.row_number().over(W.partitionBy("user_id").orderBy(F.coalesce("__day", F.lit(days + 1)), spot)) / per_day).cast("int"))
    slot = F.row_number().over(W.partitionBy("user_id", "day").orderBy("__h", "id"))
    decked = dealt.withColumn("slot", slot)
    return last_before(decked, ["user_id"], ["day", "slot"], F.col("verdict") == "REAL", F.col("id"), "counter_id").select(
        "user_id", "day", "slot", "id", "verdict", F.when(F.col("verdict") == "FAKE", F.col("counter_id")).alias("counter_id")
    )


# What a new tactic is worth to a sample, and what a candidate or a tier beyond its share costs.
NEW_TACTIC, OVER_CANDIDATE, OVER_TIER = 10.0, 3.0, 2.0


def stratified_sample(pool: DataFrame, n: int, seed: int = 1729) -> DataFrame:
    """``n`` rows of pool(id, verdict, candidate, tier, tactic), greedily spread: hard quotas by verdict, new tactics first, then balance.

    The greedy choice is sequential. It runs over a bounded candidate table: for
    each (verdict, candidate, tier, tactic) only the first n rows in hash order
    can ever be chosen. Rows of one such group are worth the same at any step,
    so that only the first of each that is left is looked at.
    """
    import pandas as pd

    few = take_per_group(pool.select("id", "verdict", "candidate", "tier", "tactic"), ["verdict", "candidate", "tier", "tactic"], seed, "id", n)
    verdicts = apportion(pool.groupBy("verdict").agg(F.count("*").alias("n")), "verdict", "n", n).select(F.lit("verdict").alias("axis"), F.col("verdict").alias("k"), "slots")
    tiers = apportion(pool.groupBy("tier").agg(F.count("*").alias("n")), "tier", "n", n).select(F.lit("tier").alias("axis"), F.col("tier").alias("k"), "slots")
    quotas = verdicts.unionByName(tiers)
    marked = few.withColumn("__h", hash_order(seed, F.col("id"))).drop("bucket_rank").withColumn("__one", F.lit(1))

    def pick(cards: pd.DataFrame, limits: pd.DataFrame) -> pd.DataFrame:
        axes = ("verdict", "candidate", "tier", "tactic")
        waiting: dict[tuple, list[dict]] = {}
        for r in cards.sort_values(["__h", "id"], ascending=False).to_dict("records"):
            waiting.setdefault(tuple(r[a] for a in axes), []).append(r)
        limit = {(r["axis"], r["k"]): int(r["slots"]) for r in limits.to_dict("records")}
        names = sorted({key[1] for key in waiting if key[1] is not None})
        share = {c: n // len(names) + (i < n % len(names)) for i, c in enumerate(names)}
        count: dict[tuple, int] = {}
        chosen: list[dict] = []

        def worth(r: dict) -> float:
            over = lambda axis, cap: max(0, count.get((axis, r[axis]), 0) - cap)
            new = ("tactic", r["tactic"]) not in count
            return NEW_TACTIC * new - OVER_CANDIDATE * over("candidate", share.get(r["candidate"], 0)) - OVER_TIER * over("tier", limit.get(("tier", r["tier"]), 0))

        while len(chosen) < n and waiting:
            heads = sorted((rows[-1] for rows in waiting.values()), key=lambda r: (r["__h"], r["id"]))
            free = [r for r in heads if count.get(("verdict", r["verdict"]), 0) < limit.get(("verdict", r["verdict"]), 0)]
            best = max(free, key=worth) if free else heads[0]
            key = tuple(best[a] for a in axes)
            waiting[key].pop()
            if not waiting[key]:
                del waiting[key]
            chosen.append(best)
            for axis in axes:
                count[axis, best[axis]] = count.get((axis, best[axis]), 0) + 1
        out = pd.DataFrame(chosen, columns=[c for c in cards.columns if c != "__one"]).drop(columns="__h")
        out["pick"] = range(1, len(out) + 1)
        return out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pool.select("id", "verdict", "candidate", "tier", "tactic").schema) + ", pick int"
    return marked.groupBy("__one").cogroup(quotas.withColumn("__one", F.lit(1)).groupBy("__one")).applyInPandas(pick, schema)
