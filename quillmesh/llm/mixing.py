"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with share w of the mix and size n has mean repetition rate
w * total / n. A row's count inverts the Poisson distribution at a uniform
number hashed from seed and id; a rate above PART is a sum of equal parts,
each with its own hash, which is the same distribution without underflow. Rows
are exploded by their count and dealt to partitions by a hash of seed, id and
copy, and ordered by it: a global shuffle.

Edge cases: a null source is a source of its own; null texts count as empty;
a source without characters counts as one character; a null id hashes as the
empty string; repeated rows get equal counts; an empty table gives an empty
result; all input columns are carried, and names of the added ones win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import free_name, materialise, table

SEED = 17
#: Weights are sizes to this power where none are given; 0.5 lies between natural and uniform.
TEMPERATURE = 0.5
#: Rates above this are split into equal parts.
PART = 16.0
#: Terms of a part's distribution: beyond them the chance is below the steps of a double.
TERMS = 96


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the md5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, temperature: float = TEMPERATURE) -> DataFrame:
    """(mix_source, rate): one row a source. ``weights`` need not sum to one; sources they omit get rate 0."""
    size = F.greatest(F.sum(F.length(F.coalesce("text", F.lit("")))), F.lit(1)).cast("double")
    sizes = docs.groupBy(F.col("source").alias("mix_source")).agg(size.alias("size"))
    if weights is None:
        weight = F.sqrt("size") if temperature == 0.5 else F.pow("size", F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    weighed = sizes.withColumn("weight", weight)
    total = weighed.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    return weighed.crossJoin(F.broadcast(total)).select(  # one row
        "mix_source", (F.lit(epochs) * F.col("weight") / F.col("all_weight") * F.col("all_size") / F.col("size")).alias("rate")
    )


def distribution(rate: Column) -> Column:
    """The Poisson distribution function at 0..TERMS as an array."""
    first = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, step)["c"]


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """``docs`` with copy (from 1), n_copies and shuffle_key; rows of count 0 are gone."""
    added = {"copy", "n_copies", "shuffle_key"}
    docs = docs.select(*[c for c in docs.columns if c.lower() not in added])
    source, rate, parts, cdf = (free_name(docs, f"mix_{x}") for x in ("source", "rate", "parts", "cdf"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    by_source = rates(docs, weights, epochs, temperature).toDF(source, rate)
    by_source = by_source.withColumn(parts, F.greatest(F.ceil(F.col(rate) / PART), F.lit(1)).cast("int"))
    by_source = by_source.withColumn(cdf, distribution(F.col(rate) / F.col(parts))).drop(rate)
    # written first, so that the planner knows its size: a small table is broadcast under the session's threshold, a large one is not
    by_source = materialise(by_source, "rates")
    joined = docs.join(by_source, docs["source"].eqNullSafe(by_source[source]))
    draw = lambda j: F.size(F.filter(cdf, lambda c: c <= uniform(F.lit(str(seed)), key, j.cast("string"))))
    counts = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda n, j: n + draw(j))
    counted = joined.withColumn("n_copies", counts).filter("n_copies > 0").drop(source, parts, cdf)
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), key, F.col("copy").cast("string")).cast("binary"))
    return copies.withColumn("shuffle_key", order).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents mixed to the square root of their sources' sizes, one epoch in all."""
    mixed = replicate(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "text", "copy", "n_copies", "shuffle_key")


ORACLE_OP10 = f"""
WITH sizes AS (
  SELECT source, greatest(sum(length(coalesce(text, ''))), 1)::DOUBLE AS size FROM documents GROUP BY source
), rated AS (
  SELECT source, sqrt(size) / (SELECT sum(sqrt(size)) FROM sizes) * (SELECT sum(size) FROM sizes) / size AS rate FROM sizes
), parts AS (
  SELECT source, greatest(ceil(rate / {PART}), 1)::INT AS parts, rate / greatest(ceil(rate / {PART}), 1) AS part FROM rated
), terms AS (
  SELECT source, parts, k, exp(-part) * coalesce(product(part / nullif(k2, 0)), 1) AS p
  FROM parts, (SELECT unnest(range(0, {TERMS + 1})) AS k) a, (SELECT unnest(range(0, {TERMS + 1})) AS k2) b
  WHERE k2 <= k GROUP BY source, parts, part, k
), cdf AS (
  SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms
), draws AS (
  SELECT d.doc_id, d.source, d.lang, d.text, j.j,
    ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '') || ':' || j.j), 1, 13))::BIGINT / {float(1 << 52)} AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, p.parts + 1)) AS j) j
), counted AS (
  SELECT doc_id, source, lang, text, sum((SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM draws.source AND c <= u))::INT AS n_copies
  FROM draws GROUP BY doc_id, source, lang, text
), copies AS (
  SELECT *, unnest(range(1, n_copies + 1))::INT AS copy FROM counted WHERE n_copies > 0
)
SELECT doc_id, source, lang, text, copy, n_copies, md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key FROM copies
"""
