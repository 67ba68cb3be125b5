"""Mixing sources to target weights by weighted sampling without replacement.

Each source gets a token budget: its share of the target weights times the total. A source is taken whole as many
times as its budget holds it (epochs), and what is left is filled by Efraimidis-Spirakis sampling: each row gets the
exponential key -ln(u) / w, u from a hash of the row and the seed and w its quality weight; rows are taken
in the order of their keys while the sum of their tokens stays within what is left.

The order within a source is never established as a whole. The range of its keys is cut to CELLS, which are summed, and the cell in
which the budget ends is cut again, until it holds RANGE_ROWS rows or one key; only these rows are sorted.
So a source that holds most of the corpus is no single task, whatever the distribution of its weights.

Defined cases: a null or empty text has no token: it comes with each whole epoch and never in the fraction (it fills
no budget); a null source is a source of its own; ties of keys (rows repeated as a whole) are taken in the
order of (doc_id, null first, row key) and, as equals, together, if the budget holds them all; weights must be positive and a source without a given weight gets
none of the budget; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeflow.llm.common import cut

#: Tempering: a source's share of the mixture goes with its tokens to this power.
TEMPERATURE = 0.7
SEED = 17
#: Rows of a source that are sorted, and cells to a range of keys.
RANGE_ROWS = 20_000
CELLS = 1024
_BAD = "#$%&*@^~<>{}[]=+_|!?0123456789"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\f\\r]+")), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """Square of the share of characters that are neither symbols nor digits; 0.05 at least."""
    size = F.length(text)
    share = F.length(F.translate(text, _BAD, "")) / F.greatest(size, F.lit(1)).cast("double")
    return F.coalesce(F.greatest(F.lit(0.05), share * share), F.lit(0.05))


def uniform(seed: int) -> Column:
    """In (0, 1), of doc_id and text."""
    told = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return (F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _row_key(d: Column, text: Column) -> Column:
    return F.xxhash64(d, text)


def _limits(row: DataFrame, weights: dict[str | None, float] | None, total: int | None) -> DataFrame:
    """(s, epochs, left, k, d, r) of each source that gets a part of the budget: how often it is taken whole, the tokens that are left, and the place
    (k, d, r) from which on its rows do not fit there (null: all do). row: (s, t, k, d, r), in the shared folder.
    """
    spark = row.sparkSession
    held = row.groupBy("s").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("rows"), F.min("k").alias("low"), F.max("k").alias("high"))
    if weights is None:
        held = held.withColumn("w", F.pow(F.col("tokens").cast("double"), F.lit(TEMPERATURE)))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], f"name {row.schema['s'].dataType.simpleString()}, w double")
        held = held.join(given, F.col("s").eqNullSafe(F.col("name")), "left").drop("name").fillna(0.0, ["w"])
    held = cut(held)
    tokens, share = held.agg(F.sum("tokens"), F.sum("w")).first()
    if weights is not None:
        share = sum(weights.values())
    total = (tokens or 0) if total is None else total
    budget = F.floor(F.lit(float(total)) * F.col("w") / F.lit(float(share or 1.0)))
    epochs = F.when(F.col("tokens") > 0, F.floor(budget / F.col("tokens"))).otherwise(0).cast("bigint")
    plan = cut(held.select("s", epochs.alias("epochs"), (budget - epochs * F.col("tokens")).cast("bigint").alias("left"), "rows", "low", "high"))
    # the range of keys in which a budget ends: halved by CELLS until it holds no more than RANGE_ROWS rows, or one key
    open_ = plan.where("left > 0").select("s", "left", F.lit(0).cast("bigint").alias("before"), "low", "high", "rows")
    while open_.where((F.col("rows") > RANGE_ROWS) & (F.col("low") < F.col("high"))).limit(1).count():
        cell = F.least(F.floor((F.col("k") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * CELLS), F.lit(CELLS - 1))
        inside = row.join(open_.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")) & F.col("k").between(F.col("low"), F.col("high")))
        sums = inside.groupBy("s", "left", "before", F.coalesce(cell, F.lit(0)).alias("cell")).agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("rows"), F.min("k").alias("low"), F.max("k").alias("high"))
        upto = F.col("before") + F.sum("t").over(Window.partitionBy("s").orderBy("cell"))  # CELLS rows a source at most
        last = sums.withColumn("upto", upto).where("upto > left").groupBy("s").agg(F.min(F.struct("cell", "left", (F.col("upto") - F.col("t")).alias("before"), "low", "high", "rows")).alias("x"))
        open_ = cut(last.select("s", "x.left", "x.before", "x.low", "x.high", "x.rows"))
    inside = row.join(open_.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")) & F.col("k").between(F.col("low"), F.col("high")))
    equal = inside.groupBy("s", "left", "before", "k", "d", "r").agg(F.sum("t").alias("t"))
    upto = F.col("before") + F.sum("t").over(Window.partitionBy("s").orderBy("k", F.col("d").asc_nulls_first(), "r"))
    stop = equal.withColumn("upto", upto).where("upto > left").groupBy("s").agg(F.min(F.struct("k", "d", "r")).alias("stop"))
    return cut(plan.join(stop.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left").where("epochs > 0 or left > 0").select("s", "epochs", "left", "stop"))


def _taken(keyed: DataFrame, limits: DataFrame) -> DataFrame:
    """keyed with an epoch, once for each time that a row is taken."""
    joined = keyed.join(limits.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")))
    partly = (F.col("t") > 0) & (F.col("left") > 0) & (F.col("stop").isNull() | (F.struct("k", "d", "r") < F.col("stop")))
    times = joined.withColumn("times", (F.col("epochs") + F.when(partly, 1).otherwise(0)).cast("int")).where("times > 0")
    return times.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))


def _keyed(docs: DataFrame, seed: int, quality: Column | None) -> list[Column]:
    text, d = F.col("text").cast("string"), F.col("doc_id").cast("bigint")
    weight = quality_weight(text) if quality is None else quality.cast("double")
    return [F.col("source").alias("s"), n_tokens(text).alias("t"), (-F.log(uniform(seed)) / weight).alias("k"), d.alias("d"), _row_key(d, text).alias("r")]


def report(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = SEED, quality: Column | None = None) -> DataFrame:
    """(doc_id, source, epoch, n_tokens) of each row of the mixture.

    weights: target share by source; by default tempered by TEMPERATURE. total: tokens of the mixture; by
    default those of docs. quality: each row's weight, positive; by default quality_weight. The text is read once.
    """
    row = cut(docs.select(*_keyed(docs, seed, quality)))
    limits = _limits(row.where("t > 0"), weights, total)
    return _taken(row, limits).select(F.col("d").alias("doc_id"), F.col("s").alias("source"), F.col("epoch").cast("bigint").alias("epoch"), F.col("t").alias("n_tokens"))


def sample(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = SEED, quality: Column | None = None) -> DataFrame:
    """The rows of the mixture with the columns of docs. The text is read twice: for the keys, and to be taken."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    limits = _limits(cut(docs.select(*_keyed(docs, seed, quality)).where("t > 0")), weights, total)
    return _taken(docs.select(*_keyed(docs, seed, quality), whole), limits).select("whole.*")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\f\\r]+')) AS BIGINT) AS t,
    length(translate(text, '{_BAD}', '')) / greatest(length(text), 1)::DOUBLE AS share,
    (('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, '-'), md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52}::DOUBLE AS u
  FROM documents),
keyed AS (SELECT doc_id, source, t, -ln(u) / coalesce(greatest(0.05, share * share), 0.05) AS k FROM d),
held AS (SELECT source, sum(t) AS t, pow(sum(t)::DOUBLE, {TEMPERATURE}) AS w FROM keyed GROUP BY source),
budget AS (SELECT source, t, CAST(floor((SELECT sum(t) FROM held)::DOUBLE * w / (SELECT sum(w) FROM held)) AS BIGINT) AS b FROM held),
plan AS (SELECT source, CASE WHEN t > 0 THEN b // t ELSE 0 END AS epochs, CASE WHEN t > 0 THEN b % t ELSE 0 END AS rest FROM budget),
summed AS (SELECT k.*, p.epochs, p.rest, sum(k.t) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id) AS upto
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source),
times AS (SELECT *, epochs + CASE WHEN t > 0 AND upto <= rest THEN 1 ELSE 0 END AS n FROM summed)
SELECT doc_id, source, CAST(unnest(range(CAST(n AS BIGINT))) AS BIGINT) AS epoch, t AS n_tokens FROM times WHERE n > 0
"""
