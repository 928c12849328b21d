"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target of `budget` times all words, shared by weight and capped at `max_epochs` times the
source; what a cap frees is shared again by weight until no target is above its cap. A source's target is met
by complete epochs of all its documents first, then by a fraction: its documents in ascending order of the
exponential key -ln(u) / quality, prefix-summed up to the document whose middle still lies within what is left, so
the sum misses the target by half a document at most. u comes from a hash of
the id and the text, so reruns agree; `quality` is the share of ordinary letters in the text, so documents of
letters come first more often.

No source meets in one task. A source's cut is found in rounds: sizes are added up by (source, bucket of the key), the
running sums over a source's buckets tell which one the cut falls in, and that bucket is cut into buckets again until it
holds `FEW` different documents or one key. Only these are ordered one by one, after equal documents (key, id, size) were
added up. What a row needs is its source's cut, so rows may be of any width and are not shuffled; only equal rows that the cut
divides are numbered, by the partitions they lie in. The tables of sources and of cuts have one row a source.
Everything is DataFrame expressions.

Defined results: a null text has size 0 and is taken 0 words; null sources form one source, last in order; a
source of size 0 has target 0. Repeated rows are documents of their own (ties by id, null ids last, then size; equal rows are
interchangeable). Very long texts are counted whole. An empty table gives an empty table. `keyed` carries the columns it is
told to under names that can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import table, written

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
BUCKETS = 4096
FEW = 20_000
SEED = 7
ODD = r"[#*$%&|<>!{}\[\]=_~^0-9]"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """From 0.05 to 1: one less four times the share of characters rarely met in prose."""
    n = F.length(text)
    odd = F.regexp_count(text, F.lit(ODD))
    return F.when(n > 0, F.greatest(F.lit(0.05), 1 - 4 * odd / n)).otherwise(F.lit(0.05))


def uniform(doc_id: Column, text: Column) -> Column:
    """In (0, 1), from 52 bits of the MD5 of seed, id and text; any SQL can repeat it."""
    digest = F.md5(F.concat(F.lit(f"{SEED}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), text))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def keyed(docs: DataFrame, extra: list[str] = ()) -> DataFrame:
    """(doc_id, source, size, key, also `extra` columns): what the sampling needs of a document; the key is finite."""
    return docs.select(*extra, *_keyed_columns())


def _keyed_columns() -> list:
    text = F.coalesce(F.col("text"), F.lit(""))
    key = -F.ln(uniform(F.col("doc_id"), text)) / quality(text)
    return ["doc_id", "source", n_words(text).alias("size"), key.alias("key")]


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Water-filling without a loop: a source is capped if its cap over its weight is below the level. In ascending
    order of that ratio, source k is capped if all before it are and the level left without it exceeds its ratio.
    The windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("w", F.get(listed, (place % len(weights)).cast("int"))).withColumn("cap", most * F.col("source_size"))
    s = s.withColumn("total", budget * F.sum("source_size").over(Window.partitionBy()))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("w_left", F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.col("total") - F.col("spent")) / F.col("w_left"))
    s = s.withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    # The first source that is not capped fixes the level of all after it.
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("final", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(upto))
    target = F.coalesce(F.least(F.col("final") * F.col("w"), F.col("cap")), F.col("cap")).cast("double")
    return s.select("source", "source_size", target.alias("target"))


def _order(key: str = "key", doc_id: str = "doc_id", size: str = "size") -> Column:
    """The order of a source's documents, as a struct without nulls."""
    return F.struct(F.col(key).alias("key"), F.col(doc_id).isNull().alias("none"), F.coalesce(F.col(doc_id), F.lit(0)).cast("long").alias("id"), F.col(size).alias("size"))


def cuts(rows: DataFrame, targets: DataFrame, buckets: int, few: int) -> DataFrame:
    """(plan_source, cut, cut_taken): the first documents, in order, that are not taken whole, and how many of these equal ones are.

    Rows before the cut are taken, rows after it are not; sources without a cut are taken whole. targets has one row a source.
    """
    slim = rows.select("source", "key", "doc_id", "size")
    # Of each source: the interval of keys that the cut is in, and the sizes before it.
    every = F.struct(F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    open_ = targets.select("plan_source", "rest", F.lit(0).cast("long").alias("before"), every.lo.alias("lo"), every.hi.alias("hi"), F.lit(None).cast("long").alias("n"))
    found: list[DataFrame] = []
    while True:
        own = slim.join(open_, F.col("source").eqNullSafe(F.col("plan_source")) & F.col("key").between(F.col("lo"), F.col("hi")))
        share = (F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        share = F.when(F.col("hi") == float("inf"), 1 - F.exp(-F.col("key"))).otherwise(F.when(F.col("hi") > F.col("lo"), share).otherwise(0.0))
        cell = F.least(F.floor(buckets * share), F.lit(buckets - 1)).cast("int")
        cells = own.groupBy("plan_source", "rest", "before", cell.alias("cell")).agg(F.sum("size").alias("cell_size"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n"))
        run = Window.partitionBy("plan_source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("start", F.col("before") + F.coalesce(F.sum("cell_size").over(run), F.lit(0)))
        over = cells.filter(F.col("start") + F.col("cell_size") > F.col("rest")).groupBy("plan_source").agg(F.min_by(F.struct("rest", "start", "lo", "hi", "n"), "cell").alias("c"))
        over = written(over.select("plan_source", "c.rest", F.col("c.start").cast("long").alias("before"), "c.lo", "c.hi", "c.n"), "mix-open")
        small = (F.col("n") <= few) | (F.col("lo") == F.col("hi"))
        found.append(over.filter(small))
        open_ = over.filter(~small)
        if open_.isEmpty():
            break
    last = found[0]
    for more in found[1:]:
        last = last.unionByName(more)
    own = slim.join(last, F.col("source").eqNullSafe(F.col("plan_source")) & F.col("key").between(F.col("lo"), F.col("hi")))
    kinds = own.groupBy("plan_source", "rest", "before", "size", _order().alias("at")).agg(F.count(F.lit(1)).alias("c"))
    run = Window.partitionBy("plan_source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("start", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("c")).over(run), F.lit(0)))
    # The j-th of c equal documents is taken if its middle, start + (j - 1/2) * size, is within the rest.
    room = 2 * (F.col("rest") - F.col("start")) + F.col("size")
    fit = F.when(F.col("size") > 0, F.floor(room / (2 * F.col("size")))).otherwise(F.when(room >= 0, F.col("c")).otherwise(0))
    kinds = kinds.withColumn("fit", F.greatest(F.lit(0), F.least(fit, F.col("c"))).cast("long")).filter("fit < c")
    first = kinds.groupBy(F.col("plan_source").alias("cut_source")).agg(F.min_by(F.struct("at", "fit"), "at").alias("first"))
    # If the last document of the bucket has its middle within the rest, the cut is behind the bucket.
    behind = F.struct(F.col("hi").alias("key"), F.lit(True).alias("none"), F.lit(2**63 - 1).alias("id"), F.lit(2**63 - 1).alias("size"))
    both = last.join(first, F.col("plan_source").eqNullSafe(F.col("cut_source")), "left")
    at, fit = F.coalesce("first.at", behind), F.coalesce("first.fit", F.lit(0))
    return both.select(F.col("plan_source").alias("cut_source"), at.alias("cut"), fit.cast("long").alias("cut_taken"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with `number`, counted from 1 within each plan_source: running sums over partitions, then places within one."""
    placed = written(rows.withColumn("at_row", F.monotonically_increasing_id()), "mix-equal")
    placed = placed.withColumn("part", F.shiftright("at_row", 33))
    run = Window.partitionBy("plan_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("plan_source", "part").agg(F.count(F.lit(1)).alias("part_n"))
    parts = parts.select(F.col("plan_source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("part_n").over(run), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("plan_source", "part").orderBy("at_row")
    placed = placed.withColumn("place", F.row_number().over(within))
    same = F.col("plan_source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))
    return placed.join(parts, same).withColumn("number", F.col("earlier") + F.col("place")).drop("at_row", "part", "s", "p", "earlier", "place")


def mix(rows: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: int = MAX_EPOCHS, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """Add source_size, target, copies and taken to rows that `keyed` made; they are read several times."""
    sizes = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    targets = source_targets(sizes, weights, budget, most)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = written(targets.withColumnRenamed("source", "plan_source"), "mix-targets")
    plan = targets.join(cuts(rows, targets, buckets, few), F.col("plan_source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    plan = written(plan, "mix-plan")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    at = _order()
    divided = F.coalesce((at == F.col("cut")) & (F.col("cut_taken") > 0), F.lit(False))
    clear = joined.filter(~divided).withColumn("partial", F.col("cut").isNull() | (at < F.col("cut")))
    if plan.filter("cut_taken > 0").isEmpty():
        both = clear
    else:
        some = numbered(joined.filter(divided))
        both = clear.unionByName(some.withColumn("partial", F.col("number") <= F.col("cut_taken")).drop("number"))
    more = F.when(F.col("partial") & (F.col("epochs") < most), 1).otherwise(0)
    both = both.withColumn("copies", (F.col("epochs") + more).cast("int"))
    return both.withColumn("taken", F.col("size") * F.col("copies")).drop("plan_source", "epochs", "rest", "cut", "cut_taken", "partial")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, source, text, ...) as often as the mix takes it; nothing but ids, keys and sizes is shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # Keys are written once, with the whole rows beside them: what is read again is the few narrow columns.
    rows = written(docs.select(row, "doc_id", "source", "text").select("row", *_keyed_columns()), "mix-rows")
    taken = mix(rows).filter("copies > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return taken.select("row", copies).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(keyed(table(spark, sf_dir, "documents")), "mix-keys")
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows by sorting each source whole.
ORACLE_SQL = rf"""
WITH keyed AS (SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS size,
    -ln((CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || t), 1, 13) AS BIGINT) + 0.5) / CAST({1 << 52} AS DOUBLE))
    / (CASE WHEN length(t) > 0 THEN greatest(CAST(0.05 AS DOUBLE), 1 - 4 * CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>!{{}}\[\]=_~^0-9]', '', 'g')) AS DOUBLE) / length(t)) ELSE CAST(0.05 AS DOUBLE) END) AS key
  FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)),
sizes AS (SELECT source, sum(size) AS source_size FROM keyed GROUP BY source),
weighed AS (SELECT source, source_size, [{', '.join(f'{w}.0' for w in WEIGHTS)}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INT)]::DOUBLE AS w,
    CAST({MAX_EPOCHS} * source_size AS DOUBLE) AS cap, CAST({BUDGET} AS DOUBLE) * sum(source_size) OVER () AS total FROM sizes),
run AS (SELECT *, (total - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level, row_number() OVER o AS k FROM weighed
  WINDOW o AS (ORDER BY cap / w, source NULLS LAST), before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first_free AS (SELECT arg_min(level, k) AS level, min(k) AS k FROM run WHERE level * w <= cap),
targets AS (SELECT r.source, r.source_size, CASE WHEN f.k IS NULL OR r.k < f.k THEN r.cap ELSE least(f.level * r.w, r.cap) END AS target FROM run r, first_free f),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
placed AS (SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (epochs + CASE WHEN epochs < {MAX_EPOCHS} AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM placed"""
