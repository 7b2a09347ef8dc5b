"""Mixing sources to target weights: equal blocks of words dealt out by Sainte-Laguë quotients.

Sources in code-point order, null last, weigh 1, 2, 3, repeating. They share all words by weight,
but none gets more than ``MAX_REPEATS`` times its own words; the excess is shared again by weight
until none is above (water filling, solved in closed form from running sums).

The mix is then dealt in blocks of ``BLOCK`` words, twice by the same rule: to the sources by their
targets, and within a source to its shards by their words, which gives every shard an integer
quota. Highest quotients w / (2s - 1) win; the closed form w / (2s - 1) >= d settles all but two
seats for each claimant, and only those are ranked, so the cost does not grow with the blocks.
Within a shard, documents stand in an order drawn from a seed. A quota goes through them as often
as it fills the shard, and then as far as it reaches, so the last document is taken in part.

Only DataFrame functions. The texts are read once and reduced to (id, source, words, seeded hash),
which is checkpointed; only those four columns are ever shuffled. A source is split into shards of
about ``SHARD`` words by the hash, so a source with a third of all rows is spread over many tasks.
Tables with a row for each source, or for each shard of one source (at most ``MAX_SHARDS``), are the
only ones ordered as a whole.

Defined results: null or empty texts have 0 words and are never taken; null is a source of its own
and null ids are ordinary ids. Repeated rows are separate documents; equal rows get a share each,
in either order. Very long texts are counted to their end, and taken in part where a quota ends. An empty
table gives an empty mix. Equal quotients go to the source or shard
earlier in order. Other columns of the input never take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.shared import durable, words_of

BLOCK = 8
SHARD = 32_768
MAX_SHARDS = 4_096
MAX_REPEATS = 3
SEED = "mix-1"


def sizes(docs: DataFrame, key: str, text: str, source: str, seed: str) -> DataFrame:
    """__id, __source, __size, __order (hex, drawn from the seed, the id and the text)."""
    drawn = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))
    return docs.select(
        F.col(key).alias("__id"),
        F.col(source).alias("__source"),
        F.size(words_of(F.col(text))).cast("long").alias("__size"),
        drawn.alias("__order"),
    )


def targets(by_source: DataFrame) -> DataFrame:
    """Adds __weight and __target to a row for each source (__source, __total).

    Sources by rising cap for each unit of weight: those before the level reach their caps, and
    the others share what is left by weight.
    """
    ordered = Window.orderBy(F.col("__source").asc_nulls_last())
    filling = Window.orderBy(F.col("__cap") / F.col("__weight"), F.col("__rank"))
    upto = filling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = by_source.withColumn("__rank", F.row_number().over(ordered))
    weighed = ranked.withColumn("__weight", ((F.col("__rank") - 1) % 3 + 1).cast("long")).withColumn("__cap", F.col("__total") * MAX_REPEATS)
    sums = (
        weighed.withColumn("__all", F.sum("__total").over(everything))
        .withColumn("__weights", F.sum("__weight").over(everything))
        .withColumn("__capped", F.sum("__cap").over(upto) - F.col("__cap"))
        .withColumn("__below", F.sum("__weight").over(upto) - F.col("__weight"))
    )
    level = (F.col("__all") - F.col("__capped")) / (F.col("__weights") - F.col("__below"))
    # the first source that does not reach its cap sets the level for all after it
    stops = F.when(level * F.col("__weight") <= F.col("__cap"), F.struct(F.row_number().over(filling).alias("place"), level.alias("level")))
    filled = sums.withColumn("__level", F.min(stops).over(everything)["level"])
    share = F.col("__level") * F.col("__weight")
    return filled.withColumn(
        "__target", F.when(F.col("__level").isNull() | (share > F.col("__cap")), F.col("__cap").cast("double")).otherwise(share)
    ).select("__source", "__total", "__rank", "__weight", "__target")


def sainte_lague(claims: DataFrame, within: list[str], seats: str, weight: str, order: str, most: str) -> DataFrame:
    """Adds __seats to each claim: the seats of its group dealt by highest quotients.

    With n claimants of weight w and N seats for a total of W, divisors (N - n/2) / W and
    (N + n/2) / W give sums of rounded shares on either side of N. The seats between the two, about
    one for each claimant, are ranked by quotient. ``most`` bounds a claimant's seats.
    """
    group = Window.partitionBy(*within)
    n, total = F.count(F.lit(1)).over(group), F.sum(weight).over(group)
    share = claims.withColumn("__n", n).withColumn("__w", total)
    rounded = lambda shift: F.floor(F.col(weight) * F.greatest(F.lit(0.0), F.col(seats) + shift * F.col("__n")) / F.col("__w") + 0.5)
    sure = F.when(F.col("__w") > 0, F.greatest(F.lit(0), rounded(-0.5) - 1)).otherwise(F.lit(0)).cast("long")
    last = F.when(F.col("__w") > 0, rounded(0.5) + 1).otherwise(F.lit(0)).cast("long")
    bounds = share.withColumn("__sure", F.least(sure, F.col(most))).withColumn("__last", F.least(last, F.col(most)))
    left = bounds.withColumn("__left", F.col(seats) - F.sum("__sure").over(group))
    disputed = left.where(F.col("__last") > F.col("__sure")).select(
        *within, order, weight, "__left", F.explode(F.sequence(F.col("__sure") + 1, F.col("__last"))).alias("__seat")
    )
    by_quotient = Window.partitionBy(*within).orderBy((F.col(weight) / (2 * F.col("__seat") - 1)).desc(), F.col(order), F.col("__seat"))
    won = (
        disputed.withColumn("__place", F.row_number().over(by_quotient))
        .where(F.col("__place") <= F.col("__left"))
        .groupBy(*within, order)
        .agg(F.count(F.lit(1)).alias("__won"))
    )
    dealt = left.join(won, [*within, order], "left").withColumn("__seats", F.col("__sure") + F.coalesce("__won", F.lit(0)))
    return dealt.drop("__n", "__w", "__sure", "__last", "__left", "__won")


def _take(quota: Column) -> Column:
    """Words taken of a document: whole passes over the shard, then the part of the last pass."""
    passes = F.floor(quota / F.col("__shard_total"))
    rest = quota - passes * F.col("__shard_total")
    part = F.greatest(F.lit(0), F.least(F.col("__size"), rest - (F.col("__upto") - F.col("__size"))))
    return (passes * F.col("__size") + part).cast("long")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """key, size, source_size, target, taken, shard quota and the document's seeded hash."""
    sized = durable(sizes(docs, key, text, source, seed))
    by_source = targets(sized.groupBy("__source").agg(F.sum("__size").alias("__total"))).withColumn("__group", F.lit(0))
    blocks = by_source.withColumn("__n_blocks", F.round(F.sum("__target").over(Window.partitionBy("__group")) / BLOCK).cast("long"))
    blocks = blocks.withColumn("__most", F.ceil(F.col("__total") * MAX_REPEATS / BLOCK).cast("long"))
    sources = sainte_lague(blocks, ["__group"], "__n_blocks", "__target", "__rank", "__most").select(
        "__source",
        "__rank",
        F.col("__total").alias("__source_total"),
        "__target",
        F.col("__seats").alias("__source_seats"),
        F.greatest(F.lit(1), F.least(F.lit(MAX_SHARDS), F.ceil(F.col("__total") / SHARD))).cast("long").alias("__shards"),
    )
    sources = durable(sources)
    placed = durable(
        sized.join(sources, sized["__source"].eqNullSafe(sources["__source"]))
        .drop(sources["__source"])
        .withColumn("__shard", F.conv(F.substring("__order", 1, 8), 16, 10).cast("long") % F.col("__shards"))
    )
    shards = placed.groupBy("__rank", "__shard").agg(F.sum("__size").alias("__shard_total"), F.first("__source_seats").alias("__source_seats"))
    shards = shards.withColumn("__most", F.ceil(F.col("__shard_total") * MAX_REPEATS / BLOCK).cast("long"))
    quotas = durable(
        sainte_lague(shards, ["__rank"], "__source_seats", "__shard_total", "__shard", "__most").select(
            "__rank", "__shard", "__shard_total", F.least(F.col("__seats") * BLOCK, F.col("__shard_total") * MAX_REPEATS).alias("__quota")
        )
    )
    drawn = Window.partitionBy("__rank", "__shard").orderBy("__order", "__id", "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = placed.join(quotas, ["__rank", "__shard"]).withColumn("__upto", F.sum("__size").over(drawn))
    return lined.select(
        F.col("__id").alias(key),
        F.col("__size").alias("size"),
        F.col("__source_total").alias("source_size"),
        F.col("__target").alias("target"),
        F.when(F.col("__shard_total") > 0, _take(F.col("__quota"))).otherwise(F.lit(0)).cast("long").alias("taken"),
        F.col("__quota").alias("shard_quota"),
        F.col("__order").alias("drawn"),
    )


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", chars: str = "n_chars", seed: str = SEED) -> DataFrame:
    """The mix as documents: a row for each time a text is taken, the last one cut to its words.

    Rows are found again by the seeded hash of id and text. Where several rows have one hash, one of
    them stands for all and is given once for each of their decisions; only these are told apart by
    looking at rows again, so the texts are brought to their decisions once.
    """
    columns = docs.columns
    judged = mix(docs, key, text, source, seed).groupBy("drawn").agg(F.count(F.lit(1)).alias("__rows"), F.first("size").alias("size"), F.array_sort(F.collect_list(F.when(F.col("taken") > 0, F.col("taken")))).alias("__taken"))
    decided = durable(judged.where(F.size("__taken") > 0))
    drawn = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(f"__row.{key}").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(f"__row.{text}"), F.lit(""))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row")).withColumn("drawn", drawn)
    found = rows.join(decided.where("__rows = 1"), "drawn")
    twins = decided.where("__rows > 1")
    if not twins.isEmpty():
        found = found.unionByName(rows.join(twins, "drawn").dropDuplicates(["drawn"]))
    copies = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    dealt = found.withColumn("taken", F.explode("__taken")).withColumn("__copy", F.explode(copies))
    words = F.col("taken") - (F.col("__copy") - 1) * F.col("size")
    cut = F.array_join(F.slice(words_of(F.col(f"__row.{text}")), F.lit(1), words.cast("int")), " ")
    put_text = F.when(words >= F.col("size"), F.col(f"__row.{text}")).otherwise(cut)
    dealt = dealt.withColumn("__text", put_text)
    put = {text: F.col("__text"), chars: F.length("__text").cast("long")}
    return dealt.select(*[put.get(c, F.col("__row")[c]).alias(c) for c in columns])


def oracle() -> str:
    """The same mix in SQL."""
    return rf"""
    WITH RECURSIVE sized AS (
      SELECT doc_id AS id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
             md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS drawn
      FROM documents),
    src AS (
      SELECT source, total, rk, (rk - 1) % 3 + 1 AS weight, total * {MAX_REPEATS} AS cap
      FROM (SELECT source, sum(size)::BIGINT AS total, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM sized GROUP BY source)),
    filling AS (
      SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, rk) AS place, (sum(total) OVER () - (sum(cap) OVER w - cap))::DOUBLE / (sum(weight) OVER () - (sum(weight) OVER w - weight))::DOUBLE AS lvl
      FROM src WINDOW w AS (ORDER BY cap::DOUBLE / weight, rk ROWS UNBOUNDED PRECEDING)),
    level AS (SELECT arg_min(lvl, place) FILTER (WHERE lvl * weight <= cap) AS lvl FROM filling),
    tgt AS (
      SELECT source, total, rk, CASE WHEN level.lvl IS NULL OR level.lvl * weight > cap THEN cap::DOUBLE ELSE level.lvl * weight END AS target FROM filling, level),
    seats AS (SELECT round(sum(target) / {BLOCK})::BIGINT AS n FROM tgt),
    claim AS (
      SELECT t.*, greatest(0, least(floor(target * greatest(0.0, n - 0.5 * (SELECT count(*) FROM tgt)) / nullif(sum(target) OVER (), 0) + 0.5) - 1, ceil(total * {MAX_REPEATS} / {BLOCK})))::BIGINT AS sure,
             least(floor(target * (n + 0.5 * (SELECT count(*) FROM tgt)) / nullif(sum(target) OVER (), 0) + 0.5) + 1, ceil(total * {MAX_REPEATS} / {BLOCK}))::BIGINT AS lst
      FROM tgt t, seats),
    won AS (
      SELECT rk, count(*) AS won FROM (
        SELECT rk, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, rk, seat) AS place
        FROM (SELECT rk, target, unnest(generate_series(sure + 1, lst)) AS seat FROM claim))
      WHERE place <= (SELECT n FROM seats) - (SELECT sum(sure) FROM claim) GROUP BY rk),
    source_seats AS (
      SELECT c.source, c.rk, c.total, c.target, coalesce(c.sure, 0) + coalesce(won, 0) AS seats,
             greatest(1, least({MAX_SHARDS}, ceil(c.total / {SHARD})))::BIGINT AS shards
      FROM claim c LEFT JOIN won USING (rk)),
    placed AS (
      SELECT s.*, q.rk, q.total AS source_total, q.target, q.seats, ('0x' || substr(s.drawn, 1, 8))::BIGINT % q.shards AS shard
      FROM sized s JOIN source_seats q ON s.source IS NOT DISTINCT FROM q.source),
    shd AS (
      SELECT rk, shard, sum(size)::BIGINT AS total, any_value(seats) AS seats, ceil(sum(size) * {MAX_REPEATS} / {BLOCK})::BIGINT AS most
      FROM placed GROUP BY rk, shard),
    sclaim AS (
      SELECT *, greatest(0, least(floor(total * greatest(0.0, seats - 0.5 * count(*) OVER g) / nullif(sum(total) OVER g, 0) + 0.5) - 1, most))::BIGINT AS sure,
             least(floor(total * (seats + 0.5 * count(*) OVER g) / nullif(sum(total) OVER g, 0) + 0.5) + 1, most)::BIGINT AS lst
      FROM shd WINDOW g AS (PARTITION BY rk)),
    sleft AS (SELECT *, seats - sum(sure) OVER (PARTITION BY rk) AS lft FROM sclaim),
    swon AS (
      SELECT rk, shard, count(*) AS won FROM (
        SELECT rk, shard, lft, row_number() OVER (PARTITION BY rk ORDER BY total::DOUBLE / (2 * seat - 1) DESC, shard, seat) AS place
        FROM (SELECT rk, shard, total, lft, unnest(generate_series(sure + 1, lst)) AS seat FROM sleft))
      WHERE place <= lft GROUP BY rk, shard),
    quota AS (
      SELECT q.rk, q.shard, q.total, least((q.sure + coalesce(won, 0)) * {BLOCK}, q.total * {MAX_REPEATS})::BIGINT AS quota
      FROM sleft q LEFT JOIN swon USING (rk, shard)),
    lined AS (
      SELECT p.*, q.total AS shard_total, q.quota, sum(size) OVER (PARTITION BY p.rk, p.shard ORDER BY drawn, id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
      FROM placed p JOIN quota q USING (rk, shard))
    SELECT id AS doc_id, size, source_total AS source_size, target,
           CASE WHEN shard_total > 0 THEN (quota // shard_total) * size
             + greatest(0, least(size, quota % shard_total - (upto - size))) ELSE 0 END::BIGINT AS taken
    FROM lined
    """
