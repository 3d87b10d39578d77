"""Mix sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is put in a fixed random order and cut into blocks of about
`block_words` words of consecutive documents. A source's target fixes how many
blocks it gives: whole passes over the source and a last, partial pass, whose last
document is trimmed so that the words taken hit the target. The quotas of blocks
are split over the output shards by a binary tree: at each node the left half of
the shards gets a multivariate-hypergeometric draw from the node's counts, source
by source. A shard then takes its next blocks of each source, so blocks are
disjoint and none is left, and orders its documents by a hash.

DataFrame functions only. Words are counted, never moved: the work is on
(document, source, size) rows. Running sums over a source go by hash buckets, so a
source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.partitioned import number_rows, running_sum
from .common import WORD, broadcast_if_light, keep

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CEILING = 1.5, 2.0
BLOCK_WORDS = 16_384
# Words of one output shard, and the least number of shards, where none is given.
SHARD_WORDS, LEAST_SHARDS = 4_000_000, 16
BUCKETS = 512
SEED = 20_26


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, text_hash): size is the number of words; a null text has none."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(text).cast("string")).alias("text_hash"),
    )


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, weight, target): one row per source, the null source included.

    Sources by code point, null last, take the weights in turn. A source's target
    is weight * level, but at most `ceiling` times its size; the level is what the
    repeated sharing of the excess ends at: sources reach their ceiling in the order
    of size over weight, so it follows from running sums over that order.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    named = per_source.withColumn("weight", F.get(listed, turn))
    order = [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onwards = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.least(F.lit(share), F.lit(ceiling)) * F.sum("source_size").over(everything)
    # The level if this and all later sources are below their ceiling and all before are at it.
    level = (budget - ceiling * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(onwards)
    tried = named.withColumn("_cap", F.col("source_size") * ceiling).withColumn("_level", level)
    # The first source that stays below its ceiling sets the level for all after it.
    settled = F.min(F.when(F.col("weight") * F.col("_level") < F.col("_cap"), F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("_level").alias("v")))).over(everything)
    level_all = F.coalesce(settled["v"], F.lit(float("inf")))
    return tried.select("source", "source_size", "weight", F.least(F.col("_cap"), F.col("weight") * level_all).alias("target"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once: a lambda's argument is evaluated a single time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _log_weight(k: Column, total: Column, good: Column, drawn: Column) -> Column:
    """log P(k+1) / P(k) for k good among `drawn` out of `total`."""
    up = (good - k) * (drawn - k)
    down = (k + 1) * (total - good - drawn + k + 1)
    return F.log(up.cast("double") / down.cast("double"))


def hypergeometric(total: Column, good: Column, drawn: Column, uniform: Column) -> Column:
    """Draw by inverse distribution function; `uniform` in [0, 1).

    Weights are relative to the mode and cover 12 deviations to both sides, beyond
    which the mass is below double precision.
    """
    low = F.greatest(F.lit(0).cast("long"), drawn - (total - good))
    high = F.least(good, drawn)
    t, g, d = total.cast("double"), good.cast("double"), drawn.cast("double")
    spread = F.sqrt(F.greatest(d * g / t * (1 - g / t) * (t - d) / F.greatest(t - 1, F.lit(1.0)), F.lit(0.0)))
    reach = F.ceil(12 * spread + 12).cast("long")
    mode = F.least(high, F.greatest(low, F.floor((d + 1) * (g + 1) / (t + 2)).cast("long")))
    values = F.sequence(F.greatest(low, mode - reach), F.least(high, mode + reach))
    zero, log0 = F.lit(0.0), F.lit(0.0)

    def weigh(a: Column, k: Column) -> Column:
        """Running sum of weights relative to the largest log weight so far."""
        return let(
            F.greatest(a["peak"], a["log"]),
            lambda top: F.struct(
                (a["log"] + _log_weight(k, total, good, drawn)).alias("log"),
                top.alias("peak"),
                (a["sum"] * F.exp(a["peak"] - top) + F.exp(a["log"] - top)).alias("sum"),
            ),
        )

    def search(mass: Column) -> Column:
        wanted = uniform * mass["sum"]
        steps = F.aggregate(
            values,
            F.struct(log0.alias("log"), zero.alias("sum"), F.lit(0).cast("long").alias("below")),
            lambda a, k: let(
                a["sum"] + F.exp(a["log"] - mass["peak"]),
                lambda upto: F.struct(
                    (a["log"] + _log_weight(k, total, good, drawn)).alias("log"),
                    upto.alias("sum"),
                    (a["below"] + F.when(upto <= wanted, 1).otherwise(0)).alias("below"),
                ),
            ),
        )
        return F.least(F.element_at(values, -1), F.element_at(values, 1) + steps["below"])

    mass = F.aggregate(values, F.struct(log0.alias("log"), log0.alias("peak"), zero.alias("sum")), weigh)
    return F.when(high <= low, low).otherwise(let(mass, search))


def _draw(seed: Column) -> Callable[[Column, Column], Column]:
    """One source's draw for the left half, given what earlier sources left."""

    def draw(a: Column, c: Column) -> Column:
        u = F.pmod(F.xxhash64(seed, F.col("lo"), c["source"], c["z"]), F.lit(1 << 53)).cast("double") / float(1 << 53)
        return let(
            hypergeometric(a["rest"], c["n"], a["room"], u),
            lambda x: F.struct(
                (a["rest"] - c["n"]).alias("rest"), (a["room"] - x).alias("room"), F.concat(a["taken"], F.array(x)).alias("taken")
            ),
        )

    return draw


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(shard, source, blocks): the exact quotas (source, blocks) dealt over the shards.

    A node holds its shards and one count per source. The left half draws its share
    of all blocks; the draws are done source by source, each conditional on the rest.
    """
    cells = F.sort_array(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("k"), F.col("source").isNull().alias("z"), F.col("source").alias("source"), F.col("blocks").alias("n"))))
    nodes = quotas.where("blocks > 0").agg(cells.alias("cells")).select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("width"), "cells")
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        total = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["n"])
        half = F.floor(F.col("width") / 2).cast("long")
        begun = nodes.withColumn("_total", total).withColumn("_left", F.floor(F.col("_total") * half / F.col("width")).cast("long"))
        start = F.struct(F.col("_total").alias("rest"), F.col("_left").alias("room"), F.array().cast("array<bigint>").alias("taken"))

        drawn = begun.withColumn("_taken", F.aggregate("cells", start, _draw(F.lit(seed + level)))["taken"])

        def side(left: bool) -> Column:
            count = lambda c, x: x if left else c["n"] - x
            return F.zip_with("cells", "_taken", lambda c, x: F.struct(c["k"].alias("k"), c["z"].alias("z"), c["source"].alias("source"), count(c, x).alias("n")))

        halves = F.array(
            F.struct(F.col("lo").alias("lo"), half.alias("width"), side(True).alias("cells")),
            F.struct((F.col("lo") + half).alias("lo"), (F.col("width") - half).alias("width"), side(False).alias("cells")),
        )
        # Cut each level: draws are computed once, and expressions do not nest level in level.
        # From 256 nodes on they are spread over tasks.
        nodes = keep(
            (drawn.repartition("lo") if level >= 8 else drawn).select(F.when(F.col("width") > 1, halves).otherwise(F.array(F.struct("lo", "width", "cells"))).alias("h"))
            .select(F.inline("h"))
        )
    return nodes.select(F.col("lo").alias("shard"), F.explode("cells").alias("c")).select("shard", "c.source", F.col("c.n").alias("blocks"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    ceiling: float = CEILING,
    block_words: int = BLOCK_WORDS,
    shards: int | None = None,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(draws, documents).

    draws: (shard, place, doc_id, source, text_hash, size, pass, words), one row per
    document and pass that the mix reads; `words` of its first words are taken and
    `place` orders the shard. Without `shards` their number is the power of two that
    gives a shard at most SHARD_WORDS words. documents: (doc_id, size, source_size, target, taken),
    one row per input row.

    Null texts have size 0 and are never drawn; a null source is a source of its own;
    repeated rows are drawn each for itself, in an order fixed by id and size, so that
    reruns agree. Extra columns are ignored. Empty tables give empty results.
    """
    sizes = keep(sized(docs, doc_id, source, text).withColumn("_key", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), 1)))
    targets = keep(source_targets(sizes, weights, share, ceiling))
    light = broadcast_if_light(targets, F.coalesce(F.length("source"), F.lit(0)) + 64)
    sources = light.withColumnRenamed("source", "_source")
    known = sizes.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # Words of the source before and up to this document, in the source's random order.
    bucket = F.floor(F.col("_key") / F.lit((1 << 63) // BUCKETS)).cast("long")
    named = known.withColumn("_name", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    ends = keep(running_sum(named, ["_name"], ["_key", "doc_id", "text_hash"], bucket, F.col("size"), "_end"))
    goal = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    rest = goal - full * F.col("source_size")
    begin = F.col("_end") - F.col("size")
    partial = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - begin))
    placed = ends.withColumn("_full", full).withColumn("_part", partial)

    passes = F.filter(
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("_full")),
            lambda p: F.struct(p.alias("pass"), F.when(p < F.col("_full"), F.col("size")).otherwise(F.col("_part")).alias("words")),
        ),
        lambda d: d["words"] > 0,
    )
    reads = placed.withColumn("_begin", begin).withColumn("_d", F.explode(passes)).select("*", "_d.pass", "_d.words")
    # Blocks of one source, numbered over its passes.
    per_pass = F.ceil(F.col("source_size") / block_words).cast("long")
    in_blocks = reads.withColumn("_block", F.col("pass") * per_pass + F.floor(F.col("_begin") / block_words).cast("long"))
    blocks = keep(in_blocks.groupBy("_name", "source", "_block").agg(F.sum("words").alias("_words")))
    if shards is None:
        words = targets.agg(F.sum("target")).first()[0] or 0
        shards = max(LEAST_SHARDS, 1 << max(0, math.ceil(math.log2(max(1, words / SHARD_WORDS)))))
    keyed = blocks.withColumn("_at", F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "_name", "_block"), 1))
    numbered = number_rows(keyed, ["_name"], ["_at", "_block"], F.floor(F.col("_at") / F.lit((1 << 63) // BUCKETS)).cast("long"), "_turn")
    dealt = split_quotas(blocks.groupBy("_name", "source").agg(F.count(F.lit(1)).alias("blocks")).select("source", "blocks"), shards, seed)
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    upto = Window.partitionBy("_name").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = dealt.where("blocks > 0").withColumn("_name", name).withColumn("_to", F.sum("blocks").over(upto))
    turns = ranges.select("_name", "shard", F.explode(F.sequence(F.col("_to") - F.col("blocks") + 1, F.col("_to"))).alias("_turn"))
    homes = numbered.join(turns, ["_name", "_turn"]).select("_name", "_block", "shard")
    draws = in_blocks.join(homes, ["_name", "_block"]).select(
        "shard", F.xxhash64(F.lit(seed + 2), "doc_id", "pass", "_begin").alias("place"), "doc_id", "source", "text_hash", "size", "pass", "words",
        "_name", "_end",
    )
    # A row with words is known by its source and where it ends there.
    taken = draws.groupBy("_name", "_end").agg(F.sum("words").alias("taken")).withColumn("_some", F.lit(True))
    documents = placed.withColumn("_some", F.col("size") > 0).join(taken, ["_name", "_end", "_some"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
    return draws.drop("_name", "_end"), documents


def drawn_texts(
    docs: DataFrame, draws: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", carry: tuple[str, ...] = ("lang",)
) -> DataFrame:
    """(doc_id, text, source, carry..., n_chars, shard, place): one row per draw.

    A draw of a whole document has its text as it is; a trimmed one has its first
    words, joined by blanks. Rows with equal id, source and text are interchangeable;
    of their carried columns the smallest stay.
    """
    key = [F.col(doc_id).alias("_id"), F.col(source).cast("string").alias("_source"), F.xxhash64(F.col(text).cast("string")).alias("_hash")]
    texts = docs.select(*key, F.col(text).cast("string").alias("_text"), F.struct(*carry).alias("_carry")).groupBy("_id", "_source", "_hash")
    texts = texts.agg(F.min("_text").alias("_text"), F.min("_carry").alias("_carry"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("text_hash") == F.col("_hash"))
    words = F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    part = F.when(F.col("words") == F.col("size"), F.col("_text")).otherwise(F.array_join(F.slice(words, 1, F.col("words").cast("int")), " "))
    joined = draws.join(texts, same).select("doc_id", part.alias("text"), "source", "_carry.*", "shard", "place")
    return joined.withColumn("n_chars", F.length("text").cast("long"))
