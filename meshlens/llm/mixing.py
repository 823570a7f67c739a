"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

A source's words are laid end to end, shard by shard (a shard is a hash class of doc_ids, in seeded order), and cut into
blocks of 16 words, equal within a shard to one word. Targets become whole blocks: the source with the highest quotient
``weight / (2 * seats + 1)`` gets the next block until all are given; the same rule splits a source's blocks among its
shards by their sizes. A shard takes ``quota div n`` times each of its n blocks and once more those that a seeded affine
permutation of block numbers puts first, so which blocks are taken is a function of the block number and needs no shuffle.

Defined cases: a null text has no words; a source without words has target 0; repeated rows are rows of their own; an
empty table gives an empty mix; null is a source of its own, last in order. No document is taken more than ``cap`` times.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshlens.llm.shared import WORD, staged, word_count

WEIGHTS, SHARE, CAP, BLOCK, SEED = (5, 2, 1), 1.5, 2, 16, 42
#: Words of a shard at least, and shards of a source at most: beyond that, shards grow.
SHARD_WORDS, MOST_SHARDS = 1 << 16, 1 << 16


def _primes(n: int, above: int) -> list[int]:
    """Primes above every block number of a shard: each is prime to the number of blocks."""
    out, x = [], above | 1
    while len(out) < n:
        if all(x % d for d in range(3, int(x**0.5) + 1, 2)):
            out.append(x)
        x += 2
    return out


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sources(source, source_size) with sid, its place in order, and target: shares by weight, none above cap times its size.

    Taken in order of size over weight, the capped ones come first; the level of the rest is what is left over their weights.
    The table has one row a source; its windows run over that.
    """
    ranked = sources.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).cast("long") - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(cap))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "sid")
    all_ = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(all_) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(all_) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    found = ranked.withColumn("_level", level).withColumn("_capped", F.col("_cap") / F.col("_w") <= F.col("_level"))
    rest = F.max(F.when(~F.col("_capped"), F.col("_level"))).over(all_)
    return found.withColumn("target", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * rest))).drop("_w", "_cap", "_level", "_capped")


def apportion(groups: DataFrame) -> DataFrame:
    """groups(seats, ps: array of structs with weight, most and ord) with quota in each struct: the seats by highest quotients, at most ``most`` each.

    The quotient at which the seats run out is bracketed by halving; only quotients inside the bracket are ranked (ties by
    ord), so no seat takes a row. A group's parties are sources or the shards of one source, of bounded number.
    """
    least = lambda per, p: F.least(F.floor(p["weight"] * per + 0.5), p["most"])
    given = lambda per: F.aggregate("ps", F.lit(0).cast("long"), lambda a, p: a + least(per, p))
    smallest = F.array_min(F.filter(F.transform("ps", lambda p: p["weight"]), lambda w: w > 0))
    # seats for each unit of weight: none at 0; all that can be had at the upper end
    top = F.coalesce(F.lit(4.0) * (F.col("seats") + F.size("ps")) / F.greatest(F.lit(1e-9), smallest), F.lit(0.0))

    def halve(at: Column, _: Column) -> Column:
        mid = (at["lo"] + at["hi"]) / 2
        return F.when(given(mid) <= F.col("seats"), F.struct(mid.alias("lo"), at["hi"].alias("hi"))).otherwise(F.struct(at["lo"].alias("lo"), mid.alias("hi")))

    # written between the steps: else Spark puts a step's expression into the next one's lambdas and works it out for every element
    found = staged(groups.withColumn("_b", F.aggregate(F.sequence(F.lit(1), F.lit(96)), F.struct(F.lit(0.0).alias("lo"), top.alias("hi")), halve)), "mix-bracket")
    steps = lambda p: F.when(least(F.col("_b.hi"), p) > least(F.col("_b.lo"), p), F.sequence(least(F.col("_b.lo"), p), least(F.col("_b.hi"), p) - 1)).otherwise(F.array().cast("array<bigint>"))
    open_ = F.array_sort(F.flatten(F.transform("ps", lambda p: F.transform(steps(p), lambda k: F.struct((-p["weight"] / (2 * k + 1)).alias("q"), p["ord"].alias("ord"))))))
    found = found.withColumn("_open", open_).withColumn("_left", F.greatest(F.lit(0), F.col("seats") - given(F.col("_b.lo"))).cast("int"))
    found = staged(found.withColumn("_more", F.slice("_open", F.lit(1), F.col("_left"))).drop("_open", "_left"), "mix-more")
    quota = lambda p: least(F.col("_b.lo"), p) + F.size(F.filter("_more", lambda m: m["ord"] == p["ord"]))
    return found.withColumn("ps", F.transform("ps", lambda p: p.withField("quota", quota(p).cast("long")))).drop("_b", "_more")


def _shard(shards: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), F.col("_id")), F.col(shards))


def plan(docs: DataFrame, id_col: str = "doc_id", **options: object) -> tuple[DataFrame, DataFrame]:
    """(sources, shards): targets, and blocks and quotas of each shard. The texts are read once; what is kept of them is one number a row."""
    sized = staged(docs.select(F.col(id_col).alias("_id"), F.col("source"), word_count(F.col("text")).alias("_size")), "mix-sizes")
    # one row a source from here on to the targets: in one task, without a shuffle
    sources = targets(sized.groupBy("source").agg(F.sum("_size").alias("source_size")).coalesce(1), **options)
    count = F.least(F.lit(MOST_SHARDS).cast("long"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / SHARD_WORDS)))
    sources = staged(sources.withColumn("n_shards", count), "mix-sources")
    placed = sized.join(sources.select("source", "sid", "n_shards").withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    shards = placed.groupBy("sid", _shard("n_shards").alias("ord")).agg(F.sum("_size").alias("words"))
    shards = shards.withColumn("blocks", F.when(F.col("words") > 0, F.greatest(F.lit(1).cast("long"), F.round(F.col("words") / BLOCK).cast("long"))).otherwise(F.lit(0).cast("long")))
    party = F.struct("ord", "words", "blocks", F.col("words").cast("double").alias("weight"), (F.col("blocks") * CAP).alias("most"))
    of_source = staged(shards.groupBy("sid").agg(F.collect_list(party).alias("ps"), F.sum("blocks").alias("blocks")).coalesce(8), "mix-shards")
    # a source's claim in blocks of its own mean length
    claims = of_source.select("sid", "blocks").coalesce(1).join(sources, "sid").select(F.col("sid").alias("ord"), (F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1))).alias("weight"), (F.col("blocks") * CAP).alias("most"))
    whole = claims.groupBy().agg(F.collect_list(F.struct("ord", "weight", "most")).alias("ps"), F.least(F.round(F.sum("weight")).cast("long"), F.sum("most")).alias("seats")).withColumn("seats", F.coalesce("seats", F.lit(0)))
    seats = apportion(whole).select(F.inline("ps")).select(F.col("ord").alias("sid"), F.col("quota").alias("seats"))
    shards = apportion(of_source.join(seats, "sid")).select("sid", F.inline("ps"))
    shards = staged(shards.select("sid", F.col("ord").alias("shard"), "words", "blocks", "quota"), "mix-blocks")
    return sources, shards


def _located(docs: DataFrame, id_col: str, keep: list[str], **options: object) -> DataFrame:
    """Every row with _size, the words before it in its shard (_at), and its shard's blocks, quota and permutation."""
    sources, shards = plan(docs, id_col, **options)
    rows = docs.select(F.col(id_col).alias("_id"), F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"), F.xxhash64("text").alias("_tie"), F.struct(*keep).alias("_row"))
    src = sources.select(F.col("source").alias("_name"), "sid", "source_size", "target", "n_shards")
    rows = rows.join(src, F.col("_source").eqNullSafe(F.col("_name"))).withColumn("shard", _shard("n_shards"))
    order = Window.partitionBy("sid", "shard").orderBy(F.xxhash64(F.lit(SEED + 1), "_id"), "_id", "_size", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_at", F.sum("_size").over(order) - F.col("_size")).join(shards, ["sid", "shard"])
    primes = F.array(*[F.lit(p) for p in _primes(8, 1 << 31)])
    seed = lambda k: F.xxhash64(F.lit(SEED + k), "sid", "shard")
    return rows.withColumn("_step", F.element_at(primes, (F.pmod(seed(2), F.lit(8)) + 1).cast("int")) % F.greatest("blocks", F.lit(1))).withColumn("_turn", F.pmod(seed(3), F.greatest("blocks", F.lit(1))))


def _times(block: Column) -> Column:
    """How often a block is taken."""
    extra = F.pmod(block * F.col("_step") + F.col("_turn"), F.col("blocks")) < F.expr("quota % greatest(blocks, 1)")
    return F.expr("quota div greatest(blocks, 1)") + extra.cast("long")


def _block_of(place: Column) -> Column:
    """The block that holds a word of the shard: block k begins at floor(k * words / blocks)."""
    return _div((place + 1) * F.col("blocks") - 1, F.col("words"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def taken(docs: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    rows = _blocked(_located(docs, id_col, [id_col], **options))
    count = F.aggregate("_blocks", F.lit(0).cast("long"), lambda a, b: a + b["n"] * b["times"])
    return rows.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", F.when(F.col("_size") > 0, count).otherwise(F.lit(0).cast("long")).alias("taken"))


def _blocked(rows: DataFrame) -> DataFrame:
    """rows with _blocks: for each block that a document meets, how many of its words come before, how many are inside, and how often it is taken."""
    first, last = _block_of(F.col("_at")), _block_of(F.col("_at") + F.col("_size") - 1)
    begin = lambda k: F.greatest(F.col("_at"), _div(k * F.col("words"), F.col("blocks"))) - F.col("_at")
    end = lambda k: F.least(F.col("_at") + F.col("_size"), _div((k + 1) * F.col("words"), F.col("blocks"))) - F.col("_at")
    part = lambda k: F.struct(begin(k).alias("before"), (end(k) - begin(k)).alias("n"), _times(k).alias("times"))
    return rows.withColumn("_blocks", F.when(F.col("_size") > 0, F.transform(F.sequence(first, last), part)))


#: Where a row of a file stands.
_PLACE = {"file_path": "_file", "row_index": "_line"}


def _places(docs: DataFrame) -> list[Column]:
    return [docs.metadataColumn("_metadata")[c].alias(a) for c, a in _PLACE.items()]


def _in_files(docs: DataFrame) -> DataFrame:
    """docs if it is read from files, whose rows have places, else written to the shared folder."""
    try:
        docs.select(_places(docs)[-1]).schema  # noqa: B018
    except AnalysisException:
        return staged(docs, "mix-texts")
    return docs


def mixed(docs: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """The mix itself, with the columns of docs: a row holds the words of the blocks taken at least once, a second one those taken twice.

    A document all of whose words are taken keeps its text as it is, uncut; others have their words joined by one space.
    """
    docs = _in_files(docs)
    named = docs.select(F.col(id_col), "source", "text", *_places(docs))
    rows = _blocked(_located(named, id_col, list(_PLACE.values()), **options).filter("_size > 0"))
    times = F.transform("_blocks", lambda b: b["times"])
    rows = rows.withColumn("_least", F.array_min(times)).withColumn("_most", F.array_max(times)).filter("_most > 0")
    wanted = rows.select("_row.*", "_least", "_most", F.when(F.col("_least") < F.col("_most"), F.col("_blocks")).alias("_blocks"))
    # the texts move once, beside what is wanted of them, and aren't sorted
    whole = docs.select(*_places(docs), F.struct(*docs.columns).alias("_row"))
    rows = whole.join(wanted.hint("shuffle_hash"), list(_PLACE.values()))
    rows = rows.withColumn("_pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_most"))))
    kept = lambda words: F.transform(F.filter("_blocks", lambda b: b["times"] >= F.col("_pass")), lambda b: F.slice(words, (b["before"] + 1).cast("int"), b["n"].cast("int")))
    # a text's words are bound once, as the one element of an array
    cut = F.transform(F.array(F.regexp_extract_all(F.col("_row.text"), F.lit(WORD), F.lit(0))), lambda words: F.array_join(F.flatten(kept(words)), " "))
    rows = rows.withColumn("_text", F.when(F.col("_least") >= F.col("_pass"), F.col("_row.text")).otherwise(cut[0]))
    made = {"text": F.col("_text"), "n_chars": F.char_length("_text")}
    kinds = dict(docs.dtypes)
    return rows.select(*[made[c].cast(kinds[c]).alias(c) if c in made else F.col("_row").getField(c).alias(c) for c in docs.columns])
