"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

A source's weight is an integer p out of the sum P of all weights. Its block k is released at slot
floor(k P / p) and due by slot ceil((k + 1) P / p); every slot goes to the released block that is
due first. One processor that is exactly full meets all deadlines, so in every prefix of slots each
source is less than one block from its weight.

Sources of equal weight make a class, which is scheduled like one source and dealt to them in turn;
that keeps the bound. What EDF does from a slot on depends on the blocks that are then pending, and
once the latest deadline among those has passed, no longer on which of them they were. So the
slots are cut into chunks, and each chunk is scheduled by itself after a run-up of that length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The unit of weights: target weights are read to so many parts, and powers of row counts to thousandths.
PARTS, FRACTION = 10**9, 1000
#: Different weights there may be, and slots folded together before their picks are appended.
KINDS, _STEP = 1 << 20, 512


def source_weights(docs: DataFrame, weights: dict | None = None, temperature: float = 0.5) -> DataFrame:
    """source, n_docs, weight: an integer for every source that occurs, null included.

    With weights, a source's weight is its part of the weights' sum in units of 1 / PARTS (at least
    one; sources without one get one); without, its row count to the power temperature, in
    thousandths. These integers are the target; nothing is rounded after them.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        w = F.pow(F.col("n_docs").cast("double"), F.lit(float(temperature))) * FRACTION
    elif weights:
        total = float(sum(weights.values()))
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v) / total * PARTS)])
        w = F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0))
    else:
        w = F.lit(0.0)
    return counts.select("source", "n_docs", F.greatest(F.lit(1).cast("long"), F.round(w).cast("long")).alias("weight"))


def weight_classes(weighed: DataFrame, name: Column) -> DataFrame:
    """_name, weight, members, member, total: each source's place among those of its weight, and the sum of all weights."""
    same = Window.partitionBy("weight").orderBy("_name")
    whole = weighed.agg(F.sum("weight").alias("total"))  # one row
    sizes = weighed.groupBy("weight").agg(F.count(F.lit(1)).alias("members"))
    placed = weighed.select(name.alias("_name"), "weight", "n_docs").withColumn("member", F.row_number().over(same) - 1)
    return placed.join(sizes, "weight").crossJoin(F.broadcast(whole))


def pfair_slots(classes: DataFrame, chunk_slots: int = 2048, block_rows: int = 32) -> DataFrame:
    """weight, turn, slot: the slot of each turn (0, 1, ...) of each weight's class, up to the last block of any source.

    classes is weight_classes' table. A chunk has chunk_slots slots, or as many as the lightest
    class needs to run up; its state is one number for each different weight, and its work grows
    with slots times different weights.
    """
    kinds = classes.groupBy("weight", "members", "total").agg(F.max(F.ceil(F.col("n_docs") / block_rows)).alias("blocks"))
    # the last slot any source can need: the deadline of its last block
    one = kinds.agg(
        F.sort_array(F.collect_list(F.struct(F.col("weight"), (F.col("weight") * F.col("members")).alias("p")))).alias("c"),
        F.max("total").alias("total"),
        F.max(F.expr("(blocks * total + weight - 1) div weight")).alias("slots"),
        F.max(F.expr("(total + weight * members - 1) div (weight * members)")).alias("reach"),
    ).filter("total is not null")  # one row; an entry for each different weight
    one = one.withColumn("chunk", F.greatest(F.lit(chunk_slots).cast("long"), F.col("reach") + 1))
    chunks = one.select("c", "total", "chunk", "reach", "slots", F.explode(F.expr("sequence(0L, (slots - 1) div chunk)")).alias("number"))
    chunks = chunks.repartition("number").withColumn("begin", F.col("number") * F.col("chunk")).withColumn("end", F.least(F.col("begin") + F.col("chunk"), F.col("slots")))
    chunks = chunks.withColumn("from", F.greatest(F.lit(0).cast("long"), F.col("begin") - F.col("reach") - 1))
    # at its first slot a chunk takes any state: whole turns by weight, and one more for those that are due first
    floor = "transform(c, x -> (from * x.p) div total)"
    due = "transform(c, (x, i) -> struct(((from * x.p) div total + 1) * total * 1.0D / x.p as due, i as i, (from * x.p) % total > 0 as open))"
    early = f"transform(slice(array_sort(filter({due}, y -> y.open)), 1, cast(from - aggregate({floor}, 0L, (a, x) -> a + x) as int)), y -> y.i)"
    chunks = chunks.withColumn("early", F.expr(early)).withColumn("done", F.expr(f"transform({floor}, (d, i) -> d + if(array_contains(early, i), 1L, 0L))"))
    key = lambda turn, p, i: f"(({turn} + 1) * total + {p} - 1) div {p} * {KINDS}L + {i}"
    state = f"named_struct('d', done, 'k', transform(done, (d, i) -> {key('d', 'p[i]', 'i')}), 'got', cast(array() as array<bigint>))"
    # of the released turns the one due first: turn d is released at or before slot t if d * total < (t + 1) * p
    pick = "array_min(transform(b.k, (k, i) -> if(b.d[i] * total < (t + 1) * p[i], k, null)))"
    taken = f"""named_struct(
        'd', transform(z.d, (d, i) -> if(i = y % {KINDS}, d + 1, d)),
        'k', transform(z.k, (k, i) -> if(i = y % {KINDS}, {key('(z.d[i] + 1)', 'p[i]', 'i')}, k)),
        'got', z.got || array(z.d[cast(y % {KINDS} as int)] * {KINDS}L + y % {KINDS}))"""
    step = f"aggregate(sequence(w.lo, w.hi - 1), named_struct('d', w.s.d, 'k', w.s.k, 'got', cast(array() as array<bigint>)), (b, t) -> aggregate(array({pick}), b, (z, y) -> {taken}))"
    parts = f"transform(sequence(from, end - 1, {_STEP}L), lo -> struct(lo, least(lo + {_STEP}L, end) as hi))"
    fold = f"""aggregate({parts}, {state}, (s, q) -> aggregate(array(named_struct('s', s, 'lo', q.lo, 'hi', q.hi)), s, (x, w) ->
        aggregate(array({step}), x, (v, r) -> named_struct('d', r.d, 'k', r.k, 'got', v.got || r.got)))).got"""
    chunks = chunks.withColumn("p", F.expr("transform(c, x -> x.p)"))
    seats = chunks.withColumn("got", F.expr(fold)).select("c", "from", "begin", F.posexplode("got").alias("at", "g"))
    return seats.select(
        F.expr(f"c[cast(g % {KINDS} as int)].weight").alias("weight"), F.expr(f"g div {KINDS}").alias("turn"), (F.col("from") + F.col("at")).alias("slot"), "begin"
    ).filter("slot >= begin").drop("begin")


def mix(docs: DataFrame, weights: dict | None = None, block_rows: int = 32, temperature: float = 0.5, buckets: int = 1024, carry: list[str] | None = None, chunk_slots: int = 2048) -> DataFrame:
    """Each row's place in the mixture: doc_id, source, the columns in carry, block, release, due, slot, position.

    Within a source, rows are ordered by the md5 of doc_id (then doc_id; equal ids in any order) and
    cut into blocks of block_rows. position = slot * block_rows + place in the block is the order of
    the mixture. While every source lasts, each prefix of slots holds each source's weight to less
    than one block; when a source ends, its later slots stay empty and the others keep their rates.
    Every row gets a position; null ids come last in a source, and null is a source of its own. An
    empty table gives no row. Columns not in carry are ignored.

    Ranks in a source are made of ranks in (source, first md5 digits) and sums of the counts before,
    so a source with most of the rows is spread over all tasks. Blocks and slots join by weight and
    turn, of which there is one each for a block.
    """
    carry = [c for c in carry or [] if c not in ("doc_id", "source")]
    width = len(f"{buckets - 1:x}")
    md5 = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("g"))  # after every hex digit
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # null as a key that joins
    keyed = lambda rows: rows.select(name.alias("_name"), F.substring(md5, 1, width).alias("_part"), md5.alias("_md5"), "doc_id", "source", *carry)
    inside = Window.partitionBy("_name", "_part").orderBy("_md5", F.col("doc_id").asc_nulls_last())
    before = Window.partitionBy("_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed(docs).groupBy("_name", "_part").agg(F.count(F.lit(1)).alias("n"))
    classes = weight_classes(source_weights(docs, weights, temperature), name)
    places = sizes.select("_name", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")).join(
        classes.select("_name", F.col("weight").alias("_weight"), F.col("members").alias("_members"), F.col("member").alias("_member"), F.col("total").alias("_total")), "_name"
    )
    ranked = keyed(docs).withColumn("_rank", F.row_number().over(inside) - 1).join(places, ["_name", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_start"))
    ranked = ranked.withColumn("block", F.expr(f"_rank div {block_rows}")).withColumn("_turn", F.expr("block * _members + _member"))
    slots = pfair_slots(classes, chunk_slots, block_rows).select(F.col("weight").alias("_weight"), F.col("turn").alias("_turn"), F.col("slot").alias("slot"))
    kept = [*(f"`{c}`" for c in ["doc_id", "source", *carry]), "block"]
    return ranked.join(slots, ["_weight", "_turn"]).selectExpr(
        *kept, "(block * _total) div _weight as release", "((block + 1) * _total + _weight - 1) div _weight as due", "slot", f"slot * {block_rows} + _rank % {block_rows} as position"
    )


def mixed(docs: DataFrame, **plan) -> DataFrame:
    """docs, all rows and columns (whatever their values), in the order of the mixture; see mix for nulls, ties and empty tables."""
    whole = docs.select("doc_id", "source", F.struct(*docs.columns).alias("_row"))  # whatever the other columns are called
    placed = mix(whole, carry=["_row"], **plan)
    return placed.repartitionByRange("position").sortWithinPartitions("position").select("_row.*")
