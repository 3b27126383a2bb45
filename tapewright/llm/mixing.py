"""Mixing sources to target weights (DataFrame functions only).

1. Targets: sources share all words by weight; a target stops at ``cap`` times
   its source's size and the excess is reshared (the water level is found with
   window sums over the sources, in closed form).
2. Blocks: a hash deals every source's documents over blocks of about
   ``block_words`` words.  A source gives its blocks once per whole epoch and,
   for the rest of its target, a permuted prefix of them; the one block on the
   edge is filled by a greedy choice of its documents.
3. Splitting tree: the units (source, epoch, block) are dealt over the output
   shards by halving the range of shards again and again.  At each node the left
   half's share of every source's quota is a multivariate-hypergeometric draw, exact
   at every size, so shards hold exact numbers of units and no unit is drawn twice.
4. A shard's units are disjoint slices of each source's permuted unit list; the
   local shuffle is the order of a hash within the shard.

All randomness is a hash of ``seed`` and of the rows: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import fresh, word_count, written

#: A running sum within a source goes by buckets of about so many rows.
BUCKET_ROWS = 65_536
#: The table of sources is broadcast up to so many sources, else joined by shuffle.
BROADCAST_SOURCES = 50_000

#: Widths of the tree at which its nodes are dealt over tasks again, as a written table: no plan has more than five levels.
SPREAD_AT = tuple(2**i for i in range(4, 40, 5))

_TWO63 = float(2**63)


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Per source: ``source, no, source_size, target``.

    Sources rank by code point with null last and take ``weights`` in turn.  The
    windows here run over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("no", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))))
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.col("no") - 1) % len(weights) + 1).cast("int")).cast("long")
    x = ranked.withColumn("w", w).withColumn("most", F.col("source_size") * cap).withColumn("full_at", F.col("most").cast("double") / F.col("w"))
    everything = W.partitionBy()
    before = W.orderBy("full_at", "no").rowsBetween(W.unboundedPreceding, -1)
    # with the sources before it full, what is left for one unit of weight
    x = x.withColumns({
        "left_words": F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)),
        "left_weight": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    open_ = F.when(F.col("most") * F.col("left_weight") > F.col("w") * F.col("left_words"), F.struct("full_at", "no", "left_words", "left_weight"))
    x = x.withColumn("edge", F.min(open_).over(everything))
    share = (F.col("w") * F.col("edge.left_words")).cast("double") / F.col("edge.left_weight")
    full = F.col("edge").isNull() | (F.struct("full_at", "no") < F.struct("edge.full_at", "edge.no"))
    return x.select("source", "no", "source_size", F.when(full, F.col("most").cast("double")).otherwise(share).alias("target"))


def _before(df: DataFrame, bucket: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before, within ``no``, in the order of bucket and ``order``.

    Buckets are summed first, so that no task sorts a whole source.
    """
    x = df.withColumn("bucket", bucket)
    per = x.groupBy("no", "bucket").agg(F.sum(value).alias("of_bucket"))
    earlier = F.coalesce(F.sum("of_bucket").over(W.partitionBy("no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = per.select("no", "bucket", earlier.alias("of_earlier"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy("no", "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn(out, inside).join(firsts, ["no", "bucket"]).withColumn(out, (F.col(out) + F.col("of_earlier")).cast("long")).drop("bucket", "of_earlier")


def _by_hash(h: Column, rows: int) -> Column:
    """A bucket of about ``BUCKET_ROWS`` of ``rows`` rows, from a hash."""
    return F.pmod(F.shiftrightunsigned(h, 16), F.lit(max(1, -(-rows // BUCKET_ROWS))).cast("long"))


def _blocks(docs: DataFrame, sources: DataFrame, bounded: bool, seed: int) -> DataFrame:
    """Per block: ``no, block, words, epochs, gap``; gap: words that the edge block still gives."""
    per = written(docs.where(F.col("size") > 0).groupBy("no", "block").agg(F.sum("size").alias("words")))
    h = F.xxhash64(F.lit(seed), "no", "block")
    x = _before(per, _by_hash(h, per.count()), [h, F.col("block")], F.col("words"), "before")
    x = x.join(_small(sources.select("no", "source_size", "target"), bounded), "no")
    x = x.withColumn("whole", F.floor(F.col("target") / F.col("source_size")).cast("int")).withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    inside = F.col("before") + F.col("words") <= F.col("rest")
    gap = F.when(~inside & (F.col("before") < F.col("rest")), F.col("rest") - F.col("before")).otherwise(0)
    return x.select("no", "block", "words", (F.col("whole") + inside.cast("int")).alias("epochs"), gap.alias("gap"))


def _small(df: DataFrame, bounded: bool) -> DataFrame:
    return F.broadcast(df) if bounded else df


def _edge_picks(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per edge block: ``no, block, picks``, the keys of the documents that fill its gap.

    Greedy from the largest document that fits down; then one more document if
    that ends nearer to the gap.  An edge block is about ``block_words`` words, whatever its source's size.
    """
    edge = blocks.where(F.col("gap") > 0).select("no", "block", "gap")
    per = docs.where(F.col("size") > 0).join(edge, ["no", "block"]).groupBy("no", "block", "gap", "key").agg(F.sum("size").alias("size"))
    listed = per.groupBy("no", "block", "gap").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("down"), "key", "size"))).alias("all"))
    start = F.struct(F.col("gap").alias("left"), F.array().cast("array<bigint>").alias("picks"), F.lit(None).cast("struct<size:bigint,key:bigint>").alias("least"))

    def step(acc, d):
        fits = d["size"] <= acc["left"]
        other = F.struct(d["size"].alias("size"), d["key"].alias("key"))
        return F.struct(
            F.when(fits, acc["left"] - d["size"]).otherwise(acc["left"]).alias("left"),
            F.when(fits, F.concat(acc["picks"], F.array(d["key"]))).otherwise(acc["picks"]).alias("picks"),
            F.when(fits | (acc["least"] <= other), acc["least"]).otherwise(other).alias("least"),
        )

    def finish(acc):
        nearer = acc["least"].isNotNull() & (acc["least"]["size"] < 2 * acc["left"])
        return F.when(nearer, F.concat(acc["picks"], F.array(acc["least"]["key"]))).otherwise(acc["picks"])

    return listed.select("no", "block", F.aggregate("all", start, step, finish).alias("picks"))


def _hypergeometric(all_: str, own: str, drawn: str, u: str) -> str:
    """SQL: how many of ``drawn`` units, out of ``all_``, are among the ``own`` ones; ``u`` is uniform in (0, 1).

    The distribution's inverse, walked from its mode to both sides by the ratio of
    neighbouring terms.  The walk is as long as the range, or 40 and 12 standard
    deviations: what lies beyond is below the rounding of the sum.
    """
    up = "a.up * (h.own - h.mode - j + 1) * (h.drawn - h.mode - j + 1) / (1d * (h.mode + j) * (h.others - h.drawn + h.mode + j))"
    down = "a.down * (h.mode - j + 1) * (h.others - h.drawn + h.mode - j + 1) / (1d * (h.own - h.mode + j) * (h.drawn - h.mode + j))"
    step = f"transform(array(named_struct('up', {up}, 'down', {down})), t -> named_struct('up', t.up, 'down', t.down, 'sum', a.sum + t.up + t.down{{}}))[0]"
    add = step.format("")
    find = step.format(", 'x', CASE WHEN a.x IS NOT NULL THEN a.x WHEN h.goal < a.sum + t.up THEN h.mode + j WHEN h.goal < a.sum + t.up + t.down THEN h.mode - j END")
    sum_ = f"CASE WHEN h.steps < 1 THEN 1d ELSE aggregate(sequence(1L, greatest(1L, h.steps)), named_struct('up', 1d, 'down', 1d, 'sum', 1d), (a, j) -> {add}, a -> a.sum) END"
    walk = f"CASE WHEN h.steps < 1 OR h.goal < 1d THEN h.mode ELSE coalesce(aggregate(sequence(1L, greatest(1L, h.steps)), named_struct('up', 1d, 'down', 1d, 'sum', 1d, 'x', cast(NULL AS bigint)), (a, j) -> {find}, a -> a.x), h.mode) END"
    fields = "'own', h.own, 'others', h.others, 'drawn', h.drawn"
    given = f"named_struct('own', {own}, 'others', {all_} - {own}, 'drawn', {drawn})"
    ranged = f"named_struct({fields}, 'low', greatest(0L, h.drawn - h.others), 'high', least(h.drawn, h.own), 'mode', cast(floor((h.drawn + 1d) * (h.own + 1d) / (h.own + h.others + 2d)) AS bigint), 'spread', sqrt(1d * h.drawn * h.own * h.others * greatest(0L, h.own + h.others - h.drawn)) / ((h.own + h.others) * sqrt(greatest(1d, h.own + h.others - 1d))))"
    clipped = f"named_struct({fields}, 'mode', least(h.high, greatest(h.low, h.mode)), 'steps', least(h.high - h.low, cast(ceil(40 + 12 * h.spread) AS bigint)))"
    aimed = f"named_struct({fields}, 'mode', h.mode, 'steps', h.steps, 'goal', {u} * {sum_})"
    out = f"array({given})"
    for body in (ranged, clipped, aimed, walk):
        out = f"transform({out}, h -> {body})"
    return f"{out}[0]"


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Deal ``no, units`` over ``shards``: rows ``shard, no, units``.

    Every shard gets floor or ceiling of its even share of all units, and every
    source's units add up to its quota.  A node of the tree is a row: its range of
    shards and the quotas of the sources that have units there.  Rows spread over
    tasks as the tree widens.
    """
    root = quotas.where("units > 0").groupBy().agg(F.array_sort(F.collect_list(F.struct("no", "units"))).alias("q"), F.coalesce(F.sum("units"), F.lit(0)).alias("total"))
    nodes = root.where("total > 0").select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "q", "total")
    u = f"(shiftrightunsigned(xxhash64({int(seed)}, lo, hi, s.no), 1) + 0.5d) / {_TWO63}d"
    x = _hypergeometric("acc.n", "s.units", "acc.left", u)
    # source by source: what the left half takes of this one, out of what it still has to take
    step = f"transform(array({x}), x -> named_struct('n', acc.n - s.units, 'left', acc.left - x, 'out', concat(acc.out, array(x))))[0]"
    start = f"cast(floor(total * {{}} / {int(shards)}) AS bigint)"
    first = f"named_struct('n', {start.format('hi')} - {start.format('lo')}, 'left', {start.format('mid')} - {start.format('lo')}, 'out', cast(array() AS array<bigint>))"
    got = F.expr(f"CASE WHEN hi - lo <= 1 THEN transform(q, s -> s.units) ELSE aggregate(q, {first}, (acc, s) -> {step}, acc -> acc.out) END")
    children = F.expr("""array(named_struct('lo', lo, 'hi', mid, 'q', zip_with(q, got, (s, x) -> named_struct('no', s.no, 'units', x))),
                              named_struct('lo', mid, 'hi', hi, 'q', zip_with(q, got, (s, x) -> named_struct('no', s.no, 'units', s.units - x))))""")
    tasks = int(quotas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = 1
    while width < shards:
        nodes = nodes.withColumn("mid", F.expr("CASE WHEN hi - lo <= 1 THEN hi ELSE cast(floor((lo + hi) / 2) AS int) END")).withColumn("got", got)
        nodes = nodes.select("total", F.explode(children).alias("c")).where("c.lo < c.hi").select("c.lo", "c.hi", F.expr("filter(c.q, s -> s.units > 0)").alias("q"), "total")
        width *= 2
        if width in SPREAD_AT:
            nodes = written(nodes.repartition(min(width, tasks), "lo", "hi"))
    return nodes.select(F.col("lo").alias("shard"), F.explode("q").alias("s")).select("shard", "s.no", "s.units")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block_words: int = 16_384, shard_units: int = 64, seed: int = 20_240, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, source, size, source_size, target, key, draws``.

    ``draws`` lists (shard, order, epoch) for every time the mix takes the
    document, at most ``cap`` times; ``order`` sorts a shard's documents.  A
    document without words, a null text included, has size 0; it may be drawn with
    its block but adds no words.  A null source is a source of its own, ranked
    last.  Null or repeated ids are fine: equal rows (id, size and text) are taken
    alike.  An empty table gives an empty result; other columns are not read.

    Each source's drawn words end within about one document of its target.
    """
    text = F.col("text")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    sized = written(sized.select("doc_id", "source", word_count(text).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("key")))
    sources = written(targets(sized, weights, cap))
    bounded = sources.count() <= BROADCAST_SOURCES
    blocks_of = sources.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(block_words))).cast("long"))
    u = F.shiftrightunsigned("key", 1).cast("double") / F.lit(_TWO63)
    dealt = sized.join(_small(blocks_of, bounded), sized["source"].eqNullSafe(blocks_of["source"])).select("doc_id", sized["source"], "size", "key", "no", "source_size", "target", F.least(F.floor(u * F.col("n")), F.col("n") - 1).alias("block"))
    blocks = written(_blocks(dealt, sources, bounded, seed))
    units = blocks.select("no", "block", F.col("gap") > 0, "epochs").toDF("no", "block", "edge", "epochs")
    units = units.withColumn("n", F.col("epochs") + F.col("edge").cast("int")).where("n > 0")
    quotas = written(units.groupBy("no").agg(F.sum("n").alias("units")))
    total = quotas.agg(F.sum("units")).first()[0] or 0
    shards = max(1, -(-total // shard_units))
    epoch = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    units = units.select("no", "block", "edge", "epochs", epoch.alias("epoch")).withColumn("partial", F.col("edge") & (F.col("epoch") == F.col("epochs")))
    h = F.xxhash64(F.lit(seed + 1), "no", "epoch", "block")
    units = _before(units, _by_hash(h, total), [h, F.col("epoch"), F.col("block")], F.lit(1), "rank")
    split = written(split_quotas(quotas, shards, seed))
    first = _before(split, F.floor(F.col("shard") / BUCKET_ROWS), [F.col("shard")], F.col("units"), "first")
    slices = first.select("no", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("units") - 1)).alias("rank"))
    # written, like the picks: a row for each block, planned by themselves and not with every reader of the mix
    drawn = written(units.join(slices, ["no", "rank"]).groupBy("no", "block").agg(F.collect_list(F.struct("shard", "epoch", "partial")).alias("units")))
    plan = drawn.join(written(_edge_picks(dealt, blocks)), ["no", "block"], "left")
    out = dealt.join(plan, ["no", "block"], "left")
    taken = F.filter(F.coalesce("units", F.array().cast("array<struct<shard:int,epoch:int,partial:boolean>>")), lambda x: ~x["partial"] | F.array_contains(F.coalesce("picks", F.array().cast("array<bigint>")), F.col("key")))
    draws = F.array_sort(F.transform(taken, lambda x: F.struct(x["shard"].alias("shard"), F.xxhash64(F.lit(seed + 2), x["shard"], x["epoch"], F.col("key")).alias("order"), x["epoch"].alias("epoch"))))
    return out.select("doc_id", "source", "size", "source_size", "target", "key", draws.alias("draws"))


def repeat_drawn(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is drawn, in shard order.

    Keeps the columns of ``docs``; rows that no draw takes are absent.
    """
    id_col, text_col, seed = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("seed", 20_240)
    # rows of equal id and text are drawn alike, so one of them stands for all in the join
    plan = mix(docs, **options).where(F.size("draws") > 0).select("key", F.explode("draws").alias("d")).groupBy("key", "d").agg(F.lit(1).alias("one"))
    own = fresh("key", docs.columns)
    shard, order = fresh("shard", docs.columns), fresh("order", docs.columns)
    keyed = docs.withColumn(own, F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)))
    found = written(plan.select(F.col("key").alias(own), F.col("d.shard").alias(shard), F.col("d.order").alias(order)))
    return keyed.join(found, own).repartition(shard).sortWithinPartitions(shard, order).select(*docs.columns)
