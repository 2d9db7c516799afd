"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.llm.common import BLANKS, free_name, word_count

#: Hexadecimal digits of the permutation key that name a document's bucket within its source.
BUCKET_DIGITS = 3
#: A draw is looked for within so many standard deviations (and two steps) of its mean.
DEVIATIONS = 12


def source_targets(sizes: DataFrame, weights: Sequence[float], ratio: float, limit: float) -> DataFrame:
    """Add ``target`` to (source, source_size): words that the mix takes from each source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``ratio`` times all
    words; a target stops at ``limit`` times its source's size, and what is above is shared by
    weight among the others until none is above. One row per source passes through one task.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_all") * ratio - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    free = F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.col("_level"))
    return (
        ranked.withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size").cast("double") * limit)
        .withColumn("_all", F.sum("source_size").over(whole).cast("double"))
        .withColumn("_level", level)
        .withColumn("_level", F.max(free).over(whole))
        .withColumn("target", F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * F.col("_level"))))
        .select("source", "source_size", "target", F.col("_rank").alias("rank"))
    )


#: One hypergeometric draw by inverse cumulative weights: of ``c.n`` blocks of a source among
#: ``s.pop`` blocks, how many are among the ``s.left`` that go to the left half. The weights
#: follow from each other by a ratio, from the low end of the range to its high end.
_MEAN = "(s.left * (c.n / cast(s.pop as double)))"
_SD = "sqrt(greatest(0D, s.left * (c.n / cast(s.pop as double)) * (1D - c.n / cast(s.pop as double)) * ((s.pop - s.left) / cast(greatest(s.pop - 1L, 1L) as double))))"
_RANGE = f"""sequence(
    greatest(0L, s.left - (s.pop - c.n), cast(floor({_MEAN} - {DEVIATIONS} * {_SD}) as bigint) - 2L),
    least(c.n, s.left, cast(ceil({_MEAN} + {DEVIATIONS} * {_SD}) as bigint) + 2L))"""
_RATIO = "((c.n - k) * 1D * (s.left - k)) / ((k + 1D) * (s.pop - c.n - s.left + k + 1D))"
_TOTAL = f"aggregate(r, named_struct('w', 1D, 't', 0D), (a, k) -> named_struct('w', a.w * {_RATIO}, 't', a.t + a.w), a -> a.t)"


def _draws(seed: int) -> Column:
    """For a node (lo, hi, total, blocks, counts): the blocks of each source that go left."""
    uniform = f"(shiftrightunsigned(xxhash64({seed}, lo, hi, c.i), 12) + 0.5D) / 4503599627370496D"
    total = _TOTAL
    pick = f"""aggregate(r, named_struct('w', 1D, 't', 0D, 'k', r[0]),
        (a, k) -> named_struct('w', a.w * {_RATIO}, 't', a.t + a.w, 'k', if(a.t <= goal, k, a.k)), a -> a.k)"""
    drawn = f"element_at(transform(array({_RANGE}), r -> element_at(transform(array({uniform} * {total}), goal -> {pick}), 1)), 1)"
    step = f"""element_at(transform(array(if(c.n = 0L, 0L, {drawn})), x ->
        named_struct('pop', s.pop - c.n, 'left', s.left - x, 'out', concat(s.out, array(x)))), 1)"""
    start = "named_struct('pop', blocks, 'left', left_blocks, 'out', cast(array() as array<bigint>))"
    return F.expr(f"aggregate(counts, {start}, (s, c) -> {step}, s -> s.out)")


def split_tree(quotas: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """Deal (i, n), source numbers and their blocks, to shards: (i, ends), ends by shard.

    The blocks of a node are split between the two halves of its shards, each with its exact
    share of all blocks, by a multivariate-hypergeometric draw over the sources; the leaves hold
    one shard each. So every source's blocks are dealt exactly once, every shard gets as many
    blocks as any other but for one, and the composition is that of a random permutation of all
    blocks without permuting them. ``ends`` are running sums: shard j takes the source's blocks
    from ends[j-1] up to ends[j].
    """
    whole = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("i", F.col("n").cast("long").alias("n")))).alias("counts"), F.sum("n").alias("blocks"))
    whole = whole.where("blocks is not null")
    nodes = whole.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.col("blocks").alias("total"), "blocks", "counts")
    bound = lambda at: f"cast(floor(total * cast({at} as double) / {shards}) as bigint)"
    for _ in range((shards - 1).bit_length()):
        nodes = nodes.withColumn("mid", F.expr("cast((lo + hi) div 2 as int)"))
        nodes = nodes.withColumn("left_blocks", F.expr(f"if(hi - lo = 1, 0L, {bound('mid')} - {bound('lo')})"))
        nodes = nodes.withColumn("drawn", F.when(F.expr("hi - lo > 1"), _draws(seed)))
        left = "named_struct('lo', lo, 'hi', mid, 'blocks', left_blocks, 'counts', zip_with(counts, drawn, (c, x) -> named_struct('i', c.i, 'n', x)))"
        right = "named_struct('lo', mid, 'hi', hi, 'blocks', blocks - left_blocks, 'counts', zip_with(counts, drawn, (c, x) -> named_struct('i', c.i, 'n', c.n - x)))"
        same = "array(named_struct('lo', lo, 'hi', hi, 'blocks', blocks, 'counts', counts))"
        nodes = nodes.select("total", F.explode(F.expr(f"if(hi - lo = 1, {same}, array({left}, {right}))")).alias("x")).select("total", "x.lo", "x.hi", "x.blocks", "x.counts")
    dealt = nodes.select("lo", F.explode("counts").alias("c")).select(F.col("c.i").alias("i"), "lo", F.col("c.n").alias("n"))
    listed = dealt.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("lo", "n"))).alias("per"))
    ends = F.expr("transform(sequence(1, size(per)), j -> aggregate(slice(per, 1, j), 0L, (a, p) -> a + p.n))")
    return listed.select("i", ends.alias("ends"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    ratio: float = 1.5,
    limit: float = 2.0,
    shards: int = 16,
    block_words: int = 1024,
    seed: int = 17,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, pieces, taken.

    Each source's documents are permuted by a hash of their ids and laid end to end, again and again,
    up to the source's target; this line is cut into blocks of ``block_words`` words, the splitting
    tree deals exact block quotas to the shards, and a shard draws the next blocks of the line, so
    no two shards draw the same block. ``pieces`` (pass, shard, block, words) are the document's
    copies in the mix; a copy belongs to the block in which it begins. Only the last copy before a
    target may be cut to fewer words than the document has, so ``taken``, the words over all pieces,
    adds up to the rounded target in every source. Reruns give the same mix for the same rows.

    Size is the number of words; null and blank texts have none and no pieces. A source without
    words has target 0. Null is a source like any other. Rows that agree in id and text are
    interchangeable. An empty table gives no rows. ``carry`` names further columns to keep.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    others = [F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), key.alias("_key"), F.xxhash64("text").alias("_text"), *others)
    rows = rows.withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS)).withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))

    buckets = rows.groupBy("_source", "_bucket").agg(F.first("source").alias("source"), F.sum("size").alias("_sum"))
    sizes = buckets.groupBy("_source").agg(F.first("source").alias("source"), F.sum("_sum").alias("source_size"))
    targets = source_targets(sizes, weights, ratio, limit).withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    targets = targets.withColumn("_words", F.round("target").cast("long")).withColumn("_blocks", F.ceil(F.col("_words") / block_words).cast("long"))
    ends = split_tree(targets.select(F.col("rank").alias("i"), F.col("_blocks").alias("n")), shards, seed)
    plan = targets.join(ends, targets["rank"] == ends["i"]).select("_source", "source_size", "target", "_words", "ends")
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("_source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")).join(plan, "_source")

    line = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", "size", "_text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_within", F.coalesce(F.sum("size").over(line), F.lit(0))).join(starts, ["_source", "_bucket"])
    placed = placed.withColumn("_start", F.col("_offset") + F.col("_within"))
    copies = F.expr(f"""filter(transform(
        if(size = 0, cast(array() as array<bigint>), sequence(0L, cast(ceil(_words / source_size) as bigint))),
        p -> named_struct('pass', p, 'block', (p * source_size + _start) div {block_words}, 'words', least(size, greatest(0L, _words - p * source_size - _start)))),
        x -> x.words > 0)""")
    dealt = F.expr("transform(_copies, x -> named_struct('pass', x.pass, 'shard', size(filter(ends, e -> e <= x.block)), 'block', x.block, 'words', x.words))")
    out = placed.withColumn("_copies", copies).withColumn("pieces", dealt)
    kept = [F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry) if c.lower() not in ("doc_id", "source")]
    return out.select("doc_id", "source", "size", "source_size", "target", "pieces", F.expr("aggregate(pieces, 0L, (a, x) -> a + x.words)").alias("taken"), *kept)


def mixed_documents(docs: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """The mix itself: a row for each copy, with the named columns of its document and the shard.

    A copy that the target cuts keeps its first words, joined by single spaces. ``n_chars``, if
    named, is that of the copy's text.
    """
    # carried under names of their own, whatever they are called
    asked = {c: f"_asked{i}" for i, c in enumerate(c for c in columns if c not in ("doc_id", "source", "text"))}
    named = docs.select("doc_id", "source", "text", *[F.col(c).alias(a) for c, a in asked.items()])
    mixed = mix(named, carry=["text", *asked.values()], **options).withColumn("_piece", F.explode("pieces"))
    cut = F.array_join(F.slice(F.split(F.regexp_replace("text", f"^{BLANKS}", ""), BLANKS), 1, F.col("_piece.words").cast("int")), " ")
    mixed = mixed.withColumn("text", F.when(F.col("_piece.words") < F.col("size"), cut).otherwise(F.col("text")))
    if "n_chars" in asked:
        mixed = mixed.withColumn(asked["n_chars"], F.char_length("text").cast("long"))
    kept = [F.col(asked.get(c, c)).alias(c) for c in columns]
    shard, turn = (free_name(columns, n) for n in ("mix_shard", "mix_pass"))
    return mixed.select(*kept, F.col("_piece.shard").alias(shard), F.col("_piece.pass").alias(turn))


def write_mix(docs: DataFrame, path: str, columns: Sequence[str], shards: int = 16, seed: int = 17, **options) -> None:
    """Write the mix as Parquet, a folder per shard, its rows shuffled within each file."""
    copies = mixed_documents(docs, columns, shards=shards, seed=seed, **options)
    dealt = copies.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", "mix_pass"))
    dealt.repartition(shards, "mix_shard").sortWithinPartitions("mix_shard", "_order").drop("_order").write.mode("overwrite").partitionBy("mix_shard").parquet(path)


SQL = """
with d as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
           md5('17:' || coalesce(cast(doc_id as varchar), '')) as k from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w,
             1.5::double * sum(source_size) over () as total from s),
p as (select *, 2.0::double * source_size as cap from r),
levels as (
    -- the level of the water after the i fullest-relative sources are full, for every i
    select i.n, (max(total) - coalesce(sum(cap) filter (cap / w < i.edge), 0)) / nullif(sum(w) filter (cap / w >= i.edge), 0) as level, i.edge
    from p, (select distinct cap / w as edge, cap / w as n from p) i group by i.n, i.edge),
level as (select max(level) filter (level <= edge) as level from levels),
t as (select source, source_size, least(cap, w * level.level) as target from p, level),
o as (select d.*, sum(size) over (partition by source order by k, doc_id rows unbounded preceding) - size as start from d)
select o.doc_id, o.size::bigint as size, t.source_size, t.target::double as target,
       (case when o.size = 0 then 0 else
          least(o.size, greatest(0, round(t.target)::bigint - o.start)) + least(o.size, greatest(0, round(t.target)::bigint - t.source_size - o.start)) end)::bigint as taken
from o join t on o.source is not distinct from t.source
"""
