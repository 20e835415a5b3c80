"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coursecast.operators.order import fresh
from coursecast.sources.scratch import settle

# Fixed values of the mix.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
WORD = r"[^\x20\x09-\x0D]+"

_CELLS = 4096


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source``, ``source_size`` and ``target`` per source.

    Sources in code point order, null last, get the weights in turn. Targets share ``share`` of all words by
    weight; none exceeds ``most`` times its source, and what is cut off goes to the others by weight. The
    level that does so is found from sums in the order in which sources reach their limit. The windows see one
    row per source.
    """
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", F.element_at(cycle, (place - 1) % len(weights) + 1)).withColumn("cap", F.col("source_size") * most)
    full_at = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    per = (
        per.withColumn("budget", share * F.sum("source_size").over(everything))
        .withColumn("full", F.sum("cap").over(full_at.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(full_at.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.coalesce("full", F.lit(0))) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything))
    )
    return per.select(
        "source", "source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"),
    )


def uniform(*parts: Column, seed: int) -> Column:
    """A number between 0 and 1, neither included, that depends on the values of ``parts`` only."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def pareto_mix(docs: DataFrame, *, text_col: str = "text", source_col: str = "source", weight_col: str | None = None,
               weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 20) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` of every row.

    A document's expected number of copies is its source's target over its size, times its weight over the
    source's mean weight if ``weight_col`` is given (null counts as 1, negative as 0). The whole part is
    certain. The rest is its inclusion probability in a sample of fixed size: documents are ranked by random
    odds over inclusion odds, and taken in that order while they fit into the words that the source still
    needs. Of the others, the one whose size is nearest to what is then missing comes last, if that brings the
    source nearer to its target. Documents are taken whole.

    A null or empty text has size 0 and nothing is taken; a null source is a source; repeated rows are
    documents of their own, told apart by size only where they differ; a null id is drawn like any other. An
    empty table gives an empty result; extra columns are ignored. Ranks are found by counting words per cell of
    the rank's range, in two steps, so that no task sorts more than about a 16-millionth of a source.
    """
    weight = F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)), F.lit(0.0))
    sized = settle(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            size_of(F.col(text_col).cast("string")).alias("size"), weight.alias("weight"),
        ),
        "mix-sizes",
    )
    mean = sized.groupBy("source").agg((F.sum(F.col("size") * F.col("weight")) / F.sum("size")).alias("mean"))
    goal = targets(sized, weights=weights, share=share, most=most)
    goal = settle(goal.join(mean, goal.source.eqNullSafe(mean.source)).select(goal.source, "source_size", "target", "mean"), "mix-targets")

    def with_source(rows: DataFrame, other: DataFrame, *columns: str) -> DataFrame:
        other = other.withColumnRenamed("source", "_source")
        return rows.join(other, rows.source.eqNullSafe(F.col("_source")), "left").select(*rows.columns, *columns)

    rows = with_source(sized, goal, "source_size", "target", "mean")
    expected = F.coalesce(F.col("target") / F.col("source_size"), F.lit(0.0))
    if weight_col is not None:
        expected = F.coalesce(F.least(expected * F.col("weight") / F.col("mean"), F.lit(float(most))), F.lit(0.0))
    chance = F.col("expected") - F.col("sure")
    odds = F.col("u") / (1 - F.col("u")) / (chance / (1 - chance))
    rows = (
        rows.withColumn("expected", expected).withColumn("sure", F.floor("expected").cast("long"))
        .withColumn("u", uniform(F.col("doc_id"), F.col("source"), seed=seed))
        .withColumn("rank", F.when((chance > 0) & (F.col("size") > 0), odds))
        .withColumn("cell", F.floor(F.col("rank") / (1 + F.col("rank")) * (_CELLS * _CELLS)).cast("long"))
        .withColumn("cell", F.least("cell", F.lit(_CELLS * _CELLS - 1).cast("long")))
        .withColumn("coarse", F.floor(F.col("cell") / _CELLS).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "sure", "rank", "cell", "coarse")
    )
    # One row per source, stored: Spark knows its size and does not deal all rows by source to join it.
    need = settle(rows.groupBy("source").agg((F.max("target") - F.sum(F.col("sure") * F.col("size"))).alias("need")), "mix-need")

    def edge(counted: DataFrame, cell: str, need: DataFrame) -> DataFrame:
        """Per source the cell in which the need is met, and what it still needs there."""
        per = counted.groupBy("source", cell).agg(F.sum("size").alias("size"))
        before = F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy(cell).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        per = with_source(per.withColumn("before", before), need, "need")
        met = (F.col("before") < F.col("need")) & (F.col("need") <= F.col("before") + F.col("size"))
        return per.filter(met).select("source", F.col(cell).alias(f"edge_{cell}"), (F.col("need") - F.col("before")).alias("need"))

    ranked = rows.filter("rank is not null")
    first = settle(edge(ranked, "coarse", need), "mix-edge")
    inside = with_source(ranked, first, "edge_coarse").filter("coarse = edge_coarse").drop("edge_coarse")
    second = settle(edge(inside, "cell", first), "mix-edge")
    rows = with_source(with_source(rows, second.select("source", "edge_cell", F.col("need").alias("edge_need")), "edge_cell", "edge_need"), need, "need")
    at_edge = F.col("rank").isNotNull() & (F.col("cell") == F.col("edge_cell"))
    easy = rows.filter(~F.coalesce(at_edge, F.lit(False))).withColumn(
        "more", F.coalesce((F.col("need") > 0) & F.coalesce(F.col("cell") < F.col("edge_cell"), F.col("rank").isNotNull()), F.lit(False))
    )
    upto = F.sum("size").over(W.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    close = settle(rows.filter(at_edge), "mix-close").withColumn("upto", upto)  # so that the joins before split hot sources
    close = close.withColumn("more", F.col("upto") <= F.col("edge_need")).drop("upto")
    columns = ["doc_id", "source", "size", "source_size", "target", "sure", "rank", "more"]
    drawn = settle(easy.select(*columns).unionByName(close.select(*columns)), "mix-drawn")

    gaps = settle(drawn.groupBy("source").agg(
        (F.max("target") - F.sum((F.col("sure") + F.col("more").cast("long")) * F.col("size"))).alias("gap")
    ), "mix-gaps")
    off = F.abs(F.col("size") - F.col("gap"))
    fits = F.min(F.struct(off.alias("off"), "rank", "doc_id", "size")).alias("last")
    left = with_source(drawn.filter("rank is not null and not more"), gaps, "gap").filter(off < F.col("gap"))
    last = settle(left.groupBy("source").agg(fits), "mix-last")
    final = with_source(drawn, last, "last")
    is_last = ~F.col("more") & F.struct("rank", "doc_id", "size").eqNullSafe(F.struct("last.rank", "last.doc_id", "last.size")) & F.col("last").isNotNull()
    final = final.withColumn("is_last", is_last)
    one = F.row_number().over(W.partitionBy("source").orderBy("rank")) == 1  # of repeated rows
    chosen = settle(final.filter("is_last"), "mix-last").withColumn("copies", F.col("sure") + one.cast("long"))
    final = final.filter("not is_last").withColumn("copies", F.col("sure") + F.col("more").cast("long")).unionByName(chosen)
    return final.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, with the columns of ``docs``.

    Documents without words are in no mix. Rows with the same ``doc_id`` and size share their copies evenly, the
    first by the hash of their text getting what is left over. Further columns stay as they are, whatever their names;
    an empty table gives an empty result.
    """
    id_, taken, copies, n, words, copy = (
        fresh(docs, c) for c in ("mix_id", "mix_size", "mix_copies", "mix_rows", "mix_words", "mix_copy")
    )
    take = pareto_mix(docs, **options).groupBy(F.col("doc_id").alias(id_), F.col("size").alias(taken))
    take = take.agg(F.sum("copies").alias(copies), F.count("*").alias(n)).filter(F.col(copies) > 0)
    text = F.col(options.get("text_col", "text")).cast("string")
    rows = docs.withColumn(words, size_of(text))
    rows = rows.join(take, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(words) == F.col(taken)))
    place = F.row_number().over(W.partitionBy(id_, words).orderBy(F.xxhash64(text)))
    alone = rows.filter(F.col(n) == 1)
    even = F.floor(F.col(copies) / F.col(n)) + (place <= F.col(copies) % F.col(n)).cast("long")
    several = rows.filter(F.col(n) > 1).withColumn(copies, even)
    rows = alone.unionByName(several.filter(F.col(copies) > 0))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


ORACLE = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), per as (
  select source, sum(size)::bigint as source_size,
    [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from sized group by source
), level as (
  select *, 1.5::double * (sum(source_size) over ())::double as budget,
    coalesce(sum(2 * source_size) over (o rows between unbounded preceding and 1 preceding), 0)::double as reached,
    (sum(weight) over (o rows between current row and unbounded following))::double as unmet
  from per window o as (order by (2 * source_size)::double / weight, source nulls last)
), goal as (
  select source, source_size, least((2 * source_size)::double,
    max(case when (budget - reached) / unmet <= (2 * source_size)::double / weight then (budget - reached) / unmet end) over () * weight) as target
  from level
), drawn as (
  select s.doc_id, s.source, s.size, g.source_size, g.target,
    coalesce(floor(g.target / nullif(g.source_size, 0)), 0)::bigint as sure,
    coalesce(g.target / nullif(g.source_size, 0), 0) - coalesce(floor(g.target / nullif(g.source_size, 0)), 0) as chance,
    (('0x' || substr(md5('20|' || coalesce(s.doc_id::varchar, '-') || '|' || coalesce(s.source, '-')), 1, 13))::bigint + 0.5::double)
      / 4503599627370496::double as u
  from sized s join goal g on s.source is not distinct from g.source
), ranked as (
  select *, target - sum(sure * size) over (partition by source) as need,
    case when chance > 0 and size > 0 then u / (1 - u) / (chance / (1 - chance)) end as rank
  from drawn
), summed as (
  select *, sum(size) over (partition by source, rank is null order by rank, doc_id, size rows unbounded preceding) as upto from ranked
), fitted as (
  select *, rank is not null and coalesce(upto <= need, false) as more from summed
), missing as (
  select *, target - sum((sure + more::int) * size) over (partition by source) as gap from fitted
), ordered as (
  select *, row_number() over (partition by source order by
    case when rank is not null and not more and abs(size - gap) < gap then abs(size - gap) end nulls last, rank nulls last, doc_id, size) as place
  from missing
)
select doc_id, source, size, source_size, target, copies, copies * size as taken from (
  select *, sure + (more or (place = 1 and rank is not null and abs(size - gap) < gap))::bigint as copies from ordered)
"""
