"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Everything is DataFrame and SQL functions: sizes are counted once and staged, targets and seats are
windows over one row per source or shard, and a document finds its chosen blocks by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.llm.common import WORD, narrow, staged, token_hash

MAX_REPEATS = 3
WEIGHT_CYCLE = 3
DOCS_PER_SHARD = 10_000
BLOCK_WORDS = 64
LEAST_BLOCKS = 65_536
SEED = 17
#: Large primes; modulo a smaller number each gives a step coprime to it.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size: words of the whole text (null: 0)."""
    return narrow(docs, doc_id=id_col, source=source_col, text=text_col).select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """One row per source: its number in code point order (null last), weight, words, target and shards.

    All words are shared by weight; a source takes at most ``MAX_REPEATS`` times its own words and the
    excess is shared again by weight. In ascending order of cap per weight the capped sources come first,
    so one pass of running sums finds the level of the rest.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by = by.withColumn("idx", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    by = by.withColumn("weight", F.col("idx") % WEIGHT_CYCLE + 1).withColumn("cap", F.lit(MAX_REPEATS) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "idx")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = (by.withColumn("total", F.sum("source_size").over(everything))
          .withColumn("level", (F.col("total") - F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("cap"))
                      / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
          .withColumn("free", F.col("cap") > F.col("level") * F.col("weight")))
    by = by.withColumn("level", F.max(F.when(F.col("free"), F.col("level"))).over(everything))
    target = F.when(F.col("free"), F.col("level") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.expr(f"total div {LEAST_BLOCKS}"))).cast("long")
    return by.select("source", "idx", "source_size", target.alias("target"), "total", block.alias("block"),
                     F.ceil(F.col("docs") / docs_per_shard).cast("long").alias("shards"))


def sainte_lague(keys: DataFrame, group: list[str], key: str, share: str, seats: str) -> DataFrame:
    """``keys`` with ``quota``: the group's ``seats`` given to the highest quotients share / (2s + 1).

    The divisor lies within half a seat per key of the exact one, so every key surely has the seats up to
    ``lo`` and surely none beyond ``hi``; only the quotients between, a few per key, are ranked. Ties go to
    the smaller key.
    """
    whole = Window.partitionBy(*group) if group else Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.sum((F.col(share) > 0).cast("long")).over(whole)
    per = F.col(share) / F.sum(share).over(whole)
    some = F.col(share) > 0
    df = keys.withColumn("lo", F.when(some, F.greatest(F.lit(0), F.floor(per * (F.col(seats) - n / 2) - 0.5) - 1)).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("hi", F.when(some, F.greatest(F.lit(0), F.ceil(per * (F.col(seats) + n / 2) + 0.5) + 1)).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("open", F.col(seats) - F.sum("lo").over(whole))
    cand = df.where("hi > lo").withColumn("s", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)))
    order = (Window.partitionBy(*group) if group else Window).orderBy((F.col(share) / (2 * F.col("s") + 1)).desc(), key, "s")
    won = (cand.withColumn("rank", F.row_number().over(order)).where("rank <= open")
           .groupBy(*group, key).agg(F.count(F.lit(1)).alias("won")))
    return df.join(won, [*group, key], "left").withColumn("quota", F.col("lo") + F.coalesce("won", F.lit(0))).drop("lo", "hi", "open", "won")


CHOSEN = "(b * step + shift) % blocks < once"


def _prime(h: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (h % len(PRIMES) + 1).cast("int"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        docs_per_shard: int = DOCS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and the block layout each document was chosen by.

    A source's documents are dealt to shards by a hash of their id, so no task holds a whole source. Seats
    go to sources by target, then to a source's shards by words. In a shard the documents lie in seeded
    order and every ``block`` words are a block; with a quota of q blocks of n, each is taken q div n times
    and q mod n of them, chosen by a seeded permutation, once more.

    Null texts and texts without a word have size 0 and are never taken; rows with a null source form one
    source, ordered last; repeated rows are separate documents; null ids hash like the text ``~``; an empty
    table gives an empty result.
    """
    return place(staged(sized(docs, id_col, text_col, source_col), "mix-sizes"), docs_per_shard, seed)


def place(sizes: DataFrame, docs_per_shard: int = DOCS_PER_SHARD, seed: int = SEED, rows: DataFrame | None = None) -> DataFrame:
    """``mix`` over staged sizes; ``rows`` are the same documents with doc_id, source, size and whatever is to be kept."""
    sources = staged(source_targets(sizes, docs_per_shard), "mix-sources")
    seated = sainte_lague(sources.withColumn("seats", F.round(F.col("total") / F.col("block")).cast("long")), [], "idx", "target", "seats")
    seated = seated.select("idx", F.col("quota").alias("source_quota"), "block")

    def dealt(df: DataFrame) -> DataFrame:
        return (df.alias("d").join(sources.alias("s"), F.expr("d.source <=> s.source"))
                .select("d.*", "s.idx", "s.source_size", "s.target", "s.block", "s.shards")
                .withColumn("h", token_hash(F.lit(seed), "doc_id")).withColumn("shard", F.col("h") % F.col("shards")))

    shards = dealt(sizes).groupBy("idx", "shard").agg(F.sum("size").alias("words"))
    quotas = sainte_lague(shards.join(seated, "idx"), ["idx"], "shard", "words", "source_quota")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("words") / F.col("block"))).cast("long")
    h = token_hash(F.lit(seed), "idx", "shard")
    quotas = (quotas.withColumn("blocks", blocks).withColumn("h", h)
              .withColumn("quota", F.least("quota", MAX_REPEATS * F.col("blocks")))
              .select("idx", "shard", "blocks", F.expr("quota div blocks").alias("every"), (F.col("quota") % F.col("blocks")).alias("once"),
                      (_prime(F.col("h")) % F.col("blocks")).alias("step"), (F.col("h") % F.col("blocks")).alias("shift")))
    order = Window.partitionBy("idx", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt(sizes if rows is None else rows).withColumn("x1", F.sum("size").over(order)).withColumn("x0", F.col("x1") - F.col("size"))
    out = laid.join(quotas, ["idx", "shard"])
    more = F.expr(f"""aggregate(sequence(x0 div block, (x1 - 1) div block), 0L, (acc, b) -> acc +
        if({CHOSEN}, least(x1, (b + 1) * block) - greatest(x0, b * block), 0L))""")
    return out.withColumn("taken", F.when(F.col("size") > 0, F.col("every") * F.col("size") + more).otherwise(F.lit(0)).cast("long"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars",
          docs_per_shard: int = DOCS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """The mix as rows of ``docs``: a document's whole text as often as all its blocks are taken, and one more row
    with the words of the blocks that are taken once more, joined by spaces. ``length_col`` follows the text.
    Documents that the mix does not take, and those without a word, have no row.
    """
    whole = docs.select(F.struct("*").alias("row"))
    field = lambda name: F.col("row").getField(name)
    rows = whole.select("row", field(id_col).alias("doc_id"), field(source_col).alias("source"),
                        F.coalesce(F.regexp_count(field(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    laid = place(staged(sized(docs, id_col, text_col, source_col), "mix-sizes"), docs_per_shard, seed, rows)
    part = F.array_join(F.filter(F.regexp_extract_all(field(text_col), F.lit(WORD), F.lit(0)), lambda w, i: _taken(i)), " ")
    copies = F.sequence(F.lit(0), F.col("every") - F.when(F.col("taken") > F.col("every") * F.col("size"), 0).otherwise(1))
    out = laid.where("taken > 0").select("row", F.explode(copies).alias("copy"), "every", "once", "x0", "block", "blocks", "step", "shift")
    out = out.select("row", F.when(F.col("copy") < F.col("every"), field(text_col)).otherwise(part).alias("text"))
    other = {text_col: F.col("text"), length_col: F.length("text").cast(docs.schema[length_col].dataType) if length_col in docs.columns else None}
    return out.select(*[(other[c] if c in other else field(c)).alias(c) for c in docs.columns])


def _taken(i: Column) -> Column:
    """Whether the document's word ``i`` lies in a block taken once more."""
    b = F.floor((F.col("x0") + i) / F.col("block"))
    return (b * F.col("step") + F.col("shift")) % F.col("blocks") < F.col("once")
