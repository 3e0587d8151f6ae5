"""Mixing sources to target weights by repeating whole documents.

1. Sizes (words) are added up per source.
2. Sources are ordered by code point, null last, and weighed by ``weights`` in turn. The targets
   share all words by weight; a target stops at ``most`` times its source's size, and what is
   left over is shared again among the others until no target is above. With ``capped`` the
   sources that stopped, every other target is ``weight * (all - caps of capped) / weights of the
   others``; a round only adds to ``capped``, so the loop ends, and it compares whole numbers.
3. A source's rate is target / size. A document is emitted ``floor(rate)`` times, and once more
   where the hash of its id is below the fraction.

Sizes are added map-side, so a source with a third of all rows is one partial sum a task; the
sources alone are ordered (over range partitions) and shared out, as a written table of
one row a source. Decisions hang on document and seed only: reruns and retried tasks agree.

Cases: a null text has size 0; the null source is a source of its own, and comes last. A source
of size 0 has target and rate 0. A null id is hashed by its text. Repeated rows are decided alike. An
empty table gives no rows. ``mix`` keeps extra columns, whatever their names; ``taken`` does not read
them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.llm.ranking import numbered
from reportloom.plans.store import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_col: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that hangs on the document and the seed only: 52 bits of a hash."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """``source, source_size, target, rate`` of ``sizes(source, size)``, one row a source."""
    summed = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    turn = F.array(*(F.lit(w) for w in weights))
    placed = numbered(summed, [], [F.col("source").asc_nulls_last()])
    shares = materialize(placed.withColumn("weight", F.get(turn, (F.col("place") % len(weights)).cast("int"))).drop(
        "place"), "source-weights")
    total, weight = (int(x or 0) for x in shares.agg(F.sum("source_size"), F.sum("weight")).first())
    rest, left = total, weight
    whole = "decimal(38,0)"
    cap = F.col("source_size").cast(whole) * F.lit(most)

    def above() -> Column:
        return cap * F.lit(left).cast(whole) < F.col("weight").cast(whole) * F.lit(rest).cast(whole)
    while left:
        stopped = shares.filter(above()).agg(F.sum("source_size"), F.sum("weight")).first()
        after = total - most * int(stopped[0] or 0), weight - int(stopped[1] or 0)
        if after == (rest, left):
            break
        rest, left = after
    share = F.col("weight") * F.lit(float(rest)) / F.lit(float(max(left, 1)))
    target = F.when(above() if left else F.lit(True), (F.col("source_size") * most).cast("double")).otherwise(share)
    out = shares.select("source", "source_size", target.alias("target")).withColumn("rate", F.when(
        F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0)))
    discard(summed)
    return out


def copies(rate: Column, drawn: Column) -> Column:
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")).cast("long")


def taken(docs: DataFrame, weights=WEIGHTS, most: int = 3, seed: int = 0, id_col: str = "doc_id",
          source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per row: id, ``size``, ``source_size``, ``target``, ``taken``, ``copies``."""
    text = F.col(text_col)
    sizes = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(text).alias("size"),
                                    draw(F.col(id_col), text, seed).alias("drawn")), "document-sizes")
    shares = targets(sizes, weights, most)
    n = copies(F.col("rate"), F.col("drawn"))
    return sizes.alias("d").join(shares.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (n * F.col("size")).alias("taken"), n.alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = 3, seed: int = 0, id_col: str = "doc_id",
        source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed documents: every row as often as it is taken, in the columns of ``docs``.

    Texts are read twice and moved only if Spark finds the sources too many to send along.
    """
    text = F.col(text_col)
    shares = targets(docs.select(F.col(source_col).alias("source"), words(text).alias("size")), weights, most)
    rates = shares.select(F.col("source").alias("_mix_source"), F.col("rate").alias("_mix_rate"))
    n = copies(F.col("_mix_rate"), draw(F.col(id_col), text, seed)).cast("int")
    return (docs.join(rates, F.col(source_col).eqNullSafe(F.col("_mix_source")))
            .withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), n))).select(*docs.columns))
