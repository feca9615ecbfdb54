"""Mixing sources to target weights: capped water-filling, then seeded repetitions."""

from pyspark.sql import DataFrame, Window, functions as F

from pathledger.llm.text import WORD
from pathledger.operators.spread import numbered
from pathledger.session import materialise

WEIGHTS = (5, 2, 1)
_BUCKETS = 4  # hex digits of the seeded order that tell a document's bucket


def targets(sizes: DataFrame, weights=WEIGHTS, share=1.5, epochs=2) -> DataFrame:
    """``sizes`` (source, source_size) with the ``target`` of each source.

    The sources, by code point and null last, get the weights in turn and share ``share`` of all
    sizes. A target stops at ``epochs`` times the source's size; what is over goes to the other
    sources by weight, until none is above. Each round clamps at least one source and is one sum
    over the sources. If all are clamped, the rest of the share is nobody's.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranked = numbered(sizes.select("source", "source_size"), order, name="place")
    turn = (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")
    weight = F.element_at(F.array(*map(F.lit, weights)), turn)
    ranked = materialise(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    cap = F.col("source_size") * epochs
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level_up, level_down = share * total, ranked.agg(F.sum("weight")).first()[0] or 1
    while True:
        # The level is level_up / level_down; a source above its cap under it is clamped.
        level = F.lit(float(level_up)) * F.col("weight") / F.lit(float(level_down))
        clamped = level > cap
        row = ranked.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        now = share * total - row.full, row.open
        if not row.open or now == (level_up, level_down):
            break
        level_up, level_down = now
    target = F.when(clamped, cap.cast("double")).otherwise(level)
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, doc_id="doc_id", text="text", source="source", seed=17, **how) -> DataFrame:
    """``docs`` packed as column ``doc``, with what the mix takes of each.

    Adds source_size, target (of the document's source), size (words of the text; null has 0) and
    taken: the words that the mix takes, repeats counted. Every document is taken
    floor(target / source_size) times. What then is missing to the target comes from the
    documents in the order of a seeded hash of id, source and text, each once at most; the one that reaches
    the target counts for the words still missing, so a source takes its target, rounded. Nothing
    depends on the layout of the rows, so reruns agree. Rows equal in id, source and text share
    their hash and are taken one after the other. A null source is a source of its own, a null
    id counts as ''. A source without words takes nothing.

    Only sums per source and hash bucket leave the map side: documents whose bucket lies before or
    after the one that reaches the target are decided by comparison, and the documents of
    that one bucket (a 65,536th of a source) by a running sum.
    """
    size = F.regexp_count(F.coalesce(F.col(f"doc.{text}"), F.lit("")), F.lit(WORD)).cast("long")
    cell = F.coalesce(F.col(f"doc.{doc_id}").cast("string"), F.lit(""))
    body = F.md5(F.coalesce(F.col(f"doc.{text}"), F.lit("")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc")).select(
        "doc",
        F.col(f"doc.{source}").alias("source"),
        size.alias("size"),
        F.md5(F.concat_ws(" ", F.lit(str(seed)), cell, F.coalesce(F.col(f"doc.{source}"), F.lit("")), body)).alias("order"),
    )
    rows = rows.withColumn("bucket", F.substring("order", 1, _BUCKETS))
    cells = materialise(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "cells")
    sizes = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    aims = targets(sizes, **how)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round(F.col("target")).cast("long") - whole * F.col("source_size")
    aims = aims.select("source", "source_size", "target", whole.alias("whole"), rest.alias("rest"))
    # At most 65,536 buckets per source.
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    named = aims.withColumnRenamed("source", "name")
    cut = cells.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    cut = cut.join(named, cut.source.eqNullSafe(named.name))
    cut = cut.filter("start <= rest and rest < start + words").select(
        "name", F.col("bucket").alias("cut"), "start"
    )
    aims = named.join(cut.withColumnRenamed("name", "at"), F.col("name").eqNullSafe(F.col("at")), "left")
    aims = materialise(aims.select("name", "source_size", "target", "whole", "rest", "cut", "start"), "aims")
    joined = rows.join(aims, rows.source.eqNullSafe(aims.name), "left")
    # Without a bucket that goes beyond it, the rest is all of the source or nothing.
    once = F.when(F.col("cut").isNull(), F.when(F.col("rest") > 0, F.col("size")).otherwise(0))
    once = once.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(0)
    inside = Window.partitionBy("source").orderBy("order", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - reached))
    at_cut = F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False))
    kept = ["doc", "source_size", "target", "size", "whole"]
    # Rows without their text go through the running sum; both parts read the same rows.
    plain = joined.filter(~at_cut).select(*kept, once.alias("once"))
    summed = joined.filter(at_cut).select(*kept, part.alias("once"))
    taken = F.col("whole") * F.col("size") + F.col("once")
    return plain.unionByName(summed).select(
        "doc", "size", "source_size", "target", taken.cast("long").alias("taken")
    )


def repeated(mixed: DataFrame, text="text") -> DataFrame:
    """The rows of a ``mix`` as often as it takes them, with their number ``copy`` from 1.

    A document taken 0 times is not there, one taken twice is there twice. A copy that is taken in
    part has the first words of its text, joined by single spaces. So the words of all rows of a
    source add up to what the mix takes of it. Documents without words are never taken. The
    repetitions are made where the row is; a document has as many as the mix has epochs, one more at most.
    """
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = mixed.filter("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    words = (F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    body = F.col(f"doc.{text}")
    part = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), F.lit(1), words), " ")
    return rows.withColumn("doc", F.col("doc").withField(text, F.when(words >= F.col("size"), body).otherwise(part)))
