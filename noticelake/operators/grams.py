"""Which texts may hold which needles: an inverted index over short character sequences, joined on each needle's rarest one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.operators.skew import with_global_index
from noticelake.session import ensure_checkpoint_dir

SIZE = 3  # characters of a gram; a shorter term is a gram itself
BROADCAST_GRAMS = 400_000  # different grams, rows of a few bytes, that are broadcast; beyond it the joins shuffle
LISTED_GRAMS = 64  # grams that every text is searched for one by one


def _grams(text: Column, size: int) -> Column:
    """All sequences of ``size`` characters, overlapping ones too, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _grams_of(size: int) -> Callable[[Column], Column]:
    return lambda part: _grams(part, size)


def candidates(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """Of all texts that hold every term of a needle, and of some that do not, the text's columns but for parts with the needle's.

    ``texts``: text_id, parts (an array of strings) and what else is to come along; ``needles``: needle_id, terms (an
    array) and what else. A needle's grams are the sequences of three characters of its terms. How many texts hold each
    is counted first; the one that the fewest hold finds the candidates, which the caller verifies. A needle with a gram
    that no text holds has none, nor has one without terms. However many needles there are, they share their grams: the
    different ones are broadcast while they are few, so that only counts and candidates leave the texts.
    """
    ensure_checkpoint_dir(texts.sparkSession)
    own = F.transform("terms", lambda t: F.when(F.length(t) >= SIZE, _grams(t, SIZE)).otherwise(F.array(t)))
    asked = needles.select("needle_id", F.explode(F.array_distinct(F.flatten(own))).alias("gram")).filter("gram != ''")
    wanted = asked.select("gram").distinct().checkpoint()
    sizes = sorted(r["n"] for r in wanted.select(F.length("gram").alias("n")).distinct().collect())  # SIZE numbers at most
    brought = [c for c in texts.columns if c != "parts"]
    if not sizes:
        return texts.limit(0).select(*brought, *[F.lit(None).cast(f.dataType).alias(f.name) for f in needles.schema])
    small = F.broadcast if wanted.count() <= BROADCAST_GRAMS else (lambda df: df)
    found = F.array_distinct(F.flatten(F.concat(*[F.transform("parts", _grams_of(s)) for s in sizes])))
    grams = texts.select(*brought, F.explode(found).alias("gram"))
    counts = grams.select("gram").join(small(wanted), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    counts = wanted.join(counts, "gram", "left").select("gram", F.coalesce("n", F.lit(0)).alias("n"))
    # a gram's place, rarest first, is one number: its least is kept without sorting the grams of all needles
    ranked = with_global_index(counts, [F.col("n").asc(), F.col("gram").asc()], "rank")
    first = asked.join(small(ranked.select("gram", "rank")), "gram").groupBy("needle_id").agg(F.min("rank").alias("rank"))
    chosen = first.join(small(ranked.filter("n > 0")), "rank").select("needle_id", "gram").join(needles, "needle_id").checkpoint()
    held = chosen.select("gram").distinct()
    listed = [r["gram"] for r in held.limit(LISTED_GRAMS + 1).collect()]
    if 0 < len(listed) <= LISTED_GRAMS:  # the texts need not be taken apart again
        table = F.array(*[F.lit(g) for g in sorted(listed)])
        grams = texts.select(*brought, F.explode(F.filter(table, lambda g: F.exists("parts", lambda p: F.contains(p, g)))).alias("gram"))
    if chosen.count() <= BROADCAST_GRAMS // 4:
        return grams.join(F.broadcast(chosen), "gram").select(*brought, *needles.columns)
    return grams.join(small(held), "gram", "left_semi").join(chosen, "gram").select(*brought, *needles.columns)
