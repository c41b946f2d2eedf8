"""Which block of the paper shows a spot that two readings dispute, and which line of it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strings_column, text_column, witness_key

# The shortest text that is looked for, and what a line's box has above and below it.
LEAST, PAD = 3, 2.0
#: Edge of a page.
PAGE = 1000.0


def _line_keys(text: str | None) -> list[str]:
    return [witness_key(line) for line in (text or "").split("\n") if line.strip()]


def _rounded(x: Column) -> Column:
    return F.round(x, 1)


def spot_boxes(spots: DataFrame, blocks: DataFrame, card: list[str], spot: list[str]) -> DataFrame:
    """``spot`` columns, page, x0, y0, x1, y1: the box that shows the witness's side of a spot.

    ``spots(*card, *spot, before, witness, after)`` and ``blocks(*card, seq,
    page, x0, y0, x1, y1, text)`` meet card by card. The text looked for is the
    witness's with both surroundings, else with those before, else with those
    after it, of three characters or more; of several blocks the first by seq
    counts. Where a block keeps its lines and one alone has the text, the box
    is that line's. Null texts and boxes show nothing; spots that no block
    shows give no row; repeated spots and blocks give one.
    """
    b = blocks.where("text is not null and x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    keyed = b.select(*card, "seq", "page", "x0", "y0", "x1", "y1", text_column(witness_key, F.col("text")).alias("key"), strings_column(_line_keys, F.col("text")).alias("lines"))
    part = lambda name: F.coalesce(name, F.lit(""))
    before, seen, after = part("before"), part("witness"), part("after")
    needles = F.array(*[F.struct(F.lit(rank).alias("rank"), F.concat(*parts).alias("needle")) for rank, parts in enumerate(((before, seen, after), (before, seen), (seen, after)))])
    asked = spots.select(*card, *spot, F.explode(needles).alias("n")).select(*card, *spot, "n.*").where(F.length("needle") >= LEAST)
    hit = asked.join(keyed, card).where(F.contains("key", "needle"))
    best = hit.groupBy(*card, *spot).agg(F.min(F.struct("rank", "seq", "page", "x0", "y0", "x1", "y1", "needle", "lines")).alias("m")).select(*card, *spot, "m.*")
    n = F.size("lines")
    where = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.coalesce(F.contains(F.get(F.col("lines"), i - 1), F.col("needle")), F.lit(False)))
    one = (n > 1) & (F.size(where) == 1)
    step, line = (F.col("y1") - F.col("y0")) / n, F.get(where, F.lit(0))
    top = F.when(one, F.col("y0") + step * (line - 1) - PAD).otherwise(F.col("y0"))
    bottom = F.when(one, F.col("y0") + step * line + PAD).otherwise(F.col("y1"))
    return best.select(*card, *spot, "page", _rounded(F.col("x0")).alias("x0"), _rounded(F.greatest(F.lit(0.0), top)).alias("y0"), _rounded(F.col("x1")).alias("x1"), _rounded(F.least(F.lit(PAGE), bottom)).alias("y1"))
