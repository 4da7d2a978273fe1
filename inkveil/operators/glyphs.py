"""Glyph streams to the text and spans of pages, as windows over a page's order.

A glyph is a row: keys, seq (its order on the page), text, mode, transform (numbers that place it), x, y, w, h. Keys and seq
together are distinct. A page's glyphs meet in one task, as a page is bounded; pages are dealt over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import settled, sums_before
from .geometry import SPAN
from .mask import same_line

#: Coefficients of transforms that differ by less are equal.
EQUAL = 1e-9


def _near(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) < EQUAL), lambda ok: F.coalesce(ok, F.lit(False)))


def without_second_draws(glyphs: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_index")) -> DataFrame:
    """glyphs without those that only draw the one before them in another mode, such as the outline after the fill.

    Of a run of equal characters at one place those in the mode of the first stay.
    """
    page = Window.partitionBy(*keys).orderBy("seq")
    before = lambda c: F.lag(c).over(page)
    same = (F.col("text") == before("text")) & _near(F.col("transform"), before("transform"))
    runs = glyphs.withColumn("new_", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run_", F.sum("new_").over(page))
    first = F.first("mode").over(Window.partitionBy(*keys, "run_").orderBy("seq"))
    return runs.withColumn("first_", first).where(F.col("mode") == F.col("first_")).select(*glyphs.columns)


def with_advances(glyphs: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_index")) -> DataFrame:
    """glyphs with ink_w, the width as drawn, and w the way to the next glyph, where that follows on the line close by."""
    page = Window.partitionBy(*keys).orderBy("seq")
    after = lambda c: F.lead(c).over(page)
    way = after("x") - F.col("x")
    follows = same_line(F.col("y"), F.col("h"), after("y"), after("h")) & (way > 0.2) & (way < 3 * F.greatest(F.col("h"), F.lit(4.0)))
    return glyphs.withColumn("ink_w", F.col("w")).withColumn("w", F.when(F.coalesce(follows, F.lit(False)), way).otherwise(F.col("w")))


def collected(glyphs: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_index")) -> DataFrame:
    """keys, text, spans of pages: second draws and glyphs without extent are dropped, small ones get the least extent."""
    g = with_advances(without_second_draws(glyphs, keys), keys).where("w <> 0 and h <> 0")
    rect = F.struct(F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), F.greatest("w", F.lit(0.5)).cast("float").alias("w"), F.greatest("h", F.lit(1.0)).cast("float").alias("h"))
    listed = g.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", "text", rect.alias("rect"), F.col("ink_w").cast("float").alias("ink_w")))).alias("g_"))
    listed = settled(listed.withColumn("at_", sums_before(F.transform("g_", lambda x: F.octet_length(x.text)))), "at_")
    span = F.zip_with("g_", "at_", lambda x, at: F.struct(at.alias("start"), (at + F.octet_length(x.text)).alias("end"), x.text.alias("text"), x.rect.alias("rect"), x.ink_w.alias("ink_w")))
    return listed.select(*keys, F.array_join(F.transform("g_", lambda x: x.text), "").alias("text"), span.cast(f"array<{SPAN}>").alias("spans"))
