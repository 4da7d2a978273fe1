"""Masking of text, and of pixels.

Text: matches are drawn over with a block for each code point, so that lengths stay. Null text stays null, and rows
without matches are unchanged. Pixels: rectangles are padded, scaled, clamped to the image, painted, and checked.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, scan, sums_before

BLOCK = "█"
#: A checked pixel is darker than this in each channel.
DARK = 40


def merged(spans: Column) -> Column:
    """array<struct<s, e>> of disjoint spans, from matches with char_start and char_end in any order; touching ones become one."""

    def heads(x: Column) -> Column:
        # the furthest end before each span; a span that begins behind it opens a new one
        return let(scan(F.transform(x, lambda v: v.e), F.lit(-1), lambda a, b: F.greatest(a, b)), lambda ends: of(x, ends))

    def of(x: Column, ends: Column) -> Column:
        opening = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i).s > F.get(ends, i))
        last = F.array_max(F.transform(x, lambda v: v.e))
        closing = lambda o: F.concat(F.slice(F.transform(o, lambda i: F.get(ends, i)), F.lit(2), F.size(o)), F.array(last))
        return let(opening, lambda o: F.zip_with(o, closing(o), lambda i, e: F.struct(F.get(x, i).s.alias("s"), e.alias("e"))))

    ordered = F.array_sort(F.transform(spans, lambda m: F.struct(m.char_start.alias("s"), m.char_end.alias("e"))))
    return F.when(F.size(spans) > 0, let(ordered, heads)).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


#: Characters of a block: a place in a text is found by its block, not from the text's start.
CHARS = 4096


def _cut(blocks: Column, a: Column, b: Column) -> Column:
    """The characters [a, b) of a text that is given in blocks."""
    first, last = F.floor(a / CHARS).cast("int"), F.floor(b / CHARS).cast("int")
    head = F.substr(F.get(blocks, first), a - first * CHARS + 1, F.when(first == last, b - a).otherwise(F.lit(CHARS)))
    middle = F.when(last > first + 1, F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")).otherwise("")
    tail = F.when(last > first, F.substr(F.get(blocks, last), F.lit(1), b - last * CHARS)).otherwise("")
    return F.concat(F.coalesce(head, F.lit("")), middle, F.coalesce(tail, F.lit("")))


def masked(text: Column, spans: Column, token: Column | None = None) -> Column:
    """text with each span replaced: by blocks of its length, or by token. The time is linear in text and spans."""

    def piece(blocks: Column, all_: Column):
        def of(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(all_, i - 1).e).otherwise(0)
            return F.concat(_cut(blocks, before, x.s), F.repeat(F.lit(BLOCK), x.e - x.s) if token is None else token)

        return of

    def drawn(t: Column, all_: Column) -> Column:
        blocks = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0))
        return let(blocks, lambda k: F.concat(F.array_join(F.transform(all_, piece(k, all_)), ""), _cut(k, F.element_at(all_, -1).e, F.length(t))))

    bound = F.struct(text.alias("t"), spans.alias("s"))
    return let(bound, lambda x: F.when(F.size(x["s"]) > 0, let(merged(x["s"]), lambda m: drawn(x["t"], m))).otherwise(x["t"]))


def with_masked(pages: DataFrame, text: str = "text", matches: str = "matches", name: str = "masked") -> DataFrame:
    return pages.withColumn(name, masked(F.col(text), F.col(matches)))


def occurrences(text: Column, needle: Column) -> Column:
    """All places of a needle, overlapping ones too, as struct(char_start, char_end); none for an empty needle or null.

    The text is split before each place, so that the lengths before the pieces are the places: the time is linear.
    """
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(needle, F.lit("\\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    span = lambda at: F.struct(at.alias("char_start"), (at + F.length(needle)).alias("char_end"))

    def places(pieces: Column) -> Column:
        starts = sums_before(F.transform(pieces, F.length))
        # the first piece may stand before the first place
        return F.transform(F.when(F.startswith(text, needle), starts).otherwise(F.slice(starts, F.lit(2), F.size(pieces))), span)

    found = let(F.split(text, quoted, -1), places)
    return F.when((needle != "") & text.contains(needle), found).otherwise(F.array().cast("array<struct<char_start:int,char_end:int>>"))


# --- rectangles, as columns: x, y, w, h in points from the top left ---


def valid_rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    finite = F.forall(F.array(x, y, w, h), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= 1e6))
    return F.coalesce(finite & (w > 0) & (h > 0), F.lit(False))


def padded_rect(x: Column, y: Column, w: Column, h: Column, pad: float = 1.5) -> tuple[Column, Column, Column, Column]:
    """pad on all sides, and more by height: descenders below, glued neighbours at the sides. Sizes are 0 at least."""
    tall, wide = F.least(F.greatest(0.25 * h, F.lit(1.0)), F.lit(4.0)), F.least(F.greatest(0.75 * h, F.lit(4.0)), F.lit(12.0))
    return x - pad - wide / 2, y - pad - tall, F.greatest(w + 2 * pad, F.lit(0.0)) + 1.5 * wide, F.greatest(h + 2 * pad, F.lit(0.0)) + tall


def pixel_range(start: Column, size: Column, scale: float, limit: Column) -> tuple[Column, Column]:
    """First and end pixel of an extent, both held to the image."""
    clamp = lambda c: F.least(F.greatest(c, F.lit(0)), limit)
    return clamp(F.floor(start * scale)), clamp(F.ceil((start + size) * scale))


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union of two rectangles of columns; 0 where the union is empty."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    across = F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0.0))
    down = F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0.0))
    both = across * down
    whole = aw * ah + bw * bh - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def same_line(y1: Column, h1: Column, y2: Column, h2: Column) -> Column:
    return F.abs(y1 - y2) < 0.6 * F.greatest(F.least(h1, h2), F.lit(4.0))


# --- pixels ---


def _box(rect: tuple[float, float, float, float], scale: float, shape: tuple[int, int]) -> tuple[int, int, int, int]:
    x, y, w, h = rect
    if not all(map(math.isfinite, rect)) or w <= 0 or h <= 0 or max(map(abs, rect)) > 1e6:
        raise ValueError(f"no valid rectangle: {rect}")
    hold = lambda v, most: min(max(v, 0), most)
    return hold(math.floor(x * scale), shape[1]), hold(math.floor(y * scale), shape[0]), hold(math.ceil((x + w) * scale), shape[1]), hold(math.ceil((y + h) * scale), shape[0])


def paint(image: np.ndarray, rects: list[tuple], scale: float) -> np.ndarray:
    """A copy of an (h, w, 4) image with the rectangles in opaque black."""
    out = image.copy()
    for r in rects:
        x0, y0, x1, y1 = _box(r, scale, image.shape)
        out[y0:y1, x0:x1] = (0, 0, 0, 255)
    return out


def is_black(image: np.ndarray, rect: tuple, scale: float) -> bool:
    """Whether the inside of a rectangle, two pixels from its edge or what remains, is dark. Off the image is an error."""
    x0, y0, x1, y1 = _box(rect, scale, image.shape)
    if x0 >= x1 or y0 >= y1:
        raise ValueError("the rectangle lies off the page")
    for inset in (2, 1, 0):
        inner = image[y0 + inset : y1 - inset, x0 + inset : x1 - inset, :3]
        if inner.size:
            return bool((inner < DARK).all())
    return False


def opaque_rgb(image: np.ndarray) -> np.ndarray:
    if (image[..., 3] != 255).any():
        raise ValueError("the page isn't opaque")
    return image[..., :3]


def grayscale(image: np.ndarray) -> np.ndarray:
    """Luma of an (h, w, 3 or 4) image, by the weights of ITU-R BT.601 in thousandths, rounded down."""
    return (image[..., :3].astype(np.int64) @ np.array([299, 587, 114]) // 1000).astype(np.uint8)


def stretch(gray: np.ndarray, low: int = 1, high: int = 99) -> np.ndarray:
    """Contrast stretched between the values that low and high percent of the pixels reach; flat images stay."""
    reached = np.bincount(gray.reshape(-1), minlength=256).cumsum()
    if not gray.size:
        return gray
    a, b = (int(np.argmax(reached >= gray.size * p // 100)) for p in (low, high))
    if b <= a:
        return gray
    return np.floor(np.clip((gray.astype(float) - a) / (b - a), 0, 1) * 255 + 0.5).astype(np.uint8)


def sharpen(gray: np.ndarray, amount: float = 0.5) -> np.ndarray:
    """Unsharp mask: against the mean of a pixel, counted four times, and its four neighbours. Edges stay."""
    out, g = gray.copy(), gray.astype(float)
    if min(gray.shape) >= 3:
        c = g[1:-1, 1:-1]
        mean = (g[1:-1, :-2] + g[1:-1, 2:] + g[:-2, 1:-1] + g[2:, 1:-1] + 4 * c) / 8
        out[1:-1, 1:-1] = np.clip(np.floor(c + amount * (c - mean) + 0.5), 0, 255).astype(np.uint8)
    return out
