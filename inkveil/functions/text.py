"""Text columns: normal forms, similarity, and the quality of a text layer. Null text gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(df: DataFrame, *names: str) -> DataFrame:
    """df whose named columns are computed where they stand.

    Spark moves conditions on a column below its projection, where its expression is repeated for each mention, and again
    for each mention inside it. It doesn't move them below a generator, so the columns go through one of a single row.
    """
    others = [c for c in df.columns if c not in names]
    bound = F.explode_outer(F.array(F.struct(*names))).alias("settled_")
    return df.select(*others, bound).select(*(F.col(f"settled_.{c}").alias(c) if c in names else c for c in df.columns))


#: Values that a scan folds in one go; longer arrays are folded block by block.
BLOCK = 128


def scan(values: Column, zero: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """For each value of an array, the fold of those before it. fold is associative.

    An array that grows by one in each step is copied in each step, so that is done for blocks only: the time is linear.
    """

    def run(block: Column) -> Column:
        start = F.struct(zero.alias("all"), F.filter(F.array(zero), lambda _: F.lit(False)).alias("out"))
        return F.aggregate(block, start, lambda a, x: F.struct(fold(a["all"], x).alias("all"), F.concat(a["out"], F.array(a["all"])).alias("out")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: run(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))

    def joined(parts: Column) -> Column:
        before = run(F.transform(parts, lambda x: x["all"]))["out"]
        return F.flatten(F.zip_with(parts, before, lambda x, b: F.transform(x["out"], lambda v: fold(b, v))))

    return F.when(F.size(values) > 0, let(blocks, joined)).otherwise(F.filter(F.array(zero), lambda _: F.lit(False)))


def sums_before(values: Column) -> Column:
    """For each integer of an array, the sum of those before it."""
    return scan(values, F.lit(0), lambda a, b: a + b)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def trimmed(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_text(c: Column) -> Column:
    """White space runs to one space, trimmed, ASCII letters in lower case."""
    return ascii_lower(trimmed(F.regexp_replace(c, r"(?U)\s+", " ")))


def compact_text(c: Column) -> Column:
    return ascii_lower(F.regexp_replace(c, r"(?U)\s+", ""))


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def loose_text(c: Column) -> Column:
    """Letters and digits of any script, in lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}]", ""))


def loose_ascii(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def similar(a: Column, b: Column) -> Column:
    """Whether the loose forms are equal or one holds the other; an empty form is like nothing."""
    x, y = loose_text(a), loose_text(b)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


# Scripts written without spaces, as code point ranges.
_SPACELESS = (
    r"[\x{1100}-\x{11FF}\x{2E80}-\x{2EFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}"
    r"\x{0E00}-\x{0E7F}\x{0E80}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{F900}-\x{FAFF}\x{0F00}-\x{0FFF}\x{20000}-\x{2FA1F}]"
)


def _count(c: Column, chars: str) -> Column:
    """How many characters of a class a text has: it is shorter by that many without them."""
    return (F.length(c) - F.length(F.regexp_replace(c, f"{chars}+", ""))).cast("double")


def _ramp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def _words_like(c: Column) -> Column:
    """How many of the text's words have two letters or more, and more letters than other characters; 3 stands for 3 or more.

    Three words of letters alone settle it for most texts after a few characters.
    """
    three = r"(?U)(?:(?<!\S)\p{IsAlphabetic}{2,}(?!\S)[\s\S]*?){3}"
    mostly = F.filter(F.split(c, r"(?U)\s+", -1), lambda w: let(_count(w, r"\p{IsAlphabetic}"), lambda k: (k >= 2) & (2 * k > F.length(w))))
    return F.when(c.rlike(three), 3.0).otherwise(F.least(F.size(mostly), F.lit(3)).cast("double"))


def _longest_run(c: Column) -> Column:
    """Length of the longest piece between white space, where it is over 80 characters; else 80."""
    return F.when(c.rlike(r"(?U)\S{81}"), F.array_max(F.transform(F.split(c, r"(?U)\s+", -1), F.length))).otherwise(80).cast("double")


def layer_quality(c: Column) -> Column:
    """struct(score, reasons): 1 less what each finding costs, 0 at least. Empty text scores 0, for the reason "empty".

    The text is gone through once for each count; costs and reasons come from the counts.
    """
    n = F.length(c).cast("double")
    safe = F.greatest(n, F.lit(1.0))
    counts = F.struct(
        n.alias("n"),
        (_count(c, r"\p{IsAlphabetic}") / safe).alias("letters"),
        (_count(c, "[0-9]") / safe).alias("digits"),
        (_count(c, r"(?U)\s") / safe).alias("spaces"),
        (_count(c, r"[\x{0080}-\x{024F}\x{0300}-\x{036F}]") / safe).alias("broken"),
        (_count(c, r"[\p{Cc}\x{FFFD}&&[^\n\r\t]]") / safe).alias("bad"),
        (_count(c, _SPACELESS) > F.floor(n / 2)).alias("spaceless"),
        _words_like(c).alias("words"),
        _longest_run(c).alias("run"),
    )
    empty = F.struct(F.lit(0.0).alias("score"), F.array(F.lit("empty")).alias("reasons"))
    return F.when(c.isNotNull(), F.when(n == 0, empty).otherwise(let(counts, _rated)))


def _rated(k: Column) -> Column:
    """Each cost is a column of its own size: null where the finding doesn't hold, so that costs and reasons come from one list."""
    n, letters, solid, spaceless = k["n"], k["letters"], k["letters"] + k["digits"], k["spaceless"]
    glued = ~spaceless & (k["spaces"] < 0.02) & (n > 40)
    costs = [
        ("tiny", F.when(n < 12, 0.65 - 0.2 * n / 12)),
        ("very-short", F.when((n >= 12) & (n < 24), 0.45 - 0.25 * (n - 12) / 12)),
        ("short", F.when((n >= 24) & (n < 80), 0.2 * (1 - (n - 24) / 56))),
        ("few-letters", F.when(letters < 0.15, 0.4 - 0.25 * letters / 0.15)),
        ("low-letter-ratio", F.when((letters >= 0.15) & (letters < 0.35), 0.15 * (1 - (letters - 0.15) / 0.2))),
        ("low-alnum", F.when((letters >= 0.35) & (solid < 0.4), 0.2 * (1 - solid / 0.4))),
        ("mojibake", F.when(k["broken"] > 0.2, 0.35 * F.least((k["broken"] - 0.2) / 0.3, F.lit(1.0)))),
        ("control-or-replacement-chars", F.when(k["bad"] > 0, 0.3 * k["bad"])),
        ("no-word-breaks", F.when(glued, 0.25 * _ramp(n, 40, 80) * (1 - k["spaces"] / 0.02))),
        ("few-word-tokens", F.when(~spaceless & ~glued & (k["words"] < 3) & (n > 60), 0.25 * _ramp(n, 60, 120) * (1 - k["words"] / 3))),
        ("long-unbroken-run", F.when(~spaceless & (k["run"] > 80), 0.2 * _ramp(k["run"], 80, 160))),
    ]
    found = F.filter(F.array(*(F.struct(F.lit(r).alias("reason"), v.alias("cost")) for r, v in costs)), lambda x: x.cost.isNotNull())
    return let(
        found,
        lambda f: F.struct(
            F.least(F.greatest(F.aggregate(f, F.lit(1.0), lambda a, x: a - x.cost), F.lit(0.0)), F.lit(1.0)).alias("score"),
            F.transform(f, lambda x: x.reason).alias("reasons"),
        ),
    )


def is_poor(quality: Column, least: float) -> Column:
    return quality.score <= least


# --- when to read a page by optical character recognition ---

MODES = ("off", "auto", "on", "force")
SPARSE = 32


def needs_ocr(mode: str, text: Column, least: float = 0.45) -> Column:
    """off: never; on and force: always; auto: where the text has under SPARSE characters or poor quality."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    if mode != "auto":
        return F.lit(mode != "off")
    return (F.length(text) < SPARSE) | is_poor(layer_quality(text), least)


def solid_share(text: Column) -> Column:
    """Share of letters and digits of any script; 0 for empty text."""
    return F.coalesce(_count(text, r"[\p{IsAlphabetic}\p{N}]") / F.nullif(F.length(text).cast("double"), F.lit(0.0)), F.lit(0.0))


def retry_wins(first: Column, second: Column) -> Column:
    """Whether a second reading replaces a sparse first one: half as long again, and better, or as good but not without value."""
    a, b = solid_share(first), solid_share(second)
    n, m = F.length(first), F.length(second)
    return (b > 0) & ((b > a) | ((b == a) & (m > n))) & (m >= F.greatest(n + F.ceil(n / 2), F.lit(1)))
