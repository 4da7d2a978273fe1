"""Detection: candidates of a pattern catalog, sanitised, validated, scored by context, and freed of overlaps.

All of it is one projection over arrays: no shuffle, no Python, and texts are read where they lie. Null text counts as
empty and has no matches; in matches, the noncharacter U+10FFFF counts as U+10FFFE. Offsets are UTF-8 bytes (start, end) and code points (char_start, char_end), ends exclusive.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sanitize, validators
from ..functions.catalog import GROUPS, PATTERNS, Pattern
from ..functions.text import ascii_lower, let, settled, sums_before

MATCH = "struct<start:int,end:int,char_start:int,char_end:int,text:string,category:string,confidence:float,detector_id:string,source:string>"
_CANDIDATE = "array<struct<pattern:int,chars:int,bytes:int,raw:string>>"
#: Bytes on either side of a match in which keywords count.
MARGIN = 40
BOOST, CAP, AGGRESSIVE_BOOST, AGGRESSIVE_DROP = 0.2, 0.99, 0.08, 0.12
DEFAULT_FLOOR = 0.35


@dataclass(frozen=True)
class DetectOptions:
    min_confidence: float = DEFAULT_FLOOR
    #: Categories or groups; None for all.
    categories: tuple[str, ...] | None = None
    aggressive: bool = False
    #: For date horizons; None for the clock's.
    as_of_year: int | None = None
    patterns: tuple[Pattern, ...] = field(default=PATTERNS, repr=False)

    def __post_init__(self):
        unknown = set(self.categories or ()) - GROUPS.keys()
        if unknown:
            raise ValueError(f"no such categories: {sorted(unknown)}")

    @property
    def floor(self) -> float:
        """The least confidence kept, in single precision."""
        least = self.min_confidence if math.isfinite(self.min_confidence) else DEFAULT_FLOOR
        if self.aggressive:
            least = min(max(np.float32(least) - np.float32(AGGRESSIVE_DROP), np.float32(0.15)), np.float32(1.0))
        return float(np.float32(least))

    def wanted(self) -> list[Pattern]:
        return [p for p in self.patterns if self.categories is None or {p.category, GROUPS[p.category]} & set(self.categories)]


def _single(x: float) -> Column:
    return F.lit(float(np.float32(x))).cast("float")


#: A noncharacter put on both sides of each match, and the one that stands for it where a text holds it.
MARK, STAND_IN = "\U0010ffff", "\U0010fffe"


def _whole(text: str) -> Column:
    t = F.coalesce(F.col(text), F.lit(""))
    return F.when(t.contains(MARK), F.translate(t, MARK, STAND_IN)).otherwise(t)


def _marked(whole: Column, pattern: str) -> Column:
    """The text with a mark on both sides of each match: one search finds all matches and their places."""
    return F.regexp_replace(whole, pattern, f"{MARK}$0{MARK}")


def _placed(found: Column) -> Column:
    """The candidates of struct(pattern, marked): pieces alternate between gaps and matches, and lengths before them are their places."""

    def of(pieces: Column) -> Column:
        places = F.struct(sums_before(F.transform(pieces, F.length)).alias("chars"), sums_before(F.transform(pieces, F.octet_length)).alias("bytes"))
        odd = F.transform(F.sequence(F.lit(1), F.floor((F.size(pieces) - 1) / 2).cast("int")), lambda i: 2 * i - 1)
        return let(
            places,
            lambda at: F.transform(
                odd,
                lambda i: F.struct(found["pattern"].alias("pattern"), F.get(at["chars"], i).alias("chars"), F.get(at["bytes"], i).alias("bytes"), F.get(pieces, i).alias("raw")),
            ),
        )

    return let(F.split(found["marked"], MARK, -1), of)


def candidates(text: str, pattern: str) -> Column:
    """array of struct(pattern, chars, bytes, raw): the matches of a pattern in the named column; null text has none."""
    found = F.struct(F.lit(0).alias("pattern"), _marked(_whole(text), pattern).alias("marked"))
    return let(found, lambda f: F.when(f["marked"].contains(MARK), _placed(f)).otherwise(F.array().cast(_CANDIDATE))).cast(_CANDIDATE)


def context(text: Column, chars: Column, raw: Column) -> Column:
    """The words within MARGIN bytes of a match and in it, in lower case, each between single spaces.

    Only ASCII letters and digits make words, so bytes of other characters, even cut ones, stand for gaps.
    """
    before = F.substr(text, F.greatest(chars - MARGIN + 1, F.lit(1)), F.least(chars, F.lit(MARGIN)))
    after = F.substr(text, chars + F.length(raw) + 1, F.lit(MARGIN))
    raw_bytes = lambda c: F.encode(c, "UTF-8")
    window = F.concat(F.substring(raw_bytes(before), -MARGIN, MARGIN), raw_bytes(raw), F.substring(raw_bytes(after), 1, MARGIN))
    return F.concat(F.lit(" "), F.regexp_replace(ascii_lower(F.decode(window, "ISO-8859-1")), "[^a-z0-9]+", " "), F.lit(" "))


def _keyword_pattern(keywords: tuple[str, ...]) -> str:
    spaced = [" ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in k.lower()).split()) for k in keywords]
    return f" (?:{'|'.join(spaced)}) "


def _gates(whole: str, patterns: list[Pattern]) -> Column:
    """Whether a text has what patterns need: each need is looked for once, whichever patterns share it."""
    return F.array(*(F.col(whole).rlike(n) for n in dict.fromkeys(p.needs for p in patterns if p.needs)))


def _all_candidates(whole: str, gates: str, patterns: list[Pattern]) -> Column:
    """Candidates of all patterns; texts without what a pattern needs are not searched for it."""
    needs = list(dict.fromkeys(p.needs for p in patterns if p.needs))
    found = []
    for i, p in enumerate(patterns):
        here = _marked(F.col(whole), ("(?iU)" if p.case_blind else "(?U)") + (p.search or p.regex))
        if p.needs:
            here = F.when(F.get(F.col(gates), F.lit(needs.index(p.needs))), here)
        found.append(F.struct(F.lit(i).alias("pattern"), here.alias("marked")))
    hits = F.filter(F.array(*found), lambda f: F.coalesce(f["marked"].contains(MARK), F.lit(False)))
    return F.flatten(F.transform(hits, _placed)).cast(_CANDIDATE)


def _choose(c: Column, patterns: list[Pattern], name: str, makers: dict, otherwise: Column) -> Column:
    """By the candidate's pattern, what the function that its field `name` names makes: each function once, for all its patterns."""
    out = None
    for k in dict.fromkeys(getattr(p, name) for p in patterns if getattr(p, name)):
        mine = c.pattern.isin(*(i for i, p in enumerate(patterns) if getattr(p, name) == k))
        out = (F.when if out is None else out.when)(mine, makers[k](c))
    return otherwise if out is None else out.otherwise(otherwise)


def _cleaned(patterns: list[Pattern]):
    def one(k):
        def make(c: Column) -> Column:
            text, front = sanitize.BY_NAME[k](c.raw)
            return F.struct(text.alias("text"), (F.lit(None).cast("int") if front is None else front).alias("front"))

        return make

    def clean(c: Column) -> Column:
        as_is = F.struct(c.raw.alias("text"), F.lit(0).alias("front"))
        made = _choose(c, patterns, "clean", {k: one(k) for k in sanitize.BY_NAME}, as_is)
        return F.struct(c.pattern.alias("pattern"), c.chars.alias("chars"), c.bytes.alias("bytes"), c.raw.alias("raw"), made.alias("made"))

    return clean


def _scored(text: Column, patterns: list[Pattern], opts: DetectOptions):
    def of(c: Column, values: list) -> Column:
        return F.get(F.array(*map(F.lit, values)), c.pattern)

    def alone(p: Pattern) -> float:
        base = np.float32(p.base)
        return float(min(base + np.float32(AGGRESSIVE_BOOST), np.float32(CAP)) if opts.aggressive and base < np.float32(0.5) else base)

    boosted = [float(min(np.float32(p.base) + np.float32(BOOST), np.float32(CAP))) for p in patterns]

    def score(c: Column) -> Column:
        def placed(front: Column) -> Column:
            # where the text isn't in the match as it stands, the whole match is covered
            skipped, kept = F.coalesce(front, F.lit(0)), F.when(front.isNotNull(), F.length(c.made.text)).otherwise(F.length(c.raw))
            return F.struct(skipped.alias("skipped"), kept.alias("kept"), (c.bytes + F.octet_length(F.substr(c.raw, F.lit(1), skipped))).alias("start"))

        near = F.rlike(context(text, c.chars, c.raw), of(c, [_keyword_pattern(p.keywords) for p in patterns]))
        found = let(F.instr(c.raw, c.made.text), lambda place: F.when((place > 0) & (c.made.text != ""), place - 1))
        return let(
            let(F.coalesce(c.made.front, found), placed),
            lambda at: F.struct(
                at.start.alias("start"),
                (at.start + F.octet_length(F.substr(c.raw, at.skipped + 1, at.kept))).alias("end"),
                (c.chars + at.skipped).alias("char_start"),
                (c.chars + at.skipped + at.kept).alias("char_end"),
                c.made.text.alias("text"),
                of(c, [p.category for p in patterns]).alias("category"),
                F.when(near, of(c, boosted)).otherwise(of(c, [alone(p) for p in patterns])).cast("float").alias("confidence"),
                of(c, [f"regex:{p.id}" for p in patterns]).alias("detector_id"),
                F.lit("regex").alias("source"),
            ),
        )

    return score


def _group(category: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in GROUPS.items() for x in pair)), category)


def _family(a: Column, b: Column) -> Column:
    """Same category or group; "other" is no family."""
    return ~((a == "other") & (b == "other")) & ((a == b) | (_group(a) == _group(b)))


def _specific(category: Column) -> Column:
    return F.when(category == "date-of-birth", 2).when(category == "date", 1).otherwise(0)


def resolve(matches: Column) -> Column:
    """Of overlapping matches of one family the most confident stays, then the longest, then the first.

    On one span the more specific category stays whatever its confidence, and of a social security and a routing number one stays.
    """
    ranked = F.transform(matches, lambda m, i: F.struct((-m.confidence).alias("a"), (m.start - m.end).alias("b"), m.start.alias("c"), i.alias("d"), m.alias("m")))
    ranked = F.transform(F.array_sort(ranked), lambda r: r.m)

    def same_span(m: Column, k: Column) -> Column:
        pair = F.array_sort(F.array(m.category, k.category)) == F.array(F.lit("routing-number"), F.lit("ssn"))
        return (m.start == k.start) & (m.end == k.end) & (pair | _family(m.category, k.category))

    def add(kept: Column, m: Column) -> Column:
        better = lambda k: F.when(same_span(m, k) & _family(m.category, k.category) & (_specific(m.category) > _specific(k.category)), m).otherwise(k)
        overlaps = F.exists(kept, lambda k: (m.start < k.end) & (k.start < m.end) & _family(m.category, k.category))
        return F.when(F.exists(kept, lambda k: same_span(m, k)), F.transform(kept, better)).when(overlaps, kept).otherwise(F.concat(kept, F.array(m)))

    kept = F.aggregate(ranked, F.array().cast(f"array<{MATCH}>"), add)
    return F.array_sort(kept)


def with_matches(pages: DataFrame, opts: DetectOptions | None = None, text: str = "text", name: str = "matches") -> DataFrame:
    """pages with an array of MATCH, resolved and sorted by start; other columns are kept.

    Each step is a projection of its own over the small array of the step before.
    """
    return settled(_with_matches(pages, opts, text, name), name)


def _with_matches(pages: DataFrame, opts: DetectOptions | None, text: str, name: str) -> DataFrame:
    step, whole, gates = f"{name}_step_", f"{name}_whole_", f"{name}_gates_"
    opts = opts or DetectOptions()
    out = pages.withColumn(whole, _whole(text)).withColumn(gates, _gates(whole, opts.wanted()))
    for column in _steps(opts, whole, gates, step, id(pages.sparkSession.sparkContext)):
        out = out.withColumn(step, column)
    return out.withColumn(name, F.col(step)).drop(step, whole, gates)


@functools.lru_cache(maxsize=64)
def _steps(opts: DetectOptions, text: str, gates: str, step: str, context: int) -> tuple[Column, ...]:
    """The steps' columns. They are many expressions, so they are built once in a Spark context for the same options."""
    patterns, valid = opts.wanted(), validators.by_name(opts.as_of_year)
    if not patterns:
        return (F.array().cast(f"array<{MATCH}>"),)
    makers = {k: (lambda c, v=v: v(c.made.text)) for k, v in valid.items()}
    ok = lambda c: c.made.text.isNotNull() & _choose(c, patterns, "valid", makers, F.lit(True))
    scored = F.transform(step, _scored(F.col(text), patterns, opts))
    return (
        _all_candidates(text, gates, patterns),
        F.transform(step, _cleaned(patterns)),
        F.filter(step, ok),
        F.filter(scored, lambda m: m.confidence >= _single(opts.floor)).cast(f"array<{MATCH}>"),
        F.when(F.size(step) > 1, resolve(F.col(step))).otherwise(F.col(step)),
    )


def detect(pages: DataFrame, opts: DetectOptions | None = None, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """A row for each match: keys, then the fields of MATCH."""
    found = _with_matches(pages.select(*keys, F.col(text).alias("text_")), opts, "text_", "matches_")
    # explode() lets Spark infer a filter on the array's size, and put the whole expression below the projections once more
    return found.select(*keys, F.explode_outer("matches_").alias("m_")).where(F.col("m_").isNotNull()).select(*keys, "m_.*")
