"""Secret scans in DataFrame functions only.

Three base kinds are found by pattern. The method adds a fourth: candidate strings in which some sliding window has
a high Shannon entropy for its character class. The entropy is kept by counts: a character that enters or leaves
the window changes only its own term. Candidates on an allow-list are suppressed.

Positions come from one trick: the pieces between matches (split) and the matches (extract) alternate, so the
running sum of their lengths gives every start, in code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base kinds.
ASSIGN = r"(?:(?i)(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}+"
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "entropy")
#: A candidate is a whole run of this class, of WINDOW characters at least, with a digit and a letter in it.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Bits per character that some window must reach, for hexadecimal candidates and for all others.
HEX_BITS, OTHER_BITS = 3.0, 3.75
#: Candidates that are no secrets: UUIDs, dates, alphabets, placeholders, words joined by signs.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"|0123456789|(?i)abcdefghij|(?i)example|(?i)placeholder|(?i)x{8}|^[A-Za-z/_=+-]*+[0-9]{0,4}$"
)
#: Candidates are looked at in stretches of this many windows.
STRETCH = 256
_BLOCK = 128


def _bound(value: Column, body) -> Column:
    """`body(value)` with the value worked out once: inside a lambda, an outer expression is worked out per element."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column) -> Column:
    """The sum of all values before each, in blocks, so that a long array isn't copied once per element."""
    grow = lambda a, x: F.array_append(a, F.element_at(a, -1) + x)

    def of(blocks: Column) -> Column:
        before = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)), F.array(F.lit(0)), grow)
        inner = F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, s: F.slice(F.aggregate(b, F.array(s), grow), 1, F.size(b)))
        return F.flatten(inner)

    return _bound(values, lambda v: _bound(F.transform(_steps(v), lambda k: F.slice(v, k * _BLOCK + 1, _BLOCK)), of))


def _steps(values: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))


_SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"


def _spans(text: Column, pattern: str, kind: int, maybe: Column, group: int = 0) -> Column:
    """Spans (start, kind, end, text of the group) of all matches; `maybe` says cheaply if there can be any."""
    of = F.lit(pattern)
    found, gaps = F.regexp_extract_all(text, of, F.lit(0)), F.split(text, pattern, -1)

    def located(p: Column) -> Column:
        """From gaps (one more than matches, the last is not needed), matches and groups."""
        gap = F.transform(F.slice(p["gaps"], 1, F.size(p["found"])), lambda g: F.length(g))
        before = _running(F.zip_with(gap, p["found"], lambda g, m: g + F.length(m)))
        start = F.zip_with(before, gap, lambda b, g: b + g)
        ends = F.zip_with(start, p["found"], lambda a, m: F.struct(a.alias("start"), (a + F.length(m)).alias("end")))
        held = p["held"] if group else p["found"]
        return F.zip_with(ends, held, lambda e, h: F.struct(e["start"].alias("start"), F.lit(kind).alias("kind"), e["end"].alias("end"), h.alias("text")))

    parts = F.struct(found.alias("found"), gaps.alias("gaps"), *([F.regexp_extract_all(text, of, F.lit(group)).alias("held")] if group else []))
    spans = F.when(F.size(found) > 0, _bound(parts, located)).otherwise(F.array().cast(_SPAN))
    return F.when(maybe, spans).otherwise(F.array().cast(_SPAN))


def peak_bits(candidate: Column) -> Column:
    """The highest Shannon entropy, in bits per character, of any window of WINDOW characters; 0 if it is shorter."""
    term = F.array(*(F.lit(k * math.log2(k) if k else 0.0) for k in range(WINDOW + 1)))

    def step(s: Column, move: Column) -> Column:
        """The window moves on by one character: one count falls, one rises, and the sum of their terms follows."""
        gone = F.when(move["gone"] > 0, F.get(s["counts"], move["gone"] - 1)).otherwise(0)
        left = s["total"] - F.when(gone > 0, term[gone] - term[F.greatest(gone - 1, F.lit(0))]).otherwise(0.0)
        come = F.get(s["counts"], move["come"] - 1) - F.when(move["gone"] == move["come"], 1).otherwise(0)
        total = left + term[come + 1] - term[come]
        counts = F.transform(s["counts"], lambda n, k: n + F.when(k + 1 == move["come"], 1).otherwise(0) - F.when(k + 1 == move["gone"], 1).otherwise(0))
        full = s["seen"] + 1 >= WINDOW
        bits = F.when(full, F.lit(math.log2(WINDOW)) - total / WINDOW).otherwise(0.0)
        return F.struct(counts.alias("counts"), (s["seen"] + 1).alias("seen"), total.alias("total"), F.greatest(s["best"], bits).alias("best"))

    def through(stretch: Column) -> Column:
        return _bound(F.split(stretch, ""), lambda chars: _bound(F.struct(chars.alias("chars"), F.array_distinct(chars).alias("kinds")), folded))

    def folded(p: Column) -> Column:
        come = F.transform(p["chars"], lambda ch: F.array_position(p["kinds"], ch).cast("int"))
        moves = _bound(come, lambda c: F.zip_with(c, F.slice(F.concat(F.array_repeat(F.lit(0), WINDOW), c), F.lit(1), F.size(c)), lambda x, y: F.struct(x.alias("come"), y.alias("gone"))))
        none = F.transform(p["kinds"], lambda _: F.lit(0))
        start = F.struct(none.alias("counts"), F.lit(0).alias("seen"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
        return F.aggregate(moves, start, step, lambda s: s["best"])

    stretches = F.regexp_extract_all(candidate, F.lit(rf"(?=(.{{1,{STRETCH + WINDOW - 1}}})).{{1,{STRETCH}}}"), F.lit(1))
    return F.array_max(F.transform(stretches, through))


def _entropy_spans(spans: Column) -> Column:
    """The candidates whose peak entropy is that of random characters of their class."""
    bits = lambda x: F.when(x["text"].rlike("^[0-9a-fA-F]+$"), F.lit(HEX_BITS)).otherwise(F.lit(OTHER_BITS))
    return F.filter(F.filter(spans, lambda x: ~x["text"].rlike(ALLOW)), lambda x: peak_bits(x["text"]) >= bits(x))


def scan(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """`docs` with the spans of its secrets: an array of (start, kind, end), in order of start, then kind.

    Positions count code points from 0, the end excluded; `kind` is an index into KINDS. Base kinds are found from
    left to right without overlap within a kind, in the whole text however long; an entropy span is left
    out only where it lies within a base one. A null or
    empty text has no spans (an empty array). Repeated rows are scanned each; a column named `spans_col` is replaced.
    """
    keep = [c for c in docs.columns if c != spans_col]
    t = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(
        F.struct(*keep).alias("row"),
        F.filter(_spans(t, ASSIGN, 0, t.rlike("[:=]"), 2), lambda x: F.length(x["text"]) >= ASSIGN_LEAST).alias("assign"),
        _spans(t, ACCESS, 1, F.contains(t, F.lit("AKIA"))).alias("access"),
        _spans(t, HEX, 2, t.rlike("[0-9][0-9a-f]{15}|[a-f][0-9a-f]{15}")).alias("hex"),
        _spans(t, CANDIDATE, 3, t.rlike("[0-9]")).alias("candidates"),
    )
    base = found.select("row", F.concat("assign", "access", "hex").alias("base"), _entropy_spans(F.col("candidates")).alias("more"))

    def joined(p: Column) -> Column:
        within = lambda x: F.exists(p["base"], lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))
        both = F.concat(p["base"], F.filter(p["more"], lambda x: ~within(x)))
        return F.array_sort(F.transform(both, lambda x: F.struct(x["start"], x["kind"], x["end"])))

    return base.select("row", _bound(F.struct("base", "more"), joined).alias("spans")).select("row.*", F.col("spans").alias(spans_col))


def spelled(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name[x["kind"]], x["start"], x["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span of its texts replaced by `mark`; spans that overlap or touch are replaced as one.

    A text without spans, a null one too, stays as it is. Other columns keep their names, whatever these are.
    """
    row = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("t"))
    scanned = scan(row, "t", "spans")
    t = F.col("t")
    runs = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (F.element_at(a, -1)["end"] >= x["start"]),
            F.array_append(
                F.slice(a, 1, F.size(a) - 1),
                F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end")),
            ),
        ).otherwise(F.array_append(a, F.struct(x["start"].alias("start"), x["end"].alias("end")))),
    )
    merged = scanned.withColumn("runs", F.when(F.size("spans") > 0, runs))
    before = F.slice(F.concat(F.array(F.lit(0)), F.transform("runs", lambda x: x["end"])), 1, F.size("runs"))
    parts = F.zip_with("runs", before, lambda x, b: F.concat(F.substring(t, b + 1, x["start"] - b), F.lit(mark)))
    rest = F.substring(t, F.element_at("runs", -1)["end"] + 1, F.length(t))
    out = F.when(F.size("spans") > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(t)
    return merged.select(*((out if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
