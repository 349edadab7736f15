"""Column helpers: blanks, ordered lists, dates and texts of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: str | Column) -> Column:
    """Missing is null or empty; '0' is a value."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (c == "")


def first_filled(*cs: str | Column) -> Column:
    """The first value that isn't blank, else ''."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cs], F.lit(""))


def text_of(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def ordered_distinct(pairs: Column) -> Column:
    """Values of array<struct<ord, v>> in order, blanks out, first standing of each."""
    values = F.transform(F.array_sort(pairs), lambda p: p["v"])
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def has_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def iso_date(c: str | Column) -> Column:
    """Y[-/.]M[-/.]D zero-padded; anything else with its separators replaced."""
    c = F.col(c) if isinstance(c, str) else c
    p = F.split(c, "[-/.]", -1)
    return F.when(F.size(p) == 3, F.concat_ws("-", p[0], F.lpad(p[1].cast("int").cast("string"), 2, "0"), F.lpad(p[2].cast("int").cast("string"), 2, "0"))).otherwise(F.translate(c, "/.", "--"))


def labelled_date(text: str | Column, labels: list[str]) -> Column:
    """The date after the first of the labels, in their order, that has one; '' without."""
    found = [F.regexp_extract(text, label + r"\s*[:：]?\s*(20\d{2}[-/.]\d{1,2}[-/.]\d{1,2})", 1) for label in labels]
    return F.coalesce(*[F.when(f != "", iso_date(f)) for f in found], F.lit(""))


def last_date(text: str | Column) -> Column:
    all_ = F.regexp_extract_all(text, F.lit(r"20\d{2}[-/.]\d{1,2}[-/.]\d{1,2}"), F.lit(0))
    return F.when(F.size(all_) == 0, "").otherwise(iso_date(F.element_at(all_, -1)))


def estimate_tokens(text: str | Column) -> Column:
    """Words over 0.75, floored; words end at ASCII white space."""
    return F.floor(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")) / F.lit(0.75))


def safe_filename(c: str | Column) -> Column:
    plain = F.regexp_replace(c, r'[\\/:*?"<>|]+', "_")
    return F.ltrim(F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), r"_+", "_"), F.lit("."))


def half_width(c: str | Column) -> Column:
    """Full-width forms U+FF01..U+FF5E and the ideographic space to ASCII."""
    return F.translate(c, "".join(chr(0xFF01 + i) for i in range(94)) + "　", "".join(chr(0x21 + i) for i in range(94)) + " ")


def markdown_escape(c: Column) -> Column:
    for ch in "*`~$":
        c = F.replace(c, F.lit(ch), F.lit("\\" + ch))
    return c


def iou(a: str, b: str, eps: float = 0.0) -> Column:
    """Intersection over union of boxes a and b (columns a_x1.. and b_x1..), as doubles."""
    w = F.greatest(F.lit(0.0), F.least(F.col(f"{a}x2"), F.col(f"{b}x2")) - F.greatest(F.col(f"{a}x1"), F.col(f"{b}x1")))
    h = F.greatest(F.lit(0.0), F.least(F.col(f"{a}y2"), F.col(f"{b}y2")) - F.greatest(F.col(f"{a}y1"), F.col(f"{b}y1")))
    return w * h / (area(a) + area(b) - w * h + F.lit(eps))


def overlap(a: str, b: str) -> Column:
    w = F.greatest(F.lit(0.0), F.least(F.col(f"{a}x2"), F.col(f"{b}x2")) - F.greatest(F.col(f"{a}x1"), F.col(f"{b}x1")))
    h = F.greatest(F.lit(0.0), F.least(F.col(f"{a}y2"), F.col(f"{b}y2")) - F.greatest(F.col(f"{a}y1"), F.col(f"{b}y1")))
    return w * h


def area(a: str) -> Column:
    return (F.col(f"{a}x2") - F.col(f"{a}x1")) * (F.col(f"{a}y2") - F.col(f"{a}y1"))


def corner_distance(a: str, b: str) -> Column:
    return sum((F.abs(F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in ("y1", "x2", "y2")), F.abs(F.col(f"{a}x1") - F.col(f"{b}x1")))


def let(value: Column, f) -> Column:
    """f(value) with value worked out once a row, however often f names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def sums_before(values: Column, size: int = 16) -> Column:
    """For each element of an array of whole numbers the sum of those before it. Sums run inside pieces of `size` and over the pieces, as a fold copies what it has gathered at each step."""

    def running(a: Column) -> Column:
        start = F.array(F.lit(0).cast("long"))
        sums = F.aggregate(a, start, lambda s, v: F.concat(s, F.array(F.element_at(s, -1) + v)))
        return F.slice(sums, 1, F.size(a))

    def parted(a: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int")), lambda i: F.slice(a, i * size + 1, F.lit(size)))
        base = lambda ps: running(F.transform(ps, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda t, v: t + v)))
        return let(pieces, lambda ps: F.flatten(F.zip_with(ps, base(ps), lambda p, b: F.transform(running(p), lambda v: v + b))))

    return let(values, lambda a: F.when(F.size(a) <= size, running(a)).otherwise(parted(a)))


def edits(a: str, b: str, short: int = 64) -> Column:
    """Edit distance of two text columns, the same as levenshtein, which takes the product of the lengths.

    Where one text holds the other it is the difference of lengths. Else it is at most the places that differ with both laid over each other, and at least what one text has of
    its characters more than the other has; where these meet, nothing is left to find, and where they don't only the band up to the former is searched. Texts of up to `short` characters go straight through.
    """
    x, y = F.col(a), F.col(b)
    longer = F.length(x) - F.length(y)
    most = F.size(F.filter(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: ~p.eqNullSafe(q)), lambda d: d))
    kinds = F.array_distinct(F.split(x, ""))

    def surplus(ks: Column) -> Column:
        count = lambda t, k: F.length(t) - F.length(F.replace(t, k, F.lit("")))
        return F.aggregate(ks, F.lit(0), lambda n, k: n + F.greatest(F.lit(0), count(x, k) - count(y, k)))

    # counting goes over the text for each kind of character, so it is left out where most differ
    least = let(kinds, lambda ks: F.when(4 * F.size(ks) <= F.length(x), let(surplus(ks), lambda n: F.greatest(n, n - longer))).otherwise(F.lit(0)))
    searched = let(most, lambda m: F.when(least == m, m).otherwise(F.call_function("levenshtein", x, y, m)))
    inside = F.contains(x, y) | F.contains(y, x)
    return F.when(x == y, 0).when(F.greatest(F.length(x), F.length(y)) <= short, F.levenshtein(x, y)).when(inside, F.abs(longer)).otherwise(searched)
