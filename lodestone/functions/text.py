"""Column functions on text: extraction, classification, tokenising and scoring. All stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(c: Column) -> Column:
    """White space runs as one blank, trimmed; null reads as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def truncated(c: Column, limit: int, marker: str = " [cut]") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(marker))).otherwise(c)


def pdf_date_iso(c: Column) -> Column:
    """``D:YYYYMMDDHHmmSS`` with absent parts read as 01, in ISO form; anything else, and impossible dates, unchanged."""
    p = r"^D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(c, p, i), F.lit("")), F.lit("01"))
    iso = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"), part(4), F.lit(":"), part(5), F.lit(":"), part(6))
    return F.when(c.rlike(p) & iso.try_cast("timestamp").isNotNull(), iso).otherwise(c)


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """First match of a pattern, null instead of empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def year_guess(c: Column) -> Column:
    return first_match(c, r"(?:19|20)\d{2}")


def doi_guess(c: Column) -> Column:
    return first_match(c, r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+")


def word_hits(c: Column, words: list[str]) -> Column:
    """How often the words occur, without regard to case; each word's occurrences count."""

    def hits(low: Column) -> Column:
        out = F.lit(0)
        for w in words:
            # most words do not occur, which a search tells sooner than a count
            out = out + F.when(low.contains(w), F.regexp_count(low, F.lit(re.escape(w)))).otherwise(0)
        return out

    return once(F.lower(c), hits)


def once(c: Column, f) -> Column:
    """``f(c)`` with ``c`` evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def rule_class(c: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Class of the first of many rules one of whose words is contained in the lower-cased text, else null."""
    table = F.array(*[F.struct(F.lit(n).alias("n"), F.array(*[F.lit(w) for w in ws]).alias("w")) for n, ws in rules])
    return once(F.lower(c), lambda low: F.get(F.filter(table, lambda r: F.exists(r["w"], lambda w: low.contains(w))), F.lit(0))["n"])


def matches(c: Column, pattern: str, groups: int) -> Column:
    """array<struct<start, g0, g1, ...>> of all matches of a pattern with their one-based starts."""
    found = F.arrays_zip(*[F.regexp_extract_all(c, F.lit(pattern), i).alias(f"g{i}") for i in range(groups + 1)])
    pieces = F.split(c, pattern, -1)
    lengths = F.transform(found, lambda x, i: F.struct(F.length(F.get(pieces, i)).alias("a"), F.length(x["g0"]).alias("b")))
    ends = F.aggregate(lengths, F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), lambda acc, x: F.concat(acc, F.array(F.struct((F.element_at(acc, -1)["end"] + x["a"]).alias("start"), (F.element_at(acc, -1)["end"] + x["a"] + x["b"]).alias("end")))))
    return F.transform(found, lambda x, i: F.struct((F.get(ends, i + 1)["start"] + 1).alias("start"), *[x[f"g{g}"].alias(f"g{g}") for g in range(groups + 1)]))


def contained(c: Column, words: list[str]) -> Column:
    """How many of the words are contained, each once."""
    out = F.lit(0)
    for w in words:
        out = out + F.coalesce(F.lower(c).contains(w).cast("int"), F.lit(0))
    return out


def first_class(c: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Class of the first rule one of whose words is contained."""
    out = F.lit(default)
    for name, words in reversed(rules):
        test = F.lit(False)
        for w in words:
            test = test | F.lower(c).contains(w)
        out = F.when(test, name).otherwise(out)
    return out


def flags(c: Column, classes: dict[str, list[str]]) -> Column:
    """Names of the classes any of whose words is contained, joined in the classes' order."""
    return F.concat_ws(",", *[F.when(contained(c, words) > 0, name) for name, words in classes.items()])


def safe_number(c: Column) -> Column:
    """Number in a free-form value: placeholders null, of a range the first end, powers of ten resolved."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[~<>≈±=]+\s*", ""), r"\s*[x×]\s*10\^?", "e")
    s = F.regexp_replace(s, ",", "")
    return F.regexp_extract(s, r"^(-?[0-9]+(?:\.[0-9]+)?(?:e-?[0-9]+)?)", 1).try_cast("double")


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\.[0-9]+)?"), 0)


def word_set(c: Column) -> Column:
    """Distinct words; markup of formulas is split first."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"\\([a-z]+)", "$1"), r"[{}_^=]", " ")
    return F.array_distinct(F.regexp_extract_all(s, F.lit("[a-z0-9]+"), 0))


def plausibility(value: Column, low: float, high: float) -> Column:
    """1 inside the range, else a Gaussian of the distance from its middle in half-widths."""
    mid, half = (low + high) / 2, (high - low) / 2
    return F.when(value.between(low, high), 1.0).otherwise(F.exp(-0.5 * F.pow((value - mid) / half, 2)))


def within(value: Column, low: float, high: float, tolerance: float = 0.2) -> Column:
    return value.between(low * (1 - tolerance), high * (1 + tolerance))


def context_window(c: Column, at: Column, before: int, after: int) -> Column:
    start = F.greatest(F.lit(1), at - before)
    return F.substring(c, start, at + after - start)


def positions(c: Column, needle: str) -> Column:
    """One-based positions of all occurrences of a literal that cannot overlap itself; null for null."""
    parts = F.split(c, rf"\Q{needle}\E", -1)
    step = F.slice(parts, 1, F.size(parts) - 1)
    ends = F.aggregate(step, F.array(F.lit(1 - len(needle))), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x) + len(needle))))
    return F.slice(ends, 2, F.size(step))


def keyword_score(c: Column, words: list[str]) -> Column:
    """``min(hits / max(0.3 n, 1), 1)``."""
    return F.least(contained(c, words) / max(0.3 * len(words), 1.0), F.lit(1.0))


def keyword_density(c: Column, words: list[str]) -> Column:
    n = F.size(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0))
    hits = contained(c, words)
    return F.when((n == 0) | F.lit(not words), 0.0).otherwise(100.0 * (hits / float(len(words) or 1)) * (hits / n))


def chunk_array(c: Column, size: int, overlap: int) -> Column:
    """Fixed-size chunks of a text with overlap, in order."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.substring(c, s + 1, F.lit(size)))


def extractive_summary(c: Column, words: list[str], top: int = 3, limit: int = 220) -> Column:
    """The sentences with most keyword hits (ties: the later in sort order), joined and cut."""
    s = F.filter(F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda x: (F.length(x) > 15) & (F.length(x) < 250))
    scored = F.sort_array(F.transform(s, lambda x: F.struct(contained(x, words).alias("k"), x.alias("s"))), asc=False)
    return F.substring(F.concat_ws(" ", F.transform(F.slice(scored, 1, top), lambda x: x["s"])), 1, limit)


def named_or_unknown(c: Column) -> Column:
    """Null and empty as 'Unknown'."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown"))


def tagged(found: dict[str, Column], name: str, value: str, of=lambda x: x) -> Column:
    """One array of structs (name, value) of the elements of several named arrays."""

    def tag(label: str, c: Column) -> Column:
        return F.transform(c, lambda x: F.struct(F.lit(label).alias(name), of(x).alias(value)))

    return F.flatten(F.array(*[tag(label, c) for label, c in found.items()]))
