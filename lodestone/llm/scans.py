"""Noise in text from scanned pages: broken words, misread characters, running headers and page numbers.

Skip-gram vectors are learned over all pages; rare words are linked to frequent neighbours of theirs that one plausible
glyph edit leads to, and corrected in context; furniture is found per paper and removed; the rest is reflowed.

The text is read twice and never shuffled: once for word counts, broken words and edge lines, once for the vectors of the
words that a glyph edit links and the context of each doubtful word. Words, links and occurrences are tables that are
joined, so no vocabulary reaches the driver; broadcast are a sketch and two bitmaps of fixed size.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.pairs import packed_sketch
from lodestone.session import cut, ship

#: Glyphs as a scanner misreads them, and the glyphs that were printed.
GLYPHS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("f", "t"), ("t", "f"), ("q", "g"), ("b", "h"), ("h", "b"), ("ä", "a"), ("ö", "o"), ("ü", "u"),
    ("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("ri", "n"), ("h", "li"), ("m", "rn"), ("d", "cl"), ("u", "ii"), ("n", "ri"), ("li", "h"), ("o", "c"), ("c", "o"), ("u", "v"), ("v", "u"), ("y", "v"), ("n", "u"), ("u", "n"), ("|", "l"), ("!", "l"),
)
#: Hyphens that break a word at the end of a line.
_HYPHENS = "-¬\xad‐"
_TOKEN = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_TAIL = re.compile(r"(?:[^\W_]+[-'’])*[^\W_]+$")
_DIGITS = re.compile(r"\d+")
#: Two rows of 2**21 counters.
SKETCH_BITS = 22
#: Bits of the bitmaps of words that pass on from the second reading; a false hit is dropped by the join that follows.
WORD_BITS = 23
_NUMBER_LINE = re.compile(r"(?:[\[(]\s*\d{1,5}\s*[\])]|[-–—]\s*\d{1,5}\s*[-–—]|(?:[Pp]age|[Pp]\.|[Pp]g\.?|S\.|Seite)\s*\d{1,5}(?:\s*(?:of|/|von)\s*\d{1,5})?|\d{1,5}\s*(?:of|/)\s*\d{1,5}|\d{1,5}|\d{1,5}\s*\|\s*[^\W\d_]+|[^\W\d_]+\s*\|\s*\d{1,5})")


@dataclass(frozen=True)
class ScanParams:
    """A rare word is linked to a word whose count is ``ratio`` times its own, if their vectors say nothing. Vectors count as
    up to ``evidence`` on the logarithm of that ratio, for or against the link; a word of fewer than ``least`` letters
    needs 1.5 more of it for each missing letter. ``dims`` and ``window`` are those of the skip-gram vectors."""

    ratio: float = 20.0
    evidence: float = 1.5
    least: int = 5
    dims: int = 24
    window: int = 4
    subsample: float = 1e-3


def page_lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if "\r" in text else text.split("\n")


def broken_words(lines: list[str]) -> list[tuple[int, int, int, str, str]]:
    """(line, start of the left part, end of the right part in the next line, left, right) of words broken over two lines."""
    out = []
    for i, line in enumerate(lines[:-1]):
        s = line.rstrip(" \t")
        if len(s) > 1 and s[-1] in _HYPHENS and s[-2].isalnum():
            n = lines[i + 1].lstrip(" \t")
            if n[:1].isalnum():
                # a word is no longer than the last 200 characters of a line
                left, right = _TAIL.search(s[-201:-1]).group(), _TOKEN.match(n).group()
                if any(c.isalpha() for c in left + right):
                    out.append((i, len(s) - 1 - len(left), len(lines[i + 1]) - len(n) + len(right), left, right))
    return out


class Words:
    """Words of white-space separated pieces of text, kept per piece."""

    def __init__(self):
        self.known: dict[str, tuple[str, ...]] = {}

    def __getitem__(self, piece: str) -> tuple[str, ...]:
        if (got := self.known.get(piece)) is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            self.known[piece] = got = tuple(x.lower() for x in _TOKEN.findall(piece))
        return got


def whole_words(text: str, breaks: list, lines: list[str]) -> str:
    """The text with a gap in place of each broken word."""
    if not breaks:
        return text
    part, begin = list(lines), {i + 1: end for i, _, end, _, _ in breaks}
    for i, start, _, _, _ in breaks:
        part[i] = part[i][: max(start, begin.get(i, 0))] + " \0"
    for i, end in begin.items():
        part[i] = part[i][end:] if len(part[i]) > end else " \0"
    return "\n".join(part)


def may_break(text: str) -> bool:
    return any(h in text for h in _HYPHENS) and ("\n" in text or "\r" in text)


def edge_lines(lines: list[str]) -> list[tuple[int, int, str]]:
    """(place, line, trimmed text) of the two non-blank lines at both edges: 1, 2 from the top, -1, -2 from the end."""
    full = [i for i, x in enumerate(lines) if x and not x.isspace()]
    if len(full) < 3:
        return []
    places = (1, -1) if len(full) < 4 else (1, -1, 2, -2)
    return [(p, i, lines[i].strip()) for p in places for i in (full[p - 1] if p > 0 else full[p],)]


def read_pages(pages: DataFrame, key: str, paper: str, text: str) -> DataFrame:
    """First reading: (kind, k, paper, a, b, line, at, n). 'word': count n of word a in one task. 'broken': the parts a and b
    of a word broken after ``line``. 'edge': the line a at place ``at``, b its form without digits, n 1 for a page number."""
    src = pages.select(F.col(key).alias("k"), F.col(paper).alias("paper"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    types = dict(src.dtypes)

    def read(batches):
        from collections import Counter

        words, count, schema = Words(), Counter(), None
        for batch in batches:
            rows, pieces = [], Counter()
            schema = batch.schema
            for k, p, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lines = page_lines(t)
                breaks = broken_words(lines) if may_break(t) else []
                pieces.update(whole_words(t, breaks, lines).split())
                rows += [("broken", k, p, left.lower(), right.lower(), i, 0, 0) for i, _, _, left, right in breaks]
                rows += [("edge", k, p, x, " ".join(_DIGITS.sub("#", x).split()), i, at, int(_NUMBER_LINE.fullmatch(x) is not None)) for at, i, x in edge_lines(lines)]
            for piece, n in pieces.items():
                for w in words[piece]:
                    count[w] += n
            if len(count) > 500_000:
                rows += [("word", None, None, w, None, 0, 0, n) for w, n in count.items()]
                count.clear()
            yield packed(rows, schema)
        if count:
            yield packed([("word", None, None, w, None, 0, 0, n) for w, n in count.items()], schema)

    def packed(rows, schema):
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        kinds = [pa.string(), schema.field(0).type, schema.field(1).type, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["kind", "k", "paper", "a", "b", "line", "at", "n"])

    return src.mapInArrow(read, f"kind string, k {types['k']}, paper {types['paper']}, a string, b string, line int, at int, n long")


def glyph_edits(word: str) -> list[str]:
    """Words of letters that one plausible glyph edit makes of a word that is mostly letters."""
    letters = sum(c.isalpha() for c in word)
    if len(word) < 3 or letters * 2 <= len(word):
        return []
    out = {}
    for a, b in GLYPHS:
        i = word.find(a)
        while i >= 0:
            c = word[:i] + b + word[i + len(a) :]
            if c.replace("-", "").replace("'", "").isalpha():
                out[c] = None
            i = word.find(a, i + 1)
    return list(out)


def glyph_links(vocabulary: DataFrame, params: ScanParams) -> DataFrame:
    """(word, n, other, m): words and the sufficiently more frequent words that a glyph edit makes of them."""

    def edit(frames):
        for f in frames:
            got = [(w, n, c) for w, n in zip(f["word"], f["n"], strict=True) for c in glyph_edits(w)]
            yield pd.DataFrame(got, columns=["word", "n", "other"])

    edits = vocabulary.mapInPandas(edit, "word string, n long, other string")
    links = edits.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    return links.where(_log_ratio("n", "m", "word", params) >= -params.evidence).select("word", "n", "other", "m")


def _log_ratio(n: str, m: str, word: str, params: ScanParams) -> Column:
    """How far the logarithm of the ratio of counts lies above what a link needs."""
    return F.log(F.col(m) / F.greatest(F.col(n), F.lit(1))) - math.log(params.ratio) - 1.5 * F.greatest(F.lit(0), params.least - F.length(word))


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def _slots(h: int) -> tuple[int, int]:
    return h & ((1 << 21) - 1), (1 << 21) | (h >> 32) & ((1 << 21) - 1)


def count_sketch(vocabulary: DataFrame) -> np.ndarray:
    """Packed counters of all words; an upper bound of each count, which weighs the contexts of the vectors."""

    def spread(batches):
        for b in batches:
            at = np.array([_slots(_hash(w)) for w in b.column(0).to_pylist()], np.int32).reshape(-1, 2)
            n = b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(at.ravel(order="F")), pa.array(np.concatenate([n, n]))], names=["at", "c"])

    counts = vocabulary.select("word", "n").mapInArrow(spread, "at int, c long").groupBy("at").agg(F.sum("c").alias("c"))
    return packed_sketch(counts, SKETCH_BITS)


def word_bitmap(words: DataFrame) -> np.ndarray:
    """Bitmap of fixed size of the words of a table, merged from one bitmap per task."""

    def bits(batches):
        out = np.zeros(1 << WORD_BITS >> 3, np.uint8)
        for b in batches:
            h = np.array([_hash(w) & ((1 << WORD_BITS) - 1) for w in b.column(0).to_pylist()], np.int64)
            np.bitwise_or.at(out, h >> 3, (1 << (h & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["b"])

    total = np.zeros(1 << WORD_BITS >> 3, np.uint8)
    for r in words.coalesce(16).mapInArrow(bits, "b binary").toLocalIterator():
        total |= np.frombuffer(r["b"], np.uint8)
    return total


class Contexts:
    """Skip-gram vectors of one task: of each word the sum of the signatures of the words around it.

    A word's signature is a random direction, a function of the word alone, weighed less the more frequent the word is, as
    skip-gram models subsample. The sums are a random projection of the matrix of co-occurrences, which skip-gram models
    factorise, and they add up over tasks in one pass.
    """

    def __init__(self, sketch: np.ndarray, total: int, doubtful: np.ndarray, linked: np.ndarray, params: ScanParams):
        self.sketch, self.total, self.doubtful, self.linked, self.p = sketch, total, doubtful, linked, params
        self.words = Words()
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.names: list[str] = [""]
        self.signatures = np.zeros((1, self.p.dims), np.float32)
        self.flags = np.zeros(1, np.uint8)
        self.pieces: dict[str, tuple[int, ...]] = {"\0": (0,)}

    def piece(self, piece: str) -> tuple[int, ...]:
        """Numbers of the words of one piece of text."""
        if (got := self.pieces.get(piece)) is None:
            got = []
            for w in self.words[piece]:
                if (i := self.ids.get(w)) is None:
                    self.ids[w] = i = len(self.names)
                    self.names.append(w)
                got.append(i)
            self.pieces[piece] = got = tuple(got)
        return got

    def learn(self) -> None:
        """Signatures and flags of the words met since the last call."""
        new = self.names[len(self.flags) :]
        if not new:
            return
        h = [_hash(w) for w in new]
        s = np.array([_slots(x) for x in h], np.int64)
        code = np.minimum(self.sketch[s[:, 0]], self.sketch[s[:, 1]]).astype(float)
        share = np.exp2((np.maximum(code, 1) - 1) / 8) / max(self.total, 1)
        weight = np.minimum(1.0, np.sqrt(self.p.subsample / share))
        bits = np.array(h, np.uint64)[:, None] >> np.arange(self.p.dims, dtype=np.uint64) & np.uint64(1)
        self.signatures = np.concatenate([self.signatures, ((2.0 * bits - 1) * weight[:, None]).astype(np.float32)])
        low = np.array([x & ((1 << WORD_BITS) - 1) for x in h], np.int64)
        has = lambda bitmap: bitmap[low >> 3] >> (low & 7).astype(np.uint8) & 1
        self.flags = np.concatenate([self.flags, has(self.doubtful) | has(self.linked) << 1])

    def around(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed signatures and number of the words within the window of each place; 0 is a gap."""
        padded = np.concatenate([np.zeros(self.p.window, codes.dtype), codes, np.zeros(self.p.window, codes.dtype)])
        total, n = np.zeros((len(at), self.p.dims), np.float32), np.zeros(len(at), np.int64)
        for d in range(2 * self.p.window + 1):
            if d != self.p.window:
                c = padded[at + d]
                total += self.signatures[c]
                n += c > 0
        return total, n


def mean_signature(vocabulary: DataFrame, shared, params: ScanParams) -> tuple[np.ndarray, int]:
    """Mean signature over all words of the corpus, by count."""

    def add(batches):
        c = Contexts(*shared.value, params)
        total, n = np.zeros(params.dims), 0
        for b in batches:
            c.clear()
            c.names += b.column(0).to_pylist()
            c.learn()
            w = b.column(1).to_numpy()
            total += w @ c.signatures[1:].astype(float)
            n += int(w.sum())
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n])], names=["s", "n"])

    total, n = np.zeros(params.dims), 0
    for r in vocabulary.select("word", "n").mapInArrow(add, "s array<double>, n long").toLocalIterator():
        total, n = total + np.array(r["s"]), n + r["n"]
    return total / max(n, 1), n


def read_contexts(pages: DataFrame, key: str, text: str, shared, params: ScanParams) -> DataFrame:
    """Second reading: (k, line, start, stop, word, m, v). With k null, v is the sum over one task of the contexts of a linked
    word; else the context of one occurrence of a doubtful word, at characters start to stop of its line."""
    src = pages.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    ktype = dict(src.dtypes)["k"]

    def read(batches):
        c = Contexts(*shared.value, params)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield from texts(c, part.column(0).to_pylist(), part.column(1).to_pylist(), part.schema.field(0).type)

    def texts(c, keys, found, kind):
        if len(c.names) > 500_000:
            c.clear()
        codes, ends, cuts = [], [], []
        gap = [(0,) * params.window]
        for t in found:
            lines = page_lines(t) if may_break(t) else None
            breaks = broken_words(lines) if lines else []
            cuts.append(breaks)
            codes += chain(map(c.piece, whole_words(t, breaks, lines).split()), gap)
            ends.append(len(codes))
        sizes = np.fromiter(map(len, codes), np.int64, len(codes))
        flat = np.fromiter(chain.from_iterable(codes), np.int64, int(sizes.sum()))
        ends = np.concatenate([[0], np.cumsum(sizes)])[ends] if len(codes) else np.zeros(len(found), np.int64)
        c.learn()
        flags = c.flags[flat]
        out = ([], [], [], [], [], [], [])
        at = np.flatnonzero(flags & 2)
        if len(at):
            order = at[np.argsort(flat[at], kind="stable")]
            v, n = c.around(flat, order)
            first = np.flatnonzero(np.diff(flat[order], prepend=-1))
            words = [c.names[i] for i in flat[order[first]]]
            put(out, [None] * len(words), [0] * len(words), [0] * len(words), [0] * len(words), words, np.add.reduceat(n, first), np.add.reduceat(v, first))
        at = np.flatnonzero(flags & 1)
        if len(at):
            page = np.searchsorted(ends, at, side="right")
            v, n = c.around(flat, at)
            where, ks = [], []
            for p in np.unique(page):
                doubtful = {c.names[i] for i in flat[at[page == p]]}
                spots = list(occurrences(page_lines(found[p]), doubtful, cuts[p]))
                where += spots
                ks += [keys[p]] * len(spots)
            if len(where) == len(at):
                lines, starts, stops, words = zip(*where, strict=True)
                put(out, ks, lines, starts, stops, words, n, v)
            else:
                raise AssertionError("words of a text and of its lines differ")
        flatv = np.concatenate(out[6]).ravel() if out[6] else np.zeros(0, np.float32)
        rows = len(out[4])
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * params.dims), pa.array(flatv))
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], kind), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.string()), pa.array(out[5], pa.int64()), vectors], names=["k", "line", "start", "stop", "word", "m", "v"]
        )

    def put(out, ks, lines, starts, stops, words, n, v):
        for x, y in zip(out[:5], (ks, lines, starts, stops, words), strict=True):
            x.extend(y)
        out[5].extend(n.tolist())
        out[6].append(v)

    return src.mapInArrow(read, f"k {ktype}, line int, start int, stop int, word string, m long, v array<float>")


def occurrences(lines: list[str], words: set[str], breaks: list):
    """(line, start, stop, word) of each whole word of the lines that is one of ``words``."""
    left, right = {b[0]: b[1] for b in breaks}, {b[0] + 1: b[2] for b in breaks}
    for i, line in enumerate(lines):
        low = line.lower()
        if any(w in low for w in words):
            for m in _TOKEN.finditer(line):
                if (w := m.group().lower()) in words and m.start() >= right.get(i, 0) and m.end() <= max(left.get(i, len(line)), right.get(i, 0)):
                    yield i, m.start(), m.end(), w


def furniture(edges: DataFrame) -> DataFrame:
    """(k, kind, item, line) of furniture among edge lines (k, paper, a, b, line, at, n).

    A header recurs, apart from digits, at the edges of at least two pages of its paper and is neither a numbered heading
    nor, at the end of a page, running text: a line that begins with a small letter or ends as a sentence does. A page
    number line gives nothing but the number. The second line from an edge counts only next to furniture of the other kind.
    Lines are counted per paper and form before they are shuffled.
    """
    recurring = edges.where("n = 0 and paper is not null").groupBy("paper", "b").agg(F.count_distinct("k").alias("pages")).where("pages > 1").select("paper", "b", F.lit(True).alias("again"))
    a = F.col("a")
    titled = ~a.rlike(r"^\d+(\.\d+)+\.?\s") & ((F.col("at") > 0) | ~(a.rlike(r"^\p{Ll}") | a.rlike(r"(?<!\bal)[.!?]$"))) & ~((F.length("a") > 120) & a.rlike(r"\p{Ll}{3}[.!?]\s+\p{Lu}"))
    w = edges.join(recurring, ["paper", "b"], "left").withColumn("kind", F.when(F.col("n") == 1, "number").when(F.col("again") & titled, "header"))
    w = cut(w.where("kind is not null").select("k", "kind", F.col("a").alias("item"), "line", "at"))
    outer = w.where(F.abs("at") == 1)
    next_to = outer.select("k", F.signum("at").alias("side"), F.col("kind").alias("outer_kind")).distinct()
    inner = w.where(F.abs("at") == 2).withColumn("side", F.signum("at")).join(next_to, ["k", "side"]).where("kind <> outer_kind")
    return outer.select("k", "kind", "item", "line").unionByName(inner.select("k", "kind", "item", "line")).distinct()


def joined_word(left: str, right: str, count, ratio: float = 20.0) -> str:
    """The word broken into ``left`` and ``right``: with its own hyphen if the corpus writes it so."""
    whole, hyphened = left + right, f"{left}-{right}"
    a, b = count(whole), count(hyphened)
    if max(a, b) < 3:
        fixes = [(n, c) for w in (whole, hyphened) for c in glyph_edits(w) if (n := count(c)) >= ratio * max(count(w), 1)]
        if fixes:
            return max(fixes)[1]
        if not a and not b:
            return hyphened if min(count(left), count(right)) >= 50 and len(left) > 2 and len(right) > 2 else whole
    return hyphened if b > a else whole


def joined_words(broken: DataFrame, vocabulary: DataFrame, params: ScanParams) -> DataFrame:
    """(a, b, word) of each pair of parts. All words that may decide are looked up with one join."""

    def wanted(frames):
        for f in frames:
            rows = []
            for a, b in zip(f["a"], f["b"], strict=True):
                whole, hyphened = a + b, f"{a}-{b}"
                rows += [(a, b, w) for w in dict.fromkeys([whole, hyphened, a, b, *glyph_edits(whole), *glyph_edits(hyphened)])]
            yield pd.DataFrame(rows, columns=["a", "b", "word"])

    def decide(frames):
        for f in frames:
            f["word"] = [joined_word(a, b, lambda w, d={x["word"]: x["n"] for x in seen}: d.get(w, 0), params.ratio) for a, b, seen in zip(f["a"], f["b"], f["seen"], strict=True)]
            yield f[["a", "b", "word"]]

    pairs = broken.select("a", "b").distinct()
    looked = pairs.mapInPandas(wanted, "a string, b string, word string").join(vocabulary, "word", "left")
    seen = looked.groupBy("a", "b").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n"))).alias("seen"))
    return seen.mapInPandas(decide, "a string, b string, word string")


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def corrections(contexts: DataFrame, links: DataFrame, mean: np.ndarray, params: ScanParams) -> DataFrame:
    """(k, line, start, stop, item) of the doubtful words that their links' vectors confirm.

    A link's score is the logarithm of the ratio of counts and the cosine of the two words' vectors, less what a link needs;
    of several links of a word each occurrence takes the one that fits its own context best.
    """
    c = contexts.withColumn("v", F.zip_with("v", F.array(*[F.lit(float(x)) for x in mean]), lambda x, e: x.cast("double") - F.col("m") * e))
    vectors = c.groupBy("word").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(params.dims)]).select("word", F.array(*[f"v{i}" for i in range(params.dims)]).alias("wv"))
    vectors = cut(vectors)
    both = links.join(vectors, "word", "left").join(vectors.select(F.col("word").alias("other"), F.col("wv").alias("ov")), "other", "left")
    strength = params.evidence * math.sqrt(params.dims) / 3
    bounded = lambda x: F.least(F.lit(params.evidence), F.greatest(F.lit(-params.evidence), strength * x))
    kept = both.withColumn("score", _log_ratio("n", "m", "word", params) + bounded(_cosine(F.col("wv"), F.col("ov")))).where("score >= 0").select("word", "other", "score", "ov", F.col("m").alias("seen"))
    at = c.where("k is not null").join(kept, "word")
    fit = F.col("score") + bounded(_cosine(F.col("v"), F.col("ov")))
    best = at.groupBy("k", "line", "start", "stop").agg(F.max(F.struct(fit.alias("fit"), "seen", "other")).alias("b"))
    return best.select("k", "line", "start", "stop", F.col("b.other").alias("item"))


def scan_repairs(pages: DataFrame, key: str, paper: str, text: str, params: ScanParams = ScanParams()) -> DataFrame:
    """(key, kind, item, line, start, stop) of what is to be repaired or removed, without the text.

    kind is 'hyphen' (the whole word that begins on ``line``), 'char' (the word printed at characters start to stop of the
    line), 'header' or 'number' (the line). Null and blank texts and pages of fewer than three lines have no furniture;
    repeated rows count once; an empty table gives no rows. Words inside furniture are not repaired.
    """
    ship(pages.sparkSession)
    sc = pages.sparkSession.sparkContext
    first = cut(read_pages(pages, key, paper, text))
    vocabulary = cut(first.where("kind = 'word'").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n")))
    lines = cut(furniture(first.where("kind = 'edge'").select("k", "paper", "a", "b", "line", "at", "n")))
    gone = lines.select("k", "line").distinct()
    links = cut(glyph_links(vocabulary, params))
    doubtful, linked = word_bitmap(links.select("word").distinct()), word_bitmap(links.select("other").distinct())
    sketch = count_sketch(vocabulary)
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    shared = sc.broadcast((sketch, total, doubtful, linked))
    mean, _ = mean_signature(vocabulary, shared, params)
    contexts = cut(read_contexts(pages, key, text, shared, params))
    chars = corrections(contexts, links, mean, params).join(gone, ["k", "line"], "left_anti")
    broken = first.where("kind = 'broken'").select("k", "line", "a", "b").distinct()
    beside = gone.unionByName(gone.select("k", (F.col("line") - 1).alias("line"))).distinct()
    words = joined_words(broken, vocabulary, params)
    hyphens = broken.join(beside, ["k", "line"], "left_anti").join(words, ["a", "b"])
    none = F.lit(None).cast("int")
    out = chars.select("k", F.lit("char").alias("kind"), "item", "line", "start", "stop")
    out = out.unionByName(hyphens.select("k", F.lit("hyphen").alias("kind"), F.col("word").alias("item"), "line", none.alias("start"), none.alias("stop")))
    out = out.unionByName(lines.select("k", "kind", "item", "line", none.alias("start"), none.alias("stop")))
    return out.withColumnRenamed("k", key)


def repaired_text(text: str, repairs: list) -> str:
    """The text with its repairs (kind, item, line, start, stop) made, furniture removed and lines reflowed."""
    lines = page_lines(text)
    # the words' letters keep their case where the word is as stored
    by_line: dict[int, list] = {}
    for kind, item, i, start, stop in repairs:
        by_line.setdefault(i, []).append((kind, item, start, stop))
    broken = {b[0]: b for b in broken_words(lines)}
    out = list(lines)
    for i, found in by_line.items():
        edits = [(start, stop, item.capitalize() if lines[i][start : start + 1].isupper() else item) for kind, item, start, stop in found if kind == "char"]
        for kind, word, _, _ in found:
            if kind == "hyphen" and i in broken:
                _, start, _, left, right = broken[i]
                shown = left + right if word == (left + right).lower() else f"{left}-{right}" if word == f"{left}-{right}".lower() else word.capitalize() if left[:1].isupper() else word
                edits.append((start, len(lines[i]), shown))
        begin = broken[i - 1][2] if any(k == "hyphen" for k, *_ in by_line.get(i - 1, [])) and i - 1 in broken else 0
        out[i] = _edited(lines[i], edits, begin)
    for i in broken:
        if any(k == "hyphen" for k, *_ in by_line.get(i, [])) and i + 1 not in by_line:
            out[i + 1] = lines[i + 1][broken[i][2] :]
    gone = {i for i, found in by_line.items() if any(k in ("header", "number") for k, *_ in found)}
    body = "\n".join(x.rstrip() for i, x in enumerate(out) if i not in gone).strip("\n")
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", body)]
    return "\n\n".join(p for p in paragraphs if p)


def _edited(line: str, edits: list[tuple[int, int, str]], begin: int) -> str:
    out, at = [], begin
    for start, stop, word in sorted(edits):
        if start >= at:
            out += [line[at:start], word]
            at = stop
    return "".join(out) + line[at:]


def repair_scans(pages: DataFrame, key: str, paper: str, text: str, params: ScanParams = ScanParams()) -> DataFrame:
    """(key, text, repairs) of every page: reflowed text and array<struct<kind, item>> of what was repaired or removed.

    Null texts stay null, blank texts become empty, both without repairs; repeated rows give repeated rows.
    """
    found = scan_repairs(pages, key, paper, text, params).groupBy(key).agg(F.collect_list(F.struct("kind", "item", "line", "start", "stop")).alias("f"))
    joined = pages.select(key, text).join(found, key, "left").select(F.col(key).alias("k"), F.col(text).alias("t"), F.col("f"))
    ktype = dict(joined.dtypes)["k"]

    def repair(batches):
        for b in batches:
            texts, repairs = [], []
            for t, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                f = sorted((x["line"], x["kind"], x["item"], x["start"], x["stop"]) for x in f or []) if t is not None and f else []
                texts.append(None if t is None else repaired_text(t, [(kind, item, i, start, stop) for i, kind, item, start, stop in f]))
                repairs.append([{"kind": a, "item": c} for a, c in dict.fromkeys((kind, item) for _, kind, item, _, _ in f)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(repairs, pa.list_(pa.struct([("kind", pa.string()), ("item", pa.string())])))], names=["k", "text", "repairs"])

    return joined.mapInArrow(repair, f"k {ktype}, text string, repairs array<struct<kind:string,item:string>>").withColumnRenamed("k", key)
