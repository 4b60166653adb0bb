"""Evaluation texts leaking into training text.

Words are canonicalised to a template in which numbers, names and units are typed placeholders; windows of template
words are hash-joined; the slots of each matched window tell exact copies from re-parameterised ones.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.pairs import word_hashes
from lodestone.session import cut, ship, small

_WORDS = re.compile("[a-z0-9]+")
_CASED = re.compile(r"[A-Za-z0-9]+")
#: Words of which a decimal is one.
_DECIMAL_WORDS = re.compile(r"\d+(?:[.,]\d+)+(?![a-z0-9])|[a-z0-9]+")
#: Bits of the filter of template windows: 2 MB, whatever the number of evaluation items.
FILTER_BITS = 24
#: Unit words that are slots of a template.
UNITS = frozenset("w kw mw j kj mj k c f s ms us ns ps fs min h hour hours second seconds minute minutes m mm cm km nm um µm micrometre micrometres millimetre millimetres metre metres nanometre nanometres watt watts kilowatt kilowatts percent pct mpa gpa pa kpa bar hz khz mhz ghz kg g mg v mv a ma degree degrees celsius kelvin unit units".split())


def name_words(items: DataFrame, text: str) -> list[str]:
    """Words of the evaluation items that are capitalised wherever they do not open a sentence: proper names."""

    def words(batches):
        for b in batches:
            out, kind = [], []
            for t in b.column(0).to_pylist():
                start = True
                for m in _CASED.finditer(t or ""):
                    w = m.group()
                    if not start and w.isalpha() and w.isascii():
                        out.append(w.lower()), kind.append(w[:1].isupper())
                    elif start and w.isalpha() and not w[:1].isupper():
                        out.append(w.lower()), kind.append(False)
                    tail = t[m.end() : m.end() + 2]
                    start = bool(tail) and tail[0] in ".!?:" and not tail[1:].strip()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(kind, pa.bool_())], names=["w", "up"])

    got = items.select(text).mapInArrow(words, "w string, up boolean").groupBy("w").agg(F.bool_and("up").alias("up")).where("up")
    return sorted(r["w"] for r in got.collect())  # bounded by the vocabulary of the items


def known_words(items: DataFrame, text: str) -> frozenset:
    """All words of the evaluation items: a capitalised word of a document that is none of them can only be a name."""
    words = F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)).alias("w")
    return frozenset(r["w"] for r in items.select(words).distinct().collect())  # bounded by the vocabulary of the items


def _slot_class(w: str, names: frozenset) -> str | None:
    if w.isdigit() or w.replace(".", "").replace(",", "").isdigit():
        return "\0number"
    if w in UNITS:
        return "\0unit"
    if w in names or any(c.isdigit() for c in w):
        return "\0name"
    return None


def template_windows(df: DataFrame, key: str, text: str, window: int, names: list[str], keep: np.ndarray | None = None, common: frozenset | None = None, pattern: re.Pattern = _WORDS, literals: int = 0) -> DataFrame:
    """(k, th, eh, words, version, at): template hash, exact hash and words of each window of ``window`` words of each text,
    with a hash of the text and the window's first word.

    With ``keep`` (a bitmap over template hashes) only windows whose bit is set leave the scan's task. With ``common``,
    capitalised words outside of it are names too. Windows with fewer than ``literals`` words that are no slots are left out.
    """
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast((frozenset(names), keep, common))

    def typed(t: str, low: str, w: list[str], known: frozenset, common: frozenset) -> list[str]:
        if len(low) != len(t):  # a letter that lower-casing lengthens shifts all after it
            return w
        up = (t[m.start()].isupper() for m in pattern.finditer(low))
        return ["\0name" if u and x.isalpha() and x not in common and x not in known and x not in UNITS else x for x, u in zip(w, up, strict=True)]

    def windows(batches):
        known, bitmap, common = shared.value
        exact: dict[str, int] = {}
        slots: dict[str, int] = {}
        typed_words: set[str] = set()
        for b in batches:
            ks, th, eh, ws, vs, ats = [], [], [], [], [], []
            for k, t, version in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                low = t.lower() if t else ""
                w = pattern.findall(low)
                n = len(w) - window + 1
                if n <= 0:
                    continue
                y = w if common is None else typed(t, low, w, known, common)
                for x in set(y).difference(slots):
                    c = _slot_class(x, known)
                    slots[x] = int(word_hashes([c or x], {})[0])
                    if c or x[:1] == "\0":
                        typed_words.add(x)
                e = word_hashes(w, exact)
                p = np.fromiter(map(slots.__getitem__, y), np.uint64, len(y))
                with np.errstate(over="ignore"):
                    he, hp = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                    for i in range(window):
                        he = (he ^ (he >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + e[i : i + n]
                        hp = (hp ^ (hp >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + p[i : i + n]
                    hp = (hp ^ (hp >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
                at = np.arange(n)
                if bitmap is not None:
                    low = (hp & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                    at = np.flatnonzero(bitmap[low >> 3] >> (low & 7).astype(np.uint8) & 1)
                if literals and len(at):
                    plain = np.concatenate([[0], np.cumsum(np.fromiter((x not in typed_words for x in y), np.int64, len(y)))])
                    at = at[plain[at + window] - plain[at] >= literals]
                for i in at.tolist():
                    ks.append(k), ws.append(" ".join(w[i : i + window])), vs.append(version), ats.append(i)
                th.append(hp[at].view(np.int64)), eh.append(he[at].view(np.int64))
            if len(exact) > 1_000_000:
                exact.clear(), slots.clear(), typed_words.clear()
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ks, b.schema.field(0).type), pa.array(cat(th)), pa.array(cat(eh)), pa.array(ws, pa.string()), pa.array(vs, pa.int64()), pa.array(ats, pa.int32())], names=["k", "th", "eh", "words", "version", "at"])

    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("version"))
    return src.mapInArrow(windows, f"k {dict(src.dtypes)['k']}, th long, eh long, words string, version long, at int")


def window_filter(windows: DataFrame) -> np.ndarray:
    """Bitmap of the template hashes of all windows, built per partition and merged on the driver (fixed size)."""
    size = 1 << FILTER_BITS

    def bits(batches):
        out = np.zeros(size >> 3, np.uint8)
        for b in batches:
            low = b.column(0).to_numpy().view(np.uint64) & np.uint64(size - 1)
            np.bitwise_or.at(out, (low >> np.uint64(3)).astype(np.int64), (1 << (low & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["b"])

    total = np.zeros(size >> 3, np.uint8)
    for r in windows.select("th").mapInArrow(bits, "b binary").toLocalIterator():
        total |= np.frombuffer(r["b"], np.uint8)
    return total


def template_copies(docs: DataFrame, doc_key: str, items: DataFrame, item_key: str, text: str = "text", window: int = 12) -> DataFrame:
    """(doc, item, doc_words, item_words) of every window of a document whose template occurs in an item with equal slots.

    Texts with fewer than ``window`` words, null and empty texts match nothing. Only windows that pass a fixed-size
    filter of item templates leave the scan of the documents.
    """
    ship(docs.sparkSession)
    names = name_words(items, text)
    item_windows = template_windows(items, item_key, text, window, names).drop("version", "at").distinct()
    hits = template_windows(docs, doc_key, text, window, names, window_filter(item_windows))
    right = item_windows.select("th", F.col("k").alias("item"), F.col("eh").alias("item_eh"), F.col("words").alias("item_words"))
    # a template of placeholders alone may be frequent, so copies are joined by their words' hash too
    return hits.join(small(right), (hits["th"] == right["th"]) & (F.col("eh") == F.col("item_eh"))).select(F.col("k").alias("doc"), "item", F.col("words").alias("doc_words"), "item_words")


def leaked_items(docs: DataFrame, doc_key: str, items: DataFrame, item_key: str, text: str = "text", window: int = 12) -> DataFrame:
    """Distinct (``doc_key``, ``item_key``) of documents and items that share at least ``window`` consecutive words."""
    m = template_copies(docs, doc_key, items, item_key, text, window)
    return m.where("doc_words = item_words").select(F.col("doc").alias(doc_key), F.col("item").alias(item_key)).distinct()


#: Words that are no slots which a window needs to be a template; a row of numbers fits any other.
LEAST_LITERALS = 4


def template_runs(docs: DataFrame, doc_key: str, items: DataFrame, item_key: str, text: str, window: int, names: list[str], common: frozenset, pattern: re.Pattern) -> DataFrame:
    """(doc, item, run columns, exact, doc_words, item_words) of the matched windows; a run is an occurrence: windows of one
    text of the document and one of the item that follow each other in both.

    Windows that copy some item word for word are explained by it and count for other items no more.
    """
    ship(docs.sparkSession)
    found = template_windows(items, item_key, text, window, names, None, common, pattern, LEAST_LITERALS).distinct()
    hits = template_windows(docs, doc_key, text, window, names, window_filter(found), common, pattern, LEAST_LITERALS)
    right = found.select("th", F.col("k").alias("item"), F.col("eh").alias("item_eh"), F.col("words").alias("item_words"), F.col("version").alias("item_version"), F.col("at").alias("item_at"))
    m = hits.join(small(right), "th").select(F.col("k").alias("doc"), "item", "version", "item_version", (F.col("at") - F.col("item_at")).alias("shift"), "at", (F.col("eh") == F.col("item_eh")).alias("exact"), F.col("words").alias("doc_words"), "item_words").distinct()
    m = cut(m)
    copies = m.where("exact").select("doc", "version", "at").distinct()
    m = m.where("exact").unionByName(m.where("not exact").join(copies, ["doc", "version", "at"], "left_anti"))
    run = Window.partitionBy("doc", "item", "version", "item_version", "shift").orderBy("at")
    return m.withColumn("run", F.col("at") - F.row_number().over(run)).drop("at")


def reparameterised_items(docs: DataFrame, doc_key: str, items: DataFrame, item_key: str, text: str = "text", window: int = 12) -> DataFrame:
    """Documents that hold an item's template with other slot values, consistently: in an occurrence each slot value of the
    item that is replaced is replaced everywhere by one and the same value, and no value stands for two of the item's.
    Columns doc, item, slots (values replaced), windows, the latter two of the longest such occurrence.

    Names are known from the items, or in documents as capitalised words that no item has. A decimal is one number; it is
    also read as two, as runs of ``window`` words count it so. Windows need ``LEAST_LITERALS`` words that are no slots.
    """
    names, known = name_words(items, text), known_words(items, text)
    parts = [template_runs(docs, doc_key, items, item_key, text, window, names, known, p).withColumn("reading", F.lit(n)) for n, p in enumerate((_WORDS, _DECIMAL_WORDS))]
    key = ["doc", "item", "version", "item_version", "shift", "run", "reading"]
    m = parts[0].unionByName(parts[1])
    n = m.groupBy(*key).agg(F.count(F.lit(1)).alias("windows"), F.count_if(~F.col("exact")).alias("changed")).where("changed > 0")
    pairs = F.array_distinct(F.arrays_zip(F.split("item_words", " ").alias("i"), F.split("doc_words", " ").alias("d")))
    z = m.join(n, key, "left_semi").select(*key, F.explode(pairs).alias("s")).select(*key, "s.i", "s.d").distinct()
    # of the words on either side only those that were replaced, or that replace, must have one partner
    sides = z.withColumn("side", F.explode(F.array(F.struct(F.lit("i").alias("of"), F.col("i").alias("w")), F.struct(F.lit("d").alias("of"), F.col("d").alias("w")))))
    words = sides.groupBy(*key, "side").agg(F.count(F.lit(1)).alias("partners"), F.bool_or(F.col("i") != F.col("d")).alias("replaced")).where("replaced")
    ok = words.groupBy(*key).agg(F.count_if(F.col("side.of") == "i").alias("slots"), F.max("partners").alias("most")).where("most = 1")
    best = ok.join(n, key).groupBy("doc", "item").agg(F.max(F.struct("windows", "slots")).alias("b"))
    return best.select(F.col("doc").alias(doc_key), F.col("item").alias(item_key), "b.slots", "b.windows")
