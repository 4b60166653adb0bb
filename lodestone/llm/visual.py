"""Visually identical text with different characters, brought to one form.

Arrow text is copied to numpy code-point arrays; lookup-table gathers with expansion offsets remove invisible characters,
unify blanks, widths, ligatures, hyphens and look-alike letters, and marks are composed vectorially. No string method
runs per row.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut, ship

#: Letters that look like a Latin letter, and the letters they look like, in the same order.
LOOK_ALIKE = "АВЕКМНОРСТХЅІЈаеорсухѕіјһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοɡ"
LATIN = "ABEKMHOPCTXSIJaeopcyxsijhdqwABEZHIKMNOPTYXog"
#: Hyphens that look like the hyphen-minus.
HYPHENS = "‐‑"
#: Characters outside the category of format characters that show nothing.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
_SIZE = 0x110000


def _expansion(c: str) -> str:
    """What one character becomes before marks are composed."""
    if c in "\t\n\r":
        return c
    if c in INVISIBLE or unicodedata.category(c) in ("Cf", "Cc"):
        return ""
    if unicodedata.category(c) in ("Zs", "Zl", "Zp"):
        return " "
    if c in HYPHENS:
        return "-"
    if c in LOOK_ALIKE:
        return LATIN[LOOK_ALIKE.index(c)]
    d = unicodedata.decomposition(c)
    if not d:
        return c
    tag, _, rest = d.partition("> ")
    if not d.startswith("<"):
        return "".join(_expansion(chr(int(x, 16))) for x in d.split())
    if tag in ("<wide", "<narrow", "<noBreak") or c == "µ" or "ﬀ" <= c <= "ﬆ" or "ﬓ" <= c <= "ﬗ" or c in "Ĳĳ":
        return "".join(_expansion(chr(int(x, 16))) for x in rest.split())
    return c


@lru_cache(1)
def _tables() -> tuple[np.ndarray, ...]:
    """(start, length) of each code point's expansion, the expansions, combining classes, compositions (keys, values)."""
    length = np.ones(_SIZE, np.uint8)
    start = np.arange(_SIZE, dtype=np.int64)  # the identity part of the data comes first
    extra: list[int] = []
    ccc = np.zeros(_SIZE, np.uint8)
    keys, values = [], []
    for i in range(_SIZE):
        if 0xD800 <= i < 0xE000 or 0xE000 <= i < 0xF900 or (0x20000 <= i < 0xE0000 and not 0x2F800 <= i < 0x2FA20) or i >= 0xF0000 or 0x3400 <= i < 0xA000 or 0xAC00 <= i < 0xD7A4:
            continue  # private use, ideographs and Hangul syllables stay as they are
        c = chr(i)
        if x := unicodedata.combining(c):
            ccc[i] = x
        e = _expansion(c)
        if e != c:
            start[i], length[i] = _SIZE + len(extra), len(e)
            extra += map(ord, e)
        d = unicodedata.decomposition(c)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", c) == c:
            a, b = (int(x, 16) for x in d.split())
            keys.append(a << 21 | b)
            values.append(i)
    order = np.argsort(np.array(keys, np.int64))
    data = np.concatenate([np.arange(_SIZE, dtype=np.uint32), np.array(extra, np.uint32)])
    return start, length, data, ccc, np.array(keys, np.int64)[order], np.array(values, np.uint32)[order]


def _compose(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order the marks after each base by combining class and merge base and mark where one character exists."""
    _, _, _, ccc, keys, values = _tables()
    cls = ccc[cp]
    if not cls.any():
        return cp, row
    first = np.empty(len(cp), bool)
    first[:1] = True
    first[1:] = (cls[1:] == 0) | (row[1:] != row[:-1])
    if (~first[1:] & (cls[1:] < cls[:-1])).any():
        order = np.lexsort((np.arange(len(cp)), cls, np.cumsum(first)))
        cp, row, cls, first = cp[order], row[order], cls[order], first[order]
    failed = np.zeros(len(cp), bool)
    while True:
        # each round tries the first open mark of every base; marks without a composition stay and may block later ones
        mark = np.flatnonzero(~first & ~failed)
        if not len(mark):
            return cp, row
        base = np.maximum.accumulate(np.where(first, np.arange(len(cp)), 0))[mark]
        lead = np.ones(len(mark), bool)
        lead[1:] = base[1:] != base[:-1]
        mark, base = mark[lead], base[lead]
        blocked = failed[mark - 1] & (cls[mark - 1] >= cls[mark])
        key = cp[base].astype(np.int64) << 21 | cp[mark].astype(np.int64)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = (keys[at] == key) & ~blocked
        failed[mark[~hit]] = True
        if hit.any():
            cp = cp.copy()
            cp[base[hit]] = values[at[hit]]
            keep = np.ones(len(cp), bool)
            keep[mark[hit]] = False
            cp, row, first, cls, failed = cp[keep], row[keep], first[keep], cls[keep], failed[keep]


def visual_form(texts: pa.Array) -> pa.Array:
    """One visual form of each text of an Arrow string array; nulls stay null, empty stays empty."""
    texts = texts.cast(pa.large_string())
    if texts.offset:
        texts = pa.concat_arrays([texts])
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[: offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    at = begins[offsets]
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-" + ("le" if sys.byteorder == "little" else "be")), np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
    start, length, data, *_ = _tables()
    size = length[cp].astype(np.int64)
    total = int(size.sum())
    ends = np.cumsum(size)
    # gather: for each output position the source start plus the distance from that source's first output
    index = np.arange(total) + np.repeat(start[cp] - (ends - size), size)
    out, out_row = data[index], np.repeat(row, size)
    out, out_row = _compose(out, out_row)
    counts = np.bincount(out_row, minlength=n) if n else np.zeros(0, int)
    width = 1 + (out >= 0x80).astype(np.int64) + (out >= 0x800) + (out >= 0x10000)
    byte_ends = np.concatenate([[0], np.cumsum(width)])
    new_offsets = byte_ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)
    body = out.astype(np.uint32).tobytes().decode("utf-32-" + ("le" if sys.byteorder == "little" else "be")).encode("utf-8")
    valid = pa.array(np.asarray(texts.is_valid())).buffers()[1]
    return pa.Array.from_buffers(pa.large_string(), n, [valid, pa.py_buffer(new_offsets.tobytes()), pa.py_buffer(body)])


def add_visual_form(df: DataFrame, key: str, text: str, out: str = "form") -> DataFrame:
    """``key``, the text's own digest and the digest and visibility of its visual form; one row per row of ``df``.

    Null texts give null digests, texts without visible characters have ``visible`` false; other columns are dropped.
    """

    def forms(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), visual_form(b.column(1)).cast(pa.string())], names=["k", "t", "f"])

    ship(df.sparkSession)
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    formed = src.mapInArrow(forms, f"k {dict(src.dtypes)['k']}, t string, f string")
    return formed.select(F.col("k").alias(key), F.md5("t").alias("own"), F.md5("f").alias(out), F.coalesce(F.col("f").rlike(r"[^ \t\r\n]"), F.lit(False)).alias("visible"))


def visual_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``text`` in its visual form; nulls stay null, repeated rows are kept, other columns are dropped."""
    ship(df.sparkSession)

    def forms(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), visual_form(b.column(1)).cast(pa.string())], names=["k", "t"])

    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return src.mapInArrow(forms, f"k {dict(src.dtypes)['k']}, t string").withColumnsRenamed({"k": key, "t": text})


def look_alike_pairs(df: DataFrame, key: str, text: str, rows_per_task: int = 2000) -> DataFrame:
    """Pairs (``key``_a < ``key``_b) of rows whose texts differ but have the same visual form.

    Only forms written in at least two ways reach the self-join. A form with many rows is salted: its left rows are
    spread over as many salts as it has blocks of ``rows_per_task``, its right rows are repeated per salt, so that no
    task gathers a hot form. Rows with null or invisible texts have no pairs; a key given twice counts once.
    """
    # the digests are used three times; the texts are read and formed once
    f = cut(add_visual_form(df, key, text).where("visible").select(key, "own", "form"))
    several = f.groupBy("form").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("form", F.ceil(F.col("n") / rows_per_task).cast("int").alias("salts"))
    m = f.join(several, "form")
    left = m.select("form", "own", F.col(key).alias("a"), F.pmod(F.xxhash64(key), F.col("salts")).cast("int").alias("salt"))
    right = m.select("form", F.col("own").alias("own_b"), F.col(key).alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pairs = left.join(right, ["form", "salt"]).where("own <> own_b and a < b")
    return pairs.select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b")).distinct()
