"""Near-duplicate records with small edits: an exact set-similarity join over word n-grams.

The n-gram sets are ordered globally, rarest first, and their prefixes are stored flat, as postings: a posting is
(n-gram, set, depth, set size), where a prefix tree would hold a node per shared path. Sets that share an n-gram within the part that a partner must reach are
compared; the remaining-length bound prunes by depth and size, and a parity bitmap of each set bounds the symmetric
difference before anything is verified. Only classes of equal sets take part, and every surviving pair is verified on
the full sets.

No set is stored: what is kept are signatures and the prefixes, and the texts are cut into n-grams again where a step needs
them. The postings are shuffled in rounds, a part of the n-grams each, whose files are deleted before the next one.
"""

from __future__ import annotations

import zlib
from fractions import Fraction
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut, ship

#: Every byte but a-z and 0-9 separates words.
_SEPARATED = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
#: Counters of the frequency sketch that defines the global order; one byte each, so 4 MB whatever the corpus.
SKETCH_BITS = 22
#: Rows of one posting list handled together; longer lists are split into blocks of this size.
BLOCK = 2048
#: Postings shuffled in one round: so many, or so many for each set if that is more.
ROUND, ROUND_PER_SET = 4_000_000, 5
#: Bits of the wide bitmap of a set, which is looked up once for each pair and not carried by the postings.
WIDE = 512
#: Bits of the filter that stands for ids too many to be broadcast, so 4 MB whatever their number.
FILTER_BITS = 25


def words_of(text: str) -> list[bytes]:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return text.lower().encode("ascii", "replace").translate(_SEPARATED).split()


def word_hashes(words: list, cache: dict) -> np.ndarray:
    """64-bit hash of each word; ``cache`` keeps those already computed."""
    import xxhash

    for w in set(words).difference(cache):
        cache[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def shingle_rows(texts: list[str], size: int, cache: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, n): the sorted distinct hashes of the word ``size``-grams of each text, one text after the other, and how many
    each has (words: runs of a-z and 0-9 after lower-casing)."""
    words = [words_of(t) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    h = word_hashes(list(chain.from_iterable(words)), cache)
    if len(cache) > 1_000_000:
        cache.clear()
    many = max(len(h) - size + 1, 0)
    g = np.zeros(many, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            g = (g ^ (g >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + many]
        g = (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    whole = row[:many] == row[size - 1 :] if many else np.zeros(0, bool)
    g, row = g.view(np.int64)[whole], row[:many][whole]
    end = np.cumsum(np.bincount(row, minlength=len(texts))).tolist()
    for lo, hi in zip([0, *end], end, strict=False):
        g[lo:hi].sort()
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[new], np.bincount(row[new], minlength=len(texts))


def parity_bitmaps(g: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per set 256 bits, each the parity of how many elements fall on it; equal elements of two sets cancel in their xor."""
    return _parities(g & 255, n, 256).view(np.int64)


def _parities(at: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    odd = np.bincount(np.repeat(np.arange(len(n)) * width, n) + at, minlength=len(n) * width) & 1
    return np.packbits(odd.astype(np.uint8)).reshape(-1, width // 8)


def parity_bitmap(g: np.ndarray) -> np.ndarray:
    return parity_bitmaps(g, np.array([len(g)]))[0]


def long_enough(df: DataFrame, least: int) -> DataFrame:
    """Distinct word n-grams need at least as many words, so shorter texts cannot qualify."""
    return df.where(F.length("t") >= 2 * least)


def described_sets(df: DataFrame, size: int, least: int) -> DataFrame:
    """Two kinds of rows: (tb, id, sig) of every text of (tb, id, t) with at least ``least`` distinct n-grams, and (chunk,
    counts), packed parts of the counters of their n-grams, a set for each task."""

    def describe(batches):
        import xxhash

        cache: dict[bytes, int] = {}
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        names, seen = ["tb", "id", "sig", "chunk", "counts"], False
        for b in batches:
            g, n = shingle_rows(b.column(2).to_pylist(), size, cache)
            keep = n >= least
            end = np.cumsum(n)
            sig = [xxhash.xxh128_digest(g[e - k : e].tobytes()) for e, k in zip(end[keep].tolist(), n[keep].tolist(), strict=True)]
            at, many = np.unique(g[np.repeat(keep, n)] & (len(total) - 1), return_counts=True)
            total[at] += many.astype(np.uint32)
            seen = seen or bool(sig)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask), pa.array(sig, pa.binary()), pa.nulls(len(sig), pa.int32()), pa.nulls(len(sig), pa.binary())], names=names)
        if seen:
            parts = [zlib.compress(x.tobytes(), 1) for x in total.reshape(-1, 1 << 14)]
            k = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return long_enough(df, least).mapInArrow(describe, "tb int, id long, sig binary, chunk int, counts binary")


def frequency_sketch(described: DataFrame) -> np.ndarray:
    """One byte per counter: the rounded logarithm of how many n-grams of all sets fall on it (0 none, 1 exactly one)."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[at] = total.get(at, 0) + np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64)
        codes = [np.where(c > 1, np.minimum(255, 1 + np.ceil(np.log2(np.maximum(c, 1)) * 8)), c).astype(np.uint8).tobytes() for c in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(codes, pa.binary())], names=["chunk", "codes"])

    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in described.where("chunk is not null").select("chunk", "counts").repartition(16, "chunk").mapInArrow(add, "chunk int, codes binary").toLocalIterator():
        out[r["chunk"] << 14 : (r["chunk"] + 1) << 14] = np.frombuffer(r["codes"], np.uint8)
    return out


def packed_sketch(counts: DataFrame, bits: int) -> np.ndarray:
    """Byte array of 2**bits counters from rows (at, c): 0 none, 1 exactly one, else 1 + eight times the logarithm.

    The counters travel in packed chunks, so what reaches the driver is 2**bits bytes, whatever the corpus.
    """

    def pack(batches):
        rows = {}
        for b in batches:
            at, code = b.column(0).to_numpy(), b.column(1).to_numpy()
            for chunk in np.unique(at >> 14):
                m = (at >> 14) == chunk
                rows.setdefault(int(chunk), np.zeros(1 << 14, np.uint8))[at[m] & ((1 << 14) - 1)] = code[m]
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array([r.tobytes() for r in rows.values()], pa.binary())], names=["chunk", "codes"])

    code = F.when(F.col("c") == 1, 1).otherwise(F.least(F.lit(255), F.lit(1) + F.ceil(F.log2("c") * 8))).cast("int")
    out = np.zeros(1 << bits, np.uint8)
    # chunks are spread over tasks; one chunk may come in several parts, which are disjoint
    for r in counts.select("at", code.alias("code")).repartition(16, F.shiftright("at", 14)).mapInArrow(pack, "chunk int, codes binary").toLocalIterator():
        part = out[r["chunk"] << 14 : (r["chunk"] + 1) << 14]
        np.maximum(part, np.frombuffer(r["codes"], np.uint8), out=part)
    return out


def _blocks(codes: np.ndarray) -> np.ndarray:
    """Into how many blocks a posting list is split, told by the sketch's upper bound of its length."""
    return np.ceil(np.exp2((codes.astype(float) - 1) / 8) / BLOCK).astype(np.int64)


def prefixes(texts: DataFrame, size: int, least: int, sketch, t: Fraction) -> DataFrame:
    """(tb, id, n, first, posts, grams, b0..b3, wide) of the sets of at least ``least`` n-grams of (tb, id, t): the low halves of the n-grams in the part of a
    set that a partner must reach, rarest first from depth ``first`` on, and how many postings they make.

    Half a hash may stand for several n-grams; that only adds candidates.
    """

    def shorten(batches):
        codes, cache = sketch.value, {}
        for b in batches:
            g, n = shingle_rows(b.column(2).to_pylist(), size, cache)
            bits, wide = parity_bitmaps(g, n), _parities(g >> 40 & WIDE - 1, n, WIDE)
            c = codes[g & (len(codes) - 1)]
            row = np.repeat(np.arange(len(n)), n)
            first = np.bincount(row[c == 1], minlength=len(n))  # n-grams of one set only have no partner
            key = c.astype(np.uint64) << np.uint64(56) | g.view(np.uint64) & np.uint64((1 << 56) - 1)
            end = np.cumsum(n)
            for lo, hi in zip((end - n).tolist(), end.tolist(), strict=True):
                key[lo:hi].sort()
            p = np.where(n > 0, n + t.numerator * -n // t.denominator + 1, 0)
            many = np.where(n >= least, np.maximum(p - first, 0), 0)
            keep = many > 0
            stop = np.cumsum(many)
            at = np.arange(int(many.sum())) + np.repeat(end - n + first - (stop - many), many)
            blocks = _blocks((key[at] >> np.uint64(56)).astype(np.uint8))
            posts = np.bincount(np.repeat(np.arange(len(n)), many), weights=blocks, minlength=len(n)).astype(np.int64)
            grams = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop[keep]]).astype(np.int32)), pa.array((key[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(mask), b.column(1).filter(mask), pa.array(n[keep].astype(np.int32)), pa.array(first[keep].astype(np.int32)), pa.array(posts[keep]), grams, *(pa.array(bits[keep, j]) for j in range(4)), pa.array([x.tobytes() for x in wide[keep]], pa.binary())],
                names=["tb", "id", "n", "first", "posts", "grams", "b0", "b1", "b2", "b3", "wide"],
            )

    return texts.select("tb", "id", "t").mapInArrow(shorten, "tb int, id long, n int, first int, posts long, grams array<int>, b0 long, b1 long, b2 long, b3 long, wide binary")


def _postings(heads: DataFrame, sketch, part: int, parts: int) -> DataFrame:
    """(g, id, size, place, b0..b3) of each n-gram of one of the ``parts`` of all n-grams in the prefixes of sets.

    ``g`` mixes table, n-gram and pair of blocks, ``size`` holds the set's size and the n-gram's depth, ``place`` the table
    and the set's own block (0: the list is not split), so that a posting is eight numbers and sorts by two of them.
    """

    def post(batches):
        codes = sketch.value
        for b in batches:
            off = b.column(4).offsets.to_numpy().astype(np.int64)
            flat = b.column(4).values.to_numpy()[off[0] : off[-1]].astype(np.int64) & 0xFFFFFFFF
            many = np.diff(off)
            row = np.repeat(np.arange(b.num_rows), many)
            use = np.arange(len(flat)) - np.repeat(off[:-1] - off[0], many) + b.column(3).to_numpy().astype(np.int64)[row]
            mine = ((flat * 0x9E3779B1 & 0xFFFFFFFF) >> 12) % parts == part
            flat, row, use = flat[mine], row[mine], use[mine]
            tb, rid, n = (b.column(i).to_numpy().astype(np.int64) for i in range(3))
            blocks = _blocks(codes[flat & (len(codes) - 1)])
            pair, own = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
            if (blocks > 1).any():
                at = np.repeat(np.arange(len(flat)), blocks)
                other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                flat, row, use, blocks = flat[at], row[at], use[at], blocks[at]
                with np.errstate(over="ignore"):
                    block = ((rid.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64)[row] % blocks
                lo, hi = np.minimum(block, other), np.maximum(block, other)
                pair, own = lo << 24 | hi, np.where(hi > lo, block + 1, 0)
            with np.errstate(over="ignore"):
                mixed = (flat ^ pair * np.int64(0x2545F4914F6CDD1D) ^ tb[row] * np.int64(0x5851F42D4C957F2D)) * np.int64(-7046029254386353131)
            g = (mixed ^ mixed >> np.int64(29)).astype(np.uint64).astype(np.uint32).view(np.int32)
            bits = [b.column(5 + j).to_numpy()[row] for j in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g, rid[row], n[row] << 32 | use, tb[row] << 32 | own, *bits)], names=["g", "id", "size", "place", "b0", "b1", "b2", "b3"])

    return heads.select("tb", "id", "n", "first", "grams", "b0", "b1", "b2", "b3").mapInArrow(post, "g int, id long, size long, place long, b0 long, b1 long, b2 long, b3 long")


def _pairs_of_runs(f: dict[str, np.ndarray], starts: np.ndarray, ends: np.ndarray, t: Fraction, most: int = 1_500_000):
    """Candidate pairs (table, smaller id, larger id) within the runs [start, end) of rows of equal node, after the length
    and bitmap bounds."""
    n, pos, ids, bits = f["size"] >> 32, f["size"] & 0xFFFFFFFF, f["id"], f["bits"]
    tb, own = f["place"] >> 32, f["place"] & 0xFFFFFFFF
    # rows of a run are sorted by set size; row i is the smaller set of its pairs, so only partners up to the largest
    # size that its remaining length still allows are met
    rows = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends, strict=True)]) if len(starts) else np.zeros(0, int)
    run = np.repeat(np.arange(len(starts), dtype=np.int64), ends - starts)
    num, den = t.numerator, t.denominator
    reach = np.minimum((n[rows] - pos[rows]) * (num + den) // num - n[rows], n[rows] * den // num)
    width = int(n.max(initial=0)) + 2
    last = np.searchsorted(run * width + n[rows], run * width + np.clip(reach, 0, width - 1), side="right")
    many = np.maximum(last - np.arange(len(rows)) - 1, 0)
    edges = np.cumsum(many)
    begin = 0
    while begin < len(rows):
        base = edges[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(edges, base + most, side="right")))
        k = many[begin:stop]
        a = np.repeat(np.arange(begin, stop), k)
        b = rows[a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)]
        a = rows[a]
        begin = stop
        na, nb = n[a], n[b]
        need = -(-num * (na + nb) // (num + den))
        ok = (np.minimum(na, nb) * den >= num * np.maximum(na, nb)) & (np.minimum(na - pos[a], nb - pos[b]) >= need)
        a, b, need = a[ok], b[ok], need[ok]
        if len(a):
            differ = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1)
            # a pair of two blocks is met where both rows are of different blocks; rows of one block meet in its own
            ok = (differ <= n[a] + n[b] - 2 * need) & (ids[a] != ids[b]) & (tb[a] == tb[b]) & ((own[a] == 0) | (own[a] != own[b]))
            a, b = a[ok], b[ok]
            if len(a):
                yield tb[a], np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])


def _met(postings: DataFrame, t: Fraction) -> DataFrame:
    """Distinct (tb, a, b), a < b, of the sets that meet in a posting list and pass the bounds."""
    names = ["g", "id", "size", "place"]

    def join(batches):
        """Rows come sorted by node; a node's rows may go over the end of a batch."""
        rest = None
        for b in batches:
            f = {c: b.column(i).to_numpy() for i, c in enumerate(names)}
            f["bits"] = np.stack([b.column(4 + i).to_numpy() for i in range(4)], axis=1).view(np.uint64)
            if rest is not None:
                f = {c: np.concatenate([rest[c], f[c]]) for c in f}
            change = np.flatnonzero(f["g"][1:] != f["g"][:-1]) + 1
            if not len(change):
                rest = f
                continue
            rest = {c: x[change[-1] :] for c, x in f.items()}
            yield from _emit({c: x[: change[-1]] for c, x in f.items()}, np.concatenate([[0], change[:-1]]), change, t)
        if rest is not None and len(rest["g"]):
            yield from _emit(rest, np.array([0]), np.array([len(rest["g"])]), t)

    nodes = postings.repartition("g").sortWithinPartitions("g", "size")
    return nodes.mapInArrow(join, "tb int, a long, b long").distinct()


def _emit(f: dict[str, np.ndarray], starts: np.ndarray, ends: np.ndarray, t: Fraction):
    several = ends - starts > 1
    for tb, a, b in _pairs_of_runs(f, starts[several], ends[several], t):
        d = pd.DataFrame({"tb": tb.astype(np.int32), "a": a, "b": b}).drop_duplicates()
        yield pa.RecordBatch.from_pandas(d, preserve_index=False)


def candidate_pairs(texts: DataFrame, size: int, least: int, sketch: np.ndarray, t: Fraction) -> DataFrame:
    """Distinct (tb, a, b), a < b, of the texts (tb, id, t) whose sets of at least ``least`` n-grams may reach Jaccard
    similarity ``t``; none that does is missing. ``sketch`` counts the n-grams of these texts at least."""
    shared = texts.sparkSession.sparkContext.broadcast(sketch)
    heads = cut(prefixes(texts, size, least, shared, t), drop=True)
    sets, posts = heads.agg(F.count(F.lit(1)), F.sum("posts")).first()
    parts = max(1, -(-(posts or 0) // max(ROUND, ROUND_PER_SET * sets)))
    found = [cut(_met(_postings(heads, shared, i, parts), t), drop=True) for i in range(parts)]
    met = cut(reduce(DataFrame.union, found).distinct(), drop=True)
    of = heads.select("tb", "id", "n", "wide").dropDuplicates(["tb", "id"])
    left, right = (of.select("tb", F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"w{c}")) for c in ("a", "b"))

    def near(batches):
        for x in batches:
            na, nb = (x.column(i).to_numpy().astype(np.int64) for i in (3, 4))
            wa, wb = (np.frombuffer(b"".join(x.column(i).to_pylist()), np.uint64).reshape(-1, WIDE // 64) for i in (5, 6))
            need = -(-t.numerator * (na + nb) // (t.numerator + t.denominator))
            ok = np.bitwise_count(wa ^ wb).sum(axis=1) <= na + nb - 2 * need
            yield x.filter(pa.array(ok)).select(["tb", "a", "b"])

    both = met.join(left, ["tb", "a"]).join(right, ["tb", "b"])
    return both.select("tb", "a", "b", "na", "nb", "wa", "wb").mapInArrow(near, "tb int, a long, b long")


def verified_pairs(cand: DataFrame, texts: DataFrame, size: int, t: Fraction) -> DataFrame:
    """(tb, a, b, jaccard) of the pairs of ``cand`` whose texts (tb, id, t; one for an id) reach similarity ``t``."""
    left, right = (texts.select("tb", F.col("id").alias(c), F.col("t").alias(f"text_{c}")) for c in ("a", "b"))

    def verify(batches):
        cache: dict[bytes, int] = {}
        for x in batches:
            (ga, na), (gb, nb) = (shingle_rows(x.column(i).to_pylist(), size, cache) for i in (3, 4))
            row = np.concatenate([np.repeat(np.arange(len(k)), k) for k in (na, nb)])
            g = np.concatenate([ga, gb])
            order = np.lexsort((g, row))
            g, row = g[order], row[order]
            common = np.bincount(row[1:][(g[1:] == g[:-1]) & (row[1:] == row[:-1])], minlength=len(na))
            union = na + nb - common
            ok = (common * t.denominator >= union * t.numerator) & (union > 0)
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([*(x.column(i).filter(mask) for i in range(3)), pa.array(common[ok] / union[ok])], names=["tb", "a", "b", "jaccard"])

    both = cand.join(left, ["tb", "a"]).join(right, ["tb", "b"])
    return both.select("tb", "a", "b", "text_a", "text_b").mapInArrow(verify, "tb int, a long, b long, jaccard double")


#: Rows (table, id) that may be broadcast: some 24 bytes each.
MOST_ROWS = 300_000


def _places(tb: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each (table, id) in the filter."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.int64).view(np.uint64) ^ tb.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ x >> np.uint64(29)
    most = np.uint64((1 << FILTER_BITS) - 1)
    return (x & most).astype(np.int64), (x >> np.uint64(32) & most).astype(np.int64)


def _filtered(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (tb, id, t) in two parts: those that may be in ``ids`` (tb, id), all of these among them, and those that are not."""

    def places(batches):
        for b in batches:
            at = np.concatenate(_places(b.column(0).to_numpy(), b.column(1).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(at).astype(np.int32))], names=["at"])

    at = ids.select("tb", "id").mapInArrow(places, "at int").distinct().withColumn("c", F.lit(1))
    bits = rows.sparkSession.sparkContext.broadcast(np.packbits(packed_sketch(at, FILTER_BITS)))

    def part(inside: bool):
        def look(batches):
            for b in batches:
                known = np.ones(b.num_rows, bool)
                for at in _places(b.column(0).to_numpy(), b.column(1).to_numpy()):
                    known &= (bits.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
                yield b.filter(pa.array(known == inside))

        return rows.mapInArrow(look, "tb int, id long, t string")

    return part(True), part(False)


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` (tb, id, t) not in ``ids`` (tb, id); of the texts only those that may be in ``ids`` are ever shuffled."""
    if ids.limit(MOST_ROWS + 1).count() <= MOST_ROWS:
        return rows.join(F.broadcast(ids), ["tb", "id"], "left_anti")
    doubtful, sure = _filtered(rows, ids)
    return sure.union(doubtful.join(ids, ["tb", "id"], "left_anti").select("tb", "id", "t"))


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` (tb, id, t) in ``ids`` (tb, id) and, if these are many, a few others."""
    if ids.limit(MOST_ROWS + 1).count() <= MOST_ROWS:
        return rows.join(F.broadcast(ids), ["tb", "id"], "left_semi")
    return _filtered(rows, ids)[0]


def similar_classes(df: DataFrame, size: int = 5, threshold: float = 0.8, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Exact set-similarity join of the texts of (tbl, id, t): (members, links).

    ``members``: tbl, id, rep - the class of rows with the same set of word ``size``-grams, named by its smallest id.
    ``links``: tbl, a, b, jaccard - every pair of different classes of one table with Jaccard similarity of at least
    ``threshold``. Null, empty and short texts (fewer than ``least`` distinct n-grams) are in neither; a row given twice
    counts once. No pair is lost: the threshold is the fraction that ``threshold`` writes, the bounds that prune are computed
    in integers, and every pair that remains is verified.
    """
    ship(df.sparkSession)
    t = Fraction(str(threshold)).limit_denominator(10_000)
    if not 0 < t <= 1:
        raise ValueError("needs a threshold above 0 and at most 1")
    src = df.select("tbl", "id", "t").where("t is not null and id is not null and tbl is not null")
    names = sorted(r["tbl"] for r in df.select("tbl").where("tbl is not null").distinct().collect())  # the few tables that are joined
    number = F.lit(None).cast("int")
    for i, name in enumerate(names):
        number = F.when(F.col("tbl") == name, i).otherwise(number)
    texts = long_enough(src.select(number.alias("tb"), F.col("id").cast("long").alias("id"), "t"), least)
    described = cut(described_sets(texts, size, least))
    sets = described.where("chunk is null").select("tb", "id", "sig")
    # rows of one signature hold the same set; its smallest id stands for it, and only ids and signatures are shuffled
    classes = sets.groupBy("tb", "sig").agg(F.min("id").alias("rep"))
    members = cut(sets.join(classes, ["tb", "sig"]).select("tb", "id", "rep").distinct(), drop=True)
    others = cut(members.where("id <> rep").select("tb", "id"))
    cand = cut(candidate_pairs(_without(texts, others), size, least, frequency_sketch(described), t), drop=True)
    used = cut(cand.select("tb", F.explode(F.array("a", "b")).alias("id")).distinct(), drop=True)
    slim = _among(texts, used).dropDuplicates(["tb", "id"])
    pairs = cut(verified_pairs(cand, slim, size, t), drop=True)
    tbl = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("tb") + 1) if names else F.lit(None).cast("string")
    members = members.select(tbl.alias("tbl"), "id", "rep")
    return members, pairs.select(tbl.alias("tbl"), "a", "b", "jaccard")


def expand_pairs(members: DataFrame, links: DataFrame, rows_per_task: int = 2000) -> DataFrame:
    """All pairs (tbl, id_a < id_b) of rows in one class or in linked classes.

    A class with many rows is salted on its left side and repeated per salt on its right, so that no task gathers it.
    """
    sizes = members.groupBy("tbl", "rep").agg(F.count(F.lit(1)).alias("n"))
    same = sizes.where("n > 1").select("tbl", F.col("rep").alias("a"), F.col("rep").alias("b"), F.col("n").alias("left_n"))
    other = links.select("tbl", "a", "b").join(sizes.select("tbl", F.col("rep").alias("a"), F.col("n").alias("left_n")), ["tbl", "a"])
    both = same.unionByName(other).withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("left_n") / rows_per_task).cast("int") - 1)))
    salted = members.join(sizes, ["tbl", "rep"]).select("tbl", F.col("rep").alias("a"), F.col("id").alias("x"), F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / rows_per_task)).cast("int").alias("salt"))
    left = both.join(salted, ["tbl", "a", "salt"])
    out = left.join(members.select("tbl", F.col("rep").alias("b"), F.col("id").alias("y")), ["tbl", "b"])
    out = out.where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return out.select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

