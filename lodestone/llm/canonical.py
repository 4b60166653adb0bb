"""Mapping of free-entered values to the entries of a reference list.

A symmetric-delete dictionary of the reference names (bounded by the list) is broadcast; each value looks up its own
deletions, candidates are verified with a weighted Damerau-Levenshtein distance and ranked by distance and by how often
the entry is written exactly in the data. Designations (the parts with digits) and chemical formulas must agree exactly.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import ship

#: Placeholders that say a value is missing, lower-cased.
MISSING = ("", "-", "--", "n/a", "na", "none", "null", "nan", "unknown", "?", "not given", "unspecified", "tbd")
#: Words within a name that do not tell materials apart.
FILLERS = frozenset("alloy grade type no nr num number".split())
#: Words that say a value is only compared with an entry.
UNLIKE = frozenset("like equivalent similar based style analogue substitute free".split())
_ELEMENTS = frozenset(
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi".split()
)
_DIGITS = str.maketrans("₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹", "01234567890123456789")
_PART = re.compile(r"([A-Z][a-z]?)(\d*(?:\.\d+)?)")
_TOKEN = re.compile(r"[a-z]+(?:\d[a-z\d.]*[a-z\d]|\d)?|\d[a-z\d.]*[a-z\d]|\d")
#: Extra words beside a name may hold digits only as a size or a lot.
_SIZE = re.compile(r",?\s*\b\d+(?:\.\d+)?\s*(?:mm|µm|um|nm|cm|m|in|inch|%)\b|\b(?:batch|lot|heat|sample|specimen|no\.?|#)\s*[a-z]?\d*[a-z]?\b")


def fold(value: str) -> str:
    """One spelling of characters: plain digits, hyphens and blanks, no quotes or trade marks."""
    s = unicodedata.normalize("NFKC", value.translate(_DIGITS).replace("®", "").replace("™", ""))
    s = re.sub("[‐-―−_·∙•]", "-", s)
    return re.sub(r"\s+", " ", s.replace('"', "").replace("“", "").replace("”", "")).strip(" '’")


def formula(text: str) -> tuple[tuple[str, str], ...] | None:
    """Sorted (element, number) parts if the whole text is a chemical formula of at least two elements."""
    s = re.sub(r"[\s\-·,]", "", text)
    parts = _PART.findall(s)
    if len(parts) < 2 or "".join(a + b for a, b in parts) != s or any(a not in _ELEMENTS for a, _ in parts) or len({a for a, _ in parts}) < 2:
        return None
    return tuple(sorted(parts))


def weighted_distance(a: str, b: str) -> float:
    """Damerau-Levenshtein distance (adjacent transpositions); doubled letters and transpositions cost less."""
    n, m = len(a), len(b)
    d = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        d[i][0] = float(i)
    for j in range(1, m + 1):
        d[0][j] = float(j)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            drop = 0.7 if i > 1 and a[i - 1] == a[i - 2] else 1.0
            add = 0.7 if j > 1 and b[j - 1] == b[j - 2] else 1.0
            best = min(d[i - 1][j] + drop, d[i][j - 1] + add, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and a[i - 1] != b[j - 1]:
                best = min(best, d[i - 2][j - 2] + 0.8)
            d[i][j] = best
    return d[n][m]


def deletions(word: str, edits: int) -> set[str]:
    out = {word}
    level = {word}
    for _ in range(edits):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out |= level
    return out


def split_name(tokens: list[str]) -> tuple[str, str]:
    """(letters, designation): the parts without and with digits, each joined; order between the two is free."""
    return "".join(t for t in tokens if not any(c.isdigit() for c in t)), "".join(t for t in tokens if any(c.isdigit() for c in t))


class Dictionary:
    """Symmetric-delete index of a reference list; its size is bounded by the list."""

    def __init__(self, rows: list[tuple[int, str, str | None]], edits: int = 1, least: int = 5, frequency: dict[int, int] | None = None):
        self.edits, self.least, self.frequency = edits, least, frequency or {}
        self.formulas: dict = {}
        self.plain: dict[str, int] = {}
        self.index: dict[tuple[str, str], set[tuple[str, int]]] = {}
        self.designations: set[str] = set()
        for number, canonical, others in rows:
            for name in [canonical, *re.split(r"\s*;\s*", others or "")]:
                if not name:
                    continue
                f = fold(name)
                if f and (parts := formula(f)):
                    self.formulas[parts] = number
                    self.plain[self.compact(f)] = number
                    continue
                letters, mark = split_name(_TOKEN.findall(f.lower()))
                # a glued designation such as the letters and digits of a short code is kept as one
                glued = self.compact(f)
                self.plain.setdefault(glued, number)
                self.designations.add(mark)
                for w in deletions(letters, edits if len(letters) >= least else 0):
                    self.index.setdefault((w, mark), set()).add((letters, number))

    @staticmethod
    def compact(s: str) -> str:
        return re.sub(r"[^a-z0-9.]", "", s.lower())

    def _rank(self, letters: str, mark: str) -> list[tuple[float, int, int]]:
        found = set()
        for w in deletions(letters, self.edits if len(letters) >= self.least - 1 else 0):
            found |= self.index.get((w, mark), set())
        out = []
        for name, number in found:
            if name == letters:
                out.append((0.0, -self.frequency.get(number, 0), number))
            elif len(name) >= self.least and (x := weighted_distance(letters, name)) <= self.edits:
                out.append((x, -self.frequency.get(number, 0), number))
        return sorted(out)

    def _window(self, tokens: list[str]) -> tuple[float, int, int] | None:
        if (n := self.plain.get("".join(tokens))) is not None:
            return (0.0, -self.frequency.get(n, 0), n)
        letters, mark = split_name(tokens)
        tries = [(letters, mark)] if letters and mark else []
        if len(tokens) == 1 or not letters:
            # name and designation written together: every known designation that ends the word is tried
            whole = "".join(tokens)
            tries += [(whole[:-k], whole[-k:]) for k in range(1, min(7, len(whole))) if whole[-k:] in self.designations and whole[:-k].isalpha()]
        elif letters and mark and mark[0].isalpha():
            # a designation of letters and digits may have swallowed the end of the name, and the other way round
            whole = letters + mark
            tries += [(whole[:-k], whole[-k:]) for k in range(1, min(7, len(whole))) if whole[-k:] in self.designations and whole[:-k].isalpha()]
        ranked = [r for t in tries for r in self._rank(*t)]
        return min(ranked) if ranked else None

    def match(self, value: str) -> int:
        """Reference number meant by ``value``, or 0."""
        f = fold(value)
        if (n := self.plain.get(self.compact(f))) is not None:
            return n
        lowered = f.lower()
        if UNLIKE & set(re.findall("[a-z]+", lowered)):
            return 0
        words = f.split()
        # a formula may stand among plain words
        for size in range(len(words), 0, -1):
            for i in range(len(words) - size + 1):
                rest = words[:i] + words[i + size :]
                number = self.formulas.get(formula(" ".join(words[i : i + size]).strip(",;")))
                if number is not None and not any(map(formula, rest)) and not any(c.isdigit() for c in _SIZE.sub("", " ".join(rest).lower())):
                    return number
        tokens = _TOKEN.findall(lowered)
        tokens = [t for t in tokens if t not in FILLERS]
        best = None
        for size in range(len(tokens), 0, -1):
            for i in range(len(tokens) - size + 1):
                rest = " ".join(tokens[:i]) + " | " + " ".join(tokens[i + size :])
                if any(c.isdigit() for c in _SIZE.sub(" ", rest)):
                    continue
                w = tokens[i : i + size]
                if (n := self.plain.get("".join(w))) is not None:
                    return n
                r = self._window(w)
                if r and (best is None or (r[0], -size, r[1]) < best[0]):
                    best = ((r[0], -size, r[1]), r[2])
        return best[1] if best else 0


#: Characters of names of a list that may be broadcast; its delete index takes about forty times as many bytes.
MOST_BYTES = 2 << 20


def map_to_list(df: DataFrame, value: str, rows: list[tuple[int, str, str | None]], out: str = "reference_id", edits: int = 1, frequency: dict[int, int] | None = None) -> DataFrame:
    """Add ``out`` (int): the number of the reference entry meant by ``value``, 0 if the list has none, null if missing.

    Missing are null, empty, blank and placeholder values. Ties go to the closer, then the more frequent, then the
    smaller entry. Narrow: the value column passes through Arrow with a cache per task, nothing is shuffled. The list is
    broadcast, so its names may come to ``MOST_BYTES`` at most.
    """
    if sum(len(name) + len(other or "") for _, name, other in rows) > MOST_BYTES:
        raise ValueError("the reference list is too large to be broadcast")
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(Dictionary(rows, edits, frequency=frequency))
    fields = df.schema.fieldNames()
    at = fields.index(value)

    def look_up(batches):
        d = shared.value
        cache: dict[str | None, int | None] = {}
        for b in batches:
            got = []
            for v in b.column(at).to_pylist():
                if v not in cache:
                    if len(cache) > 500_000:
                        cache.clear()
                    cache[v] = None if v is None or v.strip().lower() in MISSING else d.match(v)
                got.append(cache[v])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.int32())], names=[*fields, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(look_up, f"{schema}, `{out}` int")


def exact_frequency(df: DataFrame, value: str, rows: list[tuple[int, str, str | None]]) -> dict[int, int]:
    """How often each entry is written exactly: at most one row per entry reaches the driver."""
    names = {c: n for n, c, _ in rows}
    got = df.where(F.col(value).isin(*names)).groupBy(value).agg(F.count(F.lit(1)).alias("n")).collect()
    return {names[r[value]]: r["n"] for r in got}
