import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import canonical, consensus, encode, leaks, pairs, scans, split, visual

WORDS = "laser grain pore melt pool scan hatch powder layer strain stress cooling rate phase field model heat source beam profile".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


# problem 2
ROWS = [(1, "Corvanil 612", "CV612; CV-612"), (2, "Ti5Al3Mo", None), (3, "HfMoNbW", None), (4, "alumina-zirconia AZ30", "AZ30 ceramic"), (5, "Corvanil 640", None)]


@pytest.mark.parametrize(
    ("value", "number"),
    [("corvanil-612", 1), ("612 Corvanil", 1), ("wrought Corvnail612 sheet, 2 mm", 1), ("cv-612 (as-built)", 1), ("Corvanil® grade 612", 1), ("Ti₅Al₃Mo powder", 2), ("Ti5-Al3-Mo", 2), ("Ti6Al3Mo", 0), ("W-Nb-Mo-Hf sheet, 2 mm", 3), ("HFMONBW", 3), ("AZ30 ceramic", 4), ("alumina-zircona AZ30", 4), ("Corvanil 633", 0), ("Corvanil", 0), ("titanium", 0), ("Corvanil 6121", 0), ("CV612-like", 0), ("x" * 20_000, 0)],
)
def test_canonical_values(value, number):
    assert canonical.Dictionary(ROWS).match(value) == number


def test_map_to_list_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "Unknown"), (5, "CV612"), (5, "CV612")], "reference int, v string")
    got = canonical.map_to_list(df, "v", ROWS)
    assert sorted((r["reference"], r["reference_id"]) for r in got.where("reference_id is not null").collect()) == [(5, 1), (5, 1)]
    assert canonical.map_to_list(df.limit(0), "v", ROWS).count() == 0


def test_weighted_distance_bounds_plain_edits():
    assert canonical.weighted_distance("corvanil", "corvnail") == pytest.approx(0.8)
    assert canonical.weighted_distance("corvanil", "corvannil") == pytest.approx(0.7)
    assert canonical.weighted_distance("corvanil", "zirconel") > 2


# problem 3
def brute(texts, size, t, least):
    def grams(x):
        w = re.findall("[a-z0-9]+", (x or "").lower())
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}

    s = {k: g for k, x in texts.items() if len(g := grams(x)) >= least}
    return {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) * 10 >= round(t * 10) * len(s[a] | s[b])}


@pytest.mark.parametrize(("size", "t", "least"), [(3, 0.6, 20), (5, 0.8, 1)])
def test_similarity_join_is_exact(spark, size, t, least):
    rng = random.Random(size)
    texts = {0: None, 1: "", 2: "one two", 3: " \n "}
    for k in range(10, 90):
        if k % 3 and k > 12:
            base = texts[rng.choice([x for x in texts if x >= 10])].split()
            for _ in range(rng.randrange(8)):
                base[rng.randrange(len(base))] = rng.choice(WORDS)
            texts[k] = " ".join(base)
        else:
            texts[k] = prose(rng, rng.randrange(25, 90))
    df = spark.createDataFrame([("x", k, v) for k, v in texts.items()] + [("x", 11, texts[11])], "tbl string, id long, t string").repartition(3)
    got = pairs.expand_pairs(*pairs.similar_classes(df, size, t, least)).collect()
    assert {(r["id_a"], r["id_b"]) for r in got} == brute(texts, size, t, least)
    assert len(got) == len({tuple(r) for r in got})


def test_similarity_join_with_one_hot_group(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 8)
    rng = random.Random(5)
    base = prose(rng, 60).split()
    texts = {}
    for k in range(60):
        w = list(base)
        w[rng.randrange(60)] = f"edit{k}"
        texts[k] = " ".join(w)
    for k in range(60, 90):
        texts[k] = texts[0]
    df = spark.createDataFrame([("x", k, v) for k, v in texts.items()], "tbl string, id long, t string")
    got = pairs.expand_pairs(*pairs.similar_classes(df, 3, 0.6, 20), rows_per_task=7).collect()
    assert {(r["id_a"], r["id_b"]) for r in got} == brute(texts, 3, 0.6, 20)


def near_copies(rng, n, words):
    """Texts in pairs that differ in one word, and a few exact copies."""
    texts = {}
    for k in range(0, n, 2):
        w = prose(rng, words).split()
        texts[k] = " ".join(w)
        w[rng.randrange(words)] = f"edit{k}"
        texts[k + 1] = " ".join(w) if k % 10 else texts[k]
    return texts


def test_similarity_join_keeps_less_than_its_sets(spark):
    import os

    texts = near_copies(random.Random(8), 1200, 300)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    kept = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)
    df = spark.createDataFrame([("x", k, v) for k, v in texts.items()], "tbl string, id long, t string").repartition(2)
    before = kept()
    got = pairs.expand_pairs(*pairs.similar_classes(df, 3, 0.6, 20)).count()
    assert got == 600 and kept() - before < 6 * 298 * 1200  # three quarters of what the n-grams of the sets take


@pytest.mark.parametrize("most", [0, 300_000])
def test_similarity_join_in_rounds_with_ids_not_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(pairs, "ROUND", 500)
    monkeypatch.setattr(pairs, "MOST_ROWS", most)
    texts = near_copies(random.Random(9), 60, 40)
    df = spark.createDataFrame([("x", k, v) for k, v in texts.items()] + [("y", 5, texts[0]), ("y", -6, texts[1])], "tbl string, id long, t string")
    got = {(r["tbl"], r["id_a"], r["id_b"]) for r in pairs.expand_pairs(*pairs.similar_classes(df, 3, 0.6, 20)).collect()}
    assert got == {("x", a, b) for a, b in brute(texts, 3, 0.6, 20)} | {("y", -6, 5)}


def test_cut_drops_its_shuffle_files(spark):
    import time

    from lodestone.session import cut

    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|").count("shuffle_")
    before = files()
    got = cut(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), drop=True)
    for _ in range(100):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and got.agg(F.sum("count")).first()[0] == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_similarity_join_empty(spark):
    df = spark.createDataFrame([], "tbl string, id long, t string")
    assert pairs.expand_pairs(*pairs.similar_classes(df)).count() == 0


def test_parity_bitmap_bounds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = np.unique(rng.integers(0, 400, 80)) * 7919, np.unique(rng.integers(0, 400, 80)) * 7919
        differ = np.bitwise_count((pairs.parity_bitmap(a) ^ pairs.parity_bitmap(b)).view(np.uint64)).sum()
        assert differ <= len(np.setxor1d(a, b))


# problem 5
def test_dominant_consensus_takes_the_most_trusted(spark):
    rows = [(1, "title", 10, "a b c d", 1), (1, "title", 11, "a b x d", 5), (1, "title", 12, "a b c d", 4), (1, "title", 9, "a b x d", 5), (2, "title", 7, "z", 0)]
    df = spark.createDataFrame(rows, "g long, field string, row long, value string, trust int")
    assert {(r["g"], r["row"]) for r in consensus.consensus_survivors(df).collect()} == {(1, 11), (2, 7)}


def test_voted_consensus_takes_the_common_value(spark):
    rows = [(1, "t", i, v, 1) for i, v in enumerate(["the melt pool is wide", "the melt pool is wide", "the melt pol is wide", "melt pool is very wide", "the melt pool iz wide"])]
    df = spark.createDataFrame(rows, "g long, field string, row long, value string, trust int")
    assert [r["row"] for r in consensus.consensus_survivors(df, dominant=False).collect()] == [1]


def test_consensus_of_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(consensus, "BLOCK", 4)
    rng = random.Random(2)
    rows = [(1, "t", i, " ".join(["a", "b", rng.choice("cdefgh"), "i", str(i)]), i % 5) for i in range(120)]
    df = spark.createDataFrame(rows, "g long, field string, row long, value string, trust int")
    assert [r["row"] for r in consensus.consensus_survivors(df).collect()] == [119]
    assert consensus.consensus_survivors(df.limit(0)).count() == 0


def test_usable(spark):
    df = spark.createDataFrame([("no title", "10.1234/x", "2020", "Full text."), ("scan_1.pdf", "10.1234", "1979", "Cut off..."), ("How x", "doi:10.1234/AB", "0000", "Cut [...]"), (None, None, None, None), ("  A b ", "https://doi.org/10.1234/q", " 1980 ", "cut mid")], "t string, d string, y string, a string")
    ok = df.select(consensus.usable_title(F.col("t")), consensus.usable_doi(F.col("d")), consensus.usable_year(F.col("y")), consensus.usable_abstract(F.col("a"))).collect()
    assert [tuple(bool(x) for x in r) for r in ok] == [(False, True, True, True), (False, False, False, False), (True, True, False, False), (False, False, False, False), (True, True, True, False)]


# problem 6
def test_scan_repair(spark):
    clean = "The melt pool of the laser moves along the surface and the surface cools. " * 40
    pages = [(i, f"c{i}.pdf", 1, clean) for i in range(6)]
    head = "Journal of Beams, Vol. 3"
    for n in (1, 2, 3):
        pages.append((100 + n, "s.pdf", n, f"{head}\nThe melt pool of the 1aser moves along the sur-\nface and well\nthe 5urface cools.\n- {n + 40} -"))
    pages += [(200, "n.pdf", 1, None), (201, "n.pdf", 2, ""), (202, None, None, " \r\n ")]
    df = spark.createDataFrame(pages, "page_id long, filename string, page_num int, text string").repartition(2)
    rows = {r["page_id"]: r for r in scans.repair_scans(df, "page_id", "filename", "text").collect()}
    for n in (1, 2, 3):
        r = rows[100 + n]
        assert {(x["kind"], x["item"]) for x in r["repairs"]} == {("header", head), ("number", f"- {n + 40} -"), ("hyphen", "surface"), ("char", "laser"), ("char", "surface")}
        assert r["text"] == "The melt pool of the laser moves along the surface and well the surface cools."
    assert rows[200]["text"] is None and rows[201]["text"] == "" and rows[202]["text"] == ""
    assert not rows[0]["repairs"]


def test_own_hyphens_stay():
    counts = {"well-developed": 50, "surface": 50}

    def join(a, b):
        return scans.joined_word(a, b, lambda w: counts.get(w, 0))

    assert join("well", "developed") == "well-developed"
    assert join("sur", "face") == "surface"
    assert join("un", "seen") == "unseen"
    assert join("sur", "facc") == "surface"


# problem 7
@pytest.mark.parametrize("rule", [split.latest_boundary, split.cohesion_boundary])
def test_pieces(rule):
    rng = random.Random(7)
    for _ in range(60):
        t = "".join(rng.choice(["word ", "a", ". ", "!\n", "\n\n", "\n \t\n", "é😀", "  "]) for _ in range(rng.randrange(300, 2500)))
        if len(t) <= 1000:
            continue
        p = split.pieces(t, 1000, 100, 500, rule)
        assert p[0][0] == 0 and p[-1][1] == len(t)
        for (s, e), (s2, _) in zip(p, p[1:], strict=False):
            assert s + 500 < e <= s + 1000 and s2 == e - 100


def test_latest_boundary_equals_the_rule():
    rng = random.Random(8)
    for _ in range(300):
        t = "".join(rng.choice(["ab", " ", ".", "\n", "\n\n", "\r\n", "\t", "? "]) for _ in range(400))
        lo, hi = 50, 120
        kinds = [r"(?<=\n)[ \t\r]*\n", r"[.!?][ \t\r\n]", r"[ \t\r\n]"]
        expect = next((max(e) for k in kinds if (e := [m.end() for i in range(len(t)) if (m := re.compile(k).match(t, i)) and lo < m.end() <= hi])), hi)
        assert split.latest_boundary(t, lo, hi) == expect


def test_split_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a" * 1000), (4, "a" * 1001), (4, "a" * 1001)], "k long, t string")
    got = sorted(tuple(r) for r in split.split_oversized(df, "k", "t").collect())
    assert got == [(4, 1, 0, 1000), (4, 2, 900, 1001)]


# problem 8
@pytest.fixture(scope="module")
def encoder():
    pytest.importorskip("public_tokenizers")
    return encode.Encoder(*encode.public_vocabulary())


def test_perfect_hash(encoder):
    assert encoder.table.lookup(list(encoder.ranks)) == list(encoder.ranks.values())
    assert encoder.table.lookup([b"", b"no such token at all", b"\xff\xfe\xfd"]) == [-1, -1, -1]
    small = encode.MinimalPerfectHash([b"a", b"bc"], [5, 6])
    assert small.lookup([b"bc", b"a", b"x"]) == [6, 5, -1]


def test_encoding_equals_the_library(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(9)
    texts = ["", "<|endoftext|> x", "naïve 😀😀", "日本語 текст", " \t\r\n  ", "a" * 5000] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF)])) for _ in range(200)) for _ in range(40)]
    assert encoder.encode_batch(texts) == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_encode_corpus_edges(spark, encoder):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "melt pool"), (3, "melt pool")], "k long, t string")
    got = sorted((r["k"], list(r["ids"])) for r in encode.encode_corpus(df, "k", "t").collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and len(got[2][1]) > 0


# problem 9
def test_leaks(spark):
    item = "A stepped plate of Hestralloy C71 is kept for 56 seconds below a 926 watt beam while the wear track moved 17 micrometres away"
    other = item.replace("Hestralloy C71", "Nimbrax 90").replace("56", "31").replace("926", "400")
    docs = [(1, "Intro. " + item.upper() + " end"), (2, other), (3, " ".join(item.split()[:11])), (4, None), (5, ""), (6, "zz " + " ".join(item.split()[3:15]) + " zz"), (6, "zz " + " ".join(item.split()[3:15]) + " zz")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(9, item), (8, "another quite different text of Hestralloy steel"), (7, None)], "item_id long, text string")
    assert {tuple(r) for r in leaks.leaked_items(d, "doc_id", q, "item_id").collect()} == {(1, 9), (6, 9)}
    assert {r["doc_id"] for r in leaks.reparameterised_items(d, "doc_id", q, "item_id").collect()} == {2}
    assert leaks.leaked_items(d.limit(0), "doc_id", q, "item_id").count() == 0


# problem 10
def test_visual_form_equals_string_methods():
    def plain(t):
        return unicodedata.normalize("NFC", "".join(visual._expansion(c) for c in t))

    rng = random.Random(10)
    pool = "aeAéßñçöẠ̧̊́̈ﬁﬀ​­﻿  　ＡＢｃ１！АВсоΩΩ²½ ё̆й\n\t"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(400)] + [None, "", "​"]
    got = visual.visual_form(pa.array(texts)).to_pylist()
    assert got == [None if t is None else plain(t) for t in texts]
    assert visual.visual_form(pa.array(texts).slice(5, 7)).to_pylist() == got[5:12]
    assert visual.visual_form(pa.array([], pa.string())).to_pylist() == []


def test_look_alike_pairs(spark):
    rows = [(1, "ﬁne café"), (2, "fine café"), (3, "fine cafe"), (4, "fine café"), (5, "Fine café"), (6, "x²"), (7, "x2"), (8, "​"), (9, "﻿"), (10, None), (11, "ﬁne café"), (12, "сор"), (13, "cop"), (13, "cop")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in visual.look_alike_pairs(df, "doc_id", "text", rows_per_task=2).collect()}
    assert got == {(1, 2), (1, 4), (2, 4), (2, 11), (4, 11), (12, 13)}


def test_alignment_of_agreeing_ends_is_as_good():
    def score(a, b, steps):
        return sum(-1 if i is None or j is None else 2 if a[i] & b[j] else -1.5 for i, j in steps)

    rng = random.Random(4)
    for _ in range(200):
        a, b = ([frozenset(rng.choice("abcd")) for _ in range(rng.randrange(9))] for _ in range(2))
        steps = consensus.align(a, b)
        assert [i for i, _ in steps if i is not None] == list(range(len(a))) and [j for _, j in steps if j is not None] == list(range(len(b)))
        assert score(a, b, steps) == score(a, b, consensus._align(a, b))


def test_token_distance_equals_the_plain_one():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[:], i
            for j, y in enumerate(b, 1):
                row[j] = min(old[j - 1] + (x != y), old[j] + 1, row[j - 1] + 1)
        return row[-1]

    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        assert consensus.token_distance(a, b) == plain(a, b)


@pytest.mark.parametrize("threshold", [0.7, 0.9, 1.0])
def test_a_similarity_of_exactly_the_threshold_counts(spark, threshold):
    size = 10
    common = round(threshold * size)
    # sets of single words: common / size is the threshold, as is 1 for equal sets
    a = [f"w{i}" for i in range(size)]
    b = a[:common]
    df = spark.createDataFrame([("x", 1, " ".join(a)), ("x", 2, " ".join(b)), ("x", 3, " ".join([*a[: common - 1], "z"]))], "tbl string, id long, t string")
    got = {(r["id_a"], r["id_b"]) for r in pairs.expand_pairs(*pairs.similar_classes(df, 1, threshold, 1)).collect()}
    assert (1, 2) in got and (1, 3) not in got


def test_sets_with_thousands_of_common_elements(spark):
    a = " ".join(f"w{i}" for i in range(3000))
    df = spark.createDataFrame([("x", 1, a), ("x", 2, a + " more")], "tbl string, id long, t string")
    assert pairs.expand_pairs(*pairs.similar_classes(df, 1, 0.9, 1)).count() == 1


def test_valleys_lie_between_their_own_peaks():
    assert split.valley_depths([0.5, 0.1, 0.4, 0.3, 0.9]) == pytest.approx([0.0, 0.7, 0.0, 0.7, 0.0])


def test_cohesion_finds_planted_topics():
    rng = random.Random(11)
    topics = ["laser beam melt pool vapour keyhole spatter".split(), "grain texture twin boundary dislocation orientation phase".split()]
    right = 0
    for _ in range(40):
        first = [rng.choice(topics[0]) for _ in range(110)]
        second = [rng.choice(topics[1]) for _ in range(110)]
        say = lambda w: "".join(" ".join(w[i : i + 9]) + ". " for i in range(0, len(w), 9))
        t = say(first) + say(second)
        border = len(say(first))
        (_, e), *_ = split.pieces(t, 1000, 100, 500, split.cohesion_boundary)
        right += abs(e - border) <= 60 or not 500 < border <= 1000
    assert right >= 36


def test_planted_reparameterised_items(spark):
    """Precision and recall on items whose numbers, names and units were replaced, beside copies and inconsistent ones."""
    rng = random.Random(6)
    names = ["Hestralloy", "Quorvium", "Nimbrax", "Tungavar", "Vitrumax"]

    def item(i):
        w = ["".join(rng.choices("bdfgklmnprtv", k=6)) for _ in range(6)]
        return f"A {w[0]} plate of {{n}} was {w[1]} for {{a}} seconds and {w[2]} below a {{b}} watt beam, then {w[3]} over {{a}} seconds while {{n}} was {w[4]} and {w[5]} case{chr(97 + i % 26)} again"

    items, docs, want = [], [], set()
    for i in range(30):
        t = item(i)
        given = {"n": rng.choice(names), "a": 11 + i, "b": 500 + i}
        items.append((i, t.format(**given)))
        kind = i % 3
        other = {"n": rng.choice([x for x in names if x != given["n"]]), "a": 211 + i, "b": 900 + i}
        if kind == 0:
            docs.append((i, "Before. " + t.format(**other) + " After."))
            want.add((i, i))
        elif kind == 1:
            docs.append((i, t.format(**given)))
        else:  # replaced in one place and kept in another
            docs.append((i, t.replace("{a}", str(given["a"]), 1).format(**(given | {"a": other["a"]}))))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.reparameterised_items(d, "doc_id", q, "item_id").collect()}
    assert got == want


def test_texts_in_their_visual_form(spark):
    df = spark.createDataFrame([(1, "ﬁne café"), (2, None), (3, "")], "k long, t string")
    assert {tuple(r) for r in visual.visual_texts(df, "k", "t").collect()} == {(1, "fine café"), (2, None), (3, "")}


def test_rows_of_numbers_are_no_template(spark):
    d = spark.createDataFrame([(1, " ".join(map(str, range(40))))], "doc_id long, text string")
    q = spark.createDataFrame([(7, " ".join(map(str, range(50, 90))))], "item_id long, text string")
    assert leaks.reparameterised_items(d, "doc_id", q, "item_id").count() == 0
    q = spark.createDataFrame([(7, " ".join(map(str, range(20, 90))))], "item_id long, text string")
    assert leaks.leaked_items(d, "doc_id", q, "item_id").count() == 1


def test_new_names_decimals_and_variants_are_found(spark):
    item = "In the shop a plate of Hestralloy is kept for 3.5 seconds below a 926 watt beam"
    long = "We saw how the plate of Hestralloy was kept for 56 seconds below a beam of 926 watt until it moved away"
    docs = [
        (1, item.replace("Hestralloy", "Quorvium")),
        (2, item.replace("3.5", "4")),
        (3, long.replace("56", "31") + " and then nothing more. " + long.replace("56", "77")),
        (4, long.replace("56", "31").replace("Hestralloy", "quorvium")),
        (5, item),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(8, item), (9, long)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.reparameterised_items(d, "doc_id", q, "item_id").collect()}
    assert got == {(1, 8), (2, 8), (3, 9), (4, 9)}


def test_words_are_those_of_the_pattern():
    rng = random.Random(12)
    pool = "aZ09 -_.,éÄßİKſ²Ⅷ漢 ​\n'"
    for _ in range(500):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(40)))
        assert [w.decode() for w in pairs.words_of(t)] == re.findall("[a-z0-9]+", t.lower())
