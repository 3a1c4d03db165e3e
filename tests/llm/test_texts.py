"""Operators on texts against brute force, libraries and literal cases, with nulls, empty texts, ties and clashing columns."""

import random
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlake.functions.forms import shapes
from ledgerlake.llm import boilerplate, bpe, lookalike, neardup, packing, quality, sentences

ODD = ["", None, " ", "\n\n", "a", "Å" * 3000, "ab" * 2000, "財務部門は売掛金" * 300, "x <|endoftext|> it's I'LL  a\x1c b\n  c", "😀😀 é é", "1 2,3\t4"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, "clash", 5) for k, t in enumerate(ODD)] + [(0, "", "again", 1)], "doc_id long, text string, ids string, _id int")


def test_ids_match_the_library(odd):
    library = Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/{bpe.VOCABULARY}.json")
    library.encode_special_tokens = True
    want = {k: library.encode(t, add_special_tokens=False).ids if t else [] for k, t in enumerate(ODD)}
    got = bpe.encode_texts(odd).collect()
    assert len(got) == len(ODD) + 1 and all(list(r.ids) == want[r.doc_id] for r in got)
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(odd).collect()} == {k: len(v) for k, v in want.items()}


def test_merges_match_a_plain_loop():
    rng = random.Random(4)
    ranks = {bytes([b]): b for b in range(97, 101)}
    while len(ranks) < 60:
        ranks.setdefault(rng.choice(list(ranks)) + rng.choice(list(ranks)), 97 + len(ranks))
    encoder = bpe.Encoder(ranks)
    for _ in range(300):
        piece = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 40)))
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while True:
            pairs = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if piece in ranks or not pairs:
                break
            k = min(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert encoder.merge(piece) == ([ranks[piece]] if piece in ranks else [ranks[p] for p in parts])


def test_containers(spark):
    rng = np.random.default_rng(2)
    sizes = [0, None, 2048, 2049, 10_000, 1, *map(int, np.clip(rng.lognormal(6, 0.9, 700), 1, 5000))]
    items = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long")
    rows = packing.pack_items(items, len(sizes), group_items=256).collect()
    held, used = defaultdict(list), defaultdict(int)
    for r in rows:
        held[r.doc_id].append((r.piece, r.first, r.n_tokens))
        used[r.container] += r.n_tokens
    assert max(used.values()) <= 2048
    assert {k: sum(n for _, _, n in v) for k, v in held.items()} == {k: n for k, n in enumerate(sizes) if n}
    for k, pieces in held.items():
        assert [p for p, _, _ in sorted(pieces)] == list(range(-(-sizes[k] // 2048)))
        assert all(first == p * 2048 for p, first, _ in pieces)
    assert len(used) <= 1.05 * sum(n or 0 for n in sizes) / 2048 + 3
    assert packing.pack_items(items.limit(0), 0).count() == 0


def test_windows_within_capacity():
    """With and without the exchange: no window beyond the capacity, every item placed, and few windows more than the least."""
    rng = np.random.default_rng(6)
    for n, low, high in ((1, 1, 2047), (40, 700, 1100), (60, 1020, 1030), (500, 1, 2048), (300, 5, 50), (9, 2047, 2048)):
        sizes = np.sort(rng.integers(low, high, n))[::-1]
        for exchange in (True, False):
            window = packing.pack(sizes, 2048, exchange)
            assert len(window) == n and np.bincount(window, sizes).max() <= 2048 and set(window) == set(range(window.max() + 1))
        assert packing.pack(sizes, 2048).max() + 1 <= n
    few = rng.integers(1, 600, 1000)
    assert packing.pack(few, 2048).max() + 1 <= 1.01 * few.sum() / 2048 + 1


def test_quality_does_not_depend_on_the_cuts(spark):
    prose = "Bolaget ökade intäkterna med 5 %. Det var ett mycket bra år för alla.\n" * 4
    texts = {
        1: (prose, None), 2: ("- goodwill;\n- råvaror i Norden;\n- mål 2020;\n" * 5, "list"), 3: ("Post;2024;2023\nGoodwill;1,5;–\nVarulager;3;4\n" * 5, "table"),
        4: ("Risk ........ 3\nAktien ........... 14\n" * 6, "list"), 5: ("varumärken " * 50, "junk"), 6: ("PX5OsPv9RQkw5ECr3bxZN6wGPXH54Mg9c05fe6nuLOgvlkxPDWl0eyv1ZY9kxN6dV9" * 9, "junk"), 7: ("====== ,, ,, ~ ~ ~ ____ ���\n" * 9, "junk"),
        8: ("", None), 9: (" \n", None), 10: (None, None), 11: ("Kort", None), 12: ("| Kassa | 1 | 2 |\n| Lån | 3 | 4 |", "table"), 13: (prose + "- ett\n", None),
    }
    docs = spark.createDataFrame([(k, t, "x") for k, (t, _) in texts.items()], "doc_id long, text string, kind string")
    common = spark.createDataFrame([("sv", "det"), ("sv", "med"), (None, None)], "lang string, word string")
    whole = {r.doc_id: r for r in quality.quality(docs, common).collect()}
    assert {k: r.kind for k, r in whole.items()} == {k: kind for k, (_, kind) in texts.items()}
    for size, run in ((40, 2), (97, 3)):
        parts = {r.doc_id: r for r in quality.quality(docs, common, chunk=size, run=run).collect()}
        assert parts == whole
    assert whole[8].n_words == 0 and whole[10].n_chars == 0
    assert quality.quality(docs.limit(0), common).count() == 0


def test_quality_is_equal_for_random_cuts():
    """Every statistic, over texts with runs of blanks, long tokens, repeated words and closing signs, whole and merged from chunks in any order of merging."""
    rng = random.Random(5)
    pieces = ["ord", "Det gick bra.", " " * 60, "\n", "\n\n", "5 320", "(not 3)", "; ", " | ", "\t", "”", ".", " ....... 14", "- ett", "x" * 70, "財務部門は売掛金。", "och,", "\u00a0\u00a0", "Ã", "กำไร", "bcdfghjklm", "1) två"]
    common = frozenset(["och", "det"])
    for n in range(400):
        some = rng.sample(pieces, rng.randrange(1, len(pieces)))
        text = rng.choice(["", " "]).join(rng.choice(some) for _ in range(rng.randrange(1, 150)))
        whole = quality.whole_text(text, common, 32)
        for size in (1, 7, 50, 300):
            states = [quality.state(x, common, 32) for x in quality.cut(text, size, 32)]
            assert "".join(quality.cut(text, size, 32)) == text
            while len(states) > 1:
                k = rng.randrange(len(states) - 1)
                states[k : k + 2] = [quality.merge(states[k], states[k + 1])]
            s = states[0]
            assert quality.result(s, len(text), len(s.vocabulary), len(s.pairs)) == whole, (n, size)


def test_quality_ends_and_repetition():
    no_words = frozenset()
    assert quality.whole_text("Det gick bra." + " " * 60 + "\nutan slut", no_words)[4] == 0.5
    names = ["".join(map(chr, (97 + k // 26, 97 + k % 26, 120))) for k in range(500)]
    for distinct, times, kind in ((40, 100, "junk"), (41, 100, "junk"), (500, 20, "junk"), (500, 1, None), (500, 2, None)):
        assert quality.whole_text("\n".join([" ".join(names[:distinct]) + "."] * times), no_words)[9] == kind
    assert quality.whole_text("och, och och.", frozenset(["och"]))[5] == 1.0


def test_repeated_lines(spark):
    rows = [(p, "d", n, f"Sidfot  {n} \n\nrad {p}\nÅRSREDOVISNING") for p, n in enumerate([1, 2, 3, 4, 5, 5, 6])] + [(20, "e", 1, "sidfot 1"), (21, "d", 7, None), (22, None, 8, "Sidfot 8"), (23, "d", 9, "")]
    df = spark.createDataFrame(rows, "page_id long, document string, page_number int, text string")
    found = boilerplate.repeated_lines(df, "page_id", "text", "document", "page_number")
    assert sorted((r.page_id, r.line_no) for r in found.collect()) == sorted((p, k) for p in range(7) for k in (1, 3, 4))
    left = {r.page_id: r.text for r in boilerplate.without_lines(df, found, "page_id", "text").collect()}
    assert left[0] == "" and left[20] == "sidfot 1" and left[21] is None and left[23] == "" and len(left) == len(rows)
    once = df.withColumn("day", F.lit("2024-01-01"))
    assert boilerplate.repeated_lines(once, "page_id", "text", "document", "page_number", "day", min_dates=2).count() == 0


def fold(text):
    same = shapes()

    def parts(c):
        if unicodedata.category(c) == "Cf":
            return ""
        how = unicodedata.decomposition(c)
        if how and (how[0] != "<" or how.split()[0] in ("<wide>", "<narrow>", "<noBreak>", "<font>") or 0xFB00 <= ord(c) <= 0xFB06):
            return "".join(parts(chr(int(x, 16))) for x in how.split() if x[0] != "<")
        return same.get(c, c)

    return None if text is None else " ".join(unicodedata.normalize("NFC", "".join(map(parts, text))).split())


LOOKS = ["Å ä", "Å ä", "Ｈｕｒ ８", "К⁠арасіtet", "ạ̈ ạ̈ q̣̇ q̣̇", "ﬁnans   x　", "x² x2 ½", "", " \t", None, "​", "é́ ́", "ﾊﾞ カﾞ", "ήταν; ά", "ÅŽ" * 3000, "각 한국", "\u1100\u1161\u11a8 \u1112\u1161\u11ab국", "각\u11a8 가\u11a8", "𝐀𝒷 ԼՍ ᎪᏴ"]


def test_one_form(spark):
    df = spark.createDataFrame([(k, t, "look") for k, t in enumerate(LOOKS)], "page_id long, text string, look string")
    got = {r.page_id: r.look for r in lookalike.one_form(df, "page_id", "text").collect()}
    assert {k: v and unicodedata.normalize("NFC", v) for k, v in got.items()} == {k: fold(t) for k, t in enumerate(LOOKS)}
    assert len({got[k] for k in (4,)}) == 1 and len(set(got[4].split()[:2])) == 1 and len(set(got[4].split()[2:])) == 1
    at = LOOKS.index("각 한국")
    assert got[at] == got[at + 1] == "각 한국" and got[at + 3] == "Ab LU AB"
    assert lookalike.one_form(df.limit(0), "page_id", "text").count() == 0


def test_classes_of_looks(spark):
    pages = [(1, "d", 1, "\u00c5 x"), (2, "d", 1, "A\u030a x"), (3, "d", 1, "\u00c5 x"), (4, "d", 2, "\u00c5 x"), (6, "d", 1, None), (7, None, 1, "\u00c5 x"), (8, "d", 1, "y")]
    df = spark.createDataFrame(pages, "page_id long, document string, page_number int, text string")
    got = sorted(map(tuple, lookalike.text_classes(df, "page_id", ["document", "page_number"], "text").collect()))
    assert got == [(1, 1, 3, 2), (2, 1, 3, 2), (3, 1, 3, 2), (4, 4, 1, 1), (8, 8, 1, 1)]
    rows = spark.createDataFrame([(1, "d", ["\u20135", None]), (2, "d", ["\u22125", None]), (3, "d", []), (4, None, ["1"])], "row_id long, document string, row_values array<string>")
    assert sorted(map(tuple, lookalike.value_classes(rows, "row_id", ["document"], "row_values").collect())) == [(1, 1, 2, 2), (2, 1, 2, 2), (3, 3, 1, 1)]


def test_components(spark):
    """A chain of links is one cluster however long; texts without links are their own; copies go with their class."""
    links = spark.createDataFrame([(k, k + 1, 0.9) for k in range(1, 30)] + [(50, 52, 0.9), (51, 52, 0.9)], "a long, b long, jaccard double")
    members = spark.createDataFrame([(k, k, 1) for k in [*range(1, 31), 50, 51, 52, 60]] + [(60, 61, 2)], "class long, id long, size long")
    got = dict(map(tuple, neardup.components(links, members).select("id", "cluster").collect()))
    assert got == {k: 1 for k in range(1, 31)} | {50: 50, 51: 50, 52: 50, 60: 60, 61: 60}


def test_same_looking_pairs(spark):
    pages = [(1, "d", 1, "Å x"), (2, "d", 1, "Å x"), (3, "d", 1, "Å x"), (4, "d", 2, "Å x"), (5, "d", 1, "A x"), (6, "d", 1, None), (7, None, 1, "Å x")]
    df = spark.createDataFrame(pages, "page_id long, document string, page_number int, text string")
    assert sorted(map(tuple, lookalike.same_looking_texts(df, "page_id", ["document", "page_number"], "text").collect())) == [(1, 2), (2, 3)]
    rows = [(1, "d", "a", ["–5", None]), (2, "d", "a", ["−5", None]), (3, "d", "a", ["−5", ""]), (4, "d", "a", ["5–6"]), (5, "d", "a", ["5-6"]), (6, "d", "a", None), (7, "d", "a", []), (8, "d", "a", ["-５", None])]
    values = spark.createDataFrame(rows, "row_id long, document string, label string, row_values array<string>")
    assert sorted(map(tuple, lookalike.same_looking_values(values, "row_id", ["document", "label"], "row_values").collect())) == [(1, 2), (1, 8), (2, 8)]


def test_near_duplicates(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(120)]
    for k in range(0, 60):
        words = texts[k].split()
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(", ".join(words).upper())
    texts += [None, "", "", "...", "ab", "AB!"]
    grams = [{f[i : i + 5] for i in range(len(f) - 4)} for f in (re.sub(r"[^a-z0-9]", "", (t or "").lower()) for t in texts)]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if grams[a] and len(grams[a] & grams[b]) >= 0.7 * len(grams[a] | grams[b])}
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "chunk_no long, text string, class string")
    links, members = neardup.near_duplicates(df, "chunk_no", "text", 0.7)
    got = {tuple(r) for r in neardup.all_pairs(links, members).collect()}
    without = {(a, b) for a, b in got if grams[a]}
    assert without <= want and len(without) >= 0.98 * len(want) > 20
    assert {(a, b) for a, b in got if not grams[a]} == {(181, 182), (181, 183), (182, 183), (184, 185)}
    assert neardup.class_links(links, members).count() == len(texts) - 1
    links, members = neardup.near_duplicates(df.limit(0), "chunk_no", "text", 0.7)
    assert neardup.all_pairs(links, members).count() == 0


def test_candidates_of_large_buckets(spark):
    """Forty rows share four levels of one tree and differ in the fifth: all their pairs are candidates, as those of few rows are."""
    for n in (10, 40):
        rows = [(k, 5, 5, [(7 << neardup.LEVEL_BITS) | k]) for k in range(n)]
        got = neardup.candidates(spark.createDataFrame(rows, "id long, s1 long, s2 long, keys array<long>"), 0.7, 4).collect()
        assert sorted(map(tuple, got)) == [(a, b, 0) for a in range(n) for b in range(a + 1, n)]


def test_prefixes_are_shortened_until_the_target(spark):
    """One level is added after another while the last one adds more than the target allows; the pairs of the shortest prefixes stay."""
    bits = neardup.LEVEL_BITS
    key = lambda *levels: sum(x << bits * (4 - k) for k, x in enumerate(levels))
    far = [(100 + k, 5, 5, [key(9, k, 0, 0, 0)]) for k in range(50)]  # share one level only
    near = [(2 * k + j, 5, 5, [key(1, k, k, k, j if k % 2 else 0)]) for k in range(20) for j in (0, 1)]  # half share five levels, half four
    df = spark.createDataFrame(far + near, "id long, s1 long, s2 long, keys array<long>")
    asked = []

    def check(pairs):
        asked.append(pairs.count())
        return pairs.withColumn("jaccard", F.lit(1.0))

    got = {(r.a, r.b) for r in neardup.shorten(df, check, 0.7, 0.985, 4).collect()}
    assert got == {(2 * k, 2 * k + 1) for k in range(20)} and asked == [20, 20]  # level 4 adds half, level 3 nothing


def test_heavy_branches_are_split(spark):
    """A branch of many rows gives the same pairs in many parts of bounded size as in one."""
    rng = random.Random(3)
    rows = [(k, rng.choice((5, -6)), 5, [(7 << 2 * neardup.LEVEL_BITS) | k, (9 << 2 * neardup.LEVEL_BITS) | (k % 70 << neardup.LEVEL_BITS)]) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, s1 long, s2 long, keys array<long>")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[3][0] >> 11 == b[3][0] >> 11 or a[3][1] >> 11 == b[3][1] >> 11) and a[1] == b[1]}
    assert {tuple(r)[:2] for r in neardup.candidates(df, 0.7, 4, heavy=10_000).collect()} == want
    assert sorted(tuple(r)[:2] for r in neardup.candidates(df, 0.7, 4, heavy=50).collect()) == sorted(want)
    sizes = [r["count"] for r in neardup.groups(df, neardup.LEVEL_BITS, 50).groupBy("branch", "part").count().collect()]
    assert max(sizes) <= 2 * 2 * 50 and len(sizes) == 21 + 70


def made_texts(n=400):
    """Texts of one to four sentences in Swedish, with abbreviations, initials, notes and quotations in any place, and some in other scripts."""
    rng = random.Random(12)
    people = [f"{i}. {name}" for i in "ABCDEFGHJKLM" for name in ("Berg", "Lind", "Ek", "Dal")]
    plain = ["Bolaget växte bl.a. i {p}.", "Arbetet fortsätter.", "Det gick bra.", "Bolaget ökade med 5 mkr.", "Se not {n}.", "(Se not {n}.)", "”Vi växte!” säger vd {v}.", "Arbetet leds av {v}.", "Bolaget köpte t.ex. mark i {p}.", "Vi växte i {p}!", "Rubriken gäller {p}."]
    texts = []
    for _ in range(n):
        some = [rng.choice(plain).format(p=rng.choice(["Norden", "Europa", "Asien"]), n=rng.randrange(1, 40), v=rng.choice(people)) for _ in range(rng.randrange(1, 5))]
        texts.append(" ".join(some))
    return texts + ["กำไรเพิ่มขึ้น รายได้ลดลง", "売上は増加した。「順調だ。」と社長は述べた。利益は減少した。", "Γιατί αυξήθηκε; Ο όμιλος μεγάλωσε."] * 3


TRAIN = made_texts()

UNITS = [
    ["Bolaget växte bl.a. i Norden. ", "Arbetet fortsätter."], ["”Vi växte!” säger vd M. Berg. ", "Det gick bra."], ["Rubrik\n\n", "Arbetet fortsätter. ", "(Se not 4.) ", "Det\ngick bra.\n \n", "- ett\n", "- två; tre\n"],
    ["Post  2020  2019\n", "Varor m.m.  5  6"], ["กำไรเพิ่มขึ้น ", "รายได้ลดลง"], ["売上は増加した。", "「順調だ。」と社長は述べた。", "利益は減少した。"], ["Γιατί αυξήθηκε; ", "Ο όμιλος μεγάλωσε."],
    ["© Bolaget AB 2022. Alla rättigheter förbehållna."], ["Bolaget växte. ", "Arbetet fortsätter" + " " * 80 + "i Norden."],
    ["آمدنی میں اضافہ ہوا۔ ", "کام جاری ہے۔"], ["ចំណូលបានកើនឡើង។ ", "ការងារបន្ត។"], ["ဝင်ငွေတိုးလာသည်။ ", "အလုပ်ဆက်လုပ်သည်။"], ["ገቢው ጨምሯል። ", "ሥራው ይቀጥላል።"], ["Եկամուտն աճեց։ ", "Աշխատանքը շարունակվում է։"], ["आय बढ़ी॥ ", "काम जारी है॥"],
    ["ｳﾘｱｹﾞﾊﾌｴﾀ｡", "ﾘｴｷﾊﾍｯﾀ｡"], ["売上は増加した ", "利益は減少した"], ["ລາຍໄດ້ເພີ່ມຂຶ້ນ ", "ກຳໄລຫຼຸດລົງ"],
]


def test_units(spark):
    """Literal texts among many, in one run: each comes out as its units, whose places are those of the raw text."""
    texts = {k: "".join(u) for k, u in enumerate(UNITS)} | {100 + k: t for k, t in enumerate(TRAIN)} | {900: None, 901: "", 902: " ", 903: "\n\n", 904: "x" * 100_000}
    df = spark.createDataFrame([(k, t, "a") for k, t in texts.items()] + [(904, "Det gick bra.", "b")], "rec_id long, text string, end_pos string")
    got = defaultdict(list)
    for r in sentences.split_sentences(df, ["rec_id"], "text").orderBy("unit_no").collect():
        got[r.rec_id].append((r.start_pos, r.end_pos))
    for k, units in enumerate(UNITS):
        assert [texts[k][a - 1 : b] for a, b in got[k]] == [u.strip() for u in units]
    assert not {900, 901, 902, 903} & set(got) and sorted(got[904]) == [(1, 13), (1, 100_000)]
    assert sentences.split_sentences(df.limit(0), ["rec_id"], "text").count() == 0


def plain_round(grams):
    """Weights of every n-gram by plain loops over all of them."""
    table = lambda: defaultdict(lambda: [0.0, 0.0])
    shapes, lefts, pairs, begun, gone, kinds = table(), table(), table(), defaultdict(float), defaultdict(float), table()
    for before, left, right, n, p, edge in grams:
        if left:
            for of, key in ((shapes, sentences.left_class(left)), (lefts, left), (pairs, (before, left))):
                of[key][0] += n if edge else p * n
                of[key][1] += n
        if right:
            begun[right] += n if edge else p * n
            gone[right] += 0 if edge else (1 - p) * n
    for right in begun:
        kinds[right.split(":")[0]][0] += begun[right]
        kinds[right.split(":")[0]][1] += gone[right]
    size = {k: 1 + sum(r.split(":")[0] == k for r in begun) for k in kinds}
    n1, n0 = sum(begun.values()) + 1, sum(gone.values()) + 1
    back = lambda x, p: (x[0] + sentences.BACK * p) / (x[1] + sentences.BACK)
    out = {}
    for before, left, right, _, _, edge in grams:
        if not edge:
            shape, kind = shapes[sentences.left_class(left)], right.split(":")[0]
            p = min(max(back(pairs[before, left], back(lefts[left], (shape[0] + 0.5) / (shape[1] + 1))), sentences.LEAST), 1 - sentences.LEAST)
            word = lambda count, of, n: sentences.EXACT * count / n + (1 - sentences.EXACT) * (of + 0.1) / (n + 2) / size[kind]  # noqa: B023, E731
            out[before, left, right] = p * word(begun[right], kinds[kind][0], n1), (1 - p) * word(gone[right], kinds[kind][1], n0)
    return out


def test_rounds_match_plain_loops(spark):
    """The fit as joins on the table of n-grams gives what loops over all n-grams give, also for rare words among many texts."""
    rare = ["".join("abcdefghij"[int(d)] for d in f"{k:05d}") for k in range(3000)]
    texts = TRAIN + [f"Bolaget växte {w}. Arbetet fortsätter bl.a. i Norden. Det gick bra." for w in rare]
    observed = sentences.observe(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string"), ["id"], "text")
    grams = sentences.ngrams(observed).cache()
    held = {(r.before, r.left, r.right): r.n for r in grams.where("open").collect()}
    assert all(held["växte", w + ".", "U:arbetet"] == 1 for w in rare)
    guess = {(r.before, r.left, r.right): r.p for r in sentences.start_guess(grams).collect()}
    edges = [(r.before, r.left, r.right, r.n, 1.0, True) for r in grams.where("not open").collect()]
    for _ in range(2):
        weights = plain_round([(*g, held[g], p, False) for g, p in guess.items()] + edges)
        guess = {g: b / (b + c) for g, (b, c) in weights.items()}
    fitted = {(r.before, r.left, r.right): (r.b, r.c) for r in sentences.fit(observed, 2).collect()}
    assert fitted.keys() == weights.keys() and all(fitted[g] == pytest.approx(weights[g]) for g in weights)


def test_posteriors_match_enumeration():
    rng = random.Random(1)
    for _ in range(20):
        chain = [(rng.random(), rng.random(), rng.choice([0, 1, 2, 3])) for _ in range(5)]
        total, marginal = 0.0, [0.0] * 5
        for states in range(32):
            bits = [(states >> k) & 1 for k in range(5)]
            weight = 1.0
            for k, (one, none, words) in enumerate(chain):
                weight *= (one * (sentences.LENGTH.get(words, 1.0) if k == 0 or bits[k - 1] else 1.0)) if bits[k] else none
            total += weight
            marginal = [m + weight * b for m, b in zip(marginal, bits, strict=True)]
        assert sentences.odds_of(chain) == pytest.approx([m / total for m in marginal])


def test_texts_are_searched_for_scripts_they_hold_only(monkeypatch):
    """A text without letters of unspaced scripts is never searched for them; others are read as by a search for every class."""
    plain = ["Åtta – nio. Tio!\n\nElva ©\nTolv. 3) Tretton 14. Femton", "Ett. Två\n1. Tre – fyra.\n2. Fem"]
    mixed = ["สวัสดี ครับ. Hej. ดี 5 มาก", "これは文です。次 の文。ABC. Åter", "ພາສາ ລາວ. ខ្មែរ ភាសា. Då", "Ελληνικά; ναι. Όχι", "हिन्दी वाक्य। दूसरा। Ö."]
    found = [sentences.read(t) for t in plain + mixed]
    everything = frozenset("".join(mixed))
    monkeypatch.setattr(sentences, "frozenset", lambda x=(): everything, raising=False)  # as if each text held all scripts
    assert [sentences.read(t) for t in plain + mixed] == found
    monkeypatch.delattr(sentences, "frozenset")
    for name in ("HAS_THAI", "HAS_BLANK_GAP"):
        monkeypatch.setattr(sentences, name, None)
    assert [sentences.read(t) for t in plain] == found[: len(plain)]


def test_sentence_ends_are_chosen_over_all_chains_at_once(spark, monkeypatch):
    """Equal to the passes over one chain after another; neither these nor loops over places run for a table."""
    rng, open_odds, places, expected = random.Random(4), [], [], []
    for row in range(30):
        for chain in range(rng.randint(0, 5)):
            some = [(rng.random() * rng.choice([0, 1, 1]), rng.random(), rng.randint(0, 3)) for _ in range(rng.randint(0, 6))]
            odds = sentences.odds_of(some)
            ends = [p >= 0.5 for p in odds] if len(some) > 1 else [b * sentences.LENGTH.get(w, 1.0) >= c for b, c, w in some]
            open_odds += [x[:2] for x in some]
            places += [(row, chain, w) for *_, w in some] + [(row, -1, 0)]
            expected += [*ends, True]
    got = sentences.chosen_stops(*(np.array(x) for x in zip(*places, strict=True)), *(np.array(x) for x in zip(*open_odds, strict=True)))
    assert got.tolist() == expected
    assert sentences.chosen_stops(*(np.zeros(0, int) for _ in range(3)), np.zeros(0), np.zeros(0)).tolist() == []
    texts = ["Ett bolag växte. Det gick bra! Sedan kom 2023.  ", "\n\n", "a | b\nc | d", None, " Kort. Slut"]
    got = sentences.split_sentences(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), ["id"], "text").orderBy("id", "unit_no").collect()
    assert [(r.id, r.unit_no, texts[r.id][r.start_pos - 1 : r.end_pos]) for r in got] == [
        (0, 1, "Ett bolag växte."), (0, 2, "Det gick bra!"), (0, 3, "Sedan kom 2023."), (2, 1, "a | b"), (2, 2, "c | d"), (4, 1, "Kort."), (4, 2, "Slut"),
    ]


def test_plain_texts_are_searched_once(monkeypatch):
    texts = ["Åtta – nio. Tio!\n\nElva\nTolv. 3) Tretton 14. Femton", "One (a). Two; three?\n1. Four.\n2. Five"]
    found = [sentences.read(t) for t in texts]
    for name in ("CELLS", "NOTICE", "GAP"):  # neither cells nor notices nor rarer marks are looked for
        monkeypatch.setattr(sentences, name, None)
    monkeypatch.setattr(sentences, "frozenset", lambda x=(): pytest.fail("letters are gathered") if x else set(), raising=False)
    assert [sentences.read(t) for t in texts] == found
