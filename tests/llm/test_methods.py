"""The methods against brute force and exact round trips."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import mixing, neighbours, reading, scans, sentences, spans, tokens
from foliospark.llm.confusions import confusion_distance

LINES = "line_id long, result_id long, source_id string, page_id string, box_id string, reading_order int, text string"


# -- token ids


def naive_bpe(e, data: bytes):
    ids = [e.byte_ids[b] for b in data]
    while True:
        best = min(((e.pairs[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in e.pairs), default=None)
        if best is None:
            return tuple(ids)
        i = best[1]
        ids[i : i + 2] = [e.pairs[ids[i], ids[i + 1]][1]]


def test_segment_tree_merges_as_plain_merging_does():
    e, rng = tokens.encoder(tokens.VOCABULARY), random.Random(1)
    for _ in range(300):
        data = "".join(rng.choice("abcde theräß水車ไ ") for _ in range(rng.randint(0, 40))).encode()
        assert e.piece(data) == naive_bpe(e, data)


def test_ids_are_those_of_the_library():
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(tokens.VOCABULARY)
    lib.encode_special_tokens = True
    e = tokens.encoder(tokens.VOCABULARY)
    for t in ["", " ", "The mill's\r\n\r\nwheel  turns.", "<|endoftext|>", "a" * 3000, "水車記 ไม้ कल", "'S 12³ Ⅷ ​"]:
        assert e.encode(t) == lib.encode(t, add_special_tokens=False).ids
    assert e.encode(None) == []


# -- passages


def brute_spans(texts: dict[int, str], span: int):
    seen: dict[str, set[int]] = {}
    for k, t in texts.items():
        for i in range(len(t) - span + 1):
            seen.setdefault(t[i : i + span], set()).add(k)
    out = set()
    for k, t in texts.items():
        merged: list[list[int]] = []
        for i in range(len(t) - span + 1):
            if len(seen[t[i : i + span]]) > 1:
                if merged and i <= merged[-1][1]:
                    merged[-1][1] = i + span
                else:
                    merged.append([i, i + span])
        out |= {(k, a, b) for a, b in merged}
    return out


def shared_texts(seed: int, n: int = 60, alphabet: str = "abcdefgh 水車ไ", newlines: float = 0.5) -> dict[int, str]:
    """Texts that share passages, lines, paragraphs and whole texts, at odd places and next to one another."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [word(n) for n in (149, 150, 151, 165, 200, 400)]
    passages += [passages[4][:170] + word(60), "\n".join([passages[3], word(40), passages[5]])]
    texts = {}
    for k in range(n):
        parts = [word(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            gap = rng.choice(["\n", "\n\n", ""]) if rng.random() < newlines else ""
            parts += [gap + (p[rng.randint(0, 30) :] if rng.random() < 0.4 else p) + gap, word(rng.choice([0, 0, 5, 60]))]
        texts[k] = "".join(parts)
    texts[n] = texts[3]
    texts[n + 1] = "ab" * 400
    return texts


@pytest.mark.parametrize("seed", range(6))
def test_spans_are_those_of_brute_force(spark, seed):
    texts = shared_texts(seed)
    df = spark.createDataFrame([(k, t, "s") for k, t in texts.items()], "doc_id long, text string, source string")
    found = spans.shared_spans(df)
    want = brute_spans(texts, 150)
    assert {tuple(r) for r in found.collect()} == want
    share = {r["doc_id"]: r["shared_chars"] for r in spans.shared_share(df, found).collect()}
    assert share == {k: sum(b - a for d, a, b in want if d == k) for k in texts}


def test_lists_too_long_to_be_sent_change_nothing(spark, monkeypatch):
    texts = shared_texts(11)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(spans, "LISTED", 3)
    assert {tuple(r) for r in spans.shared_spans(df).collect()} == brute_spans(texts, 150)


def test_equal_units_are_settled_by_their_digests(spark):
    """Lines and paragraphs: the earliest is kept, the rest removed; what is removed is not looked at again."""
    rng = random.Random(9)
    line, other = ("".join(rng.choice("abc 水") for _ in range(300)) for _ in range(2))
    texts = {1: f"x\n{line}\ny", 2: f"{line}\n{other}", 3: f"zz\n\n{line}\n{other}\n\n{line}", 4: other + "\n" + other}
    rows = spark.createDataFrame(list(texts.items()), "rep long, text string")
    got = {tuple(r) for r in spans.equal_units(rows).collect()}
    assert {(1, 2, 302, True), (2, 0, 300, False), (3, 4, 304, False), (3, 607, 907, False), (2, 301, 601, True), (4, 0, 300, False)} <= got
    assert all(texts[r][a:b] in (line, other, line + "\n" + other) for r, a, b, _ in got)
    settled = [{"start": 0, "end": 300, "kept": False}]
    units = lambda s: next(spans._units(150, 50)(iter([spans.pa.RecordBatch.from_pydict({"rep": [2], "text": [texts[2]], "settled": [s]})]))).to_pydict()["pos"]
    assert 0 < len([x for x in units(settled) if x < 300]) < len([x for x in units([]) if x < 300])


# -- vectors


def clustered(n: int, dims: int = 16, seed: int = 5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 50, dims))
    return (centres[rng.integers(0, n // 50, n)] + 0.3 * rng.standard_normal((n, dims))).astype(np.float32)


def as_rows(spark, x):
    rows = [(i, "figure", "t", "p", "m", "1", x.shape[1], "h", v.tolist()) for i, v in enumerate(x)]
    schema = "vec_id long, entity_type string, modality string, provider string, model string, version string, dimension int, preprocessing_hash string, vector array<float>"
    return spark.createDataFrame(rows, schema).withColumn("arrived_at", F.current_timestamp())


def recall_of(near, x) -> float:
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    kth = np.sort(s, axis=1)[:, -10]
    return (s[near["vec_id"].to_numpy(), near["other"].to_numpy()] >= kth[near["vec_id"].to_numpy()] - 1e-5).sum() / (10 * len(x))


@pytest.mark.parametrize("sample", [20_000, 160])
def test_neighbours_reach_the_recall(spark, sample):
    """With one level of lists, and with two, as a sample of 160 has but 20 lists."""
    x = clustered(1500)
    x[700:760] = x[700]  # many copies of one vector
    near = neighbours.nearest(as_rows(spark, x), probes=10, sample=sample, list_rows=30, cell_rows=400).toPandas()
    assert len(near) == 15000 and (near.groupby("vec_id").size() == 10).all()
    assert recall_of(near, x) >= 0.97
    copies = near[near["vec_id"] == 755]["other"]
    assert sorted(copies) == list(range(700, 710))


def test_lists_grow_with_the_space(spark):
    """The rows that a query looks at stay as many when the space grows: work is not quadratic."""
    looked = []
    for n in (800, 3200):
        kept = spark.createDataFrame([(1, i, v.tobytes()) for i, v in enumerate(clustered(n))], "space long, vec_id long, v binary")
        counts = kept.groupBy("space").agg(F.count("*").alias("n"), F.lit(16).alias("dims"))
        lists = neighbours.fitted_lists(kept, counts, sample=160, list_rows=20)[1]
        near = lists.nearest(clustered(n), 8)
        size = np.bincount(near[:, 0], minlength=len(lists.centroids))
        looked.append(np.where(near >= 0, size[near], 0).sum(axis=1).mean())
        assert len(lists.first) <= 20 and len(lists.centroids) >= n / 60
    assert looked[1] < 1.6 * looked[0]


def test_scan_abandons_candidates_and_reads_less():
    rng = np.random.default_rng(0)
    centres = 3 * rng.standard_normal((10, 64))
    m = (np.repeat(centres, 50, axis=0) + rng.standard_normal((500, 64))).astype(np.float32)
    q = (centres[rng.integers(0, 10, 20)] + rng.standard_normal((20, 64))).astype(np.float32)
    d = ((q[:, None] - m[None]) ** 2).sum(2)
    bound = np.sort(d, axis=1)[:, 9]
    r, c, got, read = neighbours.scan_list(q, m, bound)
    assert len(r) >= 0.97 * 200 and np.allclose(got, d[r, c], rtol=1e-3)
    assert read < 0.8 * d.size * 64


# -- mixture


def test_flight_keeps_the_sums_and_leaves_two_open():
    rng = np.random.default_rng(1)
    p, t = rng.random(500), rng.integers(1, 900, 500)
    out = mixing.flight(p, t, rng)
    open_ = (out > 1e-9) & (out < 1 - 1e-9)
    assert open_.sum() <= 2 and abs(out.sum() - p.sum()) < 1e-6 and abs((out * t).sum() - (p * t).sum()) < 1e-3


def test_shares_come_out_within_the_passes(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["mill"] * rng.randint(5, 60)), rng.choice(["a"] * 8 + ["b", "c"])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("none", 0.1, 5)], "source string, target_share double, max_passes int")
    mixed = mixing.mix(df, targets, block=100)
    got = {r["source"]: r for r in mixing.shares(mixed, targets).collect()}
    for name, share, most in (("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2)):
        assert abs(got[name]["share"] - share / 1.0) < 0.01 and got[name]["most_passes"] <= most
    assert got["none"]["share"] == 0


# -- reading


def test_what_reads_the_same():
    same = [("mill", "mіll"), ("ｗｈｅｅｌ", "wheel"), ("ﬁne", "fine"), ("a b", "a b"), ("so­ft", "soft"), ("工", "⼯"), ("長", "⾧"), ("ピン", "ﾋﾟﾝ"), ("น้ำ", "น้ํา"), ("é", "é"), ("well‑known", "well-known"), ("車︀", "車")]
    for a, b in same:
        assert reading.reading(a) == reading.reading(b), (a, b)
    for a, b in [("Mill", "mill"), ("ft²", "ft2"), ("m1ll", "mill"), ("木", "本"), ("O", "0")]:
        assert reading.reading(a) != reading.reading(b), (a, b)


def test_trie_gives_the_frequent_spelling():
    c = reading.Canonical([("колесо", 90), ("wheel", 50), ("кoлеcо", 2)])
    assert c("кoлeco wh​eel") == "колесо wheel"


def test_the_automaton_pays_for_foreign_letters():
    c = reading.Canonical([("wheel", 90), ("Ꮃheel", 1), ("steel", 80), ("wbeel", 70), ("колесо", 50)])
    # A look-alike that no table lists, within a word: the word that it disguises, for FOREIGN's cost.
    assert c("Ꮃheel whеel wheǝl ꓪheel") == "wheel wheel wheǝl wheel"
    # Two of them are beyond the budget, and a word of another alphabet is no disguise.
    assert c("ᏔᎻeel ᎳᎻᎬ колесо") == "ᏔᎻeel ᎳᎻᎬ колесо"
    trie = reading.Trie({"wheel": 90, "steel": 80})
    assert trie.canonical("xheel") is None and trie.canonical("xheel", frozenset([0])) == "wheel" and trie.canonical("xyeel", frozenset([0, 1])) is None


def test_unlisted_look_alikes_are_found_through_the_vocabulary(spark, monkeypatch):
    rows = [(k, k, "s", "p", f"c{k}", 0, "The oiled wheel turns") for k in range(5)]
    rows += [(10, 10, "s", "p", "b", 0, "The oiled wheel"), (11, 11, "s", "p", "b", 0, "The oiled Ꮃheel"), (12, 12, "s", "p", "b", 0, "The oiled wheᎬl"), (13, 13, "s", "p", "b", 0, "The oiled ϣheel")]
    lines = spark.createDataFrame(rows, LINES)
    none = spark.createDataFrame([], "functions array<struct<supports: array<struct<support_id: long, kind: string, reference_id: string, quote: string>>>>")
    drafts = spark.createDataFrame([([None, ([(9, "b", "oiled ꓪheel")],)],)], "functional_drafts array<struct<supports: array<struct<support_id: long, item_id: string, quote: string>>>>")
    got = {tuple(r) for r in reading.same_reading(lines, none, drafts).collect()}
    assert {("line", a, b) for a in range(10, 14) for b in range(a + 1, 14)} | {("draft", 9, x) for x in range(10, 14)} == got
    for words in (0, 1, 3):
        monkeypatch.setattr(reading, "VOCABULARY_WORDS", words)
        assert {tuple(r) for r in reading.same_reading(lines, none, drafts).collect()} == got
    monkeypatch.setattr(reading, "HOT_ROWS", 2)
    assert {tuple(r) for r in reading.same_reading(lines, none, drafts).collect()} == got


def test_words_of_one_letter_keep_their_frequent_spelling(spark):
    texts = spark.createDataFrame([("рама а",), ("рама а",), ("рама a",)], "text string")
    vocabulary, rest = reading.canonical_vocabulary(texts)
    assert rest is None and {r["form"] for r in reading.canonical_forms(texts, vocabulary).collect()} == {"рама а"}


def test_words_beyond_the_vocabulary_get_their_frequent_spelling(spark):
    rows = [("рама мост",)] * 3 + [("paмa мост",), ("soft мост",), ("so\u00adft",), ("soft",), (None,), ("",)]
    texts = spark.createDataFrame(rows, "text string")
    whole = [tuple(r) for r in reading.canonical_forms(texts, *reading.canonical_vocabulary(texts)).select("text", "form").collect()]
    for words in (0, 1, 2, 3):
        vocabulary, rest = reading.canonical_vocabulary(texts, words)
        assert len(vocabulary) == words and rest is not None
        some = reading.canonical_forms(texts, vocabulary, rest).select("text", "form")
        assert sorted(map(str, whole)) == sorted(str(tuple(r)) for r in some.collect())
    assert ("paмa мост", "рама мост") in whole


def test_paragraphs_do_not_depend_on_the_size_of_the_vocabulary(spark, monkeypatch):
    rows = [(k, k, "s", "p", "b", 0, "рама и мост") for k in range(3)] + [(9, 9, "s", "p", "b", 0, "paмa и мост")]
    lines = spark.createDataFrame(rows, LINES)
    monkeypatch.setattr(scans, "VOCABULARY_WORDS", 1)
    assert {r["text"] for r in scans.repaired_pages(lines).collect()} == {"рама и мост"}


def test_pairs_of_lines_and_quotes(spark):
    rows = [(1, 1, "s", "p", "b", 0, "The oiled wheel"), (2, 2, "s", "p", "b", 0, "The оiled wheel"), (3, 3, "s", "p", "b", 0, "The Oiled wheel"), (4, 4, "s", "p", "c", 0, "The оiled wheel")]
    lines = spark.createDataFrame(rows, LINES)
    f = spark.createDataFrame([([([(7, "raw_ocr", "b", "оiled"), (8, "scan_region", "b", "оiled")],)],)], "functions array<struct<supports: array<struct<support_id: long, kind: string, reference_id: string, quote: string>>>>")
    k = spark.createDataFrame([([([(9, "c", "oiled")],)],)], "functional_drafts array<struct<supports: array<struct<support_id: long, item_id: string, quote: string>>>>")
    assert {tuple(r) for r in reading.same_reading(lines, f, k).collect()} == {("line", 1, 2), ("function", 7, 1), ("draft", 9, 4)}


# -- page noise


def test_numbers_of_pages():
    for t in ["- 32 -", "xxviiii", "l22", "〔三〕", "第七十二葉", "一百五十八丁", "१९२", "fol. 56v", "[134]", "122.", "— 147 —", "cxxxxiii"]:
        assert scans.is_number(reading.reading(t)), t
    for t in ["VI).", "mill", "mix", "no. 3, of", "482),", "etc.", "", "三尺"]:
        assert not scans.is_number(reading.reading(t)), t


def test_confusions_cost_less_than_other_edits():
    for a, b in [("harnmer", "hammer"), ("shocl", "shod"), ("tbe", "the"), ("vvheel", "wheel"), ("5poke", "spoke")]:
        assert confusion_distance(a, b) == pytest.approx(0.3)
    assert confusion_distance("wheel", "whexl") == pytest.approx(1.0)


def noisy_pages():
    """Pages of one book: a title, numbers, broken words, and a misread word that the rest of the book spells well."""
    good, n = "the weaver turns the hammer and the wheel of the mill", 0
    out = []
    for page in range(12):
        own = "abcdefghijkl"[page] * 4
        lines = ["THE BOOK OF MILLS", f"{good} {own}", f"{own} {good}", f"when the crude {own} and the ham-", f"mer stand beside the water {own}", f"- {page} -"]
        if page == 3:
            lines[1] = "the weaver turns the harnmer and the wheel of the mill dddd"
            lines[3:5] = ["when the crude dddd and the wea", "ver stand beside the water dddd"]
        for k, t in enumerate(lines):
            n += 1
            out.append((n, page, "book", f"p{page}", f"b{n}", k, t))
    return out


def test_noise_of_a_book(spark):
    rows = noisy_pages()
    got = {tuple(r) for r in scans.page_noise(spark.createDataFrame(rows, LINES)).collect()}
    want = set()
    for line, page, *_, k, _text in rows:
        if k == 0:
            want.add((line, "head"))
        if k == 5:
            want.add((line, "number"))
        if k == 3:
            want.add((line, "break"))
        if page == 3 and k == 1:
            want.add((line, "misread"))
    assert got == want


def test_misread_without_a_listed_pair(spark):
    from foliospark.llm.confusions import SINGLE_PAIRS

    assert ("m", "q") not in SINGLE_PAIRS and ("鬼", "車") not in SINGLE_PAIRS
    good = "the weaver turns the hammer and the wheel"
    texts = [good + " of the mill"] * 60 + ["the weaver turns the haqmer and the wheel of the mill", "the weaver turns the hammr and the wheel of the mill"]
    texts += ["此水車轉而上"] * 60 + ["此水鬼轉而上"]
    rows = [(k, k, "s", f"p{k}", "b", 0, t) for k, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, LINES)
    # All pages of a source alike would be titles: these stand on pages of sources of their own.
    lines = lines.withColumn("source_id", F.concat(F.lit("s"), "line_id"))
    assert sorted(tuple(r) for r in scans.page_noise(lines).collect()) == [(60, "misread"), (61, "misread"), (122, "misread")]


def test_a_lexicon_that_is_not_sent_changes_nothing(spark, monkeypatch):
    rows = noisy_pages()
    own = [
        (["cria le copiste de Kel", "gasted qui turns the wheel"], "a rare name"),
        (["the well known hammer and the well-", "known wheel of the well and the known mill"], "a compound"),
        (["and beside the wea", "ver of the mill with the mill-", "wheel-", "hammer wheel"], "a chain"),
    ]
    for page, (texts, _) in enumerate(own, 20):
        rows += [(1000 + 10 * page + k, page, "other", f"q{page}", "b", k, t) for k, t in enumerate(texts)]
    rows += [(2000 + k, 40 + k, f"o{k}", f"r{k}", "b", 0, f"it is the well known wheel {'abcdef'[k] * 5}") for k in range(6)]
    lines = spark.createDataFrame(rows, LINES)

    def both():
        return [sorted(map(str, f(lines).collect())) for f in (scans.page_noise, scans.repaired_pages)]

    sent = both()
    monkeypatch.setattr(scans, "SENT_WORDS", 0)
    assert both() == sent
    assert any("Kelgasted" in x for x in sent[1]) and any("well-known" in x for x in sent[1]) and any("mill-wheel-hammer" in x for x in sent[1])


def dense_pages():
    rng = random.Random(5)
    words = ["此水車轉而上", "其輪甚大可以引水", "鐵軸入於石臼", "人以足踏之則行", "磨上之石重百斤"]
    rows, n = [], 0
    for page in range(60):
        for k in range(4):
            n += 1
            text = "".join(rng.choice(words) for _ in range(3))
            if n % 11 == 0:
                at = rng.randrange(len(text))
                text = text[:at] + rng.choice("木本入人末未鬼") + text[at + 1 :]
            rows.append((n, page, f"s{page}", f"p{page}", f"b{n}", k, text))
    return rows


def test_characters_are_judged_alike_by_tables_and_by_joins(spark, monkeypatch):
    lines = spark.createDataFrame(dense_pages(), LINES)

    def both():
        return [sorted(map(str, f(lines).collect())) for f in (scans.page_noise, scans.repaired_pages)]

    sent = both()
    monkeypatch.setattr(scans, "CHAR_PAIRS", 5)
    assert both() == sent and sum("misread" in x for x in sent[0]) >= 10


def test_limits_change_no_row(spark, monkeypatch):
    rows = noisy_pages() + [(10_000 + n, 1000 + page, f"s{page}", p, b, k, t) for n, page, _, p, b, k, t in dense_pages()]
    lines = spark.createDataFrame(rows, LINES)
    want = sorted(map(str, scans.page_noise(lines).collect()))
    for name in ("SENT_SOURCES", "SENT_WORDS", "CHAR_PAIRS", "ROUGH_KEYS"):
        monkeypatch.setattr(scans, name, 5)
    assert sorted(map(str, scans.page_noise(lines).collect())) == want


def test_long_titles_and_numbers_between_long_rules(spark):
    title = "A VERY FULL ACCOUNT OF ALL THE MILLS AND ENGINES OF THE VILLAGES UPON THE RIVER ABOVE THE GREAT WEIR"
    rows = []
    for page in range(6):
        body = " ".join(f"{'abcdefgh'[(page * 7 + k) % 8] * 3} wheel" for k in range(6))
        for k, t in enumerate([title + "\u200b" * 80, body + " turns", f"{'—' * 40} {page + 3} {'—' * 40}"]):
            rows.append((3 * page + k, page, "book", f"p{page}", f"b{page}{k}", k, t))
    got = {tuple(r) for r in scans.page_noise(spark.createDataFrame(rows, LINES)).collect()}
    assert got == {(3 * p, "head") for p in range(6)} | {(3 * p + 2, "number") for p in range(6)}


def test_lines_without_a_result_are_read_by_page(spark):
    rows = [(k, None, f"s{k // 2}", f"p{k // 2}", "b", k % 2, t) for k, t in enumerate(["it turns the ham-", "mer of the mill"] * 3)]
    rows += [(90, None, "s", None, "b", 0, "the wea-"), (91, None, "s", None, "b", 1, "ver turns")]
    assert {tuple(r) for r in scans.page_noise(spark.createDataFrame(rows, LINES)).collect()} == {(0, "break"), (2, "break"), (4, "break")}


def test_what_reads_as_it_is():
    rng = random.Random(1)
    some = "aé水車ไเแ่ํक़क़ ﾋﾟｗ\u3099かが\u200b²ａЫßö\u0308a\u0301가\u1100\u1161゙①ﬁ〇 ⼯"
    for _ in range(3000):
        t = "".join(rng.choice(some) for _ in range(rng.randint(0, 6)))
        out = __import__("unicodedata").normalize("NFD", t).translate(reading.table())
        for a, b in reading._THAI:
            out = out.replace(a, b)
        assert reading.reading(t) == " ".join(__import__("unicodedata").normalize("NFC", out).split()), ascii(t)


def test_a_line_with_two_misread_words_is_repaired(spark):
    good = "the weaver turns the hammer and the wheel of the mill"
    texts = [good] * 40 + ["the weaver turns the harnmer and the vvheel of the mill"]
    lines = spark.createDataFrame([(k, k, f"s{k}", f"p{k}", "b", 0, t) for k, t in enumerate(texts)], LINES)
    assert {r["text"] for r in scans.repaired_pages(lines).collect()} == {good}


# -- sentences


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The mill (cf. pl. IX) at St. Ives\nweighs 5.2 lb., i.e. less. Does it? No!", ["The mill (cf. pl. IX) at St. Ives\nweighs 5.2 lb., i.e. less.", "Does it?", "No!"]),
        ("The dyer says: “Leave it. Go.” (See the note, fol. 3.) It pauses … then stops.", ["The dyer says: “Leave it. Go.”", "(See the note, fol. 3.)", "It pauses … then stops."]),
        ("“Never! Grease it,” he said, “or stop.” Two cords of wax, etc. The end", ["“Never! Grease it,” he said, “or stop.”", "Two cords of wax, etc.", "The end"]),
        ("Am 19. Mai 1795 löst er z. B. die Spule. „Haltet! Sonst“, rief er.", ["Am 19. Mai 1795 löst er z. B. die Spule.", "„Haltet! Sonst“, rief er."]),
        ("鹽工說：「先調節！別讓。」「誰來？」，學徒問完。每日8次！", ["鹽工說：「先調節！別讓。」", "「誰來？」，學徒問完。", "每日8次！"]),
        ("夫磨之轉由軸而定也磨也者所以引車焉水至則", ["夫磨之轉由軸而定也", "磨也者所以引車焉", "水至則"]),
        ("職人は「縄を引く。放す。」と記した。「回すな！」と言う。", ["職人は「縄を引く。放す。」と記した。", "「回すな！」と言う。"]),
        ("चित्र 6 में दंड है। क्या है?", ["चित्र 6 में दंड है।", "क्या है?"]),
        ("Названы рама и т. д. Здесь ось, т. е. втулка (см. с. 6), стоит.", ["Названы рама и т. д.", "Здесь ось, т. е. втулка (см. с. 6), стоит."]),
        ("Sgt. Hale and Lt. Moss left. They came.", ["Sgt. Hale and Lt. Moss left.", "They came."]),
        ("To do:\n1. First item\n2. Second item\nwith more\n(a) inner one\n(b) inner two\n3. Third. It ends.", ["To do:", "1. First item", "2. Second item\nwith more", "(a) inner one", "(b) inner two", "3. Third.", "It ends."]),
        ("• oil the hub\n• grease the reed. Wait.\nAnd rest", ["• oil the hub", "• grease the reed.", "Wait.", "And rest"]),
        ("It was built in\n1. May and\nlasted. Then", ["It was built in\n1. May and\nlasted.", "Then"]),
        ("He said (this is it. Then he left. Next day came. All went home.", ["He said (this is it.", "Then he left.", "Next day came.", "All went home."]),
        ("He said “look (at it. Now go.” They went. “Come, he said.", ["He said “look (at it. Now go.”", "They went.", "“Come, he said."]),
        ("She left. “Come here. And the", ["She left.", "“Come here. And the"]),
        ("ชาวนาใช้เฟือง เมื่อช่างทอปล่อย\nกระสวย 12 ครั้ง", ["ชาวนาใช้เฟือง", "เมื่อช่างทอปล่อย\nกระสวย 12 ครั้ง"]),
        ("", []),
        (" \n ", []),
    ],
)
def test_sentences(text, want):
    at, got = 0, []
    for end in sentences.sentence_ends(text, []):
        got.append(text[at:end].strip())
        at = end
    assert got == want


def test_titles_and_numbers_belong_to_no_sentence():
    text = "BOOK OF MILLS\nThe wheel\n- 7 -\nturns. It​\nstops\n8"
    assert sentence_parts(text, ["book of mills"]) == [text.index("turns.") + 6, text.index("stops") + 5]


def sentence_parts(text, titles):
    return sentences.sentence_ends(text, titles)


def test_units_are_common_to_equal_passages():
    rng = random.Random(4)
    p = "".join(rng.choice("abc 水") for _ in range(150))
    for _ in range(20):
        a, b = ("".join(rng.choice("abc 水") for _ in range(rng.randint(0, 90))) + p + "xy" for _ in range(2))
        hashes = []
        for t in (a, b):
            h = spans.window_hashes(spans.prefix_hashes(t), 50)
            hashes.append(set(h[spans.unit_starts(h, 101)].tolist()))
        assert hashes[0] & hashes[1]




def test_words_that_go_on_without_a_mark():
    known = {"hammer": 5, "ham": 1, "cord": 40, "cordage": 3, "age": 30, "the": 90}
    assert scans.goes_on("and the ham", "ham", "mer", known)
    assert scans.goes_on("cria le copiste de Kel", "kel", "gasted", known)
    assert not scans.goes_on("two lengths of cord", "cord", "age", known)
    assert not scans.goes_on("and the ham —", "ham", "mer", known)
    assert not scans.goes_on("of the", "the", "dyer", known)
    assert not scans.goes_on("the weaver of Kelgasted", "kelgasted", "Turns", known)
