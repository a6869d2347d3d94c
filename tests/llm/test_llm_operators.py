"""The pipeline operators against brute force on small fixtures, and on null, empty, repeated and missing rows."""

import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagequire.llm import chat, decontaminate, jaccard, language, licences, linkgraph, mixing, topk, toxicity, warc
from pagequire.llm.components import components
from pagequire.llm.words import ALNUM, SPACED, hashed, shingled

R = random.Random(5)
WORDS = [f"w{i}" for i in range(300)]


def text(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_hashed_words_follow_the_patterns():
    texts = ["Ab cd  AB\tü\x1cx", "", None, "\x00 a" * 50, "x" * 1_300_000 + " y", ("lorem ipsum, dolor! " * 60_000)]
    for table, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got, (heads,), counts = hashed([None if t is None else t.encode() for t in texts], table, (2,))
        lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
        want = [re.findall(pattern, t) for t in lower]
        assert counts.tolist() == [len(w) for w in want]
        flat = [w for ws in want for w in ws]
        assert len(set(zip(flat, got.tolist()))) == len(set(flat)) == len(set(got.tolist()))
        assert [h == 0 for h in heads.tolist()] == [len(w.encode()) <= 2 for w in flat]


def test_shingles():
    a = np.arange(1, 8, dtype=np.uint64)
    assert shingled(a, 5).size == 3 and shingled(a[:2], 5).size == 1 and shingled(a[:0], 5).size == 0


def test_language(spark):
    r = random.Random(1)
    en, de = ["the", "thing", "with", "other", "that"], ["der", "und", "schein", "nicht", "über"]
    learn = [(" ".join(r.choice(w) for _ in range(20)) + f" {i}", lang) for i in range(60) for w, lang in ((en, "en"), (de, "de"))]
    learn += [(None, "en"), ("xyz", None), ("", "de")]
    f = language.fit(spark.createDataFrame(learn, "text string, lang string"))
    docs = spark.createDataFrame([(1, "THE other thing, with that", 7), (2, "nicht der Schein über", 7), (3, None, 7), (4, "123 !?", 7), (5, "", 7), (1, "THE other thing, with that", 7), (6, "the thing " * 90_000, 7)], "doc_id int, text string, LANG_pred int")
    got = [(r["doc_id"], r["lang_pred"]) for r in language.identify(docs, f).collect()]
    assert got == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (1, "en"), (6, "en")]
    none = language.fit(docs.limit(0).select("text", F.lit("x").alias("lang")))
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}


def test_language_filters_agree_with_loops(spark):
    r = random.Random(4)
    syllables = {f"l{i:02}": [a + b for a in "bdfgklmnprst" for b in "aeiou" if r.random() < 0.2] for i in range(70)}
    say = lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    learn = [(say(lang, 40), lang) for lang in syllables for _ in range(4)]
    f = language.fit(spark.createDataFrame(learn, "text string, lang string"), log_size=16)
    assert f.languages == tuple(sorted(syllables)) and f.masks.shape == (2, 1 << 16)
    texts = [say(lang, 30) for lang in syllables] + ["", None, "12 !", "Ä ö"]
    got, scores = language.score_batch(f, texts)
    for t, lang, score in zip(texts, got, scores, strict=True):
        body, has = language._clean(t)
        if not has:
            assert (lang, score) == ("und", 0)
            continue
        grams = [int(g) for part, _ in language._grams([body]) for g in part]
        held = Counter()
        for g in grams:
            step = (g >> 33) | 1
            at = [(g + j * step) % (1 << 64) % (1 << 16) for j in range(f.hashes)]
            held.update(i for i in range(70) if all(int(f.masks[i // 63, p]) >> (i % 63) & 1 for p in at))
        right = [max(0.0, (held[i] - f.load[i] ** f.hashes * len(grams)) / (1 - f.load[i] ** f.hashes)) for i in range(70)]
        assert right[f.languages.index(lang)] >= max(right) - 1e-6 and abs(score - max(right) / len(grams)) < 1e-6
    assert sum(a == b for a, b in zip(got, syllables)) >= 60
    docs = spark.createDataFrame([(1, "x", "y", "z")], "doc_id int, text string, LANG_PRED string, lang string")
    assert language.identify(docs, f).columns == ["doc_id", "text", "lang", "lang_pred", "lang_score"] and rows(language.identify(docs.limit(0), f)) == []


def test_toxicity_ignores_groups(spark):
    r = random.Random(2)
    group = ["women", "muslims", "gay", "black"]
    learn = [(text(12, r) + (" idiot" if i % 3 == 0 else "") + (f" {r.choice(group)}" if i % 3 == 0 and i % 2 == 0 else ""), int(i % 3 == 0)) for i in range(400)]
    learn += [(None, 1), ("x", None)]
    table = spark.createDataFrame(learn, "text string, toxic int")
    fair, plain = toxicity.fit(table, fair=2.0), toxicity.fit(table, fair=0.0)
    neutral = ["we met women and men", "we met men and women"]
    spread = lambda m: abs(np.subtract(*toxicity.score_batch(m, ["women talked", "men talked"])))
    assert spread(fair) < spread(plain)
    assert (toxicity.score_batch(fair, [text(12, r) + " idiot", *neutral]) >= 0.5).tolist() == [True, False, False]
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "IDIOT you")], "doc_id int, text string")
    got = [r["tox_score"] for r in toxicity.score(docs, fair).collect()]
    assert got[0] == got[1] and all(0 <= x <= 1 for x in got)
    one = toxicity.fit(table.filter("toxic = 0"))
    assert toxicity.score_batch(one, ["a"])[0] < 0.5


def test_toxicity_reports_texts_that_name_groups(spark):
    learn = [(f"women talk {i}" if i < 7 else f"they talk {i}", i % 2) for i in range(40)]
    assert toxicity.fit(spark.createDataFrame(learn, "text string, toxic int")).named == 7
    assert toxicity.fit(spark.createDataFrame(learn[7:], "text string, toxic int")).named == 0


def jaccard_brute(docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in ids)


@pytest.mark.parametrize("tile, pivots, bits", [(4, 1, 64), (1024, 8, 5)])
def test_jaccard_join(spark, tile, pivots, bits):
    """Blocks of a few sets, so that all kinds of tiles meet; and short names that many sets share."""
    r = random.Random(3)
    docs = []
    for _ in range(6):
        base = text(r.choice([6, 30, 120]), r).split()
        for _ in range(12):
            w = list(base)
            for _ in range(r.randrange(1 + len(w) // 25)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            docs.append(" ".join(w))
    passage = text(40, r)
    docs += [text(20, r) + " " + passage for _ in range(30)] + [passage.upper()] * 5 + ["", None, "one two", "ONE two", " \t", "a b c d e"]
    docs = list(enumerate(docs))
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "id long, text string")
    got = sorted(rows(jaccard.join(df, pivots=pivots, tile=tile, bits=bits)))
    assert got == jaccard_brute(docs)


def test_jaccard_tiles_meet_all_pairs_of_different_roots(spark):
    r = random.Random(8)
    members = [(g, s, r.choice([30, 31, 38, 41, 52, 57, 70]), 1 if g < 3 and r.random() < 0.7 else s) for g in range(6) for s in r.sample(range(2, 90), 25)]
    got = rows(jaccard._all_tiles(spark.createDataFrame(members, "g long, s long, n int, root long"), 3, 4, 4))
    tiles, met = {}, set()
    for *key, side, s, n, root in got:
        tiles.setdefault(tuple(key), []).append((side, s, n, root))
    assert max(map(len, tiles.values())) < 25 and {k[1] for k in tiles} == {0, 1, 2, 3, 4}
    for (g, kind, _, i, j), held in tiles.items():
        for x in held:
            for y in held:
                if x[3] != y[3] and (x[0] != y[0] or kind == 0 and i == j):
                    met.add((g, *sorted((x[1], y[1]))))
    near = {(a[0], *sorted((a[1], b[1]))) for a in members for b in members if a[0] == b[0] and a[3] != b[3] and 4 * min(a[2], b[2]) >= 3 * max(a[2], b[2])}
    assert near <= met


def test_jaccard_exact_step_needs_no_bitmap(spark):
    """Near the limit bitmaps cannot tell: 3 in 4 links, a word less does not."""
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(base[i % 9 :] + [f"x{i}x{j}" for j in range(i % 9)])) for i in range(120)]
    got = sorted(rows(jaccard.join(spark.createDataFrame(docs, "id long, text string"), tile=16, pivots=2)))
    assert got == jaccard_brute(docs)


def test_jaccard_long_text(spark):
    r = random.Random(9)
    words = [f"w{r.randrange(5000)}" for _ in range(120_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:-9000])), (3, " ".join(words[:60_000])), (4, "short text")]
    got = {i: c for i, _, c in rows(jaccard.join(spark.createDataFrame(docs, "id long, text string")))}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_jaccard_join_edges(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "A B")], "id long, text string")
    assert sorted(rows(jaccard.join(df)), key=str) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (None, 1, 1)]
    assert rows(jaccard.join(df.limit(0))) == []


def test_jaccard_rows_without_an_id(spark):
    """Such a row may be what joins two others; alone they have no component, and null or empty texts no shingles."""
    base = [f"w{i}" for i in range(40)]
    docs = [(4, base), (None, [*base[:-3], "x", "y", "z"]), (9, [*base[3:-3], "x", "y", "z"]), (None, ["own", "words"]), (None, ["own", "words"]), (None, None), (None, []), (0, ["far"])]
    df = spark.createDataFrame([(i, w and " ".join(w) if w is None or w else "") for i, w in docs], "id long, text string")
    got = sorted(rows(jaccard.join(df)), key=str)
    assert got == sorted([(4, 36, 4), (None, 36, 4), (9, 33, 4), (None, 1, None), (None, 1, None), (None, 0, None), (None, 0, None), (0, 1, 0)], key=str)
    assert rows(jaccard.join(spark.createDataFrame([(None, "a b"), (None, "a b")], "id long, text string"))) == [(None, 1, None)] * 2


def test_jaccard_group_of_thousands_of_near_copies(spark):
    base = " ".join(f"w{i}" for i in range(60))
    docs = [(i, f"{base} v{i}") for i in range(5000)]
    got = jaccard.join(spark.createDataFrame(docs, "id long, text string")).collect()
    assert sorted((r.id, r.n_shingles, r.component) for r in got) == [(i, 57, 0) for i in range(5000)]


def test_jaccard_copies_are_shuffled_once(spark, monkeypatch):
    counts, real = [], jaccard._groups
    monkeypatch.setattr(jaccard, "_groups", lambda p: counts.append((p.count(), p.distinct().count())) or real(p))
    hot = " ".join(f"w{i}" for i in range(30))
    docs = [(i, hot if i % 2 else f"{hot} v{i % 100}") for i in range(1000)]
    df = spark.createDataFrame(docs, "id long, text string").repartition(8)
    assert {r.component for r in jaccard.join(df).collect()} == {0}
    assert counts[0][0] == counts[0][1]
    # ids that meet in the bit set: a task still hands on each set once
    far = df.withColumn("id", F.col("id") * (1 << jaccard.FIRST_BITS)).repartition(2)
    jaccard.join(far).collect()
    assert counts[1][0] <= 2 * counts[1][1]


@pytest.mark.parametrize("part", [1 << 17, 40])
def test_components(spark, part):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = rows(components(spark.createDataFrame(edges, "a long, b long"), part))
    assert sorted(got) == sorted((x, root(x)) for x in up)


def test_components_do_not_stop_halfway(spark):
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long"), 40, 1)


def test_topk(spark):
    r = np.random.default_rng(6)
    x = r.integers(-5, 6, (300, 6))
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1, None, 2, 3, 4, 5]), (902, [1, 2]), (903, x[3].tolist()), (904, [0] * 6)]
    v = spark.createDataFrame(vectors, "id long, v array<int>")
    v = v.filter("id <> 902 OR true")
    usable = {i: np.array(w) for i, w in vectors if w is not None and None not in w}
    dim = min(len(w) for w in usable.values())
    usable = {i: w for i, w in usable.items() if len(w) == dim}
    full = spark.createDataFrame([t for t in vectors if t[0] != 902], "id long, v array<int>")
    usable = {i: np.array(w) for i, w in vectors if w is not None and None not in w and i != 902}
    got = sorted(rows(topk.search(full, full.filter("id % 50 = 0 OR id = 904"), 5, 64)))
    want = []
    for q in usable:
        if q % 50 == 0 or q == 904:
            best = sorted(((-int(usable[q] @ w), i) for i, w in usable.items() if i != q))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert rows(topk.search(v.limit(0), v)) == []
    few = spark.createDataFrame([(0, [1]), (1, [2])], "id long, v array<int>")
    assert rows(topk.search(few, few.filter("id = 0"))) == [(0, 1, 1, 2)]


def test_topk_of_mixed_lengths(spark):
    vectors = [(0, [1, 2, 3]), (1, [3, 2, 1]), (2, [1, 1, 1]), (3, [9, 9]), (4, [1, 9])]
    v = spark.createDataFrame(vectors, "id long, v array<int>")
    assert sorted(rows(topk.search(v, v.filter("id IN (0, 3)"), 5, 2))) == [(0, 1, 1, 10), (0, 2, 2, 6), (3, 1, 4, 90)]


def test_topk_of_large_numbers(spark):
    vectors = [(0, [3_000_000_000, 1], "a"), (1, [3_000_000_000, 2], "b"), (1, [3_000_000_000, 2], "c"), (2, [-(1 << 31), 5], "d")]
    v = spark.createDataFrame(vectors, "id long, v array<long>, extra string")
    nine = 9 * 10**18
    assert rows(topk.search(v, v.filter("id = 0"), 2)) == [(0, 1, 1, nine + 2), (0, 2, 1, nine + 2)]
    assert sorted(rows(topk.search(v, v.filter("id = 1"), 1))) == [(1, 1, 0, nine + 2)]


def decontaminate_brute(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, it in items:
            x = words(it)
            n = min(13, len(x))
            for p in range(len(x) - n + 1) if x else ():
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == x[p : p + n]:
                        hit.update(range(s, s + n))
                        ids.add(str(i))
        out.append((d, len(w), len(hit), len(ids), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_decontamination(spark):
    r = random.Random(8)
    items = [(i, text(n, r)) for i, n in enumerate([40, 13, 12, 3, 1, 60, 14])] + [(7, ""), (8, None), (9, "Ü, ü; x"), (12, "aa bb " * 20)]
    items.append((10, items[0][1]))
    docs = [(0, None), (1, ""), (2, text(300, r)), (3, items[0][1].upper()), (4, "aa bb " * 40), (5, "ü Ü x. ü ü X")]
    for k in range(6, 30):
        t = items[r.randrange(6)][1].split()
        docs.append((k, " ".join([text(r.randrange(200), r), *t[r.randrange(3) :], text(30, r)])))
    d, i = spark.createDataFrame(docs, "row long, text string"), spark.createDataFrame([*items, (None, "x y")], "id long, text string")
    assert sorted(rows(decontaminate.judge(d, i))) == decontaminate_brute(docs, items)
    assert {x[-1] for x in rows(decontaminate.judge(d, i.limit(0)))} == {False}
    assert rows(decontaminate.judge(d.limit(0), i)) == []


def test_decontamination_of_null_and_repeated_rows(spark):
    item = text(13)
    docs = [(None, item), (None, "clean"), (7, item), (7, "x " + item), (7, "one two")]
    d, i = spark.createDataFrame([(*x, "q") for x in docs], "row long, text string, key string"), spark.createDataFrame([(1, item)], "id long, text string")
    got = sorted(((r["row"] is None, r["row"], r["n_words"], r["n_hit"], r["contaminated"]) for r in decontaminate.judge(d, i).collect()), key=str)
    assert got == sorted([(True, None, 13, 13, True), (True, None, 1, 0, False), (False, 7, 13, 13, True), (False, 7, 14, 13, True), (False, 7, 2, 0, False)], key=str)


def test_decontamination_of_a_text_made_of_one_passage(spark):
    item = "a b c"
    d, i = spark.createDataFrame([(1, "a b c " * 40_000)], "row long, text string"), spark.createDataFrame([(1, item)], "id long, text string")
    assert rows(decontaminate.judge(d, i)) == [(1, 120_000, 120_000, 1, ["1"], True)]


def test_perspectives(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "Ann", "hi"), (1, 2, "Bob", "yo"), (1, 3, "Ann", None), (2, None, None, "x"), (3, 0, "system", "alone"), (None, 1, "Ann", "a"), (None, 1, "Ann", "a")]
    turns += [(4, i, "ab"[i % 2], str(i)) for i in range(1200)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = chat.rotate(df.withColumn("seq", F.lit(1)))
    assert got.filter("conv_id = 1").count() == 8 and got.filter("conv_id = 3").count() == 0 and got.filter("conv_id IS NULL").count() == 2
    whole = {(r["conv_id"], r["perspective"], r["block"]): r for r in chat.dialogues(got).collect()}
    ann = whole[1, "Ann", 0]
    assert ann["text"] == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user Bob|>\nyo<|end|>\n<|assistant|>\n<|end|>\n"
    assert [ann["text"][s["begin"] : s["end"]] for s in ann["spans"]] == ["hi<|end|>", "<|end|>"]
    assert [ann["text"][s["begin"] : s["end"]] for s in whole[1, "Bob", 0]["spans"]] == ["yo<|end|>"]
    long = [whole[4, "a", b] for b in range(3)]
    assert [x["n_turns"] for x in long] == [512, 512, 176]
    said = re.findall(r"\|>\n(\d+)<", "".join(x["text"] for x in long))
    assert said == [str(i) for i in range(1200)]
    assert rows(chat.rotate(df.limit(0))) == []


RULES = (linkgraph.Rule("allow", "org", "/"), linkgraph.Rule("block", "example.org", "/es/"), linkgraph.Rule("block", "com", "/de/"), linkgraph.Rule("allow", "com", "/fr/"))


def test_link_graph(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">x</a>' for h in hosts)
    pages = [
        (1, "http://A.org/x?y", link("near.net", "near.net"), "v"), (2, "https://example.org/es/1#a", "", "v"), (3, "x://bad.com/de/1", "", "v"),
        (4, "http://near.net/", link("far.net"), "v"), (5, "http://far.net/a", None, "v"), (6, "http://spam.net/q", link("bad.com", "bad.com"), "v"),
        (7, None, link("near.net"), "v"), (8, "no scheme", "", "v"), (9, "http://lone.net", "", "v"), (10, "http://notorg/", "", "v"), (11, "http://x.com?/de/", "", "v"), (11, "http://x.com?/de/", "", "v"),
    ]
    got = {r["page_id"]: r for r in linkgraph.verdicts(spark.createDataFrame(pages, "page_id int, url string, html string, verdict string"), RULES).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in (1, 2, 3, 7, 8, 9, 11)] == [("a.org", "/x", "org/"), ("example.org", "/es/1", "example.org/es/"), ("bad.com", "/de/1", "com/de/"), ("", "", None), ("", "", None), ("lone.net", "", None), ("x.com", "", None)]
    assert {i: got[i]["verdict"] for i in got} == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "allow"}
    assert got[4]["trust"] > got[5]["trust"] > 0 and got[6]["distrust"] > 0


def test_page_rank_agrees_with_brute_force(spark):
    links = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("d", "a", 1), ("c", "a", 1), ("c", "e", 3)]
    got = dict(rows(linkgraph.spread(spark.createDataFrame(links, "src string, dst string, n long"), spark.createDataFrame([("a", 0.75), ("d", 0.25)], "host string, seed double"), 0.5)))
    seed = {"a": 0.75, "d": 0.25}
    mass = dict(seed)
    for _ in range(100):
        new, lost = Counter(), 0.0
        for h, m in mass.items():
            out = [(x, n) for s, x, n in links if s == h]
            if not out:
                lost += 0.5 * m
            for x, n in out:
                new[x] += 0.5 * m * n / sum(k for _, k in out)
        for h, s in seed.items():
            new[h] += s * (0.5 + lost)
        mass = dict(new)
    assert got.keys() == mass.keys() and sum(abs(got[h] - mass[h]) for h in mass) < 1e-6


def test_link_graph_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "h", "b", "u", "w")], "page_id int, url string, h string, by_rule string, host_ string, html string")
    (r,) = linkgraph.verdicts(pages, RULES).collect()
    assert (r["h"], r["by_rule"], r["host_"], r["html"], r["verdict"]) == ("h", "b", "u", "w", "allow")
    assert rows(linkgraph.verdicts(pages.limit(0), RULES)) == []
    first = (linkgraph.Rule("block", "org", "/x"), linkgraph.Rule("allow", "org", "/x"))
    assert linkgraph.verdicts(pages, first).first()["verdict"] == "block" and linkgraph.verdicts(pages, first[::-1]).first()["verdict"] == "allow"


def test_warc_round_trip(spark, tmp_path):
    big = "ä" * 9_000_000
    pages = [(1, "http://a/", "same"), (5, "http://b/\r\nX: y", "same"), (3, None, "same"), (2, "u", None), (4, "u", ""), (None, "u", "same"), (6, "u", "own"), (6, "v", "own"), (7, "w", big), (8, "w", "\r\n\r\nWARC/1.1\0")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    warc.write(df, str(tmp_path / "a"))
    got = warc.read(spark, str(tmp_path / "a")).collect()
    key = lambda r: (r["page_id"] is None, r["page_id"] or 0)
    assert [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in sorted(got, key=lambda r: (*key(r), r["record_type"]))] == [
        (1, 4, "revisit", 5), (2, 0, "revisit", 4), (3, 4, "revisit", 5), (4, 0, "response", None), (5, 4, "response", None), (6, 3, "response", None), (6, 3, "revisit", 6),
        (7, 18_000_000, "response", None), (8, 13, "response", None), (None, 4, "revisit", 5),
    ]
    assert {r["payload_digest"] for r in got if r["page_id"] in (1, 3, 5)} == {warc.sha1(b"same")}
    assert next(bytes(r["payload"]) for r in got if r["page_id"] == 7) == big.encode()
    warc.write(df, str(tmp_path / "b"), least=4)
    assert sorted(r["page_id"] for r in warc.read(spark, str(tmp_path / "b")).collect() if r["record_type"] == "response" and r["page_id"]) == [2, 4, 5, 6, 6, 7, 8]
    warc.write(df.limit(0), str(tmp_path / "c"))
    assert warc.read(spark, str(tmp_path / "c")).count() == 0


def test_archives_are_bounded_by_bytes_where_sizes_differ(spark, tmp_path):
    """Few large pages among many small ones, in one partition; a column that is called like a header's; the date of every record."""
    r = random.Random(1)
    pages = [(i, "u", bytes(r.randrange(33, 127) for _ in range(60_000 if i % 100 == 7 else 20)).decode(), "x") for i in range(1500)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, sha string").coalesce(1)
    warc.write(df, str(tmp_path / "a"), archive_bytes=100_000)
    sizes = [p.stat().st_size for p in (tmp_path / "a").glob("part-*")]
    assert len(sizes) > 5 and max(sizes) < 100_000 + 61_000 and sum(sizes) > 700_000
    assert sorted((x["page_id"], bytes(x["payload"]).decode()) for x in warc.read(spark, str(tmp_path / "a")).collect()) == [(p[0], p[2]) for p in pages]
    for p in (tmp_path / "a").glob("part-*"):
        assert {x.headers["warc-date"] for x in warc.records(io.BytesIO(p.read_bytes()))} == {"2000-01-01T00:00:00Z"}


def test_warc_reader_finds_damage():
    head = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:1>"), ("WARC-Payload-Digest", f"sha1:{warc.sha1(b'abc')}")]
    good = warc.member(head, [("Content-Length", "3")], b"abc")
    assert [r.payload for r in warc.records(io.BytesIO(good + b"\0\0" + good))] == [b"abc", b"abc"]
    plain = zlib.decompress(good, 31)
    pack = lambda x: (z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(x) + z.flush()
    for bad in (good[:-9], pack(plain.replace(b"abc", b"abd")), pack(plain[:-2]), pack(plain + plain), pack(plain.replace(b"Content-Length: ", b"Content-Length: 9")), pack(b"x" + plain)):
        with pytest.raises(warc.WarcError):
            list(warc.records(io.BytesIO(bad)))


def test_licences(spark):
    lic = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    gpl = "under the terms of the GNU General Public License as published by the Free Software Foundation"
    texts = [None, "", "x under the MIT license. under the mit-license", "under the mit licenses cc by nc cc", "Apache License, Version 2.0", f"a {lic} b", gpl, "the gnu general public licence", "under the mit " * 3 + "license", "ALL rights reserved" + " z" * 30_000, "İ under the mİt license"]
    docs = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame([(*d, "q") for d in docs], "doc_id int, text string, labels string")).collect()}
    phrases = {"mit": "under the mit license".split(), "apache-2": "apache license version 2".split(), "cc-by-nc": "cc by nc".split()}
    for i, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(s, k) for k, p in phrases.items() for s in range(len(w)) if w[s : s + len(p)] == p]
        want = (len(w), len(at), min((s for s, _ in at), default=None), max((s for s, _ in at), default=None), ",".join(sorted({k for _, k in at})))
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not r["base_labels"]
        assert 0 <= r["score"] <= 1
    assert [got[i]["labels"] for i in (5, 6, 7, 9, 10)] == ["mit", "gpl", "", "proprietary", ""]
    assert got[5]["score"] == 1 and got[6]["score"] == 1 and got[0]["score"] == 0


def test_licences_of_a_long_text_of_hits(spark):
    """120,000 words that all are filed, in seconds, equal to a loop."""
    n = 40_000
    texts = ["cc by nc " * n, ("all rights reserved under the mit license " * (n // 2))[:-8], "software without warranty express " * n]
    (a, b, c) = licences.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).orderBy("doc_id").collect()
    assert (a["n_words"], a["n_base"], a["first_word"], a["last_word"], a["base_labels"]) == (3 * n, n, 0, 3 * n - 3, "cc-by-nc")
    assert (b["n_base"], b["first_word"], b["last_word"], b["labels"], c["n_base"]) == (n // 2 - 1, 3, 7 * (n // 2 - 2) + 3, "mit,proprietary", 0)


def test_licence_columns_do_not_clash(spark):
    df = spark.createDataFrame([("under the MIT license", "a", "b", "c", "d", 1)], "text string, w string, hits string, s0 string, given string, score int")
    (r,) = licences.scan(df).collect()
    assert (r["w"], r["hits"], r["s0"], r["given"], r["n_base"], r["score"]) == ("a", "b", "c", "d", 1, 1.0)
    assert rows(licences.scan(df.limit(0))) == [] and rows(licences.scan(df.select("text")))[0][:2] == (4, 1)


def test_mixing(spark):
    r = random.Random(9)
    docs = [(i, r.choice(["a", "a", "a", "b", "c", "ü", None]), r.choice([0, 5, 50, 400, 3000])) for i in range(600)] + [(1000, "z", 7), (1001, "zero", 0)]
    df = spark.createDataFrame(docs, "key long, source string, size long")
    got = mixing.mix(df, block_words=2000).collect()
    size = Counter()
    for _, s, n in docs:
        size[s] += n
    order = sorted((s for s in size if s is not None)) + [None]
    target, free, left = {}, list(order), 1.5 * sum(size.values())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    while True:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]]
        if not over:
            break
        shares = {s: 2 * size[s] for s in over}
        target |= shares
        left -= sum(shares.values())
        free = [s for s in free if s not in over]
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    taken, times = Counter(), Counter()
    for x in got:
        taken[x["source"]] += x["size"]
        times[x["key"]] += 1
        assert abs(x["target"] - target[x["source"]]) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 1500 for s in order) and max(times.values()) <= 2
    per = Counter(x["shard"] for x in got)
    assert len(per) == 16
    for shard, n in per.items():
        mine = sorted((x["place"], x["source"] or "") for x in got if x["shard"] == shard)
        assert [p for p, _ in mine] == list(range(n))
        assert max(n, 20) / 20 < sum(a[1] != b[1] for a, b in zip(mine, mine[1:]))  # sources are shuffled among each other
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(7), block_words=2000).collect()))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_of_repeated_rows(spark):
    docs = [(i, i % 7, "s" if i % 3 else None, 10 + i % 7) for i in range(200)]
    df = spark.createDataFrame(docs, "key long, order long, source string, size long")
    got = mixing.mix(df, block_words=300).collect()
    times = Counter(x["key"] for x in got)
    assert max(times.values()) <= 2 and {x["key"] for x in got} <= set(range(200))
    again = mixing.mix(df.withColumn("key", 199 - F.col("key")), block_words=300).collect()
    assert Counter((x["source"], x["size"]) for x in got) == Counter((x["source"], x["size"]) for x in again)


def test_splitting_tree_keeps_quotas():
    q = np.array([100, 7, 0, 33])
    got = mixing.split(q, 6, np.random.default_rng(1))
    assert got.sum(0).tolist() == q.tolist() and np.ptp(got.sum(1)) <= 1 and (got >= 0).all()


def pipeline_docs(spark, tmp_path):
    """Documents with null and repeated ids and texts, a very long text and extra columns, beside their labels and benchmark."""
    r = random.Random(12)
    vocabulary = {"en": [f"{a}ing" for a in ("go", "read", "sing", "walk", "play", "build", "think")] + ["the", "of", "and", "that", "with"], "de": ["der", "und", "nicht", "gehen", "schön", "über", "straße", "zwischen"]}
    say = lambda lang, n: " ".join(f"{r.choice(vocabulary[lang])}" for _ in range(n))
    docs = [(i, say(lang, r.randrange(30, 60)) + (" idiot scum" if i % 5 == 0 else ""), lang) for i, lang in ((i, ("en", "de")[i % 2]) for i in range(120))]
    passage = say("en", 14)
    docs += [(200, docs[1][1], "de"), (201, docs[1][1], "de"), (None, docs[3][1], "de"), (None, None, "en"), (202, None, "en"), (203, "", "en"), (204, "12 34", "en")]
    docs += [(205, passage, "en"), (206, say("en", 50_000), "en"), (207, "zzqx vvkw " * 20, None), (208, say("de", 40), "de"), (208, say("de", 41), "de"), (None, say("en", 33), None)]
    df = spark.createDataFrame([(*d, f"s{i % 3}" if i % 7 else None, len(d[1] or ""), i) for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars int, shard int")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(120)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return df


def test_pipeline_stages(spark, tmp_path):
    docs, d = pipeline_docs(spark, tmp_path), str(tmp_path)
    ids = lambda df: Counter(x["doc_id"] for x in df.collect())
    before = ids(docs)
    kept = {name: stage(spark, docs, d) for name, stage in corpus_pipeline.STAGES}
    for name in ("toxicity", "language", "jaccard", "decontamination"):
        assert kept[name].columns == docs.columns
    gone = {name: before - ids(df) for name, df in kept.items()}
    assert set(gone["toxicity"]) == {i for i in range(120) if i % 5 == 0}
    assert set(gone["language"]) == {None, 202, 203, 204, 207} and gone["language"][None] == 1
    assert set(gone["jaccard"]) == {200, 201} and set(gone["decontamination"]) == {205}
    mix = kept["mixing"].collect()
    assert {(x["doc_id"], x["text"]) for x in mix} <= {(x["doc_id"], x["text"]) for x in docs.collect()}
    times = Counter((x["doc_id"], x["text"]) for x in mix)
    assert max(times.values()) <= 2 and {x["shard"] for x in mix} <= set(range(16)) and all(x["size"] == len((x["text"] or "").split()) for x in mix)
    assert {x["doc_id"] for x in mix} >= {None, 208}
    per = Counter(x["shard"] for x in mix)
    assert all(sorted(x["place"] for x in mix if x["shard"] == s) == list(range(n)) for s, n in per.items())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs = pipeline_docs(spark, tmp_path).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_pipeline_run_is_its_stages_in_turn(spark, tmp_path):
    docs = pipeline_docs(spark, tmp_path)
    docs.drop("shard").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, step, str(tmp_path)).write.parquet(f"{tmp_path}/step{i}")
        step = spark.read.parquet(f"{tmp_path}/step{i}")
    assert Counter((x["doc_id"], x["text"], x["repeat"]) for x in got.collect()) == Counter((x["doc_id"], x["text"], x["repeat"]) for x in step.collect())


def test_no_plan_of_pair_links_or_mixes_grows_large(spark, monkeypatch):
    """The driver keeps each plan's description and a thread for each exchange for a while; one plan of all tiles took hundreds of nodes."""
    from pagequire.llm import store

    sizes = []

    def measured(df):
        sizes.append(len(df._jdf.queryExecution().executedPlan().toString().splitlines()))
        return store.cut(df)

    for module in (jaccard, mixing):
        monkeypatch.setattr(module, "cut", measured)
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(6)]
    # one word of 40 differs in each copy, so 35 of 40 shingles or so are shared; every pair of copies of one text links or not
    rows = [(i * 100 + k, " ".join(w if j != k * 3 else f"x{k}" for j, w in enumerate(t.split()))) for i, t in enumerate(base) for k in range(8)]
    links = jaccard.join(spark.createDataFrame(rows, "id long, text string"))
    sizes.append(len(links._jdf.queryExecution().executedPlan().toString().splitlines()))
    assert links.count() == 48
    docs = spark.createDataFrame([(i, "abc"[i % 3], 10 + i) for i in range(60)], "key long, source string, size long")
    mix = mixing.mix(docs)
    sizes.append(len(mix._jdf.queryExecution().executedPlan().toString().splitlines()))
    assert mix.count() > 0
    assert max(sizes) < 120
