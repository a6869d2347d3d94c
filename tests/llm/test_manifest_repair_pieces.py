"""Manifest, repair and pieces against brute force and the tokenizer's library, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequire.llm import manifest, pieces, registry, repair

sha = lambda s: hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def climbed(leaves, fanout):
    """(root, path of (left, right) for each leaf) of one tree."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for p, i in zip(paths, at, strict=True):
            first = i - i % fanout
            p.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + fanout])))
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0] if nodes else None, paths


def manifest_brute(rows, fanout=2):
    """{(grp, key, leaf): (subroot, root, path)}."""
    groups = {}
    for g, key, leaf in rows:
        groups.setdefault(g, []).append((key is not None, key or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climbed([x[2] for x in sorted(groups[g])], fanout) for g in order}
    root, over = climbed([trees[g][0] for g in order], fanout)
    out = []
    for g, up in zip(order, over, strict=True):
        for (there, key, leaf), path in zip(sorted(groups[g]), trees[g][1], strict=True):
            out.append((g, key if there else None, leaf, trees[g][0], root, path + up))
    return out


@pytest.mark.parametrize(("fanout", "levels", "n"), [(2, 2, 137), (2, 1, 41), (3, 2, 60), (2, 3, 1), (2, 2, 0)])
def test_manifest_agrees_with_brute_force(spark, fanout, levels, n):
    r = random.Random(n)
    rows = [(r.choice(["en"] * 6 + [None, "", "é", "z", "one"][: 1 + n // 30]), r.choice([None, *range(2 * n)]), sha(str(i))) for i in range(n)]
    rows += rows[:3]
    df = spark.createDataFrame([(*x, 7) for x in rows], "grp string, key long, leaf string, PATH int").repartition(5)
    got = manifest.manifest(df, fanout, levels).select("grp", "key", "leaf", "subroot", "root", F.transform("path", lambda s: F.concat_ws("|", F.lower(F.hex(s.left)), F.lower(F.hex(s.right)))).alias("p"), manifest.proof(F.col("path")).alias("proof"), manifest.fold(F.col("path"), F.col("leaf")).alias("up")).collect()
    want = manifest_brute(rows, fanout)
    assert sorted(map(str, [tuple(x)[:6] for x in got])) == sorted(map(str, [(*x[:5], ["|".join(s) for s in x[5]]) for x in want]))
    assert all(x["up"] == x["root"] and x["proof"] == sha("".join(x["p"]).replace("|", "")) for x in got)


def test_manifest_of_documents(spark, tmp_path):
    """Null columns, a long text, repeated rows, equal ids, tampering that a null n_chars escapes, and clashing columns."""
    rows = [(i, "x" * (i % 5), [None, "s"][i % 2], ["en", None, "de"][i % 3], None if i % 4 == 0 else i, 1) for i in range(60)]
    rows += [(None, "é" * 200_000, "s", "en", 1, 1), (5, "x", "s", "en", 2, 1), rows[7], rows[7]]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, leaf int").write.parquet(f"{tmp_path}/documents.parquet")
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, s, lang, n: sha("".join(map(told, (d, s, lang, n, t))))
    want = []
    up = {x[:3]: x[3:] for x in manifest_brute([(lang, d, leaf(d, t, s, lang, n)) for d, t, s, lang, n, _ in rows])}
    for d, t, s, lang, n, _ in rows:
        own = leaf(d, t, s, lang, n)
        hit = d is not None and zlib.crc32(str(d).encode()) % 7 == 0 and n is not None
        subroot, root, path = up[lang, d, own]
        h = leaf(d, t, s, lang, n + 1) if hit else own
        for a, b in path:
            h = sha(a + h + b)
        want.append((d, own, subroot, root, h, h == root))
    got = registry.op11_merkle_manifest(spark, str(tmp_path)).collect()
    # repeated rows have places of their own beside equal leaves, hence only rows that are not repeated are compared in full
    assert sorted(map(str, {x[:4] for x in want})) == sorted(map(str, {(x["doc_id"], x["leaf"], x["subroot"], x["root"]) for x in got}))
    assert len(got) == len(rows) and [x["verified"] for x in sorted(got, key=str)].count(False) == sum(not x[5] for x in want)
    once = {x for x in want if sum(y[1] == x[1] for y in want) == 1}
    assert once <= {(x["doc_id"], x["leaf"], x["subroot"], x["root"], x["folded_root"], x["verified"]) for x in got}


def repaired_brute(rows):
    """(cost, audit) by dynamic programming over (row, state), rows of (initial, fault)."""
    step = {0: 2, 1: 2, 2: 3, 3: 2}
    front = {0: (0, "")}

    def better(d, q, v):
        if q not in d or v < d[q]:
            d[q] = v

    def inserted(d):
        for _ in range(3):
            for q, (c, a) in list(d.items()):
                better(d, step[q], (c + 5, a + "I"))

    for initial, fault in rows:
        inserted(front)
        new = {}
        for q, (c, a) in front.items():
            better(new, q, (c + 2, a + "D"))
            if fault not in "bd":
                more = 5 * (fault == "t")
                better(new, step[q], (c + 1 + more, a + "R"))
                if initial == {2: "u", 3: "a"}[step[q]]:
                    better(new, step[q], (c + more, a + "K"))
                if q == 0 and initial == "s":
                    better(new, 1, (c + more, a + "K"))
        front = new
    inserted(front)
    return min(front[q] for q in (0, 3) if q in front)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suua?a"), st.sampled_from("kkkkktbd")), max_size=14))
def test_search_agrees_with_dynamic_programming(rows):
    assert repair.search("".join(c for c, _ in rows), "".join(f for _, f in rows), repair.NONE, repair.ENDS) == repaired_brute(rows)


def test_search_over_a_long_conversation():
    r = random.Random(4)
    rows = [(r.choice("suua?a"), r.choice("kkkkktbd")) for _ in range(700)]
    assert repair.search("".join(c for c, _ in rows), "".join(f for _, f in rows), repair.NONE, repair.ENDS) == repaired_brute(rows)


def brute_conversations(turns):
    out = {}
    for conv, turn, role, text in turns:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    told = {}
    for conv, rows in out.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), sha(x[2])))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.strip(" \t\n\v\f\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "k")
            seen.add((role, text))
        initials = [(role[:1] if role[:1] in ("s", "u", "a") else "?") for _, role, _ in rows]
        cost, audit = repaired_brute(list(zip(initials, faults, strict=True)))
        at = iter(zip(rows, initials, strict=True))
        lines, before = [], ""
        for e in audit:
            (_, role, text), c = (("", "", ""), "") if e == "I" else next(at)
            if e != "D":
                own = "s" if e == "K" and c == "s" else "u" if before in ("", "s", "a") else "a"
                lines.append(f"{role if e == 'K' else {'u': 'user', 'a': 'assistant'}[own]}:{'' if e == 'I' else text}")
                before = own
        known = [t for t, *_ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        told[conv] = (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, sha("\n".join(lines)))
    return told


TURNS = "conv_id long, turn long, role string, text string, cost int"


@pytest.mark.parametrize("block", [3, 512])
def test_repair_of_whole_conversations(spark, block):
    """Nulls everywhere, equal turns, unknown roles, copies, a conversation of a third of all rows in small blocks."""
    r = random.Random(8)
    said = ["Yes.", "No!", "Why?", "and", "", " \t", "ok. ", None, "ça.\n", "。", "x" * 50_000]
    turns = [(r.choice([None, *range(12), *[99] * 6]), r.choice([None, *range(9)]), r.choice(["user", "assistant", "system", "tool", None, "User", ""]), r.choice(said)) for _ in range(260)]
    turns += [(500, i, ["system", "user", "assistant", "user", "assistant"][i % 5], f"Line {i}.") for i in range(90)]
    turns = sorted(set(turns), key=str)  # rows that are equal in all columns are in the next test
    told, rows = repair.repair(spark.createDataFrame([(*x, 1) for x in turns], TURNS).repartition(7), block)
    lines = {r["g"]: r["sha256"] for r in repair.digests(rows).collect()}
    got = {r["conv_id"]: (*(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), lines.get(r["g"], sha(""))) for r in told.collect()}
    assert got == brute_conversations(turns)
    every = [r["role"][0] for r in sorted(rows.filter("conv_id = 500").collect(), key=lambda r: r["place"])]
    assert "".join(every).lstrip("s").replace("ua", "") == "" and {r["edit"] for r in rows.collect()} <= {"K", "R", "I"}


def test_conversation_repair_query(spark, tmp_path):
    """Damage by the rule, a conversation of which nothing is left, repeated rows, a null id, an empty table."""
    gone = next(i for i in range(1000, 10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    turns = [(i, j, ["user", "assistant"][j % 2], f"Turn {j} of {i}. So?" if j % 7 else "Hm") for i in range(40) for j in range(i % 9)]
    turns += [(gone, 0, "user", "Bye."), (None, 0, "user", "A."), (None, None, None, None), *turns[5:8]]
    spark.createDataFrame([(*x, 1) for x in turns], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    harmed = []
    for conv, turn, role, text in turns:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        harmed += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    want = {conv: (0, 0, 0, 0, 0, 0, "", sha("")) for conv, *_ in turns} | brute_conversations(harmed)
    got = {r["conv_id"]: tuple(r)[1:] for r in registry.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert want[gone][6] == "" and got == want
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert registry.op12_conversation_repair(spark, f"{tmp_path}/none").collect() == []


@pytest.fixture(scope="module")
def model():
    return __import__("public_tokenizers").path(registry.PIECES)


@pytest.fixture(scope="module")
def library(model):
    return __import__("sentencepiece").SentencePieceProcessor(model_file=model)


@pytest.fixture(scope="module")
def loaded(model):
    return pieces.load(model)


_TEXT = st.text(alphabet=st.one_of(st.sampled_from(list(" abeth\n\t▁é中国😀\x00①<s>/0x=-")), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(_TEXT, max_size=6))
def test_pieces_of_any_texts(loaded, library, texts):
    got = pieces.tokenize(loaded, texts)
    assert [g.tolist() for g in got] == [library.encode(t) for t in texts]
    flat = np.concatenate(got) if got else np.zeros(0, np.int64)
    assert pieces.detokenize(loaded, flat.astype(np.int64), np.array([g.size for g in got], np.int64)) == [library.decode(g.tolist()) for g in got]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=8), max_size=5))
def test_any_ids_decode_as_in_the_library(loaded, library, ids):
    got = pieces.detokenize(loaded, np.array([i for x in ids for i in x], np.int64), np.array([len(x) for x in ids], np.int64))
    assert got == [library.decode(x) for x in ids]


def test_pieces_of_long_runs_and_long_texts(loaded, library):
    r = random.Random(3)
    long = [" " * 3000, "x" * 5000, "=-" * 900, "ab" * 2000, "".join(r.choice("etaoin") for _ in range(4000)), "the end of it. " * 9000, "中" * 300 + " é" * 300]
    want = [library.encode(t) for t in long]
    assert [g.tolist() for g in pieces.tokenize(loaded, long)] == want
    # parts of 100 characters, and a heap from the third round on, give the same
    assert [g.tolist() for g in pieces.tokenize(loaded, long, 100)] == want
    for t in long[:5]:
        word = loaded.symbol[[ord(c) for c in "▁" + t.replace(" ", "▁")]]
        assert pieces.merge(loaded, word, np.array([0]), 2)[0].tolist() == library.encode(t)


def test_words_with_equal_hashes_stay_apart(monkeypatch):
    monkeypatch.setattr(pieces, "_POWERS", np.zeros(4, np.uint64))
    sym, first = np.array([5, 6, 5, 7, 5, 6, 9]), np.array([0, 2, 4, 6])
    kept, of = pieces._distinct(sym, first)
    word = lambda i: sym[first[i] : [*first[1:], sym.size][i]].tolist()
    assert [word(kept[o]) for o in of] == [word(i) for i in range(4)]


def test_pieces_query(spark, tmp_path, library):
    rows = [(1, "Hello  world", 7), (2, None, 7), (3, "", 7), (None, "Ünï\x00 😀", 7), (1, "Hello  world", 7), (5, "word " * 60_000, 7)]
    spark.createDataFrame(rows, "doc_id long, text string, IDS int").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(str, map(tuple, registry.op13_pieces(spark, str(tmp_path)).collect()))) == sorted(map(str, want))
    none = spark.createDataFrame([], "doc_id long, text string, decoded string")
    model = __import__("public_tokenizers").path(registry.PIECES)
    assert pieces.decode(pieces.encode(none, model), model).columns == ["doc_id", "text", "ids", "decoded"]
    assert pieces.decode(pieces.encode(none, model), model).collect() == []


def test_a_model_of_another_kind_is_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"")
    with pytest.raises(ValueError, match="only BPE"):
        pieces.load(str(tmp_path / "m"))
