"""Queries of the pipeline operators on small tables with nulls and repeats, against SQL and loops."""

import random
import re
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from pagequire.llm import registry, toxicity

R = random.Random(77)


def sql(path, query):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return c.execute(query).fetchall()


def test_licence_query_counts_as_sql_does(spark, tmp_path):
    parts = ["under the MIT license", "Under, the mit-License", "apache license version 2", "Apache License, Version 2.0", "cc by nc", "CC-BY-NC", "cc by", "under the mit", "license", "Ünder", "x", "\t\n", "all rights reserved"]
    docs = [(i if i % 9 else None, " ".join(R.choices(parts, k=R.randrange(0, 25)))) for i in range(200)] + [(1000, None), (1001, ""), (3, "cc by nc cc by nc")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op9_licence_index(spark, str(tmp_path)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    split = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    want = sql(tmp_path, f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents), p AS (SELECT unnest(['under the mit license', 'apache license version 2', 'cc by nc']) AS phrase, unnest(['mit', 'apache-2', 'cc-by-nc']) AS label, unnest([4, 4, 3]) AS n),
      places AS (SELECT r, label, i - 1 AS i FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d), p WHERE array_to_string(w[i:i + n - 1], ' ') = phrase),
      f AS (SELECT r, count(*) AS n_base, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r)
      SELECT doc_id, len(w), coalesce(n_base, 0), a, z, coalesce(labels, '') FROM d LEFT JOIN f USING (r)""")
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(r["n_base"] for r in got) > 300


def test_link_query_judges_urls_as_a_loop_does(spark, tmp_path):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    urls = [None, "", "no scheme", "http://", "http://A.com/fr/x", "https://b.Com/de/y?q", "http://x.example.org/es/1#z", "http://example.org/en/12", "http://example.org/en/2", "ftp://org/", "http://notexample.org/es/", "http://b.com?x=/fr/", "http://com/fr/", "x://y://z", "http://org#f", "http://a.net/de/"]
    pages = [(i, u, f'<a href="http://x.example.org/">{i}</a>' if i % 3 else None) for i, u in enumerate([*urls, *urls[4:8]])]
    spark.createDataFrame([*pages, (None, "http://q.org/", "x")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in registry.op6_link_graph(spark, str(tmp_path)).collect()}
    for i, url, _ in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda f: len(f[1]), default=None)
        assert got[i][:2] == (host, path) and got[i][2] == (best and best[1]) and got[i][3] in (("allow", "block") if best is None else (best[0],))
    assert got[None][2] == "org/" and len(got) == len(pages) + 1


def test_mixing_query_on_null_and_repeated_ids(spark, tmp_path):
    """Sizes and targets against a loop; what is taken keeps to them, whatever the ids, and reruns agree."""
    docs = [(R.choice([None, 5, *range(100, 260)]), "w " * R.choice([0, 1, 9, 60, 300]), R.choice(["a", "a", "b", "ü", None])) for _ in range(240)]
    docs += docs[:4] + [(1, None, "tiny"), (2, "one", "z")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got, again = (registry.op10_mixing(spark, str(tmp_path)).select("doc_id", "size", "source_size", "target", "taken").collect() for _ in range(2))
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(docs)
    size = {}
    for _, text, source in docs:
        size[source] = size.get(source, 0) + len((text or "").split())
    order = [*sorted(s for s in size if s is not None), None]
    weight, target, free, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, list(order), 1.5 * sum(size.values())
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]]:
        target |= {s: 2 * size[s] for s in over}
        left, free = left - sum(2 * size[s] for s in over), [s for s in free if s not in over]
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    assert sorted((r["size"], r["source_size"]) for r in got) == sorted((len((t or "").split()), size[s]) for _, t, s in docs)
    assert {round(r["target"], 6) for r in got} == {round(t, 6) for t in target.values()}
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    for t in set(target.values()):
        mine = [s for s in target if target[s] == t]
        taken = sum(r["taken"] for r in got if abs(r["target"] - t) < 1e-6)
        assert abs(taken - t * len(mine)) <= 300 * len(mine)


def test_toxicity_query_never_learns_from_held_out_labels(spark, tmp_path):
    """Scores stay when labels of the held-out fold, languages and sources change; empty, null and long texts are scored."""
    word = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(R.choices(word, k=12)) + (" idiot" if i % 3 == 0 else ""), "en", "s") for i in range(300)]
    docs += [(None, "idiot", "en", "s"), (900, None, "en", "s"), (901, "", "en", "s"), (902, "idiot " * 100_000, "en", "s"), docs[4]]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    scores = []
    for k in range(2):
        d = f"{tmp_path}/{k}"
        spark.createDataFrame([(i, t, "de" if k else lang, "q" if k else s) for i, t, lang, s in docs], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
        labels = [(i, 1, (1 - int(i % 3 == 0)) if k and held(i) else int(i % 3 == 0)) for i in range(300)] + [(None, 1, 1), (901, 1, None), (5, 1, 7)]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        scores.append(sorted(map(str, map(tuple, registry.op8_toxicity_counterfactual(spark, d).collect()))))
        if not k:
            rows = registry.op8_toxicity_counterfactual(spark, d).collect()
    assert scores[0] == scores[1] and len(rows) == len(docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    fold = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 300 and r["held_out"]]
    assert all(held(r["doc_id"]) for r in fold) and sum((r["predicted"] == 1) == (r["doc_id"] % 3 == 0) for r in fold) >= 0.9 * len(fold)
    assert next(r for r in rows if r["doc_id"] == 902)["predicted"] == 1 and {r["score"] for r in rows if r["doc_id"] in (900, 901)} == {next(r for r in rows if r["doc_id"] == 900)["score"]}


def test_counterfactual_loss_is_at_its_minimum():
    """The fit against the loss written out, with its penalty on changes, at random places around it."""
    rng = np.random.default_rng(3)
    x, change = rng.normal(size=(80, 6)).astype(np.float32), rng.normal(size=(15, 6)).astype(np.float32)
    y = (x @ np.array([2, -1, 0, 0, 1, 0]) + rng.normal(size=80) > 0).astype(np.float32)

    def loss(w, b, fair):
        z = x.astype(float) @ w + b
        return np.mean(np.logaddexp(0, z) - y * z) + 0.01 / 2 * w @ w + fair * np.mean((change.astype(float) @ w) ** 2)

    for fair in (0.0, 1.0, 5.0):
        w, b = toxicity._descend(x, y, change, 0.01, fair, 3000)
        best = loss(w.astype(float), b, fair)
        assert all(loss(w + d[:6], b + d[6], fair) > best - 1e-7 for d in rng.normal(scale=0.05, size=(300, 7)))
