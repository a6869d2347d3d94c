"""Licence scan with a positional rare-token index; DataFrame functions only.

Templates are word sequences. Each is filed under its rarest words, by inverse document frequency over all documents,
with their places in it. A word of a text that is filed sets where the template would begin; places on which filed words
agree are candidates, and a template counts once its mandatory key phrases stand where that beginning puts them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """words: what the licence reads; key: (place, words) of mandatory phrases; base: whether its places are counted; least: filed words that must agree."""

    label: str
    words: tuple[str, ...]
    key: tuple[tuple[int, tuple[str, ...]], ...]
    base: bool = False
    least: int = 1


def base(label: str, phrase: str) -> Template:
    """A phrase that counts wherever it stands as a whole; where it does, all of its words agree."""
    words = tuple(phrase.split())
    return Template(label, words, ((0, words),), True, min(2, len(set(words))))


def licence(label: str, text: str, *key: str, least: int = 2) -> Template:
    """A licence sentence with mandatory phrases, which must be parts of it."""
    words = tuple(text.split())
    at = []
    for phrase in key:
        p = tuple(phrase.split())
        at.append((next(i for i in range(len(words)) if words[i : i + len(p)] == p), p))
    return Template(label, words, tuple(at), least=least)


#: The phrases that every scan counts.
BASE = (base("mit", "under the mit license"), base("apache-2", "apache license version 2"), base("cc-by-nc", "cc by nc"))
#: Sentences of public licences with the phrases that tell them apart.
LICENCES = (
    licence("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "granted free of charge", "obtaining a copy"),
    licence("apache-2", "licensed under the apache license version 2 0 the license", "apache license version 2 0"),
    licence("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms", "with or without modification"),
    licence("gpl", "under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    licence("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    licence("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    licence("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "distribute this software", "with or without fee"),
    licence("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    licence("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "commons attribution sharealike"),
    licence("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "commons attribution noncommercial"),
    licence("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software", "public domain"),
    licence("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    licence("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    licence("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "without any express or implied warranty", "held liable"),
    licence("cc0", "has waived all copyright and related or neighboring rights to this work", "waived all copyright", "neighboring rights"),
    licence("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license", "commons attribution noderivatives"),
    licence("proprietary", "all rights reserved", "all rights reserved", least=1),
)


def words(text: Column) -> Column:
    """The array of a text's words: A-Z lower-cased, runs of ASCII letters, digits and all beyond ASCII; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, _SPLIT), lambda w: w != "")


def _rarest(split: DataFrame, templates: Sequence[Template], rare: int) -> dict[str, float]:
    """Inverse document frequency of the templates' words over all documents; as many numbers as the templates have words."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = F.array_distinct(F.filter("w", lambda w: w.isin(vocabulary)))
    n, counts = split.count(), split.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    found = {r["word"]: r["n"] for r in counts}
    return {w: n / (1 + found.get(w, 0)) for w in vocabulary}


def _begins(hits: Column, filed: dict[str, Sequence[int]]) -> Column:
    """Where a template would begin by its filed words, in order: {word: its places in the template}, in one pass over the hits."""

    def places(h: Column) -> Column:
        at = F.when(F.lit(False), F.array(h.at))
        for word, own in filed.items():
            at = at.when(h.w == word, F.array(*[h.at - i for i in own]))
        return at

    return F.array_sort(F.filter(F.flatten(F.transform(F.filter(hits, lambda h: h.w.isin(list(filed))), places)), lambda s: s >= 0))


def _stands(w: Column, at: int, phrase: Sequence[str]) -> Callable[[Column], Column]:
    """Whether a template that begins at a place has its phrase where it belongs."""
    return lambda s: F.slice(w, (s + at + 1).cast("int"), len(phrase)) == F.array(*map(F.lit, phrase))


def scan(docs: DataFrame, templates: Sequence[Template] = BASE + LICENCES, rare: int = 3) -> DataFrame:
    """Columns of `docs(text)` but text, and n_words, n_base, first_word, last_word, base_labels, labels, score.

    rare: words under which a template is filed, its rarest. n_base: places of base phrases; first_word and last_word:
    the smallest and largest of them, from 0, else null; base_labels and labels: distinct, sorted, comma-joined; score:
    1 with a base phrase, else the largest share of a found template's words that stand where it puts them, else 0.
    Null and empty texts have no words. Every row is judged on its own without a shuffle, in time that grows with its
    length (by a sort of the places that templates may begin at); columns
    of the result's names are replaced, all others stay, and an empty table gives an empty one.
    """
    new = ("text", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    split = words(F.col("text"))
    idf = _rarest(docs.select(split.alias("w")), templates, rare)
    filed = {t: sorted(sorted(set(t.words), key=lambda w: (-idf[w], w))[: max(rare, t.least)]) for t in templates}
    keys = sorted({w for ws in filed.values() for w in ws})
    # what is worked out on the way has columns of its own beside a struct of the given ones, which cannot clash
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns if c.lower() not in new], F.lit(0).alias("_none")).alias("given"), split.alias("w"))
    # one pass over the words leaves the few that are filed, with their places
    hits = F.filter(F.transform("w", lambda w, i: F.when(w.isin(keys), F.struct(w.alias("w"), i.cast("long").alias("at")))), lambda x: x.isNotNull())
    rows = rows.withColumn("hits", hits)

    empty = F.expr("cast(array() as array<bigint>)")
    some = F.size("hits") > 0
    bases = [t for t in templates if t.base]
    others = [t for t in templates if not t.base]
    every = [*bases, *others]
    rows = rows.withColumns({f"b{i}": F.when(some, _begins(F.col("hits"), {w: [j for j, x in enumerate(t.words) if x == w] for w in filed[t]})).otherwise(empty) for i, t in enumerate(every)})

    def starts(i: int, t: Template) -> Column:
        """Beginnings on which enough words agree, as equal ones are neighbours now, and where the key phrases stand."""
        agree = F.zip_with(f"b{i}", F.slice(f"b{i}", t.least, F.size(f"b{i}")), lambda a, b: F.when(a == b, a))
        places = F.array_distinct(F.array_compact(agree))
        for at, phrase in t.key:
            places = F.filter(places, _stands(F.col("w"), at, phrase))
        return places

    rows = rows.withColumns({f"s{i}": F.when(F.size(f"b{i}") > 0, starts(i, t)).otherwise(empty) for i, t in enumerate(every)})
    base_at = F.concat(*[F.col(f"s{i}") for i in range(len(bases))]) if bases else empty

    def share(i: int, t: Template) -> Column:
        stands = lambda s: sum((F.try_element_at("w", (s + j + 1).cast("int")).eqNullSafe(F.lit(x)).cast("int") for j, x in enumerate(t.words)), F.lit(0))
        return F.coalesce(F.array_max(F.transform(f"s{i}", lambda s: stands(s) / F.lit(float(len(t.words))))), F.lit(0.0))

    label = lambda ts, lo: F.array_compact(F.array(*[F.when(F.size(f"s{lo + i}") > 0, t.label) for i, t in enumerate(ts)])) if ts else F.expr("cast(array() as array<string>)")
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    n_base = F.size(base_at).cast("long")
    best = F.greatest(F.lit(0.0), F.lit(0.0), *[share(len(bases) + i, t) for i, t in enumerate(others)])
    score = F.when(~some, 0.0).when(n_base > 0, 1.0).otherwise(best)
    result = F.struct(
        F.size("w").cast("long").alias("n_words"),
        n_base.alias("n_base"),
        F.array_min(base_at).alias("first_word"),
        F.array_max(base_at).alias("last_word"),
        joined(label(bases, 0)).alias("base_labels"),
        joined(F.concat(label(bases, 0), label(others, len(bases)))).alias("labels"),
        score.alias("score"),
    )
    return rows.select("given", result.alias("result")).select("given.*", "result.*").drop("_none")
