"""Licence notices in whole texts, by DataFrame functions alone.

A paragraph is a line; a notice is looked for in every line and in every stretch of words, over line ends and comment
marks too, that holds most of the word pairs of a template. The words and pairs of words of either, those the model knows, are the
features of a sparse multinomial logistic regression over the licence families and an unknown class; its probabilities
are calibrated by a temperature found on held-out rows. A line or stretch counts for a family if the family's
probability is high enough, most of the word pairs of one of its templates are there, and of each likeness of another
family to it at least one pair that only the template has; so a line or block can hold notices of several families, and
a version or a word such as lesser decides. A text without any of the model's cues, words chosen so that no template's
pairs can mostly be there without one, is passed over unread. Only fitting, on templates and a bounded sample of the corpus, is done on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short notices by family.
TEMPLATES = {
    "agpl-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License v3.0.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License v2.0.",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "Licensed under the GNU General Public License v2.0.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU General Public License v3.0.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC License.",
        "Released under the ISC License.",
    ),
    "lgpl": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License v2.1.",
        "Licensed under the GNU Lesser General Public License v3.0.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License Version 2.0.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright by the authors. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
    ),
}
#: The families' identifiers in lines of the form SPDX-License-Identifier: X.
IDENTIFIERS = {
    "agpl-3.0": ("AGPL-3.0-only", "AGPL-3.0-or-later"), "apache-2.0": ("Apache-2.0",), "bsd": ("BSD-2-Clause", "BSD-3-Clause"), "cc-by": ("CC-BY-4.0",),
    "cc-by-nc": ("CC-BY-NC-4.0",), "cc-by-sa": ("CC-BY-SA-4.0",), "epl": ("EPL-1.0", "EPL-2.0"), "gpl-2.0": ("GPL-2.0-only", "GPL-2.0-or-later"),
    "gpl-3.0": ("GPL-3.0-only", "GPL-3.0-or-later"), "isc": ("ISC",), "lgpl": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "mit": ("MIT",), "mpl-2.0": ("MPL-2.0",), "public-domain": ("CC0-1.0", "Unlicense"),
}
for _family, _names in IDENTIFIERS.items():
    TEMPLATES[_family] += tuple(f"SPDX-License-Identifier: {name}" for name in _names)
#: Share of a template's pairs from which one of another family is its likeness.
RIVAL = 0.5
#: Lines that share words with notices and are none.
NEAR_MISSES = (
    "The driver showed a license at the gate.", "All rights were given to the people of the town.", "A copy of the version was released to the public.",
    "The software is free to use in the work.", "Permission to enter the building was granted by the owner.", "The general public may use the source of the river.",
    "Creative work in the commons is for any person.", "The terms of the foundation were published.", "Reserved seats are at the door.", "Version 2.0 was released under the old name.",
    "Licensed under the Artistic License 2.0.", "Licensed under the Zlib License.", "Licensed under the European Union Public Licence v1.2.",
    "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: BSL-1.0", "This work is licensed under the Open Data Commons license, version 1.",
    "He may obtain a copy of the file.", "The binary forms of the code are in the folder.",
)
#: Words that are no feature alone, nor two of them together.
STOP = frozenset("a an and are as at be by for from in is it of on or that the this to was were with without you can may no not any all".split())
#: Documents whose lines, LINES of each at most, are the sample of the unknown class.
SAMPLE_DOCS = 300
LINES = 6
VARIANTS = 12
#: A family's probability and the share of a template's pairs from which a paragraph counts.
SURE = 0.8
CONFIRM = 0.6
UNKNOWN = "unknown"
#: A stretch of words holds at most so many times the words of its template; SIDE neighbours in order cover its overlaps.
REACH = 2
SIDE = 3 * REACH * max(len(t.split()) + 9 for ts in TEMPLATES.values() for t in ts)


def _cut(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


def grams(text: str) -> set[str]:
    """Words and pairs of neighbours, lower-cased."""
    words = _cut(text)
    return {w for w in words if w not in STOP} | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if not (a in STOP and b in STOP)}


def pairs(found: set[str]) -> set[str]:
    return {g for g in found if " " in g} or found


def rivals(family: str, template: str) -> list[list[str]]:
    """For each template of another family that has most pairs of this one too, the pairs that it lacks."""
    mine = pairs(grams(template))
    others = [pairs(grams(t)) for f, ts in TEMPLATES.items() if f != family for t in ts]
    apart = {tuple(sorted(mine - o)) for o in others if len(mine & o) >= RIVAL * len(mine) and mine - o}
    return [list(a) for a in sorted(apart)]


def choose_cues(background: list[str]) -> tuple[str, ...]:
    """Words, those that fewest lines of background have first, such that of every template fewer than CONFIRM of the
    pairs are without one."""
    often: dict[str, int] = {}
    for line in background:
        for w in set(_cut(line)):
            often[w] = often.get(w, 0) + 1
    left = {t: pairs(grams(t)) for ts in TEMPLATES.values() for t in ts}
    least, chosen = {t: CONFIRM * len(ps) for t, ps in left.items()}, []
    while open_ones := [t for t in left if len(left[t]) >= least[t]]:
        gain: dict[str, int] = {}
        for t in open_ones:
            for w in {w for p in left[t] for w in p.split()}:
                gain[w] = gain.get(w, 0) + sum(w in p.split() for p in left[t])
        best = min(gain, key=lambda w: (often.get(w, 0) / gain[w], -gain[w], w))
        chosen.append(best)
        left = {t: {p for p in ps if best not in p.split()} for t, ps in left.items()}
    return tuple(chosen)


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    vocabulary: tuple[str, ...]
    weights: np.ndarray  # a row per gram, a column per family; the last family is unknown
    bias: np.ndarray
    temperature: float
    cues: tuple[str, ...]

    def probabilities(self, text: str) -> np.ndarray:
        at = {g: k for k, g in enumerate(self.vocabulary)}
        z = (self.bias + sum((self.weights[at[g]] for g in sorted(grams(text)) if g in at), np.zeros(len(self.bias)))) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def judge(self, text: str) -> tuple[str, float, float]:
        """family (or unknown), probability, likeness to the family's nearest template."""
        p = self.probabilities(text)
        family = self.families[int(p.argmax())]
        found = grams(text)
        known = [(pairs(grams(t)), rivals(family, t)) for t in TEMPLATES.get(family, ())]
        like = max((len(gs & found) / len(gs) for gs, others in known if all(set(o) & found for o in others)), default=0.0)
        return family, float(p.max()), like


def _examples(background: list[str]) -> tuple[list[str], list[str]]:
    rng = np.random.default_rng(9)
    texts, names = [], []
    filler = [w for line in background[:200] for w in line.split()[:20]] or ["text"]
    for family, templates in TEMPLATES.items():
        for template in templates:
            words = template.split()
            for k in range(VARIANTS):
                kept = [w for w in words if k < 3 or rng.random() > 0.08] or words
                around = [list(rng.choice(filler, rng.integers(0, 12))) if k >= 2 else [] for _ in range(2)]
                texts.append(" ".join([*around[0], *kept, *around[1]]))
                names.append(family)
    held = [t for t in background if not any(len(pairs(grams(x)) & grams(t)) >= CONFIRM * len(pairs(grams(x))) for xs in TEMPLATES.values() for x in xs)]
    for line in [*held, *NEAR_MISSES * 4]:
        texts.append(line)
        names.append(UNKNOWN)
    return texts, names


def fit(background: list[str], steps: int = 300, sparsity: float = 2e-4) -> Model:
    """On the templates, varied, and lines of the corpus. Accelerated proximal gradient steps; every fifth example is
    held out for the temperature."""
    texts, names = _examples(background)
    families = (*sorted(TEMPLATES), UNKNOWN)
    vocabulary = tuple(sorted(set().union(*(grams(t) for ts in TEMPLATES.values() for t in ts), *(grams(t) for t in NEAR_MISSES))))
    at = {g: k for k, g in enumerate(vocabulary)}
    x, y = np.zeros((len(texts), len(vocabulary))), np.zeros((len(texts), len(families)))
    for r, (text, name) in enumerate(zip(texts, names, strict=True)):
        x[r, [at[g] for g in grams(text) if g in at]] = 1
        y[r, families.index(name)] = 1
    learned = np.arange(len(texts)) % 5 != 0
    a, b = x[learned], y[learned]
    mass = b.sum(0)
    cost = (len(b) / (len(families) * np.maximum(mass, 1)))[b.argmax(1)][:, None] / len(b)
    w, bias = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))
    look, look_bias, pace = w, bias, 1.0
    rate = 2.0 / max(1e-9, float((cost * (a.sum(1, keepdims=True) + 1)).sum()))
    for _ in range(steps):
        z = a @ look + look_bias
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - b) * cost
        step = look - rate * (a.T @ g)
        new, new_bias = np.sign(step) * np.maximum(np.abs(step) - rate * sparsity, 0), look_bias - rate * g.sum(0)
        next_pace = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        look, look_bias = new + (pace - 1) / next_pace * (new - w), new_bias + (pace - 1) / next_pace * (new_bias - bias)
        w, bias, pace = new, new_bias, next_pace
    z, target = x[~learned] @ w + bias, y[~learned].argmax(1)

    def loss(t: float) -> float:
        s = z / t - (z / t).max(1, keepdims=True)
        return float(-(s[np.arange(len(s)), target] - np.log(np.exp(s).sum(1))).mean())

    live = np.flatnonzero(np.abs(w).sum(1) > 0)
    temperature = min((0.1 * k for k in range(2, 31)), key=loss)
    return Model(families, tuple(vocabulary[k] for k in live), w[live], bias, temperature, choose_cues(background))


def train(docs: DataFrame, most: int = SAMPLE_DOCS) -> Model:
    """Takes the unknown class from LINES lines of each of the most documents whose texts have the least hashes. Null texts
    count for nothing, repeated ones once; without texts there are the near misses only; other columns are ignored."""
    found = docs.where("text is not null").select(F.xxhash64("text").alias("h"), "text")
    last = found.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    lines = F.min(F.slice(F.split("text", "\n"), 1, LINES)).alias("lines")
    rows = found.where(F.col("h") <= F.lit(last)).groupBy("h").agg(lines).orderBy("h").collect()  # most rows at most
    return fit([line for r in rows for line in r["lines"] if line.strip()])


def _words(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once; the optimiser may repeat what a column of an inner select says."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _with(s: Column, kept: tuple[str, ...], **more: Column) -> Column:
    return F.struct(*[s[c].alias(c) for c in kept], *[v.alias(c) for c, v in more.items()])


def _pairs(words: Column) -> Column:
    return F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))


def _grams(words: Column) -> Column:
    return F.array_distinct(F.concat(words, _pairs(words)))


def _table(rows: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in rows])


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _lists(values: list[list[str]]) -> Column:
    return F.array(*[_strings(v) for v in values]).cast("array<array<string>>")


def paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs, found: the array of (at, family, probability, likeness) of the lines and stretches of words
    of every row of docs (doc_id, text) that a family's probability and template confirm; at is the line in which one
    starts.

    A stretch runs from one of a template's pairs to the last one new in reach. Of stretches that overlap, of
    whatever family, the likest stays, and none that touches a line found for its family. Texts without most pairs of any template are
    passed over early. Null and empty texts have one empty paragraph and no finding; repeated rows are found each; an empty table
    gives no rows; other columns are ignored. Nothing is shuffled.
    """
    vocabulary = F.array(*[F.lit(g) for g in model.vocabulary])
    weights = _table((model.weights / model.temperature).tolist())
    bias = F.array(*[F.lit(float(b)) for b in model.bias / model.temperature])
    families = F.array(*[F.lit(f) for f in model.families])
    known = [(f, len(_cut(t)), sorted(pairs(grams(t))), rivals(f, t)) for f in sorted(TEMPLATES) for t in TEMPLATES[f]]
    templates = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(REACH * n).alias("reach"), _strings(gs).alias("grams"), _lists(others).alias("rivals")) for f, n, gs, others in known])
    every = F.array(*[F.lit(g) for g in sorted({g for _, _, gs, _ in known for g in gs})])
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n", -1)

    def likely(found: Column) -> Column:
        """The templates of which most pairs are there."""
        return F.filter(templates, lambda t: F.size(F.array_intersect(t["grams"], found)) >= CONFIRM * F.size(t["grams"]))

    def hits(t: Column, every_pair: Column) -> Column:
        at = F.filter(F.transform(every_pair, lambda g, i: F.struct(i.cast("int").alias("i"), g.alias("g"))), lambda h: F.array_contains(t["grams"], h["g"]))
        return F.struct(t["grams"].alias("grams"), t["reach"].alias("reach"), at.alias("hits"))

    def windows(t: Column) -> Column:
        """From each of the template's pairs on, the pairs that are in reach."""
        return F.transform(t["hits"], lambda h, k: F.struct(h["i"].alias("first"), t["grams"].alias("grams"), F.filter(F.slice(t["hits"], k + 1, t["reach"]), lambda x: x["i"] < h["i"] + t["reach"]).alias("hits")))

    def ends(w: Column) -> Column:
        return F.struct(w["first"].alias("first"), w["grams"].alias("grams"), w["hits"].alias("hits"), F.array_distinct(w["hits"]["g"]).alias("seen"))

    def stretch(w: Column) -> Column:
        last = F.get(w["hits"], F.array_position(w["hits"]["g"], F.element_at(w["seen"], -1)) - 1)["i"] + 1
        return F.struct(w["first"].alias("first"), last.alias("last"))

    def stretches(wanted: Column, every_pair: Column) -> Column:
        met = F.flatten(F.transform(F.transform(wanted, lambda t: hits(t, every_pair)), windows))
        met = F.filter(F.transform(met, ends), lambda w: F.size(w["seen"]) >= CONFIRM * F.size(w["grams"]))
        return F.array_distinct(F.transform(met, stretch))

    def of_line(p: Column) -> Column:
        return F.struct(p["at"].alias("at"), p["at"].alias("to"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), p["words"].alias("words"))

    def of_words(w: Column, flat: Column) -> Column:
        at = lambda k: F.get(flat["at"], w[k])
        return F.struct(at("first").alias("at"), at("last").alias("to"), w["first"].alias("first"), w["last"].alias("last"), F.slice(flat["words"], w["first"] + 1, w["last"] - w["first"] + 1).alias("words"))

    def near(cut: Column, wanted: Column) -> Column:
        """The lines and the stretches of a text."""
        places = F.flatten(F.transform(cut, lambda p: F.array_repeat(p["at"], F.size(p["words"]))))
        flat = F.struct(places.alias("at"), F.flatten(cut["words"]).alias("words"))
        over = lambda f: _let(_pairs(f["words"]), lambda g: F.transform(stretches(wanted, g), lambda w: of_words(w, f)))
        return F.concat(F.transform(F.filter(cut, lambda p: F.size(p["words"]) > 0), of_line), _let(flat, over))

    cut = F.transform(lines, lambda p, i: F.struct(i.cast("int").alias("at"), _words(p).alias("words")))

    def features(s: Column) -> Column:
        return _with(s, ("at", "to", "first", "last"), grams=_grams(s["words"]))

    def logits(s: Column) -> Column:
        known = F.array_intersect(F.filter(s["grams"], lambda g: g.isNotNull()), vocabulary)
        total = F.aggregate(F.array_sort(known), bias, lambda acc, g: F.zip_with(acc, F.get(weights, F.array_position(vocabulary, g) - 1), lambda x, y: x + y))
        return _with(s, ("at", "to", "first", "last", "grams"), z=total)

    def best(s: Column) -> Column:
        top = F.array_max(s["z"])
        family = F.get(families, F.array_position(s["z"], top) - 1)
        return _with(s, ("at", "to", "first", "last", "grams"), family=family, probability=1 / F.aggregate(s["z"], F.lit(0.0), lambda a, z: a + F.exp(z - top)))

    def confirmed(s: Column) -> Column:
        told = lambda t: F.forall(t["rivals"], lambda r: F.size(F.array_intersect(r, s["grams"])) > 0)
        shares = F.transform(F.filter(templates, lambda t: (t["family"] == s["family"]) & told(t)), lambda t: F.size(F.array_intersect(t["grams"], s["grams"])) / F.size(t["grams"]))
        return _with(s, ("at", "to", "first", "last", "family", "probability"), likeness=F.coalesce(F.array_max(shares), F.lit(0.0)))

    def apart(s: Column, k: Column, d: Column) -> Column:
        """Whether a stretch is in no line found for the family, and none that it overlaps is better."""
        beside = F.slice(d["over"], F.greatest(k + 1 - SIDE, F.lit(1)), 2 * SIDE + 1)
        rank = lambda x: F.struct(x["likeness"], x["first"] - x["last"], -x["first"])
        better = lambda x: (x["first"] <= s["last"]) & (x["last"] >= s["first"]) & (rank(x) > rank(s))
        return ~F.exists(d["lines"], lambda x: (x["family"] == s["family"]) & x["at"].between(s["at"], s["to"])) & ~F.exists(beside, better)

    out = lambda s: F.struct(*[s[c].alias(c) for c in ("at", "family", "probability", "likeness")])

    def settled(kept: Column) -> Column:
        order = F.transform(F.filter(kept, lambda s: s["first"] >= 0), lambda s: F.struct(*[s[c].alias(c) for c in ("first", "last", "family", "at", "to", "probability", "likeness")]))
        both = F.struct(F.filter(kept, lambda s: s["first"] < 0).alias("lines"), F.array_sort(order).alias("over"))
        return _let(both, lambda d: F.array_sort(F.concat(F.transform(d["lines"], out), F.transform(F.filter(d["over"], lambda s, k: apart(s, k, d)), out))))

    def judged(wanted: Column) -> Column:
        found = F.transform(F.transform(F.transform(F.transform(_let(cut, lambda c: near(c, wanted)), features), logits), best), confirmed)
        kept = F.filter(found, lambda s: (s["family"] != UNKNOWN) & (s["probability"] >= SURE) & (s["likeness"] >= CONFIRM))
        return _let(kept, settled)

    none = F.array().cast("array<struct<at:int,family:string,probability:double,likeness:double>>")
    read = _let(_let(F.array_intersect(_let(_words(text), _pairs), every), likely), lambda wanted: F.when(F.size(wanted) > 0, judged(wanted)).otherwise(none))
    low, short = F.lower(text), [c for c in model.cues if len(c) < 4]
    cued = low.rlike(f"(?<![a-z0-9])(?:{'|'.join(short)})(?![a-z0-9])") if short else F.lit(False)
    for cue in model.cues:
        cued |= F.contains(low, F.lit(cue)) if cue not in short else F.lit(False)
    found = F.when(cued, read).otherwise(none)
    return docs.select("doc_id", F.size(lines).cast("long").alias("n_paragraphs"), found.alias("found"))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed (lines in which a notice starts), families (distinct, in order, comma-joined),
    probability (the highest; null without a licence) of every row of docs, for odd rows as paragraphs() says."""
    rows = paragraphs(docs, model)
    names = F.array_join(F.array_sort(F.array_distinct(F.col("found.family"))), ",")
    return rows.select("doc_id", "n_paragraphs", F.size(F.array_distinct("found.at")).cast("long").alias("n_licensed"), names.alias("families"), F.round(F.array_max(F.col("found.probability")), 6).alias("probability"))
