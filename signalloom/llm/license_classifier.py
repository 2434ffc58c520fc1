"""Licence notices in paragraphs: a trained n-gram classifier, confirmed by comparison with templates.

A paragraph is a block between blank lines; line ends and comment marks within it count as any
other sign between words, so how a notice is wrapped, indented or commented makes no difference.
Its words around cue words make segments, which are scored by logistic regressions over their
distinct word 1- to 3-grams: one for each licence family, as a paragraph may name several, and
one for text that no family fits. Probabilities are calibrated by a temperature on held-out
examples. A family is found if it is likely enough, likelier than unknown, and one of its templates is there to a
good part, by the n-grams that are in no other family's templates. The model is trained once on
the driver from the templates below, varied with a fixed seed; on the data everything is DataFrame
functions: the weights and the templates' n-grams are small literal tables, joined by broadcast.
"""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, whole_text

UNKNOWN = "unknown"
#: Least probability of a family, and least share of the n-grams of a template that are its family's own.
LIKELY, CONTAINED = 0.5, 0.6
GRAMS = 3
#: Words on each side of a cue word that belong to its segment.
REACH = 40

#: Words that open a segment, in lower case: a word that has one of the first in it,
#: or two words in a row. Every template has some, none further than ``REACH`` from the next.
CUES = ("licen", "copyright", "warrant", "permission", "redistribut", "gpl", "spdx", "proprietary", "unauthori", "cc0")
PAIRS = (
    ("public", "domain"), ("creative", "commons"), ("rights", "reserved"), ("cc", "by"),
    ("under", "mit"), ("under", "apache"), ("under", "bsd"), ("under", "mpl"), ("under", "isc"), ("mit", "or"), ("or", "mit"), ("apache", "2"), ("bsd", "3"), ("bsd", "2"), ("mpl", "2"),
)

#: Notices and names by licence family.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Licensed under MIT",
        "License MIT",
        "the MIT license",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "Apache-2.0": (
        "the Apache License, Version 2.0",
        "the Apache 2.0 license",
        "Licensed under Apache 2.0",
        "License Apache 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "GPL": (
        "the GNU General Public License",
        "the GPL v3",
        "the GPLv2",
        "the GPLv3",
        "GNU GPL version 2",
        "GNU GPL v3",
        "License GPL",
        "under the GPL",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Released under the GNU General Public License version 2 or later.",
        "See the GNU General Public License for more details.",
    ),
    "LGPL": (
        "the GNU Lesser General Public License",
        "GNU Library General Public License",
        "the LGPL",
        "GNU LGPL version",
        "License LGPL",
        "Licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "AGPL": (
        "the GNU Affero General Public License",
        "the AGPL",
        "GNU AGPL version",
        "License AGPL",
        "Licensed under the GNU Affero General Public License.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation version 3",
    ),
    "BSD": (
        "the BSD license",
        "BSD 3-Clause License",
        "BSD 2-Clause License",
        "3-clause BSD license",
        "License BSD",
        "a BSD-style license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
    ),
    "MPL": ("the Mozilla Public License", "the MPL 2.0 license", "License MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."),
    "ISC": ("the ISC License", "License ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "provided that the above copyright notice and this permission notice appear in all copies"),
    "CC-BY": (
        "CC BY 4.0", "CC BY 3.0", "the CC BY license", "Creative Commons Attribution 4.0", "Creative Commons Attribution 3.0", "the Creative Commons Attribution License",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": ("CC BY-SA", "Creative Commons Attribution-ShareAlike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    "CC-BY-NC": ("CC BY-NC", "Creative Commons Attribution-NonCommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0 for non-commercial use."),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "the author has waived all copyright and related rights to this work",
        "dedicated to the public domain",
        "released into the public domain",
        "CC0 1.0 Universal",
        "the Unlicense",
    ),
    "proprietary": (
        "All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited",
        "This software is proprietary and confidential",
        "confidential and proprietary",
    ),
}

#: SPDX identifiers by family; those of families that are not told apart here are unknown.
SPDX = {
    "MIT": ("MIT", "MIT-0"),
    "Apache-2.0": ("Apache-2.0",),
    "GPL": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0", "GPL-3.0"),
    "LGPL": ("LGPL-2.0-only", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "AGPL": ("AGPL-3.0-only", "AGPL-3.0-or-later"),
    "BSD": ("BSD-2-Clause", "BSD-3-Clause", "0BSD"),
    "MPL": ("MPL-1.1", "MPL-2.0"),
    "ISC": ("ISC",),
    "CC-BY": ("CC-BY-3.0", "CC-BY-4.0"),
    "CC-BY-SA": ("CC-BY-SA-3.0", "CC-BY-SA-4.0"),
    "CC-BY-NC": ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"),
    "public-domain": ("CC0-1.0", "Unlicense"),
    UNKNOWN: ("EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "Zlib", "BSL-1.0", "Artistic-2.0", "CDDL-1.0", "OFL-1.1", "MS-PL", "PostgreSQL", "NCSA", "Python-2.0", "Vim"),
}

#: Texts with cue words that name no family.
OTHER_TEXTS = (
    "The driver showed a valid license to the officer at the border.",
    "Her fishing licence was renewed for another year by the county.",
    "Copyright law has been debated by scholars for two centuries.",
    "The warranty covers parts and labour for twelve months.",
    "You need permission from the head teacher to leave early.",
    "Licensed under the Example Public Terms, version 7.",
    "This file is licensed under terms that are described elsewhere.",
    "The bar lost its license after a complaint.",
    "See the LICENSE file for details.",
    "A search warrant was issued on Monday morning.",
    "The wealth was redistributed among the members of the community.",
    "The court held that the licensee had broken the agreement.",
    "Redistribution of income was the topic of the lecture.",
    "A licensed plumber must install the boiler.",
    "No permission is required to enter the public domain walk.",
    "The license fee is due in April and covers all public broadcasters.",
    "Licensed under the Eclipse Public License 2.0.",
    "made available under the terms of the Eclipse Public License which accompanies this distribution",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This file is available under the zlib license.",
    "under the terms of the Common Development and Distribution License, version 1.0",
    "the Artistic License 2.0",
    "This font is licensed under the SIL Open Font License, Version 1.1.",
    "the Microsoft Public License",
    "the Open Software License version 3.0",
    "the University of Illinois open source license",
    "All her rights were reserved by the court.",
    "The general public license office is on the second floor.",
    "The apache tribe asked for permission to cross the land.",
)

#: Short names by family, and those of families that are not told apart here.
NAMES = {
    "MIT": ("MIT",),
    "Apache-2.0": ("Apache 2.0", "Apache-2.0", "Apache License 2.0", "Apache License v2.0", "Apache v2", "ASL 2.0"),
    "GPL": ("GPL", "GNU GPL", "GPLv2", "GPLv3", "GPL v2", "GPL v3", "GPL 2.0", "GPL 3.0", "GNU General Public License v2", "GNU General Public License v3"),
    "LGPL": ("LGPL", "GNU LGPL", "LGPLv2.1", "LGPLv3", "LGPL 2.1", "LGPL 3.0", "LGPL v3", "GNU Lesser General Public License v3"),
    "AGPL": ("AGPL", "GNU AGPL", "AGPLv3", "AGPL 3.0", "AGPL v3", "GNU Affero General Public License v3"),
    "BSD": ("BSD", "new BSD", "modified BSD", "simplified BSD", "BSD 2-clause", "BSD 3-clause", "2-clause BSD", "3-clause BSD", "two-clause BSD", "three-clause BSD"),
    "MPL": ("MPL", "MPL 2.0", "MPL-2.0", "MPL 1.1", "MPL v2", "Mozilla Public License 2.0"),
    "ISC": ("ISC",),
    "CC-BY": ("CC BY 4.0", "CC BY 3.0"),
    "CC-BY-SA": ("CC BY-SA 4.0", "CC BY-SA 3.0"),
    "CC-BY-NC": ("CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0"),
    "public-domain": ("CC0", "CC0 1.0"),
    UNKNOWN: ("EPL 2.0", "EUPL 1.2", "zlib", "Boost", "Artistic 2.0", "CDDL 1.0", "OFL 1.1", "MS-PL", "Elastic 2.0", "SSPL", "JSON", "beerware", "AFL 3.0", "example", "same", "following", "above"),
}
#: How a short notice says a name.
FRAMES = (
    "{} licensed", "{}-licensed code", "is licensed {}", "licensed under {}", "licensed under the {} license", "dual licensed {} or", "released under {}", "released under the {}", "released under the {} license",
    "distributed under {}", "distributed under the {} license", "available under {}", "available under the {} license", "under the terms of the {} license", "under the {} licence", "the {} license", "license: {}", "license = {}", "{} or later",
)

_TOKEN = re.compile(r"[a-z0-9]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))


def grams(seq: list[str], least: int = 1) -> set[str]:
    return {" ".join(seq[i : i + n]) for n in range(least, GRAMS + 1) for i in range(len(seq) - n + 1)}


def has_cue(text: str) -> bool:
    seq = tokens(text)
    return any(c in w for w in seq for c in CUES) or any(pair in PAIRS for pair in zip(seq, seq[1:]))


def notices(family: str) -> list[str]:
    """A family's templates, SPDX lines included."""
    return [*TEMPLATES.get(family, ()), *(f"SPDX-License-Identifier: {x}" for x in SPDX.get(family, ()))]


def short_notices(family: str) -> list[str]:
    """Every name of the family in every frame: those with a cue word."""
    made = (frame.format(name) for name in NAMES.get(family, ()) for frame in FRAMES)
    return [t for t in made if has_cue(t)]


def template_grams(text: str) -> set[str]:
    """The 3-grams of a template, or the whole of a shorter one."""
    seq = tokens(text)
    return grams(seq, GRAMS) if len(seq) >= GRAMS else {" ".join(seq)}


@lru_cache(maxsize=1)
def own_grams() -> tuple[tuple[str, frozenset[str]], ...]:
    """(family, n-grams) of each template: those that are in no other family's and in no unknown
    text. A template without any confirms nothing."""
    every = {f: set().union(*(grams(tokens(t)) for t in (*notices(f), *short_notices(f)))) for f in TEMPLATES}
    every[UNKNOWN] = set().union(*(grams(tokens(t)) for t in (*OTHER_TEXTS, *notices(UNKNOWN), *short_notices(UNKNOWN))))
    out: dict[tuple[str, frozenset[str]], None] = {}
    for family in TEMPLATES:
        others = set().union(*(gs for f, gs in every.items() if f != family))
        for t in (*notices(family), *short_notices(family)):
            if own := template_grams(t) - others:
                out[family, frozenset(own)] = None
    return tuple(out)


def examples(seed: int, copies: int) -> list[tuple[list[str], frozenset[str]]]:
    """Token lists with their families: templates whole, cut, thinned, joined, and set in other words."""
    rng = random.Random(seed)
    noise = [w for t in OTHER_TEXTS for w in tokens(t)] + ["".join(rng.choices("aeiounrtshl", k=rng.randint(2, 9))) for _ in range(200)]
    around = lambda: rng.choices(noise, k=rng.choice((0, 0, rng.randint(1, 12), rng.randint(1, 2 * REACH))))

    def varied(seq: list[str]) -> list[str]:
        kept = [w for w in seq if rng.random() > 0.05] if len(seq) > 6 else seq
        return around() + kept + around()

    every = [(f, tokens(t)) for f in TEMPLATES for t in notices(f)]
    out = []
    for family, seq in every:
        out += [(seq, frozenset({family}))] + [(varied(seq), frozenset({family})) for _ in range(copies)]
    for _ in range(40 * copies):  # two notices in one segment
        (f, x), (g, y) = rng.sample(every, 2)
        out.append((varied(x) + varied(y), frozenset({f, g})))
    short = [(f, tokens(t)) for f in NAMES for t in short_notices(f)]
    for family, seq in short:
        known = frozenset() if family == UNKNOWN else frozenset({family})
        out += [(around() + seq + around(), known) for _ in range(2 if copies > 1 else 1)]
    for _ in range(20 * copies):  # a choice of two licences
        (f, x), (g, y) = rng.sample([(f, tokens(n)) for f, ns in NAMES.items() if f != UNKNOWN for n in ns], 2)
        out.append((around() + rng.choice((["license"], ["licensed", "under"], ["dual", "licensed"])) + x + [rng.choice(("or", "and"))] + y + around(), frozenset({f, g})))
    for text in (*OTHER_TEXTS, *notices(UNKNOWN)):
        seq = tokens(text)
        out += [(seq, frozenset())] + [(varied(seq), frozenset()) for _ in range(2 * copies)]
    for _ in range(40 * copies):  # single words of notices, in no order
        words = rng.choice(every)[1]
        out.append((rng.sample(words, min(len(words), rng.randint(1, 3))) + rng.choices(noise, k=rng.randint(3, 40)), frozenset()))
    return out


def _matrix(data: list, vocabulary: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(data), len(vocabulary) + 1), np.float32)
    x[:, -1] = 1
    for i, (seq, _) in enumerate(data):
        x[i, [vocabulary[g] for g in grams(seq) if g in vocabulary]] = 1
    return x


def _targets(data: list, classes: list[str]) -> np.ndarray:
    return np.array([[(c in fs) if c != UNKNOWN else not fs for c in classes] for _, fs in data], np.float32)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Model:
    """``weights``: n-gram -> a weight for each of ``classes``; ``bias``; ``temperature``."""

    def __init__(self, classes: list[str], weights: dict[str, list[float]], bias: list[float], temperature: float) -> None:
        self.classes, self.weights, self.bias, self.temperature = classes, weights, bias, temperature


@lru_cache(maxsize=1)
def trained(rounds: int = 1000, rate: float = 2.0, l2: float = 1e-4) -> Model:
    """Fit by gradient descent with momentum, then the temperature on other examples."""
    data = examples(3, 5)
    counts: dict[str, int] = {}
    for seq, _ in data:
        for g in grams(seq):
            counts[g] = counts.get(g, 0) + 1
    known = set().union(*(grams(tokens(t)) for f in (*TEMPLATES, UNKNOWN) for t in (*notices(f), *short_notices(f))), *(grams(tokens(t)) for t in OTHER_TEXTS))
    vocabulary = {g: i for i, g in enumerate(sorted(g for g, n in counts.items() if n >= 4 and g in known))}
    classes = [*TEMPLATES, UNKNOWN]
    y, x = _targets(data, classes), _matrix(data, vocabulary)
    w, speed = np.zeros((x.shape[1], len(classes)), np.float32), 0
    for _ in range(rounds):
        speed = 0.9 * speed - rate * (x.T @ (_logistic(x @ w) - y) / len(x) + l2 * w)
        w += speed
    held = examples(4, 1)
    z, truth = _matrix(held, vocabulary) @ w, _targets(held, classes)
    loss = {t: -np.log(np.maximum(np.where(truth == 1, _logistic(z / t), 1 - _logistic(z / t)), 1e-9)).mean() for t in (0.2, 0.3, 0.5, 0.7, 1.0, 1.4, 2.0)}
    table = {g: [round(float(v), 4) for v in w[i]] for g, i in vocabulary.items()}
    return Model(classes, table, [round(float(v), 4) for v in w[-1]], min(loss, key=loss.get))


def _literal(spark: SparkSession, rows: list, kind: str) -> DataFrame:
    """A small table of the driver's as an expression."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")))


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, at, first, words): the words within ``REACH`` of cue words in paragraphs
    that have some; ``at`` is the paragraph's number, ``first`` the place of the first word in it.
    Segments that would overlap are one. Each text of a doc_id once. Null and empty texts and those
    without a cue word have no segment; an empty table gives no rows. A paragraph's words are held
    as one array, whatever its length."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cue = "|".join([*CUES, *(f"{x}[^a-z0-9]+{y}" for x, y in PAIRS)])
    text = F.regexp_replace(F.translate(whole_text(text_col), upper, lower), "\r\n?", "\n")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), text.alias("text")).where(F.col("text").rlike(cue))
    # a blank line may hold a comment's marks only; one class, taken whole: a line of marks may be long
    blank = r"\n[ \t\x0B\f\r/*#;%!>-]*+\n"
    paragraphs = rows.select("doc_id", "text_hash", F.posexplode(F.split("text", blank)).alias("at", "x")).where(F.col("x").rlike(cue))
    # no filter on what is computed here: pushed below, it would compute the words once for each of them
    words = paragraphs.select("doc_id", "text_hash", "at", F.regexp_extract_all("x", F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    pairs = " or ".join(f"(x = '{x}' and get(w, i + 1) = '{y}')" for x, y in PAIRS)
    cues = words.select("*", F.expr(f"filter(transform(w, (x, i) -> if(x rlike '{'|'.join(CUES)}' or {pairs}, i, null)), i -> i is not null)").alias("c"))
    far = 2 * REACH
    ends = cues.select("*", F.expr(f"filter(c, (x, i) -> i = 0 or x - c[greatest(i - 1, 0)] > {far})").alias("a"), F.expr(f"filter(c, (x, i) -> i = size(c) - 1 or get(c, i + 1) - x > {far})").alias("b"))
    spans = ends.select("doc_id", "text_hash", "at", "w", F.explode(F.arrays_zip("a", "b")).alias("s"))
    placed = spans.select("doc_id", "text_hash", "at", F.expr(f"greatest(s.a - {REACH}, 0)").alias("first"), F.expr(f"slice(w, greatest(s.a - {REACH}, 0) + 1, s.b + {REACH} + 1 - greatest(s.a - {REACH}, 0))").alias("words"))
    return placed.dropDuplicates(["doc_id", "text_hash", "at", "first"])


def license_paragraphs(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, at, first, unknown, found) for each segment: the probability that no
    family fits, and the families found as (family, p, contained). Texts without a segment, null and
    empty ones among them, have no row."""
    model = model or trained()
    cut, key = segments(docs, id_col, text_col), ["doc_id", "text_hash", "at", "first"]
    each = [f"transform(filter(sequence(1, size(words)), i -> i <= size(words) - {n - 1}), i -> array_join(slice(words, i, {n}), ' '))" for n in range(1, GRAMS + 1)]
    spark, k = cut.sparkSession, len(model.classes)
    templates = own_grams()
    index: dict[str, list[int]] = {}
    for n, (_, own) in enumerate(templates):
        for g in own:
            index.setdefault(g, []).append(n)
    rows = [{"gram": g, "w": model.weights.get(g), "t": index.get(g)} for g in sorted(model.weights.keys() | index.keys())]
    table = _literal(spark, rows, "gram: string, w: array<double>, t: array<int>")

    # segments none of whose n-grams is known keep a row
    known = cut.select(*key, F.explode(F.array_distinct(F.expr(f"concat({', '.join(each)})"))).alias("gram")).join(F.broadcast(table), "gram", "left")
    sums = known.groupBy(*key).agg(*(F.coalesce(F.sum(F.col("w")[j]), F.lit(0.0)).alias(f"s{j}") for j in range(k)), F.flatten(F.collect_list("t")).alias("t"))
    chance = lambda j: 1 / (1 + F.exp(-(F.col(f"s{j}") + model.bias[j]) / model.temperature))

    # how much of each template that is there at all, and to which family it belongs
    owners = F.array(*(F.lit(model.classes.index(f)) for f, _ in templates))
    sizes = F.array(*(F.lit(float(len(own))) for _, own in templates))
    shares = F.transform(F.array_distinct("t"), lambda n: F.struct(F.get(owners, n).alias("owner"), (F.size(F.filter("t", lambda x: x == n)) / F.get(sizes, n)).alias("share")))
    rated = sums.withColumn("shares", shares)

    def contained(j: int) -> F.Column:
        of_family = F.filter("shares", lambda x: x["owner"] == j)
        return F.coalesce(F.array_max(F.transform(of_family, lambda x: x["share"])), F.lit(0.0))

    entries = [F.struct(F.lit(c).alias("family"), F.round(chance(j), 6).alias("p"), F.round(contained(j), 6).alias("contained")) for j, c in enumerate(model.classes) if c != UNKNOWN]
    scored = rated.select(*key, F.round(chance(model.classes.index(UNKNOWN)), 6).alias("unknown"), F.array(*entries).alias("e"))
    sure = F.filter("e", lambda x: (x["p"] >= LIKELY) & (x["p"] >= F.col("unknown")) & (x["contained"] >= CONTAINED))
    return scored.select(*key, "unknown", sure.alias("found"))


def licenses(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_candidates, n_licenses, licenses, p.

    n_candidates counts segments with a cue word, n_licenses the families found in them.
    licenses are the families, sorted and comma-joined, p the best probability (0 if none).
    Null and empty texts have none. Repeated rows each return a row; rows of one doc_id are told
    apart by their text; other columns are ignored; an empty table gives no rows.
    """
    scored = license_paragraphs(docs, model, id_col, text_col)
    names = F.array_distinct(F.flatten(F.collect_list(F.transform("found", lambda x: x["family"]))))
    best = F.max(F.array_max(F.transform("found", lambda x: x["p"])))
    per = scored.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.count("*").alias("n"), F.sum(F.size("found")).alias("k"), F.array_join(F.array_sort(names), ",").alias("f"), best.alias("p"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("hash"))
    both = rows.join(per, rows.doc_id.eqNullSafe(per.d) & (rows.hash == per.h), "left")
    return both.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_candidates"), F.coalesce("k", F.lit(0)).alias("n_licenses"), F.coalesce("f", F.lit("")).alias("licenses"), F.coalesce("p", F.lit(0.0)).alias("p"))


def op7_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(documents(spark, sf_dir))


QUERIES = {"op7_license_classifier": op7_license_classifier}
ORACLE_SQL: dict[str, str] = {}
