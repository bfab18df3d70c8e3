"""License scans: a trained paragraph classifier over sparse word n-grams, and templates that confirm it.

The fit is a small numpy job on the driver over notices made from the templates below; scanning uses DataFrame
functions alone.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.common import cut

# Notices of each family, as public licences and common headers word them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
        "Apache License Version 2.0, January 2004",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc0": (
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 public domain dedication.",
    ),
    "isc": (
        "Licensed under the ISC license.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "bsl-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.",
    ),
    "eupl": (
        "Licensed under the EUPL, Version 1.2.",
        "SPDX-License-Identifier: EUPL-1.2",
        "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the Licence); you may not use this work except in compliance with the Licence.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "mit-or-apache": (
        "This file is dual MIT/Apache.",
        "Dual-licensed under MIT and Apache-2.0.",
        "SPDX-License-Identifier: MIT OR Apache-2.0",
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option.",
    ),
}
TEMPLATES |= {
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ),
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
}
TEMPLATES["mit"] += ("THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.",)
# Identifiers of each family, and names that stand before the word license.
IDENTIFIERS = {
    "mit": ("MIT",),
    "apache-2.0": ("Apache-2.0",),
    "bsd": ("BSD-2-Clause", "BSD-3-Clause"),
    "gpl": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "lgpl": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "agpl": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "mpl": ("MPL-2.0",),
    "cc-by": ("CC-BY-4.0",),
    "cc-by-sa": ("CC-BY-SA-4.0",),
    "cc-by-nc": ("CC-BY-NC-4.0",),
    "cc-by-nd": ("CC-BY-ND-4.0",),
    "cc0": ("CC0-1.0",),
    "isc": ("ISC",),
    "bsl-1.0": ("BSL-1.0",),
    "eupl": ("EUPL-1.2",),
    "unlicense": ("Unlicense",),
    "zlib": ("Zlib",),
}
NAMES = {
    "mit": ("MIT",),
    "apache-2.0": ("Apache Software", "Apache 2.0"),
    "bsd": ("BSD", "BSD 2-Clause", "BSD 3-Clause"),
    "gpl": ("GNU General Public", "GNU GPL"),
    "lgpl": ("GNU Lesser General Public",),
    "agpl": ("GNU Affero General Public",),
    "mpl": ("Mozilla Public", "Mozilla Public License 2.0"),
    "isc": ("ISC",),
    "bsl-1.0": ("Boost Software",),
    "eupl": ("European Union Public",),
    "zlib": ("zlib",),
}
#: Short notices made from these: whole ones, as a word less would name no family.
SHORT = {f: tuple(dict.fromkeys([*(form.format(i) for i in IDENTIFIERS.get(f, ()) for form in ("SPDX-License-Identifier: {}", "License: {}")), *(form.format(n) for n in NAMES.get(f, ()) for form in ("License :: OSI Approved :: {} License", "Licensed under the {} license", "Released under the {} license", "Distributed under the {} license"))])) for f in TEMPLATES}
SHORT["gpl"] += ("Licensed under the GNU General Public License v2.0", "Licensed under the GPL v2.")
SHORT = {f: tuple(t for t in texts if re.findall("[a-z0-9]+", t.lower()) not in [re.findall("[a-z0-9]+", x.lower()) for x in TEMPLATES[f]]) for f, texts in SHORT.items()}
TEMPLATES = {f: (*texts, *SHORT[f]) for f, texts in TEMPLATES.items()}
#: How texts say that a licence doesn't hold, or name one in passing.
DENIALS = ("This is not licensed under the {} license.", "I do not license this under the {} license.", "It is no longer released under the {} license.", "The {} license does not apply to this file.", "We never released it under {}.", "This is not {} code.", "The list of names has {} in it.", "See the pages on {}.", "The people of {} renewed their license.", "{} is older than the others.")
#: A family that names two others: its n-grams are theirs too.
BOTH = "mit-or-apache"
#: The least share of a template's n-grams that confirms a notice.
CONFIRM = 0.6
#: Sentences that name licences or their words without being a notice.
OTHERS = (
    "Her driving license expired last week and she had to renew it.",
    "The copyright office is closed on public holidays.",
    "He asked for permission to leave the room.",
    "All rights reserved. No part of this book may be copied without the permission of the publisher.",
    "The free version of the game has no public server.",
    "Software of any kind comes with a warranty of two years.",
    "The fishing licence is granted to any person of full age.",
    "A general public of three thousand came to the opening.",
    "The apache helicopter landed near the creative commons building.",
    "The terms and conditions of the contract are implied by law.",
    "Copyright 2020 by the authors.",
    "You may obtain a licence plate at the office of your town.",
    "The redistribution of wealth is not permitted under the terms of the plan.",
    "Version 2.0 of the program was published by the foundation.",
)
#: Words of which two in a row are common in any English text.
COMMON = ("the", "of", "in", "to", "and", "or", "a", "is", "for", "by", "this", "with", "any", "under", "you", "may", "at", "as", "be", "not", "that", "it", "on", "all", "can", "from", "an", "are", "no", "such", "its")
#: Words that lead to a short notice.
LEADS = ("available", "provided", "published", "distributed", "code", "file", "work", "project", "here", "is", "are", "under", "the", "terms", "of", "use")
UNKNOWN = "unknown"
TOKEN = "[a-z0-9]+"


def tokens(text: str) -> list[str]:
    """Lower-case words and numbers."""
    return re.findall(TOKEN, text.lower())


def grams(words: list[str]) -> set[str]:
    """Distinct words and pairs of neighbours."""
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


@lru_cache(1)
def own_grams() -> dict[str, set[str]]:
    """The n-grams of each family's templates that no other family's has, BOTH aside: a notice needs one of them, as those that families share name none."""
    every = {f: set().union(*(grams(tokens(t)) for t in texts)) for f, texts in TEMPLATES.items()}
    return {f: g.difference(*(o for k, o in every.items() if k not in (f, BOTH))) for f, g in every.items()}


def cue_grams() -> set[str]:
    """N-grams one of which each `CONFIRM` of a template's n-grams has: its pairs, but for as many pairs of common words, and with as many single words, as leave less than that share of its n-grams. Of SHORT ones, which must be there as a whole, one pair that few families share."""
    out: set[str] = set()
    borne = Counter(w for texts in TEMPLATES.values() for w in {w for t in texts for w in tokens(t)})
    short = {t for texts in SHORT.values() for t in texts}
    for t in sorted(short):
        out.add(min((g for g in grams(tokens(t)) if " " in g), key=lambda g: (min(borne[w] for w in g.split()), sum(borne[w] for w in g.split()), g)))
    for t in (t for texts in TEMPLATES.values() for t in texts if t not in short):
        every = grams(tokens(t))
        pairs = sorted((g for g in every if " " in g), key=lambda g: (not set(g.split()) <= {*COMMON}, g))
        single = sorted(every - set(pairs), key=lambda w: (w in COMMON, borne[w], -len(w), w))
        most = -int(-(len(every) * CONFIRM - 1e-6) // 1) - 1  # of the n-grams that no paragraph need have
        spare = max(0, min(most - len(single), sum(set(g.split()) <= {*COMMON} for g in pairs)))
        out.update(pairs[spare:], single[: max(0, len(single) - most)])
    return out


@lru_cache(1)
def cues() -> str:
    """A pattern over lower-case text for cue_grams(): a trie, so that a place in the text is compared with few of them."""
    trie: dict = {}
    for g in cue_grams():
        node = trie
        for c in g:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        parts = [("(?![a-z0-9])" if not c else "[^a-z0-9]+" if c == " " else c) + pattern(rest) for c, rest in sorted(node.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""

    return "(?<![a-z0-9])" + pattern(trie)


@dataclass(frozen=True)
class Model:
    """Weights by n-gram and family, biases, and the least probability of all families together, below which a paragraph is unknown."""

    families: tuple[str, ...]
    weights: pd.DataFrame  # gram, family, weight
    bias: dict[str, float]
    least: float


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The number, 0.2 to 5, that logits (rows, classes) are best divided by, by log loss on labels y (one-hot)."""

    def loss(t: float) -> float:
        z = logits / t
        return float((np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - (z * y).sum(1)).mean())

    return min(np.geomspace(0.2, 5, 161).tolist(), key=loss)


@lru_cache(1)
def train(seed: int = 42, copies: int = 40) -> Model:
    """Softmax regression with an unknown class on altered notices, calibrated on others, held back.

    Each template gives `copies` examples with words dropped, added, or cut; the unknown class has shuffled and cut
    mixtures of the same words, and denials of each licence. Short notices keep their words. A fifth is held back. On half of it the probabilities of all classes are calibrated: the
    log-odds are divided by the temperature of least log loss. On the other half the threshold is set: the least
    probability of a licence, of whatever family, at which no unknown example passes, within 0.5 to 0.95.
    """
    rng = random.Random(seed)
    names = (UNKNOWN, *TEMPLATES)
    noise = [w for t in OTHERS for w in tokens(t)] + ["project", "author", "file", "text", "data", "page", "see", "note", "year", "name"]
    rows: list[tuple[set[str], int]] = []
    for k, (name, texts) in enumerate(TEMPLATES.items(), 1):
        for t in texts:
            for _ in range(copies):
                w = [x for x in tokens(t) if t in SHORT[name] or rng.random() > 0.06]
                if t in SHORT[name]:
                    w = rng.choices(LEADS, k=rng.randrange(5)) + w
                for _ in range(rng.randrange(6 if t in SHORT[name] else 4)):
                    w.insert(rng.choice((0, len(w))), rng.choice(noise))
                rows.append((grams(w), k))
    every = [w for texts in TEMPLATES.values() for t in texts for w in tokens(t)]
    for t in OTHERS:
        for _ in range(copies):
            rows.append((grams([x for x in tokens(t) if rng.random() > 0.1]), 0))
    for name in sorted({n for f in TEMPLATES for n in (*NAMES.get(f, ()), *IDENTIFIERS.get(f, ()))}):
        for denial in DENIALS:
            for _ in range(copies // 10):
                w = rng.choices(LEADS, k=rng.randrange(3)) + tokens(denial.format(name))
                for _ in range(rng.randrange(6)):
                    w.insert(rng.choice((0, len(w))), rng.choice(noise))
                rows.append((grams(w), 0))
    for _ in range(12 * copies):
        rows.append((grams(rng.choices(every + noise, k=rng.randrange(2, 25))), 0))
    rng.shuffle(rows)
    vocabulary = sorted(set().union(*(g for g, _ in rows)))
    at = {g: i for i, g in enumerate(vocabulary)}
    doc = np.concatenate([np.full(len(g), i) for i, (g, _) in enumerate(rows)])
    feat = np.concatenate([np.fromiter((at[x] for x in sorted(g)), np.int64, len(g)) for g, _ in rows])
    y = np.eye(len(names))[[k for _, k in rows]]
    held = np.arange(len(rows)) % 5 == 0
    w, b = np.zeros((len(vocabulary), len(names))), np.zeros(len(names))
    fit_rows = ~held[doc]
    d, f = doc[fit_rows], feat[fit_rows]
    order = np.argsort(f, kind="stable")

    def probabilities() -> np.ndarray:
        z = np.zeros((len(rows), len(names)))
        np.add.at(z, doc, w[feat])
        z = np.exp((z := z + b) - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    starts = np.searchsorted(f[order], np.arange(len(vocabulary)))
    seen = np.bincount(f, minlength=len(vocabulary)) > 0
    for _ in range(60):
        g = (probabilities() - y) * ~held[:, None]
        grad = np.zeros_like(w)
        grad[seen] = np.add.reduceat(g[d[order]], starts[seen], axis=0)
        w -= 0.02 * (grad + 0.02 * w)
        b -= 0.002 * g.sum(0)
    half = held & (np.arange(len(rows)) % 10 == 0)
    logits = np.log(np.maximum(probabilities(), 1e-300))
    w, b = w / (heat := temperature(logits[half], y[half])), b / heat
    p = probabilities()
    unknown = held & ~half & (y[:, 0] == 1)
    least = float(np.clip((1 - p[unknown, 0]).max(), 0.5, 0.95))
    i, k = np.nonzero(np.abs(w - w[:, :1]) > 0.02 / heat)
    table = pd.DataFrame({"gram": [vocabulary[x] for x in i], "family": [names[x] for x in k], "weight": (w[i, k] - w[i, 0])})
    return Model(names[1:], table, {n: float(b[j] - b[0]) for j, n in enumerate(names)}, least)


def _grams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))


BLANK = r"^[\x09-\x0D\x20]*$"


def _blocks(lines: Column) -> Column:
    """The runs of two and more lines without a blank one between, as structs like those of paragraphs()."""
    return F.transform(F.array(lines), _blocks_of)[0]


def _blocks_of(lines: Column) -> Column:
    n = F.size(lines)
    blank = lambda k: F.coalesce(F.get(lines, k).rlike(BLANK), F.lit(True))
    every = F.sequence(F.lit(0), n - 1)
    starts = F.filter(every, lambda k: ~blank(k) & blank(k - 1))
    ends = F.filter(every, lambda k: ~blank(k) & blank(k + 1))
    runs = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda r: r["s"] < r["e"])
    return F.transform(runs, lambda r: F.struct(r["s"].alias("line_no"), r["e"].alias("last"), F.array_join(F.slice(lines, r["s"] + 1, r["e"] - r["s"] + 1), " ").alias("line")))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, line_no, last, words) of the paragraphs that have a cue: runs of lines between blank ones, and each line by itself; last: the last line's number; tie tells texts of one doc_id apart."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text")).where(F.lower("text").rlike(cues()))
    lines = F.split("text", r"\r?\n")
    single = F.transform(lines, lambda x, k: F.struct(k.alias("line_no"), k.alias("last"), x.alias("line")))
    rows = rows.select("doc_id", "tie", F.explode(F.concat(single, _blocks(lines))).alias("x")).select("doc_id", "tie", "x.line_no", "x.last", F.lower("x.line").alias("line"))
    return rows.where(F.col("line").rlike(cues())).select("doc_id", "tie", "line_no", "last", F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0)).alias("words"))


def _confirmed(words: Column, confirm: float) -> Column:
    """The families (family, share) of which a paragraph has an n-gram that no other has, and of one of whose templates `confirm` of the n-grams (all of them, if it is a SHORT one)."""
    own = own_grams()
    each = lambda f, ts: [{"grams": sorted(g := grams(tokens(t))), "least": 1 - 1e-9 if t in SHORT[f] else confirm - 1e-9, "n": len(g)} for t in ts]
    known = json.dumps([{"family": f, "own": sorted(own[f]), "templates": each(f, ts)} for f, ts in TEMPLATES.items()])
    # folded to one constant
    table = F.from_json(F.lit(known), "array<struct<family:string,own:array<string>,templates:array<struct<grams:array<string>,least:double,n:int>>>>")

    def families(g: Column) -> Column:
        def share(t: Column) -> Column:
            part = F.size(F.array_intersect(g, t["grams"])) / t["n"]
            return F.when(part >= t["least"], part)

        likely = F.filter(table, lambda f: F.arrays_overlap(g, f["own"]))
        return F.filter(F.transform(likely, lambda f: F.struct(f["family"].alias("family"), F.array_max(F.transform(f["templates"], share)).alias("share"))), lambda x: x["share"].isNotNull())

    return F.transform(F.array(_grams(words)), families)[0]  # the n-grams are made once


def classify(found: DataFrame, model: Model | None = None, confirm: float = CONFIRM) -> DataFrame:
    """(doc_id, tie, line_no, last, family, probability, template_share) of the distinct paragraphs() rows that a template confirms; family is 'unknown' where a licence is less likely than the model's threshold, or where the likeliest family isn't a confirmed one.

    Paragraphs are confirmed where they lie, so only those that look like notices are shuffled and scored.
    """
    spark, model = found.sparkSession, model or train()
    weights = spark.createDataFrame(pa.Table.from_pandas(model.weights, preserve_index=False))
    bias = spark.createDataFrame([(k, v) for k, v in model.bias.items() if k != UNKNOWN], "family string, bias double")
    key = ["doc_id", "tie", "line_no", "last"]
    sure = cut(found.withColumn("sure", _confirmed(F.col("words"), confirm)).where(F.size("sure") > 0).dropDuplicates(key))
    one = sure.select(*key, F.explode(_grams(F.col("words"))).alias("gram"))
    # tables of the model: a fixed number of rows, whatever the input
    z = one.join(F.broadcast(weights), "gram").groupBy(*key, "family").agg(F.sum("weight").alias("z")).join(F.broadcast(bias), "family").withColumn("z", F.col("z") + F.col("bias"))
    top = z.groupBy(*key).agg(F.max_by(F.struct("family", "z"), F.struct("z", "family")).alias("top"), F.sum(F.exp(F.least("z", F.lit(300.0)))).alias("all"))
    same = [top[c].eqNullSafe(sure[c]) for c in key]
    both = top.join(sure, reduce(and_, same)).select(*(top[c] for c in key), "top", "all", F.get(F.filter("sure", lambda x: x["family"] == F.col("top.family")), F.lit(0))["share"].alias("share"))
    known = (F.col("all") / (1 + F.col("all")) >= model.least) & F.col("share").isNotNull()
    p = F.exp(F.least(F.col("top.z"), F.lit(300.0))) / (1 + F.col("all"))
    return both.select(*key, F.when(known, F.col("top.family")).otherwise(UNKNOWN).alias("family"), F.round(p, 6).alias("probability"), F.round("share", 6).alias("template_share"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_notices long, families array<string> (distinct, sorted), notices string ('line:family', by line).

    A notice is a line, or a run of lines between blank ones, at its first line, where no line of it is a notice of that
    family by itself. Null and empty texts, and those without notice, have none; repeated rows come repeatedly; rows
    that share a doc_id with other texts keep their own notices; very long texts are taken whole; an empty table gives
    an empty result; other columns play no part.
    """
    got = classify(paragraphs(docs)).where(F.col("family") != UNKNOWN).groupBy("doc_id", "tie").agg(F.sort_array(F.collect_list(F.struct("line_no", "last", "family"))).alias("all"))
    within = lambda x, y: (y["line_no"] == y["last"]) & (y["family"] == x["family"]) & y["line_no"].between(x["line_no"], x["last"])
    own = F.filter("all", lambda x: (x["line_no"] == x["last"]) | ~F.exists("all", lambda y: within(x, y)))
    notices = F.transform(own, lambda x: F.struct(x["line_no"].alias("line_no"), x["family"].alias("family")))
    got = got.select(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie"), notices.alias("notices"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"))
    out = rows.join(got, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie")), "left")
    none = F.coalesce("notices", F.array().cast("array<struct<line_no: int, family: string>>"))
    return out.select(
        "doc_id",
        F.size(none).cast("long").alias("n_notices"),
        F.array_sort(F.array_distinct(F.transform(none, lambda n: n["family"]))).alias("families"),
        F.array_join(F.transform(none, lambda n: F.concat_ws(":", n["line_no"].cast("string"), n["family"])), ",").alias("notices"),
    )
