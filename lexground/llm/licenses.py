"""License scans: a trained paragraph classifier (native).

Paragraphs are lines, and runs of several lines between blank ones (or ones without letters and digits), so that a
hard-wrapped notice is met whole; a run counts only for a family that none of its own lines is confirmed for.  Features
are the distinct word uni-, bi- and trigrams that hold a cue word; a multinomial logistic regression, trained here on templates of licence notices, their variations and sentences that only sound alike,
gives a probability to each licence family and to "unknown".  A temperature calibrates the probabilities: it is fitted on
templates and sentences that a first model has never seen in any variation (each third one), and the model used is then
trained on all; a family needs ``SURE`` and more than unknown.  The prediction is confirmed if the paragraph holds enough of
the trigrams of one of the family's templates.  A line that is the title of a licence and nothing else has too few words for
that; it is known by the whole title.

Paragraphs without a cue word have no features, so leaving them out changes nothing: their class is unknown.  Equal
paragraphs are scored together, ``SHARES`` times at most: each is dealt to a share by its place, so that a notice that a third of
all documents hold is no single key.

Defined cases: null text has no paragraphs; empty lines count as paragraphs and are unknown; rows that repeat a doc_id are
one document for what is found and stay rows of their own; null doc_id finds nothing; other columns are ignored; no rows
give no rows.
"""

from __future__ import annotations

import random
import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

SURE, CONFIRMED, UNKNOWN = 0.6, 0.5, "unknown"
#: Words one of which a feature holds (fixed values).
CUES = "licence licences licenced license licenses licensed licensing licensor sublicense copyright copyrighted copyleft permission permissions warranty warranties redistribution redistribute redistributions gpl gplv2 gplv3 lgpl agpl spdx mpl bsd mit apache mozilla creative commons cc cc0 unlicense reserved proprietary domain attribution noncommercial sharealike".split()

#: Notices by family (fixed values).
TEMPLATES = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT license", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0",
               "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GPL version 2",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1", "Licensed under the LGPL version 3"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0", "Licensed under the AGPL version 3"],
    "bsd": ["Released under the BSD License.", "Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Released under CC BY 3.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Released under CC BY-NC 3.0"],
    "cc0": ["Licensed under CC0 1.0.", "Released under CC0 1.0 Universal public domain dedication", "This work has been dedicated to the public domain under Creative Commons CC0"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
    "proprietary": ["All rights reserved.", "Copyright 2020. All rights reserved.", "This software is proprietary and confidential; unauthorised copying is prohibited.", "No part of this publication may be reproduced without the prior written permission of the publisher."],
}
#: Titles that stand alone on a line, by family (fixed values).
TITLES = {
    "mit": ["MIT License", "The MIT License", "The MIT License (MIT)", "Expat License"],
    "apache": ["Apache License", "Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"],
    "gpl": ["GNU General Public License", "GNU General Public License v2.0", "GNU General Public License v3.0", "GNU General Public License, version 2", "GNU General Public License, version 3"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "GNU Library General Public License"],
    "agpl": ["GNU Affero General Public License", "GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3"],
    "bsd": ["BSD License", "The BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "The 2-Clause BSD License", "The 3-Clause BSD License", "Simplified BSD License", "New BSD License"],
    "mpl": ["Mozilla Public License", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "cc-by": ["Creative Commons Attribution 4.0 International", "Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    "unlicense": ["The Unlicense"],
}
#: Sentences with cue words that name no licence.
OTHERS = [
    "He showed his driving licence to the officer at the gate.", "The licence fee went up by ten per cent this year.", "She gave us permission to enter the building after dark.",
    "The warranty of the washing machine expired in March.", "Copyright law is older than the printing press.", "An Apache helicopter landed behind the barn.", "Researchers at MIT built a small robot.",
    "The restaurant lost its license to sell wine.", "The firm holds a fishing licence for these waters.", "Please ask for permission before you take a picture.", "The domain of the function is the real line.",
    "Creative people often work at night.", "The House of Commons met on Monday.", "A table was reserved for six.", "They met in the public domain of the old town.", "The redistribution of land took years.",
    "Er kam mit dem Zug und ging mit ihr nach Haus.", "The attribution of the painting is in doubt.", "The license plate was blue.", "Mozilla was a lizard in a cartoon.", "He was licensed as a pilot in spring.",
    "The doctor is licensed to practise in two states.", "Write to cc the manager and the clerk.", "Rules on licensing of taxis differ by town.",
]
_word = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _word.findall(text.lower())


def grams_of(text: str) -> set[str]:
    words = words_of(text)
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def features_of(text: str) -> set[str]:
    return {g for g in grams_of(text) if not cues().isdisjoint(g.split())}


@cache
def cues() -> frozenset[str]:
    return frozenset(CUES)


def _variations(rng: random.Random, text: str, n: int):
    fill = words_of(" ".join(OTHERS))
    yield text
    for _ in range(n):
        words = [w for w in words_of(text) if len(words_of(text)) < 6 or rng.random() > 0.06]
        words = [str(rng.randint(1, 5)) if w.isdigit() and len(w) == 1 and rng.random() < 0.5 else w for w in words]
        before, after = (rng.choices([f for f in fill if f not in cues()], k=rng.choice((0, 0, 1, 4, 9))) for _ in range(2))
        yield " ".join([*before, *words, *after])


def examples() -> list[tuple[str, int, int]]:
    """Text, family (0: unknown), number of the template or sentence it varies."""
    rng, names = random.Random(7), [UNKNOWN, *TEMPLATES]
    texts = [(t, names.index(f), 24) for f, own in TEMPLATES.items() for t in own] + [(t, 0, 12) for t in OTHERS]
    out = [(v, k, i) for i, (t, k, n) in enumerate(texts) for v in _variations(rng, t, n)]
    # cue words alone, so that one of them never suffices
    return out + [(" ".join(rng.choices(CUES, k=rng.choice((1, 1, 2)))), 0, len(texts) + i) for i in range(400)]


def fit(rows: list[tuple[str, int, int]]):
    """Weights by feature, and constants, of a multinomial logistic regression."""
    import numpy as np

    vocabulary = sorted({g for t, _, _ in rows for g in features_of(t)})
    at, n = {g: i for i, g in enumerate(vocabulary)}, len(TEMPLATES) + 1
    x, target = np.zeros((len(rows), len(vocabulary))), np.eye(n)[[k for _, k, _ in rows]]
    for i, (t, _, _) in enumerate(rows):
        x[i, [at[g] for g in features_of(t)]] = 1
    w, b = np.zeros((len(vocabulary), n)), np.zeros(n)
    momentum_w, momentum_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(250):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        momentum_w = 0.9 * momentum_w + x.T @ (target - p) / len(rows) - 1e-4 * w
        momentum_b = 0.9 * momentum_b + (target - p).mean(axis=0)
        w, b = w + momentum_w, b + momentum_b
    return {g: w[i] for g, i in at.items()}, b


def logits(texts: list[str], weights: dict, constants):
    import numpy as np

    return np.array([constants + sum((weights[g] for g in features_of(t) if g in weights), np.zeros(len(constants))) for t in texts])


@cache
def model() -> tuple[list[str], dict[str, list[float]], list[float], float]:
    """Families (unknown first), weights by feature, constants, temperature."""
    import numpy as np

    rows = examples()
    held = [r for r in rows if r[2] % 3 == 1]
    first = logits([r[0] for r in held], *fit([r for r in rows if r[2] % 3 != 1]))

    def loss(temperature: float) -> float:
        z = first / temperature
        z = z - z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(held)), [r[1] for r in held]] - np.log(np.exp(z).sum(axis=1))).mean())

    temperature = min((0.25 * 1.1**i for i in range(40)), key=loss)
    weights, b = fit(rows)
    kept = {g: [round(v, 5) for v in w.tolist()] for g, w in weights.items() if np.abs(w).max() > 1e-4}
    return [UNKNOWN, *TEMPLATES], kept, [round(v, 5) for v in b.tolist()], round(float(temperature), 5)


@cache
def template_grams() -> list[tuple[str, frozenset[str]]]:
    """Family and trigrams of each template (all its grams, if it has no trigram)."""
    out = []
    for family, texts in TEMPLATES.items():
        for t in texts:
            three = frozenset(g for g in grams_of(t) if g.count(" ") == 2)
            out.append((family, three or frozenset(grams_of(t))))
    return out


def gram_table(spark: SparkSession) -> DataFrame:
    """gram, weights, templates: a few thousand constant rows."""
    names, weights, _, _ = model()
    member: dict[str, list[int]] = {}
    for i, (_, grams) in enumerate(template_grams()):
        for g in grams:
            member.setdefault(g, []).append(i)
    rows = [(g, weights.get(g, [0.0] * len(names)), member.get(g, [])) for g in sorted(weights.keys() | member.keys())]
    return spark.createDataFrame(rows, "gram string, weights array<double>, templates array<int>")


#: Shares that equal paragraphs are dealt to.
SHARES = 64
#: A line's place is its run's number times this and its number in the run, in the order of the text.
RUN = 1 << 32


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, run, par, line, line_key (of equal lines of a share), of_run: the lines and the runs of several lines that hold a
    cue word, ``par`` in the order of the text; a run has the place of its first line."""
    cue = r"(?<![\p{L}\p{N}])(?:" + "|".join(CUES) + r")(?![\p{L}\p{N}])"
    runs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.regexp_replace("text", r"(?dm)^[^\p{L}\p{N}\n]+$", ""), "\n\n")).alias("run", "whole"))
    runs = runs.filter(F.lower("whole").rlike(cue))
    whole = F.trim(F.col("whole"), F.lit("\n"))
    parts = F.transform(F.split("whole", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("line"), F.lit(False).alias("of_run")))
    parts = F.concat(F.filter(parts, lambda x: F.lower(x["line"]).rlike(cue)), F.when(F.contains(whole, F.lit("\n")), F.array(F.struct(F.lit(0).alias("i"), whole.alias("line"), F.lit(True).alias("of_run")))).otherwise(F.filter(parts, lambda x: F.lit(False))))
    rows = runs.select("doc_id", "run", F.explode(parts).alias("p"))
    rows = rows.select("doc_id", "run", (F.col("run") * F.lit(RUN) + F.col("p.i")).alias("par"), "p.line", "p.of_run")
    return rows.withColumn("line_key", F.concat_ws(":", F.md5(F.col("line").cast("binary")), F.pmod(F.xxhash64("doc_id", "par"), F.lit(SHARES))))


def title_family(words):
    """The family whose title the words are, all of them; null if none."""
    named = [w for f, texts in TITLES.items() for t in texts for w in (F.lit(" ".join(words_of(t))), F.lit(f))]
    return F.element_at(F.create_map(*named), F.array_join(words, " "))


def score_lines(lines: DataFrame) -> DataFrame:
    """line_key, family, probability, containment, confirmed, for (line_key, line) rows of distinct lines."""
    names, _, constants, temperature = model()
    templates = template_grams()
    words = F.regexp_extract_all(F.lower("line"), F.lit(r"([\p{L}\p{N}]+)"), 1)
    run = lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.array_join(F.slice("words", i, n), " "))
    grams = F.array_distinct(F.concat(F.col("words"), *[F.when(F.size("words") >= n, run(n)).otherwise(F.array().cast("array<string>")) for n in (2, 3)]))
    rows = lines.withColumn("words", words).select("line_key", title_family(F.col("words")).alias("title"), F.explode(grams).alias("gram")).join(F.broadcast(gram_table(lines.sparkSession)), "gram")
    sums = rows.groupBy("line_key").agg(
        F.first("title").alias("title"),
        *[F.sum(F.col("weights")[i]).alias(f"w{i}") for i in range(len(names))],
        *[F.sum(F.array_contains("templates", i).cast("int")).alias(f"t{i}") for i in range(len(templates))],
    )
    z = F.array(*[F.round((F.col(f"w{i}") + c) / temperature, 6) for i, c in enumerate(constants)])
    sums = sums.withColumn("z", z).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top")))
    best = F.array_max(F.array(*[F.struct(F.col("z")[i].alias("z"), F.lit(-i).alias("order"), F.lit(n).alias("family")) for i, n in enumerate(names)]))
    sums = sums.withColumn("probability", F.round(1 / total, 4)).withColumn("best", best["family"])
    held = F.lit(0.0)
    for n in names[1:]:
        parts = [F.col(f"t{i}") / len(g) for i, (f, g) in enumerate(templates) if f == n]
        held = F.when(F.col("best") == n, F.greatest(*parts) if len(parts) > 1 else parts[0]).otherwise(held)
    sure = (F.col("best") != UNKNOWN) & (F.col("probability") >= SURE)
    out = sums.withColumn("containment", F.round(held, 4)).withColumn("family", F.when(sure, F.col("best")).otherwise(F.lit(UNKNOWN)))
    titled = F.col("title").isNotNull()
    return out.select(
        "line_key", F.coalesce("title", "family").alias("family"), F.when(titled, 1.0).otherwise(F.col("probability")).alias("probability"), F.when(titled, 1.0).otherwise(F.col("containment")).alias("containment"),
        (titled | (F.col("family") != UNKNOWN) & (F.col("containment") >= CONFIRMED)).alias("confirmed"),
    )


def scan_paragraphs(documents: DataFrame) -> DataFrame:
    """doc_id, run, par, line, of_run, family, probability, containment, confirmed of each line, and run of lines, with a cue word."""
    found = cut(candidates(documents))  # read twice
    distinct = found.groupBy("line_key").agg(F.min("line").alias("line"))
    return found.join(score_lines(distinct), "line_key").select("doc_id", "run", "par", "line", "of_run", "family", "probability", "containment", "confirmed")


def scan_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs (lines), n_licences, families (comma-separated, confirmed ones), license (of the surest confirmed
    paragraph, else none)."""
    # one row a place: of a run the family, unless a line of its own has it
    found = scan_paragraphs(documents).filter("confirmed").groupBy("doc_id", "run", "family").agg(
        F.collect_set(F.when(~F.col("of_run"), F.struct("par", "probability"))).alias("lines"), F.collect_set(F.when(F.col("of_run"), F.struct("par", "probability"))).alias("whole"),
    )
    own = F.size("lines") > 0
    found = found.select("doc_id", "family", (~own).alias("of_run"), F.explode(F.when(own, F.col("lines")).otherwise(F.col("whole"))).alias("p")).select("doc_id", "family", "of_run", "p.*")
    found = found.groupBy("doc_id").agg(
        F.countDistinct("par", "of_run").alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.max(F.struct(F.col("probability"), (-F.col("par")).alias("early"), F.col("family"))).alias("top"),
    ).withColumnRenamed("doc_id", "found_id")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n"))
    rows = rows.select("doc_id", F.when(F.col("n") < 0, 0).otherwise(F.col("n")).alias("n_paragraphs"))
    return rows.join(found, rows["doc_id"] == found["found_id"], "left").select(
        "doc_id", "n_paragraphs", F.coalesce("n", F.lit(0)).cast("long").alias("n_licences"), F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("top.family", F.lit("none")).alias("license"), "top.probability",
    )
