"""License scans: a trained paragraph classifier with a calibrated unknown class, confirmed against templates.

Sparse word n-grams (one to three words) feed a multinomial logistic regression over license families
and `unknown`. It is trained on variations of the templates below and on prose. Its temperature is fitted
on paragraphs of templates and of prose that the model of their fold has not seen at all, so that its
probabilities stand for notices in other words too. A prediction counts only if the paragraph also resembles
a template of the family.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.linear import Rows, fit_classes, softmax

# Notices of license families; {v} stands for a version, {w} for a work.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "{w} is released under the Apache 2.0 license."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license."],
    "cc-by": ["Licensed under CC BY {v}.", "This work is licensed under a Creative Commons Attribution {v} International License.", "{w} is available under CC BY {v}."],
    "cc-by-nc": ["Licensed under CC BY-NC {v}.", "This work is licensed under a Creative Commons Attribution-NonCommercial {v} International License.", "{w} is available under CC BY-NC {v}."],
    "cc-by-nd": ["Licensed under CC BY-ND {v}.", "This work is licensed under a Creative Commons Attribution-NoDerivatives {v} International License."],
    "cc-by-sa": ["Licensed under CC BY-SA {v}.", "This work is licensed under a Creative Commons Attribution-ShareAlike {v} International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal Public Domain Dedication.", "Licensed under CC0 1.0."],
    "gpl": ["This work is licensed under the GNU General Public License, version {v}.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GNU GPL version {v}."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version {v}.", "SPDX-License-Identifier: LGPL-2.1-or-later", "Released under the GNU LGPL version {v}."],
    "agpl": ["This work is licensed under the GNU Affero General Public License, version {v}.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License {v}.", "SPDX-License-Identifier: MPL-2.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
    "proprietary": ["All rights reserved.", "Copyright {v}. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited."],
}
# Paragraphs that speak of licenses without granting one.
OTHER = ["He renewed his driving license in the city.", "The general public came to the works of the foundation.", "A fishing license is required by law.", "The version of this story released last year is free to read.", "She works under the terms of her contract.", "The software was modified by a person at the institute.", "MIT is a university in Massachusetts.", "The Apache people live in the south west.", "Attribution of the painting is uncertain.", "The public domain of science is large.", "All rights must be defended.", "Version 3 of the code was published by the author.", "Commons and lords met to reserve their rights."]
UNKNOWN = "unknown"
#: A paragraph counts from this probability and from this share of a template's n-grams.
THRESHOLD, CONFIRM = 0.6, 0.6
FOLDS = 3
# Words of notices that any prose has.
COMMON = frozenset("a all and any are as by can conditions deal either file following for form free hereby in into is it met modify of or permission person provided purpose the this that to under use via with without work works you your has been not v w text terms these subject".split())
_TOKENS = re.compile(r"[^\W_]+(?:\.\d+)*")
_PARAGRAPH = re.compile(r"[^\n]+")
_SENTENCE = re.compile(r"(?<=[.!?:;])\s+")
#: Longer paragraphs are cut at sentences, so that a notice within prose is seen by itself.
LONG_WORDS = 40


def tokens(text: str) -> list[str]:
    return _TOKENS.findall(text.lower())


def ngrams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def _calibration_error(p: np.ndarray, hit: np.ndarray) -> float:
    tenth = np.minimum((p * 10).astype(int), 9)
    return float(sum(abs(p[tenth == t].mean() - hit[tenth == t].mean()) * (tenth == t).mean() for t in np.unique(tenth)))


class LicenseModel:
    """The families' regression, its temperature, and the templates' n-grams."""

    def __init__(self, seed: int = 7, copies: int = 24):
        draw = random.Random(seed)
        self.classes = [*sorted(TEMPLATES), UNKNOWN]
        unknown = len(self.classes) - 1
        # (class, words, fold): all variations of a template or a sentence are in one fold.
        samples = [(self.classes.index(c), self._vary(draw, t), k % FOLDS) for c, ts in TEMPLATES.items() for k, t in enumerate(ts) for _ in range(copies)]
        prose = [w for t in OTHER for w in tokens(t)]
        # Words of notices in random order are no notice.
        bag = [w for ts in TEMPLATES.values() for t in ts for w in tokens(t)]
        samples += [(unknown, tokens(t), k % FOLDS) for k, t in enumerate(OTHER) for _ in range(copies)]
        samples += [(unknown, [draw.choice(bag if draw.random() < 0.4 else prose) for _ in range(draw.randint(3, 20))], k % FOLDS) for k in range(20 * copies)]
        samples += [(unknown, [], k % FOLDS) for k in range(copies)]
        draw.shuffle(samples)
        kept = Counter(g for _, w, _ in samples for g in set(ngrams(w)))
        self.vocabulary = {g: i for i, g in enumerate(sorted(g for g, c in kept.items() if c >= 3))}
        #: Words of templates that are not in COMMON. A paragraph without any is unknown whatever the classifier
        #: says: the n-grams of common words alone are too small a share of any template to confirm it.
        self.cues = {w for w in bag if w not in COMMON}
        y = np.array([c for c, _, _ in samples])
        x = Rows([self._row(w) for _, w, _ in samples], len(self.vocabulary))
        fold = np.array([f for *_, f in samples])
        z = np.zeros((len(y), len(self.classes)))
        for f in range(FOLDS):
            w, b = fit_classes(x.pick(fold != f), y[fold != f], len(self.classes))
            z[fold == f] = x.pick(fold == f).dot(w) + b
        heats = np.geomspace(0.2, 5, 40)
        self.heat = float(min(heats, key=lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()))
        p = softmax(z / self.heat)
        #: Mean distance of probability and hit rate, over tenths of probability, on the held-out paragraphs.
        self.calibration_error = _calibration_error(p.max(axis=1), p.argmax(axis=1) == y)
        self.w, self.b = fit_classes(x, y, len(self.classes))
        self.templates = {c: [(set(ngrams(tokens(t.format(v="", w="")))), t) for t in ts] for c, ts in TEMPLATES.items()}

    def _row(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(sorted({i for g in ngrams(words) if (i := self.vocabulary.get(g)) is not None}), np.int64)
        return at, np.full(len(at), 1 / max(1.0, len(at) ** 0.5))

    @staticmethod
    def _vary(draw: random.Random, template: str) -> list[str]:
        words = tokens(template.format(v=draw.choice(["1.0", "2.0", "2.1", "3", "3.0", "4.0", ""]), w=draw.choice(["This work", "This text", "The dataset", "This project"])))
        if draw.random() < 0.2 and len(words) > 6:
            del words[draw.randrange(len(words))]
        if draw.random() < 0.3:
            words = [draw.choice(["note", "see", "notice", "copyright", "source"]), *words]
        return words

    def classify(self, paragraphs: list[list[str]]) -> list[tuple[str, float, float]]:
        """(family or unknown, probability, similarity to the family's nearest template) of tokenised paragraphs."""
        x = Rows([self._row(w) for w in paragraphs], len(self.vocabulary))
        p = softmax((x.dot(self.w) + self.b) / self.heat)
        out = []
        for words, row in zip(paragraphs, p, strict=True):
            best = int(row.argmax())
            family = self.classes[best]
            if family == UNKNOWN:
                out.append((UNKNOWN, float(row[best]), 0.0))
                continue
            own = set(ngrams(words))
            like = max(len(own & t) / len(t) for t, _ in self.templates[family])
            sure = row[best] >= THRESHOLD and like >= CONFIRM
            out.append((family if sure else UNKNOWN, float(row[best]), like))
        return out


@lru_cache(1)
def default_model() -> LicenseModel:
    return LicenseModel()


def paragraphs(text: str) -> list[tuple[int, str]]:
    """(start, paragraph): lines, long ones cut at sentences. Nothing of the text is left out."""
    out = []
    for m in _PARAGRAPH.finditer(text):
        line = m[0]
        if line.count(" ") <= LONG_WORDS:
            out.append((m.start(), line))
            continue
        at = 0
        for cut in [*_SENTENCE.finditer(line), None]:
            end = cut.start() if cut else len(line)
            out.append((m.start() + at, line[at:end]))
            at = cut.end() if cut else end
    return out


def scan(text: str | None, model: LicenseModel) -> list[tuple[int, str, float, float, str]]:
    """(start, family, probability, similarity, paragraph) of the license paragraphs of a whole text.

    Sentences that together are one notice are each judged by themselves and with the sentence that follows.
    """
    pieces = [(s, p, tokens(p)) for s, p in paragraphs(text or "")]
    candidates = [i for i, (_, _, w) in enumerate(pieces) if not model.cues.isdisjoint(w)]
    if not candidates:
        return []
    judged = model.classify([pieces[i][2] for i in candidates])
    joined = [pieces[i][2] + (pieces[i + 1][2] if i + 1 < len(pieces) else []) for i in candidates]
    longer = model.classify(joined)
    out = []
    alone = {i for i, one in zip(candidates, judged, strict=True) if one[0] != UNKNOWN}
    for i, one, two in zip(candidates, judged, longer, strict=True):
        family, p, like = one if i in alone or i + 1 in alone else two
        if family != UNKNOWN:
            out.append((pieces[i][0], family, p, like, pieces[i][1]))
    return out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, start, license, probability, similarity, paragraph for every license paragraph of every text.

    A null or empty text has none; texts are read whole, however long. start counts code points. Of classes
    that are equally probable the first in alphabetical order holds. Repeated rows give repeated results;
    columns other than doc_id and text are not read; an empty table gives an empty result.
    """
    model = default_model()  # trained once on the driver; a few thousand weights go along with the tasks

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in scan(t, model)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.string()), strict=True)], ["doc_id", "start", "license", "probability", "similarity", "paragraph"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, start long, license string, probability double, similarity double, paragraph string")
