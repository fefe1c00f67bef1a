"""License scan: MinHash bands over text windows retrieve templates, exact shingle containment verifies them.

Words are lower-cased and cut at ASCII punctuation. A template is the set of its word shingles. Templates of similar size form a class; the texts are read in
overlapping windows as long as the class's largest template plus one step, so any passage of that length lies whole in some window. A window
and a template meet where the minimum hash of a band agrees; a band has one row, as texts that share no shingle with a template never agree. A window with a share of at least ``containment`` of the template's shingles has

    Jaccard >= containment * smallest / (window + (1 - containment) * smallest)

of the class, and the number of bands is the smallest that finds such a window with probability ``found`` (0.999) or more. What is met is verified: the match is kept if the share
of the template's shingles in the window is at least ``containment``. Adjoining windows with the same template are one match, at the best window.

Templates are a table of checked size (``MOST_TEMPLATES``), sent to the tasks; texts are scanned where they lie, and nothing is shuffled.

Defined cases: null and empty texts match nothing, templates without a word are left out. A template with fewer words than a shingle is one shingle of all its words, and so is found only as
consecutive words. Repeated rows are scanned each by itself. Empty tables give an empty table; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillbar.llm.words import U64, Texts, mix, slices, windows

SHINGLE = 5
CONTAINMENT = 0.8
FOUND = 0.999
MOST_TEMPLATES = 20_000
STEPS = 8

#: Short public license notices by their usual names.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


def notices(spark: SparkSession) -> DataFrame:
    """The short notices as ``license, text``."""
    return spark.createDataFrame([(name, text) for name, texts in NOTICES.items() for text in texts], "license string, text string")


def plain(texts: Texts) -> Texts:
    return Texts(_PLAIN[texts.data], texts.offsets)


EMPTY = np.iinfo(np.uint64).max


def sliding_min(x: np.ndarray, reach: int) -> np.ndarray:
    """The smallest of each ``reach`` neighbours, by doubling."""
    done = 1
    while 2 * done <= reach:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return x if done == reach else np.minimum(x[:done - reach], x[reach - done:])


class Templates:
    """One size class: its windows, and the templates by band."""

    def __init__(self, numbers: list[int], sets: list[np.ndarray], span: int, containment: float, found: float):
        self.sets = dict(zip(numbers, sets))
        self.span = span
        sizes = [len(s) for s in sets]
        self.step = max(1, max(sizes) // STEPS)
        self.reach = -(-(max(sizes) + self.step - 1) // self.step)
        self.window = self.reach * self.step
        least = min(containment * n / (self.window + (1 - containment) * n) for n in sizes)
        self.bands = max(1, math.ceil(math.log(1 - found) / math.log(1 - min(least, 1 - 1e-9))))
        seeds = np.random.Generator(np.random.PCG64(41 + span)).integers(1, 2**63, self.bands, dtype=U64)
        self.seeds = seeds | U64(1)
        self.by_band: list[dict[int, list[int]]] = []
        self.tops: list[np.ndarray] = []
        for seed in self.seeds:
            met: dict[int, list[int]] = {}
            for number, values in self.sets.items():
                met.setdefault(int((values * seed).min()), []).append(number)
            top = np.zeros(1 << 16, dtype=bool)
            top[[key >> 48 for key in met]] = True
            self.by_band.append(met)
            self.tops.append(top)

    def meet(self, shingles: np.ndarray, first: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first shingle, shingle after the last, template) of every window that meets a template. ``first`` and ``count`` bound the texts' shingles."""
        # every text begins at a full step and is followed by a window of nothing, so that no window holds two texts
        room = (-(-count // self.step) + self.reach) * self.step
        base = np.cumsum(room) - room
        place = np.arange(len(shingles)) + np.repeat(base - first, count)
        padded = np.empty(int(room.sum()) + self.window, dtype=U64)
        for seed, met, top in zip(self.seeds, self.by_band, self.tops):
            padded.fill(EMPTY)
            padded[place] = shingles * seed
            small = padded if self.step == 1 else padded[:len(padded) // self.step * self.step].reshape(-1, self.step).min(axis=1)
            low = sliding_min(small, self.reach)
            for w in np.flatnonzero(top[(low >> U64(48)).astype(np.int64)]).tolist():
                numbers = met.get(int(low[w]))
                if numbers:
                    at = w * self.step
                    doc = int(np.searchsorted(base, at, side="right")) - 1
                    begin = at - int(base[doc])
                    if begin < count[doc]:
                        for number in numbers:
                            yield int(first[doc]) + begin, int(first[doc]) + min(begin + self.window, int(count[doc])), number


def _shingles(texts: Texts, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of consecutive texts, the first one of each text, and their number."""
    words = texts.hashes()
    values = windows(words, span)[texts.inside(span)] if len(words) >= span else np.zeros(0, U64)
    count = np.maximum(texts.count - span + 1, 0)
    return values, np.cumsum(count) - count, count


def prepared(rows: list, containment: float, found: float) -> tuple[list[str], list[Templates]]:
    """The names of the templates and their classes: by shingle width, and by size in powers of two."""
    names, classes = [], {}
    if rows:
        texts = plain(next(slices(pa.array([r["text"] for r in rows], pa.string()), 1 << 62))[2])
        words = texts.hashes()
        for i, row in enumerate(rows):
            own = words[texts.first[i]:texts.first[i + 1]]
            names.append(row["license"])
            if len(own):
                span = min(SHINGLE, len(own))
                values = np.unique(windows(own, span))
                classes.setdefault((span, len(values).bit_length()), []).append((i, values))
    return names, [Templates([i for i, _ in group], [v for _, v in group], span, containment, found)
                   for (span, _), group in sorted(classes.items())]


def matches(texts: Texts, classes: list[Templates], containment: float) -> list[tuple[int, int, int, int, float]]:
    """(text, template, first word, words, containment), adjoining windows merged."""
    out = []
    texts = plain(texts)
    made = {}
    for templates in classes:
        if templates.span not in made:
            made[templates.span] = _shingles(texts, templates.span)
        values, first, count = made[templates.span]
        seen = {}
        for begin, stop, number in templates.meet(values, first, count):
            if (begin, number) not in seen:
                wanted = templates.sets[number]
                held = np.isin(wanted, values[begin:stop])
                share = held.sum() / len(wanted)
                if share >= containment:
                    # the words from the first to the last shingle that the template has
                    hit = np.flatnonzero(np.isin(values[begin:stop], wanted))
                    seen[begin, number] = (begin + int(hit[0]), begin + int(hit[-1]) + templates.span, float(share))
                else:
                    seen[begin, number] = None
        merged: dict[int, list] = {}
        for (begin, number), hit in sorted((k, h) for k, h in seen.items() if h is not None):
            runs = merged.setdefault(number, [])
            doc = int(np.searchsorted(first, begin, side="right")) - 1
            low, high = hit[0] - int(first[doc]), hit[1] - int(first[doc])
            if runs and runs[-1][0] == doc and low < runs[-1][2]:
                if hit[2] > runs[-1][3]:
                    runs[-1][1:4] = [low, high, hit[2]]
            else:
                runs.append([doc, low, high, hit[2]])
        out += [(doc, number, low, high - low, share) for number, runs in merged.items() for doc, low, high, share in runs]
    return sorted(out)


def scan(docs: DataFrame, templates: DataFrame, key: str = "doc_id", text: str = "text", containment: float = CONTAINMENT,
         found: float = FOUND) -> DataFrame:
    """``key, license, template, first_word, n_words, containment``, a row for each match. ``templates`` has ``license, text``."""
    rows = templates.where("text is not null").select("license", "text").distinct().orderBy("license", "text").limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates: scan for them in parts")
    names, classes = prepared(rows, containment, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in slices(batch.column(1)):
                hits = matches(texts, classes, containment)
                doc = np.array([h[0] for h in hits], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low).cast(pa.int64()).take(pa.array(doc)), pa.array([names[h[1]] for h in hits], pa.string()),
                    pa.array([h[1] for h in hits], pa.int32()), pa.array([h[2] for h in hits], pa.int64()),
                    pa.array([h[3] for h in hits], pa.int64()), pa.array([h[4] for h in hits], pa.float64())],
                    names=["key", "license", "template", "first_word", "n_words", "containment"])

    schema = "key long, license string, template int, first_word long, n_words long, containment double"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
