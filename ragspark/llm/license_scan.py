"""Operator 4, license scan: min-hashes look up overlapping windows that may hold a template, exact containment confirms.

Words are lower-case runs without ASCII punctuation; shingles have five. For each template length, every text is
cut into windows that overlap so far that any place of a template lies whole inside one. A template is
retrieved by the shingles that are its min-hash in one of ``BANDS`` bands: each window that holds one of them is verified
on full shingle sets, and no other. A place at the containment limit lacks all of them in one case of
0.2**16, if it has 16 distinct shingles or more. One lookup per shingle of the text whatever the number of templates; one pass in place, no shuffle of text.

Where templates differ in a word or two (versions, GPL and LGPL notices), only the one that matches best at a place is given.
A template of three or four words (``NOTICES``) is one shingle, its whole word sequence, held against all runs of so many words.

Defined cases: null, blank and short texts hold nothing; a template of fewer than three words is refused; a
document with several places of a template gives one row, the best and then first place; equal rows
give equal rows; other columns are not carried; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import IS_SPACE, U64, shingles, text_pieces, word_hashes

SHINGLE = 5
SHORTEST = 3
BANDS = 16
CONTAINMENT = 0.8
#: Public licence statements and the openings of notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Apache-2.0-statement": "This project is licensed under the Apache License 2.0.",
    "MIT-statement": "This project is licensed under the MIT License.",
    "GPL-2.0": "GNU General Public License, version 2",
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "LGPL-program-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-3.0": "GNU Affero General Public License, version 3",
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "AGPL-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "MPL-2.0-statement": "Licensed under the Mozilla Public License, version 2.0.",
    "ISC": "Released under the ISC License.",
    "ISC-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-short": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-short": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-3.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "CC-BY-NC-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "CC0-1.0-waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Under five words.
NOTICES = {"All-rights-reserved": "All rights reserved."}
SPDX = ["MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "ISC", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense"]
BLANK = IS_SPACE.copy()
BLANK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_rng = np.random.default_rng(4)
_MULTIPLY = _rng.integers(1, 2**63, BANDS, dtype=np.uint64) * U64(2) + U64(1)


def _shingles_of(texts: list[str], width: int = SHINGLE) -> list[np.ndarray]:
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    s, at = shingles(*word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets, blank=BLANK), len(raw), width)
    return [s[at == i] for i in range(len(raw))]


def all_templates() -> dict[str, str]:
    """What op4 looks for: statements, notices of under five words, SPDX tags and the whole texts of ``licenses``."""
    texts = {f"{p.stem}-text": p.read_text() for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
    return TEMPLATES | NOTICES | {f"SPDX-{x}": f"SPDX-License-Identifier: {x}" for x in SPDX} | texts


def _lookup(keys: np.ndarray):
    """A function of an array: the places of values that are in the sorted ``keys``, and which key each is."""
    first = np.zeros(1 << 16, bool)
    first[(keys >> U64(48)).astype(np.int64)] = True

    def run(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(first[(s >> U64(48)).astype(np.int64)])
        k = np.minimum(np.searchsorted(keys, s[at]), len(keys) - 1)
        same = keys[k] == s[at]
        return at[same], k[same]

    return run


def _scan(templates: dict[str, str], containment: float):
    names = list(templates)
    words = []
    for name, text in templates.items():
        words.append(len(word_hashes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), blank=BLANK)[0]))
        if words[-1] < SHORTEST:
            raise ValueError(f"template {name} has fewer than {SHORTEST} words")
    # A short template's shingle is its whole word sequence.
    sets = [_shingles_of([text], min(n, SHINGLE))[0] for text, n in zip(templates.values(), words, strict=True)]
    owners: dict[int, dict[int, list[int]]] = {}
    for t, (own, n) in enumerate(zip(sets, words, strict=True)):
        for key in {int(own[(own * multiply).argmin()]) for multiply in _MULTIPLY}:
            owners.setdefault(min(n, SHINGLE), {}).setdefault(key, []).append(t)
    # Templates that differ in a word or two hold each other at the limit: where one matches better, the other does not count.
    rivals = [[u for u, n in enumerate(words) if u != t and min(n, SHINGLE) == min(words[t], SHINGLE) and containment <= np.isin(own, sets[u]).mean() < 1] for t, own in enumerate(sets)]
    keys = {width: np.array(sorted(own), U64) for width, own in owners.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = {width: _lookup(k) for width, k in keys.items()}
        for rows, data, offsets in text_pieces(batches, 1 << 20):
            n_rows = len(offsets) - 1
            hashes = word_hashes(data, offsets, blank=BLANK)
            found: dict[tuple[int, int], tuple[float, int, int]] = {}
            for width, find in finders.items():
                s, at = shingles(*hashes, n_rows, width)
                first = np.searchsorted(at, np.arange(n_rows + 1))
                windows = set()
                places, which = find(s)
                for place, key in zip(places.tolist(), keys[width][which].tolist(), strict=True):
                    row = int(at[place])
                    size, in_row = int(first[row + 1] - first[row]), int(place - first[row])
                    for t in owners[width][key]:
                        stride = max(1, len(sets[t]) // 4)
                        span = len(sets[t]) + stride - 1
                        last = max(-(-(size - span) // stride), 0)
                        for k in range(max(0, -(-(in_row - span + 1) // stride)), min(last, in_row // stride) + 1):
                            windows.add((row, t, k * stride, min(k * stride + span, size)))
                good: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
                for row, t, a, b in windows:
                    inside = np.unique(s[first[row] + a : first[row] + b])
                    held = float((inside[np.minimum(np.searchsorted(inside, sets[t]), len(inside) - 1)] == sets[t]).mean())
                    if held >= containment:
                        good.setdefault((row, t), []).append((-held, a, b))
                for (row, t), mine in good.items():
                    better = [x for u in rivals[t] for x in good.get((row, u), ())]
                    mine = [x for x in mine if not any(y[0] < x[0] and y[1] < x[2] and x[1] < y[2] for y in better)]
                    if mine:
                        held, a, b = min(mine)
                        found[row, t] = (-held, a, b - a + width - 1)
            pairs = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array([r for r, _ in pairs], pa.int64())), pa.array([names[t] for _, t in pairs], pa.string()), pa.array([found[k][1] for k in pairs], pa.int64()), pa.array([found[k][2] for k in pairs], pa.int64()), pa.array([found[k][0] for k in pairs], pa.float64())],
                names=["doc_id", "license", "start_word", "n_words", "containment"],
            )

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, start_word, n_words, containment): the best window of each document and template that match."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_scan(templates or TEMPLATES, containment), "doc_id long, license string, start_word long, n_words long, containment double")
