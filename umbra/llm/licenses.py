"""License scans by conditional compression.

The words around cue words are candidate blocks, however the text is wrapped.  A
block is compressed alone and with each template as a Zstandard raw dictionary; the
bytes that the dictionary saves rank the templates.  All are then confirmed by their
wording, the best ranked first: a template's words are aligned with the text's
wherever it can stand, and it is confirmed if few enough words are missing or put in.
A match may differ in at most ``TOLERANCE`` of the template's words, so one of a few
pieces of the template stands in it word for word: the alignment begins at those, and
the longest or most telling word of each is the cue.  Where confirmed notices overlap,
the one with the most words of its template stays, then the one with the fewest
differences, then the first in rank: by rank alone, notices that differ in one word
are taken for one another now and then.  The rank leaves no template out.

Cases: null and empty texts have no matches; several notices in one text give
several rows, equal ones too, and repeated rows give theirs again; a template that
is part of a longer matching one on the same words gives way to it; of notices
that tie in all this the first by name counts; a run of cues longer than ``BLOCK`` is
compressed in parts, and a notice across two parts is aligned whole; in a very long
text only the words around a piece are aligned; null ids are ids like others; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.kernels import by_batch

#: Public notices by SPDX identifier.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved."],
}

CUES = r"licen[sc]e|copyright|permission|redistribut|reserved|domain|warrant|commons|software"
TOLERANCE = 0.1
#: Characters on both sides of a cue that are compressed with it; cues whose margins meet share a block.
MARGIN = 200
#: Characters from the first cue of a block to its last, at most.
BLOCK = 2_000
_CUE, _WORD = re.compile(CUES), re.compile(r"[^\W_]+")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@lru_cache(maxsize=1)
def _templates() -> list[tuple[str, list[str], zstandard.ZstdCompressor]]:
    made = []
    for name, texts in TEMPLATES.items():
        for text in texts:
            known = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.append((name, _words(text), zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=False, write_dict_id=False)))
    return made


@lru_cache(maxsize=1)
def _alone() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, write_content_size=False)


def ranked(block: str) -> list[tuple[int, int, float]]:
    """Every template by the bytes it saves of a block as dictionary, most first: (bytes, template, share of the block's)."""
    data = block.encode()
    alone = len(_alone().compress(data))
    saved = [(alone - len(known.compress(data)), k) for k, (_, _, known) in enumerate(_templates())]
    return [(n, k, round(n / alone, 4)) for n, k in sorted(saved, key=lambda x: (-x[0], x[1]))]


def _blocks(at: list[tuple[int, int]], words: list[str]) -> list[list[int]]:
    """The cue words (their places) of each candidate block."""
    blocks: list[list[int]] = []
    pieces = _pieces()
    for i in (i for i, word in enumerate(words) if word in pieces):
        if blocks and at[i][0] - at[blocks[-1][-1]][1] <= 2 * MARGIN and at[i][1] - at[blocks[-1][0]][0] <= BLOCK:
            blocks[-1].append(i)
        else:
            blocks.append([i])
    return blocks


def _places(words: list[str], cues: list[int]) -> dict[int, set[int]]:
    """By template: where it would start for one of its pieces to stand word for word at a cue."""
    places: dict[int, set[int]] = {}
    for i in cues:
        for k, piece, start, anchor in _pieces()[words[i]]:
            if words[max(i - anchor, 0) : i - anchor + len(piece)] == piece:
                places.setdefault(k, set()).add(i - anchor - start)
    return places


def notices(text: str) -> list[tuple[int, int, str, float, int, int]]:
    """Confirmed notices of a text: (first line, line after the last, license, share of its block's bytes saved, words missing, words put in)."""
    at = [m.span() for m in _WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in at]
    confirmed = []
    for cues in _blocks(at, words):
        order = ranked(text[max(at[cues[0]][0] - MARGIN, 0) : at[cues[-1]][1] + MARGIN])
        places = _places(words, cues)
        for n_saved, k, saved in order:
            name, wanted, _ = _templates()[k]
            edits = int(TOLERANCE * len(wanted))
            for start in places.get(k, ()):
                first, last = max(start - edits, 0), max(start + len(wanted) + edits, 0)
                cost, missing, a, b = _difference(wanted, words[first:last])
                if cost <= edits:
                    confirmed.append((missing - len(wanted), cost, -n_saved, name, (first + a, first + b), missing, saved))
    taken: list[tuple] = []
    for _, cost, _, name, span, missing, saved in sorted(confirmed):
        if all(span[1] <= y[1][0] or span[0] >= y[1][1] for y in taken):
            taken.append(((name, saved, missing, cost - missing), span))
    taken.sort(key=lambda x: x[1])
    ends = [m.start() for m in re.finditer("\n", text)] if taken else []
    return [(bisect(ends, at[a][0]), bisect(ends, at[b - 1][0]) + 1, *x) for x, (a, b) in taken]


@lru_cache(maxsize=1)
def _pieces() -> dict[str, list[tuple[int, list[str], int, int]]]:
    """By anchor word: (template, words of the piece, its place in the template, the anchor's place in it).

    A template that may lose or gain ``e`` words falls into ``e + 1`` pieces; one of them is whole in every match.
    """
    made: dict[str, list[tuple[int, list[str], int, int]]] = {}
    for k, (_, wanted, _) in enumerate(_templates()):
        n = int(TOLERANCE * len(wanted)) + 1
        for i in range(n):
            start, end = len(wanted) * i // n, len(wanted) * (i + 1) // n
            piece = wanted[start:end]
            word = max(piece, key=lambda w: (bool(_CUE.search(w)), len(w)))
            made.setdefault(word, []).append((k, piece, start, piece.index(word)))
    return made


@lru_cache(maxsize=1)
def _anchors() -> str:
    """Pattern of the anchor words; a text without one has no match."""
    return "(?i)" + "|".join(sorted(_pieces()))


def _difference(wanted: list[str], words: list[str]) -> tuple[int, int, int, int]:
    """The least sum of template words missing and words put in between, the missing ones, and the range in ``words``."""
    row = [(0, 0, j) for j in range(len(words) + 1)]
    for w in wanted:
        last, row = row, [(row[0][0] + 1, row[0][1] + 1, row[0][2])]
        for j, x in enumerate(words):
            up, left = last[j + 1], row[j]
            best = min((up[0] + 1, up[1] + 1, up[2]), (left[0] + 1, left[1], left[2]))
            row.append(min(best, last[j]) if w == x else best)
    end = min(range(len(row)), key=lambda j: row[j])
    cost, missing, start = row[end]
    return cost, missing, start, end


def _scan(batches):
    for batch in batches:
        cued = np.flatnonzero(pc.fill_null(pc.match_substring_regex(batch.column(1), _anchors()), False).to_numpy(zero_copy_only=False))
        rows = {k: [] for k in ("at", "first_line", "end_line", "license", "saved", "n_missing", "n_inserted")}
        for i in cued.tolist():
            for notice in notices(batch.column(1)[i].as_py()):
                for k, v in zip(rows, (i, *notice)):
                    rows[k].append(v)
        out = pa.table(rows, schema=_ROWS)
        ids = batch.column(0).take(out.column("at").combine_chunks())
        yield pa.RecordBatch.from_arrays([ids, *(c.combine_chunks() for c in out.columns[1:])], names=["id", *out.column_names[1:]])


_ROWS = pa.schema([("at", pa.int64()), ("first_line", pa.int64()), ("end_line", pa.int64()), ("license", pa.string()), ("saved", pa.float64()), ("n_missing", pa.int64()), ("n_inserted", pa.int64())])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each license notice: ``id_col``, lines, ``license``, ``saved`` (share of its block's bytes), ``n_missing``, ``n_inserted`` words."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(own.dtypes)["id"]
    rows = own.mapInArrow(by_batch(_scan), f"id {kind}, first_line long, end_line long, license string, saved double, n_missing long, n_inserted long")
    return rows.withColumnRenamed("id", id_col)
