"""License scan: license texts and notices inside documents, also when slightly changed.

Method: overlapping windows over the word shingles of a text are hashed with MinHash. Templates are sorted into classes
by length (powers of two); a window of a class has twice its length and windows overlap by half, so a
template of that class lies whole in one of them. Every band is one minimum; the number of bands of a class is
chosen so that a window with a template of the least containment misses all bands with a chance of at most
``MISS``. Windows that share a band with a template are candidates; exact containment of the template's shingles in
the text around decides. A place that overlaps that of a much longer template is a part of it. Tags
(``SPDX-License-Identifier``) are read exactly.

How it scales: one narrow read, no shuffle. The table of template bands is bounded by the templates given
(``TEMPLATES_MOST``) and travels with the tasks; minima of larger windows are made from those of smaller ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.shingles import WordHasher, mixed, text_buffer, windows

SHINGLE = 5
CONTAINMENT = 0.8
#: Chance that a window holding a template of the least containment is not retrieved.
MISS = 1e-5
TEMPLATES_MOST = 20_000
_FOUND = "doc_id long, license_id string, start long, length long, shared long, shingles long"

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


#: Full license texts, one file per identifier.
FOLDER = Path(__file__).parent / "licenses"
#: A place that overlaps that of a template with so many times its shingles is a part of that one.
MUCH_LONGER = 3
_TAG = re.compile(
    r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9][A-Za-z0-9.+:-]*\)?(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(?[A-Za-z0-9][A-Za-z0-9.+:-]*\)?)*)", re.I
)
_TAG_WORD = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")
_CC_TERMS = {
    "BY": ("Attribution",),
    "BY-SA": ("Attribution-ShareAlike", "Attribution-Share Alike"),
    "BY-NC": ("Attribution-NonCommercial", "Attribution-Noncommercial", "Attribution-Non-Commercial"),
    "BY-ND": ("Attribution-NoDerivatives", "Attribution-NoDerivs", "Attribution-No Derivative Works"),
    "BY-NC-SA": ("Attribution-NonCommercial-ShareAlike", "Attribution-Noncommercial-Share Alike", "Attribution-Non-Commercial-ShareAlike"),
    "BY-NC-ND": ("Attribution-NonCommercial-NoDerivatives", "Attribution-NonCommercial-NoDerivs", "Attribution-Noncommercial-No Derivative Works"),
}


def full_texts() -> dict[str, str]:
    """The full texts that come with this package, and the short ones of the BSD family made from one file."""
    out = {f"{file.stem}/text": file.read_text(encoding="utf-8") for file in sorted(FOLDER.glob("*.txt"))}
    university = out.pop("BSD-3-Clause/text")
    holder = university.replace("University nor the names of its", "copyright holder nor the names of its").replace("REGENTS OR", "COPYRIGHT HOLDER OR")
    holder = holder.replace("REGENTS AND", "COPYRIGHT HOLDERS AND")
    if "copyright holder nor" not in " ".join(holder.split()):
        raise ValueError("the text of BSD-3-Clause is not the expected one")
    out["BSD-3-Clause/text-university"], out["BSD-3-Clause/text"] = university, holder
    out["BSD-2-Clause/text"] = re.sub(r"3\. Neither.*?permission\.", "", holder, flags=re.S)
    return out


def further_notices() -> dict[str, str]:
    """Standard headers and short texts beside those of ``notices``."""
    gnu = "is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; "
    later = "either version {} of the License, or (at your option) any later version."
    out = {
        "AGPL-3.0/notice": "This program " + gnu.format("Affero General Public License") + later.format("3"),
        "LGPL-2.0/notice": "This library " + gnu.format("Library General Public License") + later.format("2"),
        "LGPL-2.1/notice": "This library " + gnu.format("Lesser General Public License") + later.format("2.1"),
        "LGPL-3.0/notice": "This library " + gnu.format("Lesser General Public License") + later.format("3"),
        "LGPL/notice": "This program " + gnu.format("Lesser General Public License"),
        "GFDL/notice": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",
        "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
        "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and "
        "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is "
        "furnished to do so, all subject to the following:",
        "BSL-1.0/notice": "Distributed under the Boost Software License, Version 1.0.",
        "EPL-1.0/notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "v1.0 which accompanies this distribution, and is available at",
        "EPL-2.0/notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at",
        "Perl/notice": "is free software; you can redistribute it and/or modify it under the same terms as Perl itself.",
        "Artistic-2.0/line": "under the terms of the Artistic License 2.0",
        "CC0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to",
        "CC0-1.0/name": "Creative Commons CC0 1.0 Universal",
        "MIT/named": "licensed under the MIT License",
        "ISC/named": "licensed under the ISC License",
        "BSD/named": "licensed under the BSD License",
        "BSD-2-Clause/named": "licensed under the BSD 2-Clause License",
        "BSD-3-Clause/named": "licensed under the BSD 3-Clause License",
        "MPL-2.0/named": "licensed under the Mozilla Public License 2.0",
    }
    for version in ("2", "3"):
        out[f"GPL-{version}.0-or-later/notice"] = "This program " + gnu.format("General Public License") + later.format(version)
    for terms, names in _CC_TERMS.items():
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            for at, name in enumerate(names):
                out[f"CC-{terms}-{version}/name{at or ''}"] = f"Creative Commons {name} {version}"
    return out


def known() -> dict[str, str]:
    """All templates of this package."""
    return {**notices(), **further_notices(), **full_texts()}


def tags(text: str) -> list[tuple[str, int, int]]:
    """(expression, first word, words) of every SPDX tag."""
    out = []
    for found in _TAG.finditer(text):
        named = found[1].rstrip(".:").rstrip(")") if "(" not in found[1] else found[1].rstrip(".:")
        before = len(_TAG_WORD.findall(text[: found.start()]))
        out.append((f"{named}/spdx", before, len(_TAG_WORD.findall(found[0]))))
    return out


def notices() -> dict[str, str]:
    """Fixed texts of common licenses and of the usual notices that name one."""
    out = {
        "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software.",
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
        "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
        "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at",
        "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
        "GPL/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        "MIT/line": "Released under the MIT License.",
        "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    }
    for version in ("1", "2", "3"):
        out[f"GPL-{version}.0/line"] = f"This work is licensed under the GNU General Public License, version {version}."
    for terms in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out[f"CC-{terms}-{version}/line"] = f"Licensed under CC {terms} {version}."
    return out


class _Hasher(WordHasher):
    """Words of letters and digits in lower case; everything else parts words."""

    def shingles(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes over all rows, and the first shingle of each row (those over row borders are marked by 0)."""
        word = np.append(_WORD[data], False)
        before = np.append(False, word[:-1])
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        before[inner] = False
        starts = np.flatnonzero(word & ~before)
        after = np.append(word[1:], False)
        after[inner - 1] = False
        ends = np.flatnonzero(word & ~after) + 1
        words = self.spans(data, starts, ends)
        cuts = np.searchsorted(starts, offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(cuts))
        if len(words) < SHINGLE:
            return np.zeros(len(words), np.uint64), cuts
        runs = np.zeros(len(words), dtype=np.uint64)
        runs[: len(words) - SHINGLE + 1] = windows(words, SHINGLE)
        whole = np.zeros(len(words), dtype=bool)
        whole[: len(words) - SHINGLE + 1] = row[: len(words) - SHINGLE + 1] == row[SHINGLE - 1 :]
        runs[~whole] = 0
        return runs, cuts


class Templates:
    """Template shingles, and per class of length its bands."""

    def __init__(self, texts: Mapping[str, str], containment: float):
        if len(texts) > TEMPLATES_MOST:
            raise ValueError(f"at most {TEMPLATES_MOST} templates travel with the tasks")
        hasher = _Hasher()
        self.names, self.sets, self.containment = [], [], containment
        for name, text in sorted(texts.items()):
            runs, _ = hasher.shingles(*text_buffer(pa.array([text])))
            runs = np.unique(runs[runs != 0])
            if len(runs) == 0:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            self.names.append(name)
            self.sets.append(runs)
        self.classes: dict[int, list[int]] = {}
        for at, runs in enumerate(self.sets):
            self.classes.setdefault(1 << max(0, (len(runs) - 1).bit_length()), []).append(at)
        self.bands: dict[int, int] = {}
        for size, members in self.classes.items():
            least = min(math.ceil(containment * len(self.sets[at])) / (_window(size) + len(self.sets[at])) for at in members)
            self.bands[size] = 1 if size == 1 else math.ceil(math.log(MISS) / math.log(1 - least))
        self.factors = mixed(np.arange(1, max(self.bands.values()) + 1, dtype=np.uint64)) | np.uint64(1)
        self.minima: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for size, members in self.classes.items():
            for band in range(self.bands[size]):
                values = np.array([(self.sets[at] * self.factors[band]).min() for at in members], dtype=np.uint64)
                order = np.argsort(values, kind="stable")
                self.minima[size, band] = (values[order], np.array(members)[order])


def _window(size: int) -> int:
    """Shingles in a window of a class; windows begin every half of it."""
    return 1 if size == 1 else 2 * size


class _Scan:
    def __init__(self, templates: Templates, with_tags: bool):
        self._t, self._tags = templates, with_tags

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        names = [part.split(" ")[0] for part in _FOUND.split(", ")]
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                runs, cuts = hasher.shingles(*text_buffer(part.column(1)))
                docs = part.column(0).to_pylist()
                rows = sorted([(r[0], self._t.names[r[1]], *r[2:]) for r in self._matches(runs, cuts)] + self._tagged(part.column(1)))
                columns = [[docs[r[0]] for r in rows], [r[1] for r in rows], *([r[k] for r in rows] for k in range(2, 6))]
                kinds = (pa.int64(), pa.string(), *[pa.int64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def _tagged(self, texts: pa.Array) -> list[tuple]:
        if not self._tags:
            return []
        held = pc.fill_null(pc.match_substring(texts, "SPDX-License-Identifier:", ignore_case=True), False)
        return [(row, *tag, 1, 1) for row in np.flatnonzero(held.to_numpy(zero_copy_only=False)).tolist() for tag in tags(texts[row].as_py())]

    def _candidates(self, runs: np.ndarray) -> set[tuple[int, int]]:
        """(first shingle of the window, template); windows over row borders do no harm, their text is checked."""
        found: set[tuple[int, int]] = set()
        far = np.uint64(0xFFFFFFFFFFFFFFFF)
        sizes = sorted(self._t.classes)
        for band, factor in enumerate(self._t.factors):
            live = [size for size in sizes if self._t.bands[size] > band]
            if not live or not len(runs):
                continue
            level, width = np.where(runs == 0, far, runs * factor), 1
            for size in live:
                while width < size:  # minima of blocks of twice the width
                    level = np.minimum(level[::2], np.append(level[1::2], far)[: (len(level) + 1) // 2])
                    width *= 2
                minima = level if size == 1 else np.minimum(level, np.append(level[1:], far))
                values, members = self._t.minima[size, band]
                near = self._near(minima, values)
                for at in near[np.isin(minima[near], values)]:
                    low, high = np.searchsorted(values, minima[at]), np.searchsorted(values, minima[at], side="right")
                    found.update((int(at) * size, int(member)) for member in members[low:high])
        return found

    @staticmethod
    def _near(minima: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Places whose 16 middle bits occur among the values: a cheap test before the exact one."""
        table = np.zeros(1 << 16, dtype=bool)
        table[(values >> np.uint64(24)) & np.uint64(0xFFFF)] = True
        return np.flatnonzero(table[(minima >> np.uint64(24)) & np.uint64(0xFFFF)])

    def _matches(self, runs: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(row, template, first word, words, shared shingles, shingles), one per place of a template."""
        best: dict[tuple[int, int, int], tuple] = {}
        for at, member in self._candidates(runs):
            wanted = self._t.sets[member]
            size = len(wanted)
            low, high = max(0, at - 2 * size), min(len(runs), at + 2 * _window(1 << max(0, (size - 1).bit_length())) + 2 * size)
            places = low + np.flatnonzero(np.isin(runs[low:high], wanted))
            rows = np.searchsorted(cuts, places, side="right") - 1
            for row in np.unique(rows).tolist():
                own = places[rows == row]
                begin = 0
                while begin < len(own):
                    end = int(np.searchsorted(own, own[begin] + max(size + 4, size * 3 // 2)))
                    shared = len(np.unique(runs[own[begin:end]]))
                    if shared >= self._t.containment * size:
                        first, last = int(own[begin]), int(own[end - 1])
                        best[row, member, first] = (row, member, first - int(cuts[row]), last - first + SHINGLE, shared, size)
                        begin = end
                    else:
                        begin += 1
        return self._apart(list(best.values()))

    @staticmethod
    def _apart(matches: list[tuple]) -> list[tuple]:
        """Of overlapping places the one with the largest share of its template, then the longest, then the first; places
        that overlap a much longer template do not count."""
        out, taken, by_row = [], {}, {}
        for match in matches:
            by_row.setdefault(match[0], []).append(match)
        kept = [
            m for m in matches
            if not any(o[5] >= MUCH_LONGER * m[5] and o[2] < m[2] + m[3] and m[2] < o[2] + o[3] for o in by_row[m[0]])
        ]
        for match in sorted(kept, key=lambda m: (m[0], -m[4] / m[5], -m[5], m[2], m[1])):
            spans = taken.setdefault(match[0], [])
            if all(match[2] >= high or match[2] + match[3] <= low for low, high in spans):
                spans.append((match[2], match[2] + match[3]))
                out.append(match)
        return out


def license_scan(
    docs: DataFrame, templates: Mapping[str, str] | None = None, containment: float = CONTAINMENT,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per place (id_col, license_id, start, length, shared, shingles): ``shared`` of the template's ``shingles``
    distinct five-word shingles stand in the ``length`` words from word ``start`` on. Of places that overlap, the one
    nearest to its template is given, and of a text and a part of it the whole. Without ``templates`` all of ``known`` are
    looked for, and SPDX tags are rows ``<expression>/spdx`` with one of one shingles.

    Words are runs of letters and digits in lower case. Null, empty and short texts have no match; repeated rows and
    rows without an id are scanned like any other; further columns are left out; an empty table gives no rows.
    """
    scan = _Scan(Templates(templates or known(), containment), with_tags=not templates)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(scan, _FOUND).withColumnRenamed("doc_id", id_col)
