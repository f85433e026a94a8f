"""License scans by conditional compression.

Around words that licences use, blocks of a text are candidates. Beside each such word every template
that has it is laid over the block, and zstandard compresses what lies under it with the template as
raw dictionary: what that saves, against what the template saves on itself, ranks the templates. In
that order they are held against the wording, whose exact differences confirm or refuse them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import table

#: Public wording of notices by SPDX-like name. Numbers in them have to agree.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
)
#: Every template has one of these, lower-cased.
CUES = ("licens", "licence", "permission", "redistribut", "rights reserved", "public domain", "cc0", "creative commons", "subject to the terms")
#: Characters around a cue that belong to its block. Cues whose surroundings overlap share a block.
REACH = 320
#: Share of a template's words that have to be there.
MIN_WORDS = 0.8
#: Of the plain compressor and those with a template alike.
_WINDOW_LOG = 12
_CUE = re.compile("|".join(map(re.escape, CUES)), re.IGNORECASE)
_WORDS = re.compile(r"\w+(?:\.\w+)*")


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in _WORDS.finditer(text)]


def _cue(m: re.Match) -> str:
    return m[0].lower().replace("licence", "licens")


@lru_cache(maxsize=1)
def _compressors():
    def of(content: bytes | None):
        size = len(content or b"")
        params = zstandard.ZstdCompressionParameters.from_level(19, source_size=1024, dict_size=size, window_log=_WINDOW_LOG, min_match=3, write_content_size=0, write_dict_id=0)
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if size else None
        return zstandard.ZstdCompressor(compression_params=params, dict_data=held).compress

    plain = of(None)
    out = []
    for name, template in TEMPLATES:
        data = template.lower().encode()
        with_it = of(data)
        words = _words(template)
        ends = [e for _, _, e in words]
        cues: dict[str, list[int]] = {}
        for m in _CUE.finditer(template):
            cues.setdefault(_cue(m), []).append(bisect_right(ends, m.start()))
        out.append((name, [w for w, _, _ in words], cues, with_it, len(plain(data)) - len(with_it(data))))
    return plain, out


def blocks_of(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around cues, which never overlap; texts without a cue have none."""
    a = z = None
    for m in _CUE.finditer(text):
        low, high = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if z is not None and low <= z:
            z = high
        else:
            if z is not None:
                yield a, z
            a, z = low, high
    if z is not None:
        yield a, z


def _wording(words: list[str], template: list[str]) -> tuple[int, int, list[str], list[str]] | None:
    """(first, last, missing, extra): where template's wording is in words, and how it differs."""
    matcher = SequenceMatcher(None, words, template, autojunk=False)
    best = matcher.find_longest_match()
    if not best.size:
        return None
    # Around the longest match, as far as the template could reach with some insertions.
    a = max(0, best.a - best.b - len(template) // 4)
    z = min(len(words), best.a + len(template) - best.b + len(template) // 4)
    found = [m for m in SequenceMatcher(None, words[a:z], template, autojunk=False).get_matching_blocks() if m.size]
    first, last = a + found[0].a, a + found[-1].a + found[-1].size
    there = {m.b + i for m in found for i in range(m.size)}
    here = {a + m.a + i for m in found for i in range(m.size)}
    return first, last, [w for i, w in enumerate(template) if i not in there], [words[i] for i in range(first, last) if i not in here]


def _confirmed(words: list[str], template: list[str], low: int, high: int, free: int) -> tuple[int, int, list[str], list[str]] | None:
    """_wording() between low and high, or nearer to what was found there; None if it differs too much."""
    some = set(words[low:high])
    if sum(w not in some for w in template) > (1 - MIN_WORDS) * len(template):
        return None
    hit = None
    for _ in range(2):
        got = _wording(words[low:high], template)
        if got and (hit is None or len(got[2]) + len(got[3]) < len(hit[2]) + len(hit[3])):
            hit = low + got[0], low + got[1], got[2], got[3]
        if hit is None or not hit[2]:
            break
        low, high = max(free, hit[0] - _slack(template) - len(hit[2])), hit[1] + _slack(template) + len(hit[2])
    if hit is None or any(w[0].isdigit() for w in hit[2]):
        return None
    return hit if len(hit[2]) <= (1 - MIN_WORDS) * len(template) and len(hit[3]) <= (1 - MIN_WORDS) * len(template) + 1 else None


def _slack(template: list[str]) -> int:
    """Words by which words that are missing or extra may shift a template."""
    return int((1 - MIN_WORDS) * len(template)) + 2


def find_licenses(text: str | None) -> list[tuple[int, int, str, float, str, str]]:
    """(start, end, license, saving, missing, extra) in code points, in order; spans do not overlap."""
    out = []
    plain, templates = _compressors()
    for a, z in blocks_of(text or ""):
        block = text[a:z]
        places = _words(block)
        words, ends = [w for w, _, _ in places], [e for _, _, e in places]
        free = 0  # words before it are in notices

        def saved(first: int, last: int, with_it, own: int) -> float:
            # Templates end in a full stop; the compressor looks for no match at the first byte.
            data = ("\n" + block[places[first][1] : places[last - 1][2]].lower() + ".").encode("utf-8", "surrogatepass")  # noqa: B023
            return (len(plain(data)) - len(with_it(data))) / own

        for m in _CUE.finditer(block):
            at = bisect_right(ends, m.start())
            if at < free or at == len(words):
                continue
            ranked = []
            for n, (_, template, cues, with_it, own) in enumerate(templates):
                for j in cues.get(_cue(m), ()):
                    first, last = max(free, at - j), min(len(words), at - j + len(template))
                    ranked.append((-saved(first, last, with_it, own), n, at - j))
            tried = []
            for _, n, begin in sorted(ranked):
                name, template, _, with_it, own = templates[n]
                hit = _confirmed(words, template, max(free, begin - _slack(template)), begin + len(template) + _slack(template), free)
                if hit:
                    first, last, missing, extra = hit
                    tried.append((-saved(first, last, with_it, own), len(missing) + len(extra), -len(template), first, last, name, missing, extra))
                    if not missing and not extra:
                        break
            if tried:
                saving, _, _, first, last, name, missing, extra = min(tried)
                out.append((a + places[first][1], a + places[last - 1][2], name, -saving, " ".join(missing), " ".join(extra)))
                free = last
    return out


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("span_start", pa.int64()), ("span_end", pa.int64()), ("license", pa.string()), ("saving", pa.float64()), ("missing", pa.string()), ("extra", pa.string())]
)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each licence notice in each row of docs: where it is, which, and how its wording differs.

    Null and empty texts have none; repeated rows each get their own; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for x in find_licenses(t.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, span_start long, span_end long, license string, saving double, missing string, extra string")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each licence notice in documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))
