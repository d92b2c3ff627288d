"""License scans: an exact set-similarity join of text blocks with license templates.

A token is a run of ASCII letters and digits of the lower-cased text. A block is a run of successive lines with tokens: a single
line, or lines that together have at most SPREAD times the words of the template, so that a template is
found however it is wrapped, but not in words scattered over a page. Tokens are ordered by their frequency over all lines of all
documents, rarest first. A template of n distinct tokens is contained to the degree
|template & block| / n; to reach the threshold a block needs k = ceil(threshold * n) of
them, so it must hold one of the n - k + 1 rarest (prefix filter), k template
tokens must be near it (length filter), and behind the rarest that it holds enough must be left in the template's order
(positional filter). What passes is verified exactly; of nested blocks that meet a template the smallest counts.

Plan: two narrow Arrow passes over (doc_id, text): one counts the template tokens, combined before a shuffle of one row a token,
one finds the blocks. The templates go with the task (a fixed list).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table
from .kernels import SLICE_BYTES, buffer, slices, span_hashes, spans

THRESHOLD, SPREAD = 0.8, 2
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-grant-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-warranty": 'The software is provided "as is", without warranty of any kind, express or implied',
    "mit-warranty-full": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0-terms": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "all-rights-reserved": "All rights reserved.",
}
RESULT = "doc_id long, block long, last_line long, license string, containment double"
_TOKEN = re.compile(r"[a-z0-9]+")
_BYTE = np.zeros(256, bool)
_BYTE[[*range(48, 58), *range(97, 123)]] = True


def template_tokens(text: str) -> list[str]:
    return sorted(set(_TOKEN.findall(text.lower())))


def needed(n: int, threshold: float) -> int:
    """Tokens of a template of n that a block must hold."""
    return max(1, math.ceil(round(threshold * n, 9)))


class Vocabulary:
    """The tokens of all templates, found in texts by their hashes."""

    def __init__(self, tokens: list[str]):
        raw, offsets = buffer(pa.array(tokens, pa.string()))
        hashes = span_hashes(raw, offsets[:-1], offsets[1:])
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def found(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of the token at each span, or -1."""
        h = span_hashes(raw, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1)


def _tokens(texts: pa.Array, words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every token of the texts its text, its line in all texts, and its number or -1; and the first line of each text."""
    raw, offsets = buffer(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, ends = spans(_BYTE[raw], offsets)
    breaks = np.flatnonzero(raw == 10)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    # a text begins a line of its own
    first_line = np.searchsorted(breaks, offsets[:-1]) + np.arange(len(texts))
    line = np.searchsorted(breaks, starts) + owner
    return owner, line, words.found(raw, starts, ends), first_line


def _pieces(part: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of a slice; a very long text is read in pieces of whole lines only to count tokens."""
    texts = part.column("text")
    if len(texts) == 1 and texts[0].is_valid and texts[0].as_buffer().size > 2 * SLICE_BYTES:
        text, at = texts[0].as_py(), 0
        while at < len(text):
            end = text.find("\n", at + SLICE_BYTES)
            end = len(text) if end < 0 else end + 1
            yield part.column("doc_id"), pa.array([text[at:end]])
            at = end
    else:
        yield part.column("doc_id"), texts


def _counter(tokens: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Vocabulary(tokens), np.zeros(len(tokens), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for _, texts in _pieces(part):
                    _, line, number, _ = _tokens(texts, words)
                    held = number >= 0
                    # each token counts once a line
                    total += np.bincount(np.unique(line[held] * len(tokens) + number[held]) % len(tokens), minlength=len(tokens))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["token", "n"])

    return count


class Template:
    """A template under the global order: its tokens, how many are needed, the words a block of several lines may have, and the prefix."""

    def __init__(self, name: str, tokens: list[int], words: int, threshold: float, rank: list[int]):
        ordered = sorted(tokens, key=rank.__getitem__)
        self.name, self.n, self.k, self.limit = name, len(ordered), needed(len(ordered), threshold), SPREAD * words
        # behind a token of the prefix there are at least k in the template's order, itself among them: the positional filter
        self.member, self.prefix = np.zeros(len(rank) + 1, bool), np.zeros(len(rank) + 1, bool)
        self.member[ordered] = True
        self.prefix[ordered[: self.n - self.k + 1]] = True


def blocks(template: Template, words: np.ndarray, lines: np.ndarray, tokens: np.ndarray, seeds: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first line, last line, tokens held) of each smallest block of one text: ``words`` of each line, the template tokens found, by line, and the
    lines that hold one of the prefix."""
    at = np.searchsorted(lines, np.arange(len(words) + 1))
    begins: set[int] = set()
    for seed in seeds.tolist():
        begins.add(seed)
        i, total = seed - 1, words[seed] + (words[seed - 1] if seed else 0)
        while i >= 0 and words[i] and total <= template.limit:
            begins.add(i)
            i -= 1
            total += words[i] if i >= 0 else 0
    best: tuple[int, int, int] | None = None
    met = []
    for i in sorted(begins, reverse=True):
        held: set[int] = set()
        total, j = 0, i
        while j < len(words) and words[j] and (j == i or total + words[j] <= template.limit):
            total += words[j]
            held.update(tokens[at[j] : at[j + 1]].tolist())
            if len(held) >= template.k:
                # a block that holds one that begins later is not the smallest
                if best is None or j < best[1]:
                    best = (i, j, len(held))
                    met.append(best)
                break
            j += 1
    yield from reversed(met)


def _finder(tokens: list[str], templates: list[Template]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(tokens)
        for batch in batches:
            for part in slices(batch, "text"):
                owner, line, number, first_line = _tokens(part.column("text"), words)
                found: list[tuple] = []
                if len(owner):
                    per_line = np.bincount(line, minlength=int(first_line[-1]) + 1)
                    bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
                    ids = part.column("doc_id").to_pylist()
                for t in templates if len(owner) else ():
                    seeds = np.flatnonzero(t.prefix[number])
                    for d in np.unique(owner[seeds]).tolist():
                        mine = np.arange(bounds[d], bounds[d + 1])
                        mine = mine[t.member[number[mine]]]
                        if len(np.unique(number[mine])) < t.k:  # length filter over the whole text
                            continue
                        lead = int(first_line[d])
                        end = int(first_line[d + 1]) if d + 1 < part.num_rows else len(per_line)
                        own = seeds[owner[seeds] == d]
                        for i, j, held in blocks(t, per_line[lead:end], line[mine] - lead, number[mine], np.unique(line[own]) - lead):
                            found.append((ids[d], i, j, t.name, round(held / t.n, 6)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["doc_id", "block", "last_line", "license", "containment"])

    return find


def license_blocks(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, block, last_line, license, containment): every smallest block that holds enough of a template.

    ``block`` and ``last_line`` are its first and last line, counted from 0. A block that meets several templates has
    a row for each.

    * Null ids or texts and lines without a token are in no row; a template without a token is ignored.
    * Repeated rows give one result row. Other columns are ignored, whatever their names.
    * Very long texts are searched whole. No template, or an empty table, gives an empty result.
    """
    spark = docs.sparkSession
    sets = {name: tokens for name, text in (TEMPLATES if templates is None else templates).items() if (tokens := template_tokens(text))}
    sizes = {name: len(_TOKEN.findall(text.lower())) for name, text in (TEMPLATES if templates is None else templates).items()}
    if not sets:
        return spark.createDataFrame([], RESULT)
    wanted = sorted(set().union(*sets.values()))
    number = {t: i for i, t in enumerate(wanted)}
    texts = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = texts.transform(map_batches, _counter(wanted), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    frequency = {r.token: r.n for r in counted.collect()}  # at most one row for each template token
    rank = [0] * len(wanted)
    for place, i in enumerate(sorted(range(len(wanted)), key=lambda i: (frequency.get(i, 0), wanted[i]))):
        rank[i] = place
    made = [Template(name, [number[t] for t in tokens], sizes[name], threshold, rank) for name, tokens in sorted(sets.items())]
    return texts.transform(map_batches, _finder(wanted, made), RESULT).distinct()


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_blocks(table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP3_SQL = f"""
WITH templates(license, tokens, words) AS (VALUES {", ".join(f"({_quoted(n)}, [{', '.join(map(_quoted, template_tokens(t)))}], {len(_TOKEN.findall(t.lower()))})" for n, t in TEMPLATES.items())}),
lines AS (
  SELECT DISTINCT doc_id, hash(text) AS h, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
tokens AS (SELECT doc_id, h, block, regexp_extract_all(lower(line), '[a-z0-9]+') AS w FROM lines),
-- lines with the tokens and words of all lines before them, parted where a line has no token
sized AS (SELECT *, len(w) AS n, sum(len(w)) OVER o AS upto, sum((len(w) = 0)::INT) OVER o AS part FROM tokens WINDOW o AS (PARTITION BY doc_id, h ORDER BY block)),
held AS (SELECT doc_id, h, block, part, upto - n AS before, upto, list_intersect(w, [{', '.join(sorted(set().union(*(map(_quoted, template_tokens(t)) for t in TEMPLATES.values()))))}]) AS own FROM sized WHERE n > 0),
runs AS (
  SELECT a.doc_id, a.h, license, a.block, b.block AS last_line, tokens
  FROM templates t, held a JOIN held b ON b.doc_id = a.doc_id AND b.h = a.h AND b.part = a.part AND b.block >= a.block
  WHERE (b.block = a.block OR b.upto - a.before <= {SPREAD} * t.words) AND list_has_any(t.tokens, a.own) AND list_has_any(t.tokens, b.own)),
counted AS (
  SELECT r.doc_id, r.h, r.license, r.block, r.last_line, len(any_value(r.tokens)) AS n, len(list_intersect(any_value(r.tokens), flatten(list(c.own)))) AS overlap
  FROM runs r JOIN held c ON c.doc_id = r.doc_id AND c.h = r.h AND c.block BETWEEN r.block AND r.last_line
  GROUP BY r.doc_id, r.h, r.license, r.block, r.last_line),
met AS (SELECT * FROM counted WHERE overlap >= greatest(1, ceil(round({THRESHOLD} * n, 9))))
SELECT DISTINCT doc_id, block, last_line, license, round(overlap / n, 6) AS containment FROM met m
WHERE NOT EXISTS (SELECT 1 FROM met x WHERE x.doc_id = m.doc_id AND x.h = m.h AND x.license = m.license AND x.block >= m.block AND x.last_line <= m.last_line AND (x.block, x.last_line) <> (m.block, m.last_line))
"""
