"""License scans: TF-IDF cosine to templates, then inheritance from directories.

Texts and templates become sparse TF-IDF vectors over words. The document
frequencies are those of all files, of every word: they are counted in Spark and
stay there. The driver fetches those of template words alone. In a first pass
files are scanned with these; where the frequencies of other words of a passage
can change the outcome (it reaches the threshold if these words weigh the least
that a word can, and no passage over some of the same words beats it whatever
they weigh), the file is left open. The words of open passages are joined to
their counts, one row for each word of a text, and with its own words' counts
each open file is scanned again; files with the same text share them. In every file,
windows of as many words as a template has slide over all words, so a statement
is found inside longer lines; windows of lines that begin at a line with an anchor
word are compared too, up to 128 words more than twice the template; licence files
(LICENSE, COPYING and the like by name) are also compared whole. A template's
anchors are its heaviest words, taken until the rest alone couldn't reach the
threshold. A template is passed by, without loss, where the words that the file
has of it couldn't reach the threshold.

Templates are statements, titles, notices and full texts. SPDX tags are read as
such and count as cosine 1; each id of an expression is a candidate, but for
exceptions. An id that isn't listed counts as written, if the tag ends its line (comment
marks apart), so such a file doesn't inherit another license.

A window counts if no window over some of the same words has a greater cosine
(ties: first in order of license id), so a file under several licenses shows them
all. A file's own license is that of the greatest cosine (ties: first in order of
license id), and its licenses are those of all windows that count. The license of a directory is the best among its licence files
(ties: first path). A file without a license of its own takes that of its nearest
ancestor directory that has one, by joins on paths: each directory is resolved
once, then joined to its files.

Null and empty texts have no license of their own but can inherit. A null path
has no directory. Repeated paths are each scanned. Very long texts are scanned
whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import keep, materialise
from .text import as_bytes, slices

THRESHOLD = 0.75
#: Words whose counts a task gathers before it passes them on.
COUNTED = 200_000
#: Copies of a directory's license in the join with the directories below it.
SALTS = 32
LICENCE_FILE = r"(?i)^(licen[cs]es?|copying|copyright|notice|unlicense)([._-].*)?$"
WORD = re.compile(rb"[a-z0-9]+(?:[.+-][a-z0-9]+)*|[^\x00-\x7f]+")

#: What may follow a tag on its line.
TAG_END = re.compile(rb"[ \t]*(?:\*+/|-->|\*\)|[\"'`;*#%)\]}>|])*[ \t]*(?:[\r\n]|\Z)")
#: Tags with an expression of SPDX ids.
TAG = re.compile(rb"spdx-license-identifier:[ \t]*((?:\([ \t]*)*[a-z0-9.+-]+(?:[ \t]*\))*(?:[ \t]+(?:and|or|with)[ \t]+(?:\([ \t]*)*[a-z0-9.+-]+(?:[ \t]*\))*)*)")

#: Statements, titles and notices by SPDX id (fixed values).
STATEMENTS: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License v3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.",),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "This work is released under CC0 1.0 Universal Public Domain Dedication."),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "LGPL-2.0": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def texts() -> dict[str, str]:
    """Full license texts by SPDX id."""
    return {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in (resources.files(__package__) / "license_texts").iterdir() if f.name.endswith(".txt")}


TEMPLATES: dict[str, tuple[str, ...]] = {name: (*some, *([full[name]] if name in full else [])) for full in [texts()] for name, some in STATEMENTS.items()}


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Matcher:
    """Templates as unit TF-IDF vectors under given document frequencies."""

    def __init__(self, templates: dict[str, tuple[str, ...]], frequency: dict[bytes, int], files: int, threshold: float) -> None:
        rows = [(name, Counter(words(t.encode()))) for name in sorted(templates) for t in templates[name]]
        self.names = [name for name, _ in rows]
        self.threshold, self.files = threshold, files
        #: Greatest idf of a word that occurs in a file; the least is 1.
        self.most = math.log((files + 1) / 2) + 1
        self.vocabulary = frozenset(w for _, row in rows for w in row)
        known = [*sorted(self.vocabulary), *sorted(frequency.keys() - self.vocabulary)]
        self.index = {w: i for i, w in enumerate(known)}
        self.idf = np.array([self.weight(frequency.get(w, 0)) for w in known])
        self.lengths = [sum(row.values()) for _, row in rows]
        self.weights = np.zeros((len(rows), len(self.vocabulary)))
        self.anchors = np.zeros(self.weights.shape, bool)
        for k, (_, row) in enumerate(rows):
            weight = {w: n * self.idf[self.index[w]] for w, n in row.items()}
            norm = math.sqrt(sum(x * x for x in weight.values()))
            left = 1.0
            for w, x in sorted(weight.items(), key=lambda wx: (-wx[1], wx[0])):
                self.weights[k, self.index[w]] = x / norm
                if left >= threshold**2 - 1e-9:
                    self.anchors[k, self.index[w]] = True
                    left -= (x / norm) ** 2

    def weight(self, n: int) -> float:
        """The idf of a word that n files have."""
        return math.log((self.files + 1) / (n + 1)) + 1

    def windows(self, text: bytes, whole: bool, more: dict[bytes, int] | None = None) -> "Windows | None":
        """The windows that may hold the best match; None if there is none. more: frequencies of words of this text."""
        low = text.lower()
        held = [self.index[w] for w in self.vocabulary.intersection(words(low))]
        near = np.flatnonzero((self.weights[:, held] ** 2).sum(1) >= self.threshold**2 - 1e-9) if held else []
        if not len(near):
            return None
        found = Windows(self, low, more or {})
        for k in near:
            found.slide(k)
        found.grow_lines(near)
        if whole:
            for k in near:
                found.add(k, np.zeros(1, np.int64), np.array([found.n]), *found.norms(0, np.array([found.n])))
        return found.pruned()

    def open_words(self, text: bytes, whole: bool) -> set[bytes]:
        """The words whose frequencies scan() needs and doesn't have."""
        found = self.windows(text, whole)
        return found.open_words() if found else set()

    def scan_all(self, text: bytes, whole: bool, more: dict[bytes, int] | None = None) -> list[tuple[str, float, int]]:
        """Each license found, its cosine, and the number of the line where it begins (0 for a whole file); the best first."""
        return self.judged(text, self.windows(text, whole, more))

    def judged(self, text: bytes, found: "Windows | None") -> list[tuple[str, float, int]]:
        """scan_all() of a text whose windows are there."""
        best: dict[str, tuple[str, float, int]] = {}
        for one in sorted([*self.tags(text), *(found.counted() if found else [])], key=lambda x: (-round(x[1], 9), x[0], x[2])):
            best.setdefault(one[0], one)
        return list(best.values())

    def scan(self, text: bytes, whole: bool) -> tuple[str, float, int] | None:
        """The best one."""
        return next(iter(self.scan_all(text, whole)), None)

    def tags(self, text: bytes) -> list[tuple[str, float, int]]:
        """The licenses that SPDX tags name, each with cosine 1."""
        low = text.lower()
        if b"spdx-license-identifier" not in low:
            return []
        ids, out = {name.lower().encode(): name for name in self.names}, []
        for m in TAG.finditer(low):
            line, before = low.count(b"\n", 0, m.start()), b""
            for x in re.finditer(rb"[a-z0-9.+-]+", m[1]):
                listed = ids.get(re.sub(rb"-only$|-or-later$|\+$", b"", x[0]))
                if listed:
                    out.append((listed, 1.0, line))
                elif before != b"with" and x[0] not in (b"and", b"or", b"with", b"none", b"noassertion") and TAG_END.match(low, m.end()):
                    out.append((text[m.start(1) + x.start() : m.start(1) + x.end()].decode(), 1.0, line))
                before = x[0]
        return out


class Windows:
    """Windows of a text's words, with bounds on their cosines to templates.

    The square of a window's norm is the sum, over its places, of the word's squared
    idf times 2 c - 1, if it is the word's c-th place in the window. Words without a
    frequency weigh between 1 and Matcher.most.
    """

    def __init__(self, matcher: Matcher, low: bytes, more: dict[bytes, int] | None = None) -> None:
        more = more or {}
        self.m = matcher
        lines = [words(x) for x in low.split(b"\n")]
        self.words = [w for row in lines for w in row]
        self.n = n = len(self.words)
        self.ends = np.cumsum([len(row) for row in lines])
        base, get = len(matcher.idf), matcher.index.get
        local: dict[bytes, int] = {}  # words of this text that the matcher doesn't know
        self.ids = ids = np.fromiter((get(w) if w in matcher.index else base + local.setdefault(w, len(local)) for w in self.words), np.int64, n)
        self.known = np.append(np.ones(base, bool), [w in more for w in local]).astype(bool)[ids]
        self.idf = np.append(matcher.idf, [matcher.weight(more[w]) if w in more else 0.0 for w in local])[ids]
        self.in_template = ids < len(matcher.vocabulary)
        order = np.argsort(ids, kind="stable")
        self.keys = ids[order] * (n + 1) + order
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        self.first = np.empty(base + len(local), np.int64)
        self.dots: dict[int, np.ndarray] = {}
        self.found: list[tuple[np.ndarray, ...]] = []

    def add(self, k: int, starts: np.ndarray, ends: np.ndarray, norm: np.ndarray, rest: np.ndarray) -> None:
        """Windows of template k, if they may reach the threshold."""
        if k not in self.dots:
            part = np.zeros(self.n)
            part[self.in_template] = self.m.weights[k, self.ids[self.in_template]] * self.idf[self.in_template]
            self.dots[k] = np.append(0, np.cumsum(part))
        dot = self.dots[k][ends] - self.dots[k][starts]
        with np.errstate(invalid="ignore", divide="ignore"):
            most = np.nan_to_num(dot / np.sqrt(norm + rest))
            least = np.nan_to_num(dot / np.sqrt(norm + rest * self.m.most**2))
        ok = most >= self.m.threshold - 1e-9
        self.found.append((least[ok], most[ok], np.full(ok.sum(), k), starts[ok], ends[ok]))

    def norms(self, start: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared norms of the windows from start to each end, of words with a frequency; and sums of the squared counts of the others."""
        span = slice(start, int(ends[-1]))
        ids = self.ids[span]
        self.first[ids[::-1]] = self.place[span][::-1]  # the first place of a word is written last
        odd = 2 * (self.place[span] - self.first[ids]) + 1
        at = ends - start
        return np.append(0, np.cumsum(self.idf[span] ** 2 * odd))[at], np.append(0, np.cumsum(np.where(self.known[span], 0, odd)))[at]

    def slide(self, k: int) -> None:
        """All windows of template k's length; a shorter text is one window."""
        n, width = self.n, min(self.m.lengths[k], self.n)
        starts = np.arange(n - width + 1)
        out, new = starts[:-1], starts[:-1] + width
        left = 2 * (np.searchsorted(self.keys, self.ids[out] * (n + 1) + new) - self.place[out]) - 1
        come = 2 * (self.place[new] - np.searchsorted(self.keys, self.ids[new] * (n + 1) + out + 1)) + 1
        norm, rest = self.norms(0, np.array([width]))
        norm = norm + np.append(0, np.cumsum(self.idf[new] ** 2 * come - self.idf[out] ** 2 * left))
        rest = rest + np.append(0, np.cumsum(np.where(self.known[new], 0, come) - np.where(self.known[out], 0, left)))
        self.add(k, starts, starts + width, norm, rest)

    def grow_lines(self, near: np.ndarray) -> None:
        """Windows of lines from each line that has an anchor."""
        line = np.searchsorted(self.ends, np.arange(self.n), side="right")
        hit = np.zeros((len(near), len(self.ends)), bool)
        for j, k in enumerate(near):
            held = np.flatnonzero(self.in_template)
            hit[j, line[held[self.m.anchors[k, self.ids[held]]]]] = True
        for a in np.flatnonzero(hit.any(0)):
            ks = near[hit[:, a]]
            start = int(self.ends[a - 1]) if a else 0
            reach = start + 2 * max(self.m.lengths[k] for k in ks) + 128
            ends = np.unique(self.ends[a : int(np.searchsorted(self.ends, reach, side="right")) + 1])
            norm, rest = self.norms(start, ends)
            for k in ks:
                self.add(k, np.full(len(ends), start), ends, norm, rest)

    def pruned(self) -> "Windows | None":
        """Leaves out windows that one over some of the same words beats whatever the other words weigh."""
        self.least, most, self.k, self.start, self.end = (np.concatenate(x) for x in zip(*self.found, strict=True))
        spans = list(zip(self.start.tolist(), self.end.tolist(), strict=True))
        at_least = np.zeros(self.n)  # the greatest lower bound of the windows over each word
        for i in np.argsort(self.least, kind="stable").tolist():
            at_least[spans[i][0] : spans[i][1]] = self.least[i]
        ok = np.array([most[i] >= at_least[a:b].max() - 1e-9 for i, (a, b) in enumerate(spans)], bool)
        self.least, self.k, self.start, self.end = self.least[ok], self.k[ok], self.start[ok], self.end[ok]
        return self if ok.any() else None

    def open_words(self) -> set[bytes]:
        cover = np.zeros(self.n + 1, np.int64)
        np.add.at(cover, self.start, 1)
        np.add.at(cover, self.end, -1)
        return {self.words[i] for i in np.flatnonzero((np.cumsum(cover)[:-1] > 0) & ~self.known)}

    def counted(self) -> list[tuple[str, float, int]]:
        """License, cosine and line of each window that reaches the threshold and that no better one overlaps."""
        line, out = np.searchsorted(self.ends, self.start, side="right"), []
        taken = np.zeros(self.n, bool)
        names = [self.m.names[k] for k in self.k]
        for i in sorted(range(len(names)), key=lambda i: (-round(self.least[i], 9), names[i], line[i])):
            span = slice(self.start[i], self.end[i])
            if self.least[i] >= self.m.threshold - 1e-12 and not taken[span].any():
                out.append((names[i], min(float(self.least[i]), 1.0), int(line[i])))
            taken[span] = True
        return out


def document_frequencies(files: DataFrame) -> DataFrame:
    """files (text) -> word, n: the number of files that have the word; the empty word stands for all files."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return batch

        for batch in slices(batches, "text"):
            for text in as_bytes(batch.column(0)):
                total.update({b"", *words(text)})
            if len(total) > COUNTED:
                yield out()
        yield out()

    return files.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


FOUND = "file_id long, path string, is_licence_file boolean, own_license string, score double, line int, licenses array<string>"


def scan_files(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files (file_id, path, text) -> file_id, path, is_licence_file, own_license, score, line, licenses: those of all windows that count, the best first (null if none)."""
    spark = files.sparkSession
    name = F.coalesce(F.rlike(F.substring_index("path", "/", -1), F.lit(LICENCE_FILE)), F.lit(False))
    rows = files.select("file_id", "path", name.alias("is_licence_file"), "text")
    counted = keep(document_frequencies(files))  # read twice
    vocabulary = sorted({b"", *(w for row in templates.values() for t in row for w in words(t.encode()))})
    known = {bytes(r["word"]): r["n"] for r in counted.join(F.broadcast(spark.createDataFrame([(w,) for w in vocabulary], "word binary")), "word").collect()}
    n_files = known.pop(b"", 0)
    matcher = Matcher(templates, known, n_files, threshold)
    names = ["file_id", "path", "is_licence_file", "own_license", "score", "line", "licenses"]

    def columns(found: list[list[tuple[str, float, int]]]) -> list[pa.Array]:
        own = [pa.array([f[0][k] if f else None for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int32()))]
        return [*own, pa.array([[x[0] for x in f] or None for f in found], pa.list_(pa.string()))]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found, needs = [], []
            for text, whole in zip(as_bytes(batch.column(3)), batch.column(2).to_pylist(), strict=True):
                windows = matcher.windows(text, whole)
                some = windows.open_words() if windows else set()
                found.append([] if some else matcher.judged(text, windows))
                needs.append(sorted(some) or None)
            text = batch.column(3).take(pa.array([i if x else None for i, x in enumerate(needs)], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns(found), text, pa.array(needs, pa.list_(pa.binary()))], [*names, "text", "words"])

    judged = keep(rows.mapInArrow(judge, f"{FOUND}, text string, words array<binary>"))  # read three times; texts of open files alone
    # files of one text and kind need the same words
    opened = judged.where("words is not null").withColumn("key", F.sha2(F.concat(F.encode("text", "UTF-8"), F.col("is_licence_file").cast("string").cast("binary")), 256))
    pairs = opened.select("key", "words").dropDuplicates(["key"]).select("key", F.explode("words").alias("word"))
    needed = materialise(pairs.join(counted, "word").groupBy(F.col("key").alias("of")).agg(F.collect_list(F.struct("word", "n")).alias("counts")), "counts", small=True)
    counted.unpersist()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            more = [{x["word"]: x["n"] for x in row or ()} for row in batch.column(4).to_pylist()]
            found = [matcher.scan_all(t, w, m) for t, w, m in zip(as_bytes(batch.column(3)), batch.column(2).to_pylist(), more, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns(found)], names)

    again = opened.join(needed, F.col("key") == F.col("of"), "left").select("file_id", "path", "is_licence_file", "text", "counts").mapInArrow(scan, FOUND)
    return judged.where("words is null").select(*names).unionAll(again)


def directory(path) -> F.Column:
    """The path without its last part; "" for files at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.when(path.isNotNull(), ""))


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds license (own, else of the nearest ancestor directory) and inherited_from (the licence file's path)."""
    scanned = scanned.withColumn("_dir", directory(F.col("path")))
    best = F.struct(-F.round("score", 9), "path", "own_license")
    owners = scanned.where("is_licence_file and own_license is not null").groupBy(F.col("_dir").alias("owner")).agg(F.min(best).alias("best"))
    dirs = scanned.where("_dir is not null").select("_dir").distinct()
    parts = F.split("_dir", "/")
    up = dirs.select("_dir", F.explode(F.transform(F.sequence(F.lit(0), F.when(F.col("_dir") == "", 0).otherwise(F.size(parts))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("owner")))).alias("at"))
    # every directory has the top ones as ancestors, so owners are joined in SALTS copies
    salted = owners.select("owner", "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    up = up.select("_dir", "at.depth", "at.owner", F.pmod(F.xxhash64("_dir"), F.lit(SALTS)).cast("int").alias("salt"))
    nearest = up.join(salted, ["owner", "salt"]).groupBy(F.col("_dir").alias("_d")).agg(F.max_by("best", "depth").alias("near"))
    return scanned.join(nearest, F.col("_dir") == F.col("_d"), "left").select(
        "file_id", "path", "is_licence_file", "own_license", "score", "line", "licenses",
        F.coalesce("own_license", "near.own_license").alias("license"), F.when(F.col("own_license").isNull(), F.col("near.path")).alias("inherited_from"),
    )


def license_scan(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    files = files.select(F.col(id_col).cast("long").alias("file_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    return inherit(keep(scan_files(files, templates, threshold)))  # read three times
