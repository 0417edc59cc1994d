"""Licence scans: TF-IDF cosine to templates, then inheritance along paths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import textbytes as tb
from lettermill.llm.joins import with_facts
from lettermill.session import durable

THRESHOLD = 0.7
FLUSH_TERMS = 1_000_000
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.\-_][a-z0-9.\-_]*)?$"

# Notices of public licences, titles of the long ones and the short ones whole, by SPDX identifier
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MIT", """MIT License. Copyright (c)

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-3-Clause", """BSD 3-Clause License. Copyright (c)

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """ISC License. Copyright (c)

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
]


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the terms (letters and digits, A-Z lower-cased), their starts
    and ends, and the texts' n+1 positions among them."""
    starts, ends, first = tb.word_spans(data, off, tb.NO_TERM)
    return tb.word_hashes(data, starts, ends, lower=True), starts, ends, first


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.unique(terms(raw, np.array([0, len(raw)]))[0], return_counts=True)


UPPER_NEXT = np.ones(256, bool)  # what a new sentence may begin with
UPPER_NEXT[[*range(48, 58), *range(97, 123)]] = False


def units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each term the number of its line or sentence of one, of its sentence
    (which may run over lines), of its paragraph, and of its text.

    A sentence ends at a stop before white space, unless a digit or a small
    letter goes on, and at a colon before a new line; a paragraph at a line
    without a term, such as one of comment marks alone.
    """
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if not len(starts):
        return [text] * 4
    stop = np.isin(data, np.frombuffer(b".!?", np.uint8))
    stop[:-1] &= tb.SPACE[data[1:]]
    a, b = ends[:-1], starts[1:]

    def between(mark: np.ndarray) -> np.ndarray:
        n = np.r_[0, np.cumsum(mark)]
        return n[b] - n[a]

    lines, end = between(data == 10), (between(stop) > 0) & UPPER_NEXT[data[b]]
    other = text[1:] != text[:-1]
    cuts = (lines > 0) | end, (lines > 1) | end | ((lines > 0) & (between(data == 58) > 0)), lines > 1
    return [*(np.cumsum(np.r_[False, cut | other]) for cut in cuts), text]


@dataclass(frozen=True)
class Templates:
    """TF-IDF vectors of the templates over their own vocabulary.

    ``rare`` are the terms without which no cosine reaches ``threshold``: what
    a text shares with a template but for them is too little of the template's
    length.
    """

    names: list[str]
    vocabulary: np.ndarray  # sorted hashes
    idf: np.ndarray
    weight: np.ndarray  # of each term in each template
    norm: np.ndarray
    rare: np.ndarray
    threshold: float

    @classmethod
    def of(cls, templates: list[tuple[str, str]], idf: dict[int, float], threshold: float) -> Templates:
        counted = [_counted(t) for _, t in templates]
        vocabulary = np.unique(np.concatenate([w for w, _ in counted]))
        weights = np.array([idf[int(x)] for x in vocabulary.view(np.int64)])
        tf = np.zeros((len(vocabulary), len(counted)))
        for k, (w, n) in enumerate(counted):
            tf[np.searchsorted(vocabulary, w), k] = n
        weight = tf * weights[:, None]
        norm = np.sqrt((weight**2).sum(0))
        order = np.argsort(weights, kind="stable")
        share = np.cumsum(weight[order] ** 2, axis=0) / norm**2
        common = order[(share < threshold**2 - 1e-9).all(1)]
        rare = np.ones(len(vocabulary), bool)
        rare[common] = False
        return cls([n for n, _ in templates], vocabulary, weights, weight, norm, rare, threshold)

    def candidates(self, w: np.ndarray, unit: np.ndarray) -> Iterator[tuple[int, float, list, np.ndarray, np.ndarray]]:
        """Units whose cosine may reach the threshold, if every term outside
        the vocabulary weighs as little as can be: number, squared length
        inside the vocabulary, (template, product) pairs, and the other terms
        with their counts."""
        at = np.minimum(np.searchsorted(self.vocabulary, w), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == w
        wanted = np.zeros(int(unit[-1]) + 1 if len(unit) else 0, bool)
        wanted[unit[known & self.rare[at]]] = True
        mine = np.flatnonzero(wanted[unit]) if len(unit) else unit
        if not len(mine):
            return
        order = mine[np.lexsort((w[mine], unit[mine]))]
        u, x = unit[order], w[order]
        begin = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (x[1:] != x[:-1])])
        tf = np.diff(np.r_[begin, len(u)])
        u, x, at, known = u[begin], x[begin], at[order[begin]], known[order[begin]]
        edge = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        for a, b in zip(edge.tolist(), np.r_[edge[1:], len(u)].tolist(), strict=True):
            inside, place = known[a:b], at[a:b][known[a:b]]
            vector = tf[a:b][inside] * self.idf[place]
            length, outside = float((vector**2).sum()), tf[a:b][~inside]
            dot = vector @ self.weight[place]
            near = np.flatnonzero(dot >= (self.threshold - 1e-9) * self.norm * np.sqrt(length + float((outside**2).sum())))
            if len(near):
                yield int(u[a]), length, [(int(t), float(dot[t])) for t in near], x[a:b][~inside], outside


def document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """``(term, n)``: in how many rows a term stands, partly summed; the number
    of all rows is that of term 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n, rows = 0, 0

        def flush() -> pa.RecordBatch:
            w, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(w)
            w, c = w[order], c[order]
            begin = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else order
            c = np.add.reduceat(c, begin) if len(w) else c
            return pa.RecordBatch.from_arrays([pa.array(np.r_[w[begin], np.uint64(0)].view(np.int64)), pa.array(np.r_[c, rows])], ["term", "n"])

        for _, data, off in tb.chunks(batches, text):
            w, _, _, first = terms(data, off)
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            # a term's rows stand together, so that each counts once
            order = np.argsort(w, kind="stable")
            w, doc = w[order], doc[order]
            once = w[np.r_[True, (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])]] if len(w) else w
            held.append(np.unique(once, return_counts=True))
            n, rows = n + len(held[-1][0]), rows + len(off) - 1
            if n >= FLUSH_TERMS:
                yield flush()
                held, n, rows = [], 0, 0
        if rows:
            yield flush()

    return durable(tb.map_arrow(docs.select(text), run, "term long, n long"), "terms")


CANDIDATE = "key string, no int, whole boolean, inside double, hits array<struct<t:int,dot:double>>, outside array<struct<term:long,tf:long>>"


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``own_license``, ``own_score`` and ``whole_text``.

    Every line, every sentence (which may run over lines, whatever comment
    marks begin them), every paragraph and every whole text is compared with
    the templates by the cosine of their TF-IDF vectors: counts of the terms
    times ln((1 + documents) / (1 + documents with the term)) + 1, over all
    documents and for all terms. The closest counts, if its cosine reaches
    ``threshold`` (null and 0 otherwise); of equally close templates the first.
    ``whole_text``: the text as a whole is close to a template, as a licence
    file's is.

    One pass counts the terms; a second lists the units that may be close, and
    only for the terms of these are the frequencies joined. Null and empty
    texts have no licence; repeated rows have equal results; very long texts
    are read whole; columns of the results' names are replaced, others kept
    whatever their names; an empty table gives an empty result.
    """
    templates = templates or TEMPLATES
    docs = docs.drop("own_license", "own_score", "whole_text")
    counted = document_frequencies(docs, text)
    vocabulary = np.unique(np.concatenate([_counted(t)[0] for _, t in templates])).view(np.int64).tolist()
    found = {r["term"]: r["n"] for r in counted.where(F.col("term").isin([0, *vocabulary])).groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a template term
    n_docs = found.get(0, 0)
    model = Templates.of(templates, {x: float(np.log((1 + n_docs) / (1 + found.get(x, 0))) + 1) for x in vocabulary}, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in tb.chunks(batches, "body"):
            w, starts, ends, first = terms(data, off)
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            rows = []
            kinds = units(data, starts, ends, first)
            for kind, unit in enumerate(kinds):
                owner = np.zeros(int(unit[-1]) + 1 if len(unit) else 0, np.int64)
                owner[unit] = doc
                for u, inside, hits, x, tf in model.candidates(w, unit):
                    rows.append((int(owner[u]), kind == 3, inside, hits, list(zip(x.view(np.int64).tolist(), tf.tolist(), strict=True))))
            key = part.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            columns = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.bool_()), (2, pa.float64()), (3, HITS), (4, OUTSIDE))]
            yield pa.RecordBatch.from_arrays([key, pa.array(np.arange(len(rows)), pa.int32()), *columns], ["key", "no", "whole", "inside", "hits", "outside"])

    body = docs.select(F.md5(docs[text]).alias("key"), docs[text].alias("body"))
    listed = durable(tb.map_arrow(body, run, CANDIDATE), "notices")
    # copies have equal notices, of which one will do
    alike = F.xxhash64("key", "whole", "inside", "hits", "outside")
    notices = listed.withColumn("no", alike).groupBy("key", "no").agg(F.first(F.struct("whole", "inside", "hits", "outside")).alias("x"), F.count("*").alias("n")).select("key", "no", "n", "x.*")
    notices = durable(notices, "notices")
    other = notices.select("no", "key", F.explode("outside").alias("o")).select("no", "key", "o.*")
    wanted = other.groupBy("term").agg(F.count("*").alias("uses"))
    df = counted.join(wanted, "term").groupBy("term", "uses").agg(F.sum("n").alias("df"))
    weighed = with_facts(other, df, "term", "uses", other.count(), "no")
    idf = F.log((1 + n_docs) / (1 + F.col("df"))) + 1
    outside = weighed.groupBy("key", "no").agg(F.sum(F.pow(F.col("tf") * idf, 2)).alias("out2"))
    scored = notices.join(outside, ["key", "no"], "left").select("key", "n", "whole", (F.col("inside") + F.coalesce("out2", F.lit(0.0))).alias("len2"), F.explode("hits").alias("h"))
    norms = F.array(*[F.lit(float(x)) for x in model.norm])
    scored = scored.withColumn("score", F.col("h.dot") / (F.get(norms, F.col("h.t")) * F.sqrt("len2"))).where(F.col("score") >= threshold)
    best = scored.groupBy("key").agg(F.max(F.struct("score", (-F.col("h.t")).alias("t"))).alias("b"), F.max("whole").alias("whole"), F.max("n").alias("rows"))
    names = F.array(*map(F.lit, model.names))
    best = best.select("key", "rows", F.get(names, -F.col("b.t")).alias("own_license"), F.least(F.col("b.score"), F.lit(1.0)).alias("own_score"), F.col("whole").alias("whole_text"))
    aside = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)], F.md5(docs[text]).alias("key"), F.monotonically_increasing_id().alias("at"))
    out = with_facts(aside, durable(best, "licences"), "key", "rows", n_docs, "at")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)], "own_license", F.coalesce("own_score", F.lit(0.0)).alias("own_score"), F.coalesce("whole_text", F.lit(False)).alias("whole_text"))


HITS = pa.list_(pa.struct([("t", pa.int32()), ("dot", pa.float64())]))
OUTSIDE = pa.list_(pa.struct([("term", pa.int64()), ("tf", pa.int64())]))


def directory(path: Column) -> Column:
    """The directory of a path, without a slash at its end ("" at the top)."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(scanned: DataFrame, path: str = "path", ident: str = "doc_id") -> DataFrame:
    """``scanned`` with ``license`` and ``inherited_from``, a directory.

    A licence file (by its name, or because its whole text is one) speaks for
    its directory and all below it, unless one nearer does; of several in a
    directory the best match does, then the smallest path, id and name. A
    file's own notice goes before all. The scan's narrow columns are written
    once. Ancestors are listed for each distinct directory, not for each file;
    both joins are on the directory, and a directory with very many files is
    spread. A null path inherits nothing; repeated rows have equal results;
    columns of the results' names are replaced; an empty table gives an empty
    result.
    """
    scanned = scanned.drop("license", "inherited_from")
    cols = scanned.columns
    aside = [scanned[c].alias(f"c{k}") for k, c in enumerate(cols)]
    rows = scanned.select(*aside, directory(scanned[path]).alias("dir"), scanned[path].alias("path"), scanned[ident].alias("ident"), scanned["own_license"].alias("own"), scanned["own_score"].alias("score"), scanned["whole_text"].alias("whole"))
    rows = durable(rows, "scanned")
    named = F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)
    files = rows.where(F.col("own").isNotNull() & (F.col("whole") | F.coalesce(named, F.lit(False))) & F.col("dir").isNotNull())
    rank = F.struct((-F.round("score", 9)).alias("s"), F.col("path").alias("p"), F.col("ident").alias("i"), F.col("own").alias("l"))
    given = files.groupBy(F.col("dir").alias("from")).agg(F.min(rank)["l"].alias("given"))
    dirs = rows.where("dir is not null").groupBy("dir").agg(F.count("*").alias("files"))
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    ancestors = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("from")))).alias("a")).select("dir", "a.*")
    nearest = ancestors.join(given, "from").groupBy("dir").agg(F.max(F.struct("depth", "from", "given")).alias("n"))
    nearest = nearest.join(dirs, "dir").select("dir", "files", F.col("n.from").alias("from"), F.col("n.given").alias("given"))
    out = with_facts(rows.withColumn("at", F.monotonically_increasing_id()), durable(nearest, "directories"), "dir", "files", rows.count(), "at")
    own = F.col("own")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(cols)], F.coalesce(own, F.col("given")).alias("license"), F.when(own.isNull(), F.col("from")).alias("inherited_from"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents carry no paths, so their source and id stand for one: a tree
    of a source, thousands and hundreds, in which every fifth file is called a
    licence file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    step = lambda n: F.expr(f"cast(doc_id div {n} as string)")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    name = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("LICENSE."), ident)).otherwise(F.concat(ident, F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), step(1000), step(100), name)
    scanned = scan(docs.select("doc_id", path.alias("path"), "text")).drop("text")
    return inherit(scanned).select("doc_id", "path", "own_license", "own_score", "whole_text", "license", "inherited_from")
