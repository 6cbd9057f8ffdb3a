"""License scans with a generalised suffix automaton of license texts.

The automaton holds every run of words of every template. A file's words stream through it
once and give matching statistics: at each word the longest run of template words that ends
there. Maximal runs of `min_match` words or more are chained along a template, in order and
with small gaps on both sides, into spans; a span that covers enough of its template gives
the template's label. Short phrases are templates that must stand whole: they are read off
the states that the stream passes, at every place.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from signalweir.llm.common import as_bytes, words_of

#: Phrases that must stand whole: fixed values.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices of common licenses, as their stewards ask to print them.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-2": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
}


class Automaton:
    """Generalised suffix automaton over word numbers, with the places of each state's runs."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.numbers: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.labels = [*templates]
        texts = [self._ids(t) for t in templates.values()]
        self.sizes = [len(t) for t in texts]
        for ids in [*texts, *(whole := [self._ids(p) for p in phrases])]:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        states = range(len(self.next))
        self.places: list[set[tuple[int, int]]] = [set() for _ in states]
        for number, ids in enumerate(texts):
            at = 0
            for end, c in enumerate(ids):
                at = self.next[at][c]
                self.places[at].add((number, end))
        self.ends: list[list[tuple[str, int]]] = [[] for _ in states]  # phrases that end where a state's runs end
        for (phrase, label), ids in zip(phrases.items(), whole):
            at = 0
            for c in ids:
                at = self.next[at][c]
            self.ends[at].append((label, len(ids)))
        order = sorted(states, key=self.length.__getitem__)
        for v in reversed(order[1:]):
            self.places[self.link[v]] |= self.places[v]
        for v in order[1:]:
            self.ends[v] = self.ends[v] + self.ends[self.link[v]]
        self.shortest = min(map(len, whole), default=1 << 30)

    def _ids(self, text: str) -> list[int]:
        return [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text.encode())]

    def _state(self, length: int, link: int, to: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(to)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of q that stands for its runs up to one word longer than p's."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest run that ends at each word."""
        v = n = 0
        for c in ids:
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if c in self.next[v]:
                v, n = self.next[v][c], n + 1
            yield v, n

    def scan(self, words: list[bytes], min_match: int, max_gap: int) -> dict:
        """Phrase places and the chains of the templates."""
        ids = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words))
        # only runs of known words can hold a match
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ids != 0, [0]))))
        phrases, matches = [], []
        least = min(self.shortest, min_match)
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end - start < least:
                continue
            run = list(self.statistics(ids[start:end].tolist()))
            for i, (v, n) in enumerate(run):
                phrases += [(start + i - size + 1, label) for label, size in self.ends[v] if size <= n]
                if n >= min_match and self.places[v] and (i + 1 == len(run) or run[i + 1][1] <= n):
                    matches.append((start + i - n + 1, start + i, v))
        return {"phrases": phrases, "spans": self._chains(matches, max_gap)}

    def _chains(self, matches: list[tuple[int, int, int]], max_gap: int) -> list[tuple[int, int, str, float, bool]]:
        """(first word, last word, label, share of the template covered, names its place) of each place's best chains."""
        best: list[tuple[int, int, int, int, int, int]] = []  # template, first, last, template end, covered, number
        done = []
        for first, last, v in matches:
            alive = [c for c in best if first - c[2] - 1 <= max_gap]
            done += [c for c in best if first - c[2] - 1 > max_gap]
            fresh = []
            for number, end in self.places[v]:
                size = last - first + 1
                chain = (number, first, last, end, size)
                for c in alive:
                    if c[0] == number and c[3] < end and c[2] < last:
                        more = min(size, end - c[3], last - c[2])
                        if 0 <= end - size - c[3] <= max_gap or more < size:
                            chain = max(chain, (number, c[1], last, end, c[4] + more), key=lambda x: x[4])
                fresh.append(chain)
            best = alive + fresh
        # of chains that stand over one another the one that covers most words names the place; of equal ones that
        # which has more of its template, so a license is not taken for a longer one that begins alike
        ranked = sorted(done + best, key=lambda c: (c[1], c[2], c[0]))
        worth = [(c[4], c[4] / self.sizes[c[0]]) for c in ranked]
        beaten = [False] * len(ranked)
        for i, one in enumerate(ranked):
            for j in range(i + 1, len(ranked)):
                if ranked[j][1] > one[2]:
                    break
                beaten[i] |= worth[j] > worth[i]
                beaten[j] |= worth[i] > worth[j]
        found: dict[int, list] = {}
        for lost, (number, first, last, _, covered) in zip(beaten, ranked):
            found.setdefault(number, []).append((not lost, covered, first, last))
        out = []
        for n, chains in sorted(found.items()):
            # every copy of the template counts; where it won no place, its best chain stands for the score
            won, free = [c for c in chains if c[0]], -1
            for wins, covered, first, last in won or [max(chains, key=lambda c: (c[1], -c[2]))]:
                if first > free:
                    out.append((first, last, self.labels[n], covered / self.sizes[n], wins))
                    free = last
        return out


def scan_licenses(
    text: Column, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, min_match: int = 4,
    max_gap: int = 8, min_cover: float = 0.6,
) -> Column:
    """struct(n_words, phrases array(start, label), spans array(first, last, label, cover)) of a text column.

    Spans below `min_cover` are returned too, for the score; their label does not count.
    Null and empty texts have no words, phrases or spans.
    """
    automaton = Automaton(phrases, templates)
    kind = pa.struct([
        ("n_words", pa.int64()),
        ("phrases", pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))),
        ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("cover", pa.float64()), ("counts", pa.bool_())]))),
    ])

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = []
            for data in as_bytes(batch):
                words = words_of(data)
                found = automaton.scan(words, min_match, max_gap)
                rows.append({
                    "n_words": len(words),
                    "phrases": [{"start": s, "label": x} for s, x in found["phrases"]],
                    "spans": [{"first": f, "last": e, "label": x, "cover": c, "counts": wins and c >= min_cover} for f, e, x, c, wins in found["spans"]],
                })
            yield pa.array(rows, kind)

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(
        run,
        "struct<n_words:long,phrases:array<struct<start:long,label:string>>,"
        "spans:array<struct<first:long,last:long,label:string,cover:double,counts:boolean>>>",
    ).asNondeterministic()(text)


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per input row: id, n_words, phrases, spans, base_labels, labels (arrays, sorted), score.

    score is 1 where a phrase stands, else the largest share of a template that one chain
    covers. Repeated rows are each scanned; an empty table gives an empty result.
    """
    found = docs.select(F.col(id_col).alias("id"), scan_licenses(F.col(text_col), **limits).alias("f")).select("id", "f.*")
    base = F.transform("phrases", lambda p: p["label"])
    own = F.transform(F.filter("spans", lambda s: s["counts"]), lambda s: s["label"])
    return found.select(
        "*", F.array_sort(F.array_distinct(base)).alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(base, own))).alias("labels"),
        F.when(F.size("phrases") > 0, F.lit(1.0))
        .otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0))).alias("score"),
    )
