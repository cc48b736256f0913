"""License scans with a generalised suffix automaton over template tokens.

One automaton holds all substrings of all license templates. A file's tokens
are streamed through it once; at every token the automaton gives the matching
statistic: the length of the longest token run ending there that stands in
some template, and the state that names the run. Runs that cannot be extended
to the right and are long enough become matches (file span, template span);
matches of a template that keep their order in file and template are chained,
and the chain with the most covered template tokens gives the template's
coverage in the file. Every place with a chain over the threshold that meets
no better covered one is a notice; the notices give spans and labels.

Tokens outside the templates' vocabulary reset the automaton, so only runs of
vocabulary tokens are streamed; that is exact and skips ordinary prose.

Defined cases: null text is empty; a file without tokens has no places, empty
labels and score 0; overlapping places of a phrase all count; texts are
scanned whole; rows repeat as they do in the input.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

# The base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Public license notices, by label.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "gpl-3": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "gpl-2": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
}

#: Shortest chained match in tokens, the template share that labels a file,
#: and the file tokens a chain may skip between two matches.
MIN_MATCH = 3
MIN_COVERAGE = 0.8
MAX_GAP = 20

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")


def tokens_of(text: bytes) -> list[bytes]:
    """Words of the text after lower-casing A-Z."""
    return TOKEN.findall(text.lower())


@dataclass
class Automaton:
    """Generalised suffix automaton over integer tokens."""

    next: list[dict] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set] = field(default_factory=lambda: [set()])  # (template, end position)

    def _state(self, length: int, source: int | None = None) -> int:
        self.next.append({} if source is None else dict(self.next[source]))
        self.link.append(-1 if source is None else self.link[source])
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, tok: int) -> int:
        """State of the run that reaches q from p, split off q if q is longer."""
        if self.length[q] == self.length[p] + 1:
            return q
        c = self._state(self.length[p] + 1, q)
        self.link[q] = c
        while p != -1 and self.next[p].get(tok) == q:
            self.next[p][tok] = c
            p = self.link[p]
        return c

    def extend(self, last: int, tok: int) -> int:
        if tok in self.next[last]:
            return self._split(last, self.next[last][tok], tok)
        cur = self._state(self.length[last] + 1)
        p = last
        while p != -1 and tok not in self.next[p]:
            self.next[p][tok] = cur
            p = self.link[p]
        self.link[cur] = 0 if p == -1 else self._split(p, self.next[p][tok], tok)
        return cur

    def add(self, name: int, toks: list[int]) -> None:
        last = 0
        for i, t in enumerate(toks):
            last = self.extend(last, t)
            self.ends[last].add((name, i + 1))

    def close(self) -> None:
        """Pass the end positions of longer runs down the suffix links."""
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def statistics(self, toks: list[int]) -> list[tuple[int, int]]:
        """(longest match ending here, its state) for every token."""
        out, s, n = [], 0, 0
        nxt, link, length = self.next, self.link, self.length
        for t in toks:
            while s and t not in nxt[s]:
                s = link[s]
                n = length[s]
            if t in nxt[s]:
                s = nxt[s][t]
                n += 1
            else:
                s, n = 0, 0
            out.append((n, s))
        return out


@dataclass
class Scanner:
    vocab: dict[bytes, int]
    automaton: Automaton
    sizes: list[int]                # tokens of each template
    labels: list[str]               # label of each template
    phrases: list[tuple[int, str]]  # base: (tokens, label); template number = position

    @classmethod
    def build(cls, phrases: dict[str, str], templates: dict[str, list[str]]) -> "Scanner":
        texts = [(p, lab, True) for p, lab in phrases.items()] + \
                [(t, lab, False) for lab, ts in templates.items() for t in ts]
        vocab: dict[bytes, int] = {}
        auto, sizes, labels, base = Automaton(), [], [], []
        for name, (text, label, is_phrase) in enumerate(texts):
            toks = [vocab.setdefault(w, len(vocab)) for w in tokens_of(text.encode())]
            auto.add(name, toks)
            sizes.append(len(toks))
            labels.append(label)
            if is_phrase:
                base.append((len(toks), label))
        auto.close()
        return cls(vocab, auto, sizes, labels, base)

    def runs(self, toks: list[bytes]) -> list[tuple[int, list[int]]]:
        """(start, token numbers) of the runs of vocabulary tokens that can hold a match."""
        ids = np.fromiter(map(self.vocab.get, toks, (-1 for _ in toks)), dtype=np.int32, count=len(toks))
        known = np.concatenate(([False], ids >= 0, [False]))
        edge = np.flatnonzero(known[1:] != known[:-1])
        shortest = min([MIN_MATCH, *(n for n, _ in self.phrases)])
        return [(int(a), ids[a:b].tolist()) for a, b in zip(edge[::2], edge[1::2]) if b - a >= shortest]

    def standing(self, n: int, state: int, least: int) -> dict[tuple[int, int], int]:
        """(template, end place) -> length of the longest run that ends both here
        and there, for all places of all templates: the state has those of its
        whole run, its suffix links those of shorter ones."""
        out: dict[tuple[int, int], int] = {}
        while state > 0 and n >= least:
            for place in self.automaton.ends[state]:
                out.setdefault(place, n)
            state = self.automaton.link[state]
            n = self.automaton.length[state] if state > 0 else 0
        return out

    def scan(self, toks: list[bytes], min_match: int = MIN_MATCH, max_gap: int = MAX_GAP):
        """(base places, matches, chains): places as (start, label), matches
        as (template, file start, template start, tokens), chains by template."""
        places, matches = [], []
        n_base = len(self.phrases)
        least = min([min_match, *(k for k, _ in self.phrases)])
        for start, ids in self.runs(toks):
            here: dict[tuple[int, int], int] = {}
            for i, (n, s) in enumerate([*self.automaton.statistics(ids), (0, 0)]):
                after = self.standing(n, s, least)
                for (name, end), k in here.items():
                    # here ends at token i - 1; what goes on to token i is not a maximal match
                    if name >= n_base and k >= min_match and (name, end + 1) not in after:
                        matches.append((name, start + i - k, end - k, k))
                for (name, end), k in after.items():
                    if name < n_base and end == self.sizes[name] == k:
                        places.append((start + i + 1 - end, self.phrases[name][1]))
                here = after
        return sorted(places), matches, self.chain(matches, max_gap)

    def chains_to(self, name: int, ms: list, max_gap: int, repeats: bool = True) -> list[tuple[int, int, int]]:
        """Best chain of one template up to each of its matches: (covered
        tokens, file start, file end), of equals the one that starts last.
        Without ``repeats`` no match follows if more than half of it stands for
        template tokens that the chain has covered at an earlier place."""
        ms = sorted(ms, key=lambda m: (m[1], m[2]))
        total, first = [], []
        low = 0
        for j, (_, a, t, n) in enumerate(ms):
            score, start = n, a
            # matches that end too far back cannot be followed by later ones either
            while low < j and ms[low][1] + ms[low][3] + max_gap + self.sizes[name] < a:
                low += 1
            for i in range(low, j):
                _, a0, t0, n0 = ms[i]
                twice = max(0, a0 + n0 - a)
                lap = max(twice, t0 + n0 - t)  # overlap counts once
                if a0 < a and t0 < t and lap < n and a - (a0 + n0) <= max_gap and (repeats or 2 * (lap - twice) <= n):
                    score, start = max((score, start), (total[i] + n - lap, first[i]))
            total.append(score)
            first.append(start)
        return [(c, f, m[1] + m[3]) for c, f, m in zip(total, first, ms)]

    def chain(self, matches, max_gap: int) -> dict[int, tuple[int, int, int]]:
        """Best chain of each template: (covered tokens, file start, file end)."""
        by_name: dict[int, list] = {}
        for m in matches:
            by_name.setdefault(m[0], []).append(m)
        return {name: max(self.chains_to(name, ms, max_gap), key=lambda c: c[0]) for name, ms in by_name.items()}

    def notices(self, matches, n_toks: int, min_coverage: float, min_match: int = MIN_MATCH,
                max_gap: int = MAX_GAP) -> list[tuple[str, int, int, float]]:
        """All places of the templates: (label, file start, file end, coverage).

        Of chains over ``min_coverage`` that meet, the better covered one
        stays (notices that differ in a version number only would label each
        other), of equally covered ones that with more tokens (a notice with
        one more word covers its shorter sibling over the gap); equals of
        different templates all stay. What the places that
        stay leave free is chained again, until no chain is left. Chains that
        may take a repeated notice for one come last."""
        out = []
        gone = np.zeros(n_toks, dtype=bool)
        for repeats in (False, True):
            while found := self._best_apart(self._free(matches, gone, min_match), n_toks, min_coverage, max_gap, repeats):
                for _, _, a, e, _ in found:
                    gone[a:e] = True
                out += [(self.labels[name], a, e, s) for s, name, a, e, _ in found]
        return sorted(out)

    @staticmethod
    def _free(matches, gone: np.ndarray, min_match: int) -> dict[tuple[int, int], list]:
        """Parts of the matches outside the tokens that are gone, by template
        and stretch between such tokens."""
        before = np.cumsum(gone)
        out: dict[tuple[int, int], list] = {}
        for name, a, t, n in matches:
            open_ = np.concatenate(([False], ~gone[a:a + n], [False]))
            edge = np.flatnonzero(open_[1:] != open_[:-1]).tolist()
            for i, j in zip(edge[::2], edge[1::2]):
                if j - i >= min_match:
                    out.setdefault((name, int(before[a + i])), []).append((name, a + i, t + i, j - i))
        return out

    def _best_apart(self, groups, n_toks: int, min_coverage: float, max_gap: int, repeats: bool):
        """Chains (coverage, template, file start, file end, covered tokens)
        that meet no better one. A chain that meets a better one holds its
        tokens for the next round, where it is a shorter chain."""
        hits = []
        for (name, _), ms in groups.items():
            size = self.sizes[name]
            if sum(m[3] for m in ms) >= min_coverage * size:
                hits += [(min(1.0, c / size), name, a, e, c) for c, a, e in self.chains_to(name, ms, max_gap, repeats)
                         if c / size >= min_coverage]
        taken = np.zeros(n_toks, dtype=bool)
        own: dict[int, np.ndarray] = {}
        out = []
        hits.sort(key=lambda h: (-h[0], -h[4], h[3] - h[2], h[2], h[1]))
        for _, equals in groupby(hits, key=lambda h: (h[0], h[4])):
            equals = list(equals)
            for h in equals:
                _, name, a, e, _ = h
                mine = own.setdefault(name, np.zeros(n_toks, dtype=bool))
                if not taken[a:e].any() and not mine[a:e].any():
                    out.append(h)
                mine[a:e] = True
            for _, _, a, e, _ in equals:
                taken[a:e] = True
        return out


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None,
                  min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per input row: n_words, n_base, first_word, last_word,
    base_labels, labels, score (largest template coverage, 0 to 1) and spans
    (label, first word, end word, coverage) of the notices that label it, one
    for each place.

    Row-local: no shuffle; the automaton is built from the fixed templates and
    shipped with the task.
    """
    common.prepare(df.sparkSession)
    scanner = Scanner.build(BASE_PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(b: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for text in common.text_bytes(b.column(1)):
            toks = tokens_of(text)
            places, matches, chains = scanner.scan(toks)
            score = max([0.0, *(min(1.0, c / scanner.sizes[k]) for k, (c, _, _) in chains.items())])
            hits = scanner.notices(matches, len(toks), min_coverage) if score >= min_coverage else []
            base = {lab for _, lab in places}
            out["n_words"].append(len(toks))
            out["n_base"].append(len(places))
            out["first_word"].append(places[0][0] if places else None)
            out["last_word"].append(places[-1][0] if places else None)
            out["base_labels"].append(",".join(sorted(base)))
            out["labels"].append(",".join(sorted(base | {h[0] for h in hits})))
            out["score"].append(score)
            out["spans"].append([{"label": lab, "first_word": a, "end_word": e, "coverage": s} for lab, a, e, s in hits])
        return {"doc_id": b.column(0)} | out

    kind = dict(src.dtypes)["doc_id"]
    return common.per_batch(
        src, run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, spans array<struct<label: string, first_word: long, end_word: long, coverage: double>>")
