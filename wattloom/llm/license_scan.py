"""Licence scans: notices found by their rarest words, aligned by position and verified by key phrases."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that are no part of a word become spaces, A-Z lower case.
_FOLD = bytes(32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b + 32 if 65 <= b < 91 else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


@dataclass(frozen=True)
class Template:
    """A notice of a licence. need: share of its weight that must stand at one place; slack: how many words further a
    word may stand; keys: phrases that must stand whole inside. A base phrase is found only whole."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    need: float = 0.75
    slack: int = 3
    base: bool = False


def _phrase(label: str, text: str) -> Template:
    return Template(label, text, (), 1.0, 0, True)


#: Base phrases and the labels they give.
BASE = (_phrase("mit", "under the mit license"), _phrase("apache-2", "apache license version 2"), _phrase("cc-by-nc", "cc by nc"))

#: Usual notices of public licences and the phrases that they must hold.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("mit", "Released under the terms of the MIT License", ("mit license",)),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", ("apache license version 2",)),
    Template("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("gnu general public license", "version 2")),
    Template("gpl-2", "Licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu general public license", "version 3")),
    Template("gpl-3", "Licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("lgpl", "Licensed under the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("agpl-3", "Licensed under the GNU Affero General Public License, version 3", ("gnu affero general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd", "Licensed under the BSD 3-Clause License", ("bsd 3 clause",)),
    Template("bsd", "Licensed under the BSD 2-Clause License", ("bsd 2 clause",)),
    Template("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and", "with or without fee is hereby granted")),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work", ("waived all copyright and related",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


@dataclass(frozen=True)
class Scan:
    """What a text holds: words, places of base phrases (starts), their labels, all labels, and the best share."""

    n_words: int
    starts: tuple[int, ...] = ()
    base_labels: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    score: float = 0.0


class RareIndex:
    """Postings (template, position) of the rarest words of each template.

    A word weighs by how few of the texts of the corpus have it. The rarest words of a template that outweigh what it
    may lack are its anchors: a place where enough of it stands has one of them. A base phrase may lack nothing, so its
    rarest word is its only anchor, and none of its places is missed.
    """

    def __init__(self, templates: Sequence[Template], texts: int, having: dict[bytes, int]) -> None:
        self.templates = tuple(templates)
        split = [words(t.text) for t in templates]
        keys = [[words(k) for k in t.keys] for t in templates]
        self.code = {w: i for i, w in enumerate(sorted({w for t in split for w in t} | {w for t in keys for k in t for w in k}))}
        self.weight = np.array([np.log1p((texts + 1) / (having.get(w, 0) + 0.5)) for w in self.code])
        self.sought = [np.array([self.code[w] for w in t]) for t in split]
        self.keys = [[np.array([self.code[w] for w in k]) for k in t] for t in keys]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, (template, codes) in enumerate(zip(templates, self.sought, strict=True)):
            w = self.weight[codes]
            order = np.argsort(-w, kind="stable")
            for p in order[: 1 + int(np.searchsorted(np.cumsum(w[order]), (1 - template.need) * w.sum() + 1e-9))]:
                self.postings.setdefault(int(codes[p]), []).append((t, int(p)))
        self.anchor = np.zeros(len(self.code) + 1, bool)  # the last is that of words in no template
        self.anchor[list(self.postings)] = True
        self.margin = max(map(len, self.sought)) + max(t.slack for t in templates)

    def _starts(self, codes: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Where the words of a phrase stand one after the other, from places of its rarest word."""
        rare = int(self.weight[key].argmax())
        at = np.flatnonzero(codes == key[rare]) - rare
        at = at[(at >= 0) & (at + len(key) <= len(codes))]
        return at[(codes[at[:, None] + np.arange(len(key))] == key).all(axis=1)]

    def _shares(self, padded: np.ndarray, t: int, offsets: np.ndarray) -> np.ndarray:
        """The share of a template's weight that stands at each offset."""
        codes, slack = self.sought[t], self.templates[t].slack
        at = np.arange(len(codes)) + self.margin
        w, out = self.weight[codes], []
        for lo in range(0, len(offsets), 4096):
            place = offsets[lo : lo + 4096, None] + at
            out.append(np.any([padded[place + d] == codes for d in range(-slack, slack + 1)], axis=0) @ w / w.sum())
        return np.concatenate(out)

    def scan(self, text: str | None) -> Scan:
        w = words(text)
        codes = np.fromiter(map(self.code.get, w, repeat(-1)), np.int32, len(w))
        hits = np.flatnonzero(self.anchor[codes])
        if not len(hits):
            return Scan(len(w))
        # the text's rarest licence words first
        offsets: dict[int, list[np.ndarray]] = {}
        for c in sorted(set(codes[hits].tolist()), key=lambda c: -self.weight[c]):
            here = hits[codes[hits] == c]
            for t, p in self.postings[c]:
                offsets.setdefault(t, []).append(here - p)
        padded = np.pad(codes, self.margin, constant_values=-1)
        starts, base, labels, best = [], set(), set(), 0.0
        for t, parts in offsets.items():
            template = self.templates[t]
            at = np.unique(np.concatenate(parts))
            at = at[(at > -len(self.sought[t])) & (at < len(w))]
            if not len(at):
                continue
            share = self._shares(padded, t, at)
            best = max(best, float(share.max()))
            at = at[share >= template.need - 1e-9]
            for key in self.keys[t]:
                found = self._starts(codes, key)
                first = np.searchsorted(found, at - template.slack)
                last = np.searchsorted(found, at + len(self.sought[t]) + template.slack - len(key), side="right")
                at = at[last > first]
            if len(at):
                labels.add(template.label)
                if template.base:
                    base.add(template.label)
                    starts.extend(at.tolist())
        return Scan(len(w), tuple(sorted(starts)), tuple(sorted(base)), tuple(sorted(labels)), min(1.0, best))


def document_counts(df: DataFrame, text_col: str, sought: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """(texts, how many have each of the sought words), over all texts."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = dict.fromkeys([b"", *sought], 0)
        for f in frames:
            n[b""] += len(f)
            for t in f["text"]:
                for w in sought.intersection(words(t)):
                    n[w] += 1
        yield pd.DataFrame({"word": list(n), "n": list(n.values())})

    n = {bytes(r.word): r.n for r in df.select(F.col(text_col).alias("text")).mapInPandas(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return n.pop(b"", 0), n


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: Sequence[Template] = BASE, notices: Sequence[Template] = NOTICES) -> DataFrame:
    """One row for each row of df: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words of licences weigh by their inverse document frequency over all texts. Each text looks up its rarest licence
    words in the index of the templates' rarest words; each posting gives a place where the template could stand, and the
    weight of the template's words that stand there, up to slack words from where they should, is summed. A notice gives
    its label where at least the share need of its weight and all its key phrases stand. A base phrase must stand
    whole: n_base counts its places, first_word and last_word are the smallest and largest of them (from 0, else null).
    Labels are sorted and joined by commas, "" without any. score is the largest share of a template at one place.

    Null and empty texts have no words, no labels and score 0. Null ids stay, and rows that repeat an id are scanned one
    by one; a notice that stands often in a long text is counted at every place. An empty table gives an empty result.
    Other columns are not read.
    """
    templates = (*base, *notices)
    sought = frozenset(w for t in templates for p in (t.text, *t.keys) for w in words(p))
    texts, having = document_counts(df, text_col, sought)
    index = RareIndex(templates, texts, having)

    def scanned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [index.scan(t) for t in f["text"]]
            yield pd.DataFrame(
                {
                    "id": f["id"], "n_words": [s.n_words for s in out], "n_base": [len(s.starts) for s in out],
                    "first_word": pd.array([s.starts[0] if s.starts else None for s in out], "Int64"), "last_word": pd.array([s.starts[-1] if s.starts else None for s in out], "Int64"),
                    "base_labels": [",".join(s.base_labels) for s in out], "labels": [",".join(s.labels) for s in out], "score": [s.score for s in out],
                }
            )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(scanned, "id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return out.select(F.col("id").cast(kind).alias(id_col), *out.columns[1:])


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
