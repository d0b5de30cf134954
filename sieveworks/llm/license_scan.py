"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are windows of words, overlapping by half, so that every run of words as long as a
template lies whole in one of them; short, middle and long templates have blocks of their
own. A template is found in a block that holds at least ``threshold`` of its distinct
words. Words are ordered by their frequency in the corpus, rare ones first; a block is
looked at only where one of the rarest words of a template, its prefix, stands, and the
block's size and the places of the common word in both orders must leave room for the
overlap that is needed.

Licenses of one family share nearly all their words. A template may therefore ask for one
of several phrases, its proofs, in the block. One whose label another's makes narrower
gives way to that one in overlapping blocks. One whose words all stand in another template
gives way where the other's proofs cover all of its own, or follow all its openings if it
has no proofs: not where both licenses stand side by side.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.batches import bounded

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}

# The phrases and labels of the contract.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_GPL_HEAD = "{0} is free software you can redistribute it and or modify it under the terms of the gnu {1} license as published by the free software foundation either version {2} of the license or at your option any later version"
_GPL_PLAIN = "{0} is free software you can redistribute it and or modify it under the terms of the gnu {1} license"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_CC_PARTS = {"nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}


def _templates() -> Iterator[tuple[str, str, tuple[str, ...]]]:
    families = (("gpl", "general public", "this program", "23"), ("lgpl", "lesser general public", "this library", "23"), ("agpl", "affero general public", "this program", "3"))
    for label, name, what, versions in families:
        yield label, _GPL_PLAIN.format(what, name), (f"gnu {name} license",)
        yield label, f"licensed under the gnu {name} license", (f"gnu {name} license",)
        yield label, f"released under the {label} license", (f"the {label} license", f"the gnu {label}")
        for version in versions:
            proofs = tuple(f"{x} {v}" for x in (f"gnu {name} license", f"{label} license", f"gnu {label}", label) for v in (f"version {version}", f"v{version}"))
            yield f"{label}-{version}", _GPL_HEAD.format(what, name, version), (f"gnu {name} license as published by the free software foundation either version {version}",)
            yield f"{label}-{version}", f"this work is licensed under the gnu {name} license version {version}", proofs
            yield f"{label}-{version}", f"licensed under the {label} version {version}", proofs
            yield f"{label}-{version}", f"licensed under the {label} v{version}", proofs
    yield "apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0", "apache license 2 0", "apache license v2 0")
    yield "apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2 0",)
    yield "mit", "released under the mit license", ("mit license",)
    yield "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ()
    yield "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ()
    yield "bsd", "released under the bsd license", ("bsd license", "bsd 2 clause", "bsd 3 clause")
    yield "bsd", "redistribution and use in source and binary forms with or without modification are permitted", ()
    yield "bsd-2", _BSD, ()
    yield "bsd-3", _BSD + " neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote",)
    yield "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ()
    yield "mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0", "mozilla public license version 2 0")
    yield "unlicense", "this is free and unencumbered software released into the public domain", ()
    for parts in ((), ("nc",), ("sa",), ("nd",), ("nc", "sa"), ("nc", "nd")):
        code, names = " ".join(("by", *parts)), " ".join(("attribution", *(_CC_PARTS[x] for x in parts)))
        for version in ("4", "3"):
            proofs = tuple(f"{x} {version} 0" for x in (f"cc {code}", f"commons {names}"))
            yield f"cc-{'-'.join(('by', *parts))}-{version}.0", f"licensed under cc {code} {version} 0", proofs
            yield f"cc-{'-'.join(('by', *parts))}-{version}.0", f"licensed under a creative commons {names} {version} 0 license", proofs


#: Identifiers of the software package data exchange: the words after ``SPDX-License-Identifier:`` and the label.
_IDENTIFIERS = {
    "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 0": "lgpl-2", "lgpl 2 1": "lgpl-2", "lgpl 3 0": "lgpl-3", "agpl 3 0": "agpl-3", "apache 2 0": "apache-2.0", "mit": "mit", "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "0bsd": "0bsd",
    "isc": "isc", "mpl 2 0": "mpl-2.0", "epl 1 0": "epl-1.0", "epl 2 0": "epl-2.0", "cc0 1 0": "cc0-1.0", "unlicense": "unlicense", "zlib": "zlib",
}


def _named() -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """Templates that are a name or an identifier alone, whole."""
    for words, label in _IDENTIFIERS.items():
        yield label, f"spdx license identifier {words}", (f"spdx license identifier {words}",)
    for parts in ((), ("nc",), ("sa",), ("nd",), ("nc", "sa"), ("nc", "nd")):
        for version in ("4", "3"):
            words = f"spdx license identifier cc {' '.join(('by', *parts))} {version} 0"
            yield f"cc-{'-'.join(('by', *parts))}-{version}.0", words, (words,)
    for label, versions in (("gpl", "23"), ("lgpl", "23"), ("agpl", "3")):
        for version in versions:
            for glued in (f"{label}v{version}", f"{label}{version}"):
                yield f"{label}-{version}", glued, (glued,)
    for label, names in {"cc0-1.0": ("cc0 1 0", "cc0", "creative commons zero"), "0bsd": ("zero clause bsd",), "epl-1.0": ("eclipse public license v 1 0", "eclipse public license version 1 0", "eclipse public license 1 0"), "epl-2.0": ("eclipse public license v 2 0", "eclipse public license version 2 0", "eclipse public license 2 0")}.items():
        for name in names:
            yield label, name, (name,)


#: Label, words, and proofs (one of which must stand in the block; none: the words do) of public licenses.
TEMPLATES = (*_templates(), *_named())
#: Words of the longest template of each size of block.
STRIDES = (16, 64, 256)


def block_words(text: str | None) -> list[str]:
    """The words of a text, A-Z lower-cased; a null has none."""
    return WORD.findall(text.translate(_LOWER)) if text else []


@dataclass(frozen=True)
class Entry:
    """A template or phrase: its label, distinct words in corpus order, how many of them a block needs, its proofs, the words of a phrase, and how it opens."""

    label: str
    words: list[str]
    need: int
    proofs: tuple[str, ...]
    phrase: tuple[str, ...]
    stride: int
    opening: tuple[str, ...]


def _places(words: list[str], phrases: tuple[str, ...], start: int) -> list[tuple[int, int]]:
    """First word and word after the last of every place of the phrases, numbered from ``start``."""
    out = []
    for phrase in map(str.split, phrases):
        out += [(start + i, start + i + len(phrase)) for i, w in enumerate(words) if w == phrase[0] and words[i : i + len(phrase)] == phrase]
    return out


class Templates:
    """Templates as word sets in corpus order, with an index of their prefixes."""

    def __init__(self, templates: Sequence[tuple[str, str, tuple[str, ...]]], phrases: Mapping[str, str], threshold: float, order: Mapping[str, int]) -> None:
        self.order = order
        self.entries: list[Entry] = []
        self.prefixes: dict[int, dict[str, list[tuple[int, int]]]] = {}
        for label, text, proofs, phrase in [*((*t, ()) for t in templates), *((x, p, (), tuple(p.split())) for p, x in phrases.items())]:
            length = len(text.split())
            stride = next(s for s in (*STRIDES, length) if s >= length)
            words = sorted(set(text.split()), key=order.__getitem__)
            # a phrase must be there whole
            need = len(words) if phrase else -int(-(threshold * len(words)) // 1)
            for place, word in enumerate(words[: len(words) - need + 1]):
                self.prefixes.setdefault(stride, {}).setdefault(word, []).append((len(self.entries), place))
            self.entries.append(Entry(label, words, need, proofs, phrase, stride, (" ".join(text.split()[:6]),)))
        self.anchors = frozenset(w for p in self.prefixes.values() for w in p)
        sets = [frozenset(e.words) for e in self.entries]
        #: The templates that make each one's label narrower, or say more under the same label; and those of other labels that hold all its words.
        self.narrower = [{j for j, e in enumerate(self.entries) if not e.phrase and (e.label.startswith(f"{own.label}-") or a < sets[j] and e.label == own.label)} for a, own in zip(sets, self.entries)]
        self.wider = [{j for j, e in enumerate(self.entries) if not e.phrase and a < sets[j]} - n for a, n in zip(sets, self.narrower)]

    def found(self, words: list[str]) -> Iterator[tuple[int, int, int, float]]:
        """(first word of the block, word after it, entry, containment) for every entry that a block holds; blocks start at the multiples of the entry's stride and have twice as many words."""
        at = [(i, word) for i, word in enumerate(words) if word in self.anchors]
        for stride, prefixes in self.prefixes.items() if at else ():
            anchors: dict[int, set[str]] = {}
            for i, word in at:
                if word in prefixes:
                    b = i // stride
                    anchors.setdefault(b, set()).add(word)
                    if b:
                        anchors.setdefault(b - 1, set()).add(word)
            for b in sorted(anchors):
                block = words[b * stride : (b + 2) * stride]
                own, joined = set(block), ""
                # words outside all templates come after the ones inside and can't be common to both
                ranks = sorted(self.order[w] for w in own if w in self.order)
                tried: set[int] = set()
                for word in sorted(anchors[b], key=self.order.__getitem__):
                    place_here = bisect.bisect_left(ranks, self.order[word])
                    for number, place in prefixes[word]:
                        entry = self.entries[number]
                        if number in tried or len(ranks) < entry.need:
                            continue
                        tried.add(number)
                        # earlier words of the template aren't in the block, or it would have been tried with them
                        if 1 + min(len(entry.words) - place - 1, len(ranks) - place_here - 1) < entry.need:
                            continue
                        common = sum(w in own for w in entry.words)
                        if common < entry.need:
                            continue
                        joined = joined or f" {' '.join(block)} "
                        if not entry.proofs or any(f" {p} " in joined for p in entry.proofs):
                            yield b * stride, (b + 2) * stride, number, common / len(entry.words)

    def gives_way(self, words: list[str], find: tuple[int, int, int, float], finds: list[tuple[int, int, int, float]]) -> bool:
        """Whether another find tells more of what a find stands for."""
        start, end, number, _ = find
        near = [(a, b, n) for a, b, n, _ in finds if a < end and start < b]
        if any(n in self.narrower[number] for *_, n in near):
            return True
        wider = [(a, b, n) for a, b, n in near if n in self.wider[number]]
        if not wider:
            return False
        entry = self.entries[number]
        covers = sorted({place for a, b, n in wider for place in _places(words[a:b], self.entries[n].proofs or self.entries[n].opening, a)})
        if entry.proofs:
            return all(any(a <= p and q <= b for a, b in covers) for p, q in _places(words[start:end], entry.proofs, start))
        own = sorted(p for p, _ in _places(words[start:end], entry.opening, start))
        # each opening is followed by the other's proof before the next opening
        return all(any(p <= a < after for a, _ in covers) for p, after in zip(own, [*own[1:], len(words)]))

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a text."""
        words = block_words(text)
        places: list[int] = []
        base, labels, score = set(), set(), 0.0
        finds: list[tuple[int, int, int, float]] = []
        for start, end, number, containment in self.found(words):
            entry = self.entries[number]
            if not entry.phrase:
                finds.append((start, end, number, containment))
                continue
            for i in range(start, min(start + entry.stride, len(words))):
                if words[i] == entry.phrase[0] and tuple(words[i : i + len(entry.phrase)]) == entry.phrase:
                    places.append(i)
                    base.add(entry.label)
                    score = 1.0
        for find in finds:
            if not self.gives_way(words, find, finds):
                labels.add(self.entries[find[2]].label)
                score = max(score, find[3])
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def word_order(docs: DataFrame, words: set[str]) -> dict[str, int]:
    """The rank of each of ``words``, the rarest in all texts first; ties by the word itself.

    Partitions count their own texts; only one number for each of these words reaches the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                total.update(filter(words.__contains__, block_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counts = bounded(docs).select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    known = {r["word"]: r["n"] for r in counts}
    return {w: i for i, w in enumerate(sorted(words, key=lambda w: (known.get(w, 0), w)))}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, str, tuple[str, ...]]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of ``phrases`` in the words of the text, whose first and last
    starts follow (null: none). labels adds the labels of the ``templates`` (label, words,
    proofs) of which a block of the text holds at least ``threshold`` of the distinct words
    and one of the proofs, unless one with a narrower label is found in an overlapping
    block, or one with all those words and more whose proofs cover this one's. score is the largest such share, 1 for a phrase and 0 without any
    find.

    Null and empty texts have no words. Rows are scanned one by one: repeated rows and ids
    give repeated results, other columns aren't read, an empty table gives an empty one.
    Templates are a fixed list, which goes to the tasks whole.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary = {w for t in [*(text for _, text, _ in templates), *phrases] for w in t.split()}
    index = Templates(templates, phrases, threshold, word_order(docs, vocabulary))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            columns = zip(*map(index.scan, batch["text"].to_pylist())) if batch.num_rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, map(list, columns), kinds)], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded(docs).mapInArrow(scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
