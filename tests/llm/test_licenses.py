"""License scan against brute force."""

import re

from sieveworks.llm import license_scan as L

TEXTS = [
    None, "", "   ", "Licensed under the Apache License, Version 2.0.", "Released under the MIT\nLicense. mit license! MIT-License", "gnu general public", "GNU General  Public License gnu general public license",
    "cc by cc by", "CC BY-NC 4.0 was licensed under", "x " * 500 + "released under the mit license" + " y" * 500, "license mit apache by cc", "Ámit license", "mit licenseé", "İ MIT LICENSE",
    "permission is hereby granted free of charge to any person obtaining a copy of this program and associated docs files",
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, base, labels, score = [], set(), set(), 0.0
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
                score = 1.0
    finds = []
    for label, template, proofs in L.TEMPLATES:
        wanted = set(template.split())
        stride = min(x for x in L.STRIDES if x >= len(template.split()))
        for b in range(0, max(1, len(words)), stride):
            block = words[b : b + 2 * stride]
            share = len(wanted & set(block)) / len(wanted)
            if share >= 0.8 and (not proofs or any(block[i : i + len(p.split())] == p.split() for p in proofs for i in range(len(block)))):
                finds.append((label, template, proofs, b, b + 2 * stride, share))
    for label, template, proofs, a, b, share in finds:
        wanted, near = set(template.split()), [f for f in finds if a < f[4] and f[3] < b]
        if any(n.startswith(f"{label}-") or n == label and wanted < set(t.split()) for n, t, *_ in near):
            continue
        wider = [f for f in near if wanted < set(f[1].split()) and f[0] != label]
        if wider:
            # characters of a numbered text tell what lies in what
            def at(c, d, phrases):
                here = [f"{i}:{w}" for i, w in enumerate(words[c:d], c)]
                return [set(here[i : i + len(p.split())]) for p in phrases for i in range(len(here)) if words[c + i : min(d, c + i + len(p.split()))] == p.split()]

            covers = [x for _, t, pr, c, d, _ in wider for x in at(c, d, pr or (" ".join(t.split()[:6]),))]
            first = lambda x: min(int(w.split(":")[0]) for w in x)
            if proofs:
                gone = all(any(x <= y for y in covers) for x in at(a, b, proofs))
            else:
                opens = sorted(map(first, at(a, b, (" ".join(template.split()[:6]),))))
                gone = all(any(o <= first(y) < n for y in covers) for o, n in zip(opens, [*opens[1:], 10**9]))
            if gone:
                continue
        labels.add(label)
        score = max(score, share)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
LABELLED = [
    ("This work is licensed under CC BY 4.0.", "cc-by,cc-by-4.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    ("Licensed under CC BY-SA 4.0.", "cc-by,cc-by-sa-4.0"),
    ("Licensed under CC BY-NC-ND 4.0.", "cc-by,cc-by-nc-nd-4.0"),
    ("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
    ("Licensed under a Creative Commons Attribution 3.0 License", "cc-by-3.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3"),
    ("This work is licensed under the GNU General Public License, version 2.", "gpl,gpl-2"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "agpl-3"),
    ("This work is licensed under the GNU Lesser General Public License, version 2.", "lgpl-2"),
    (GPL.format(2), "gpl,gpl-2"), (GPL.format(3), "gpl,gpl-3"),
    (GPL.format(3).replace("General", "Affero General"), "agpl-3"),
    (GPL.format(3).replace("program", "library").replace("General", "Lesser General"), "lgpl-3"),
    ("Released under the GPL license", "gpl"), ("released under the terms of the BSD license", "bsd"), ("Released under the MIT License.", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
    (BSD, "bsd-2"), (BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "bsd-3"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "isc"),
    ("The text is licensed under CC BY 4.0, the images are licensed under CC BY-SA 4.0.", "cc-by,cc-by-4.0,cc-by-sa-4.0"),
    (BSD + " " + BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "bsd-2,bsd-3"),
    (BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + BSD, "bsd-2,bsd-3"),
    ("Licensed under the GNU General Public License, version 3, and parts are licensed under the GNU Affero General Public License, version 3.", "agpl-3,gpl,gpl-3"),
    ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3"), ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", "cc-by,cc-by-nc-sa-4.0"), ("// SPDX-License-Identifier: BSD-2-Clause", "bsd-2"), ("licensed under GPLv3", "gpl-3"), ("CC0 1.0", "cc0-1.0"), ("Eclipse Public License - v 2.0", "epl-2.0"), ("identifier of a license, spdx, gpl 2", ""),
    ("the license of this work under version 3 is public, released in general for the gnu", ""), ("released under the new driving license", ""), ("It was licensed under the name by 4 people, cc 0 of them", ""),
]


def test_labels_of_siblings_and_of_none(spark):
    pad = " ".join(f"w{i}" for i in range(37))
    docs = spark.createDataFrame([(i, f"{pad[: 9 * (i % 5)]} {t} {pad}") for i, (t, _) in enumerate(LABELLED)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in L.license_scan(docs).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(LABELLED)] == LABELLED


def test_scan_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 1)], "doc_id long, text string, labels string, n_words int")
    got = [tuple(r) for r in L.license_scan(docs).collect()]
    assert len(got) == len(TEXTS) + 1
    for doc_id, *rest in got:
        assert tuple(rest) == brute(TEXTS[doc_id]), TEXTS[doc_id]
    index = L.Templates(L.TEMPLATES, L.PHRASES, 0.8, {w: i for i, w in enumerate(sorted({w for t in [*(x for _, x, _ in L.TEMPLATES), *L.PHRASES] for w in t.split()}))})
    for text, _ in LABELLED:
        for n in (0, 5, 15, 250):
            assert index.scan("z " * n + text) == brute("z " * n + text)


def test_empty_table(spark):
    assert L.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
