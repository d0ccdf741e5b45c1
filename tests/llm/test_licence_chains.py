from __future__ import annotations

import numpy as np

from watchlake.llm import licences
from watchlake.llm.tokens import ALNUM, words


def test_nearer_chain_of_less_cover_goes_on():
    """A copy cut short directly before a changed one."""
    mit = licences.template_words(licences.TEMPLATES[0][1])
    assert len(mit) == 67
    text = " ".join([*mit[:40], *mit[5:40], "zzz", *mit[41:67]]).encode()
    scanner = licences.Scanner(licences.TEMPLATES, licences.PHRASES)
    w = words(np.frombuffer(text, np.uint8), np.array([len(text)]), ALNUM)
    report = scanner.report(w, scanner.numbers(w.hashes), 0)
    assert report["score"] == 61 / 67
    assert report["labels"] == "mit"


NOTICES = {
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nd": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-sa": "It is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "agpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "gpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
}


def test_notices_have_their_own_label_only(spark):
    rows = [(label, text) for label, text in NOTICES.items()] + [("agpl-3,cc-by-sa", NOTICES["agpl-3"] + " Docs: " + NOTICES["cc-by-sa"])]
    found = licences.scan_licences(spark.createDataFrame(rows, "want string, text string"), keep=["want"])
    assert {r["want"]: r["licences"]["labels"] for r in found.collect()} == {label: label for label, _ in rows}


def test_every_template_gives_its_label():
    scanner = licences.Scanner(licences.TEMPLATES, licences.PHRASES)
    number = {w: i for i, w in enumerate(sorted({w for _, t in licences.TEMPLATES for w in licences.template_words(t)} | {w for p in licences.PHRASES for w in p.split()}))}
    for label, text in licences.TEMPLATES:
        numbers = np.array([number[w] for w in licences.template_words(text)])
        spans = scanner._best([s for s in scanner.scan(numbers)[1] if s[3] >= scanner.min_cover])
        assert {scanner.labels[s[0]] for s in spans} == {label}
