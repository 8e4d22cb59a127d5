import math
import re

from pyspark.sql import functions as F

from archivist.llm import licenses


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(text, threshold=0.8):
    """Labels and best share of all windows of the text, template by template."""
    words, labels, best = _words(text), set(), 0.0
    for label, template in licenses.TEMPLATES:
        own = _words(template)
        wanted, span = set(own), math.ceil(len(own) / threshold - 1e-9)
        for k in range(len(words)):
            block = set(words[k : k + span])
            share = len(wanted & block) / len(wanted)
            if share >= threshold - 1e-9 and (wanted & licenses.NAMING) <= block:
                labels.add(label)
                best = max(best, share)
    return labels, best


def test_templates_against_brute_force(spark, data):
    sentences = [t for _, t in licenses.TEMPLATES]
    far = "word " * 200
    rows = [(10**6 + k, f"x y {a}\n\n{b[: len(b) // 2]}") for k, (a, b) in enumerate(zip(sentences, sentences[1:] + sentences[:1], strict=True))]
    rows += [(2 * 10**6 + k, "\n".join(w + (" " * 130 if k % 2 else " of the of the") for w in t.split())) for k, t in enumerate(sentences)]
    rows += [(3 * 10**6 + k, f" {far}".join(reversed(t.split()))) for k, t in enumerate(sentences)]
    rows += [(4 * 10**6 + k, " ".join(w for n, w in enumerate(t.split()) if n % 6 != k % 6)) for k, t in enumerate(sentences)]
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for k, text in docs.collect():
        labels, best = _brute(text)
        r = found[k]
        assert set(filter(None, r.labels.split(","))) == labels | set(filter(None, r.base_labels.split(","))), text[:300]
        assert r.score == (1.0 if r.n_base else best)
    assert all(found[3 * 10**6 + k].labels == "" for k in range(len(sentences)))
    assert all(licenses.TEMPLATES[k][0] in found[10**6 + k].labels for k in range(len(sentences)))


def test_clashing_names_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "MIT License", "x")] * 2 + [(None, None, "y")], "doc_id long, text string, row string").withColumns({c: F.lit(0) for c in ("blocks", "token", "score")})
    found = sorted(licenses.scan(docs).collect(), key=str)
    assert [(r.doc_id, r.labels, r.score) for r in found] == [(1, "mit", 1.0)] * 2 + [(None, "", 0.0)]


HEADERS = {
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl,lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    "agpl,gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
    "boost": "Distributed under the Boost Software License, Version 1.0.",
    "apache": "Licensed under the Apache License, Version 2.0 (the License)",
}
OTHERS = [
    "Licensed under the Educational Community License, Version 2.0",
    "Distributed under the Artistic Software License, Version 1.0",
    "This program and the accompanying materials are made available under the terms of the Common Public License v1.0",
    "This Source Code Form is subject to the terms of the Netscape Public License, v. 1.1.",
    "Licensed under XY BY-NC 4.0",
]


def test_licenses_that_look_alike(spark):
    """Each header has its own labels only (and the base label of the phrase that it holds); other
    licenses' headers have none."""
    rows = [(k, text) for k, text in enumerate([*HEADERS.values(), *OTHERS])]
    found = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[k] for k in range(len(rows))] == [*HEADERS, *([""] * len(OTHERS))]
