"""Licence notices inside longer lines, and windows against brute force."""

import random

import pytest

from waymark.llm import licenses, registry


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Copyright 2020 Acme Inc. All rights reserved.", "all-rights-reserved"), ("We hope it helps. Released under the MIT License.", "mit"),
        ("Licensed under the MIT License.", "mit"), ("Licensed under the Apache License 2.0", "apache-2.0"),
        ("This work is licensed under CC BY 4.0.", "cc-by-4.0"), (licenses.TEMPLATES["mit/notice"] + " " + "word " * 50000, "mit"),
        ("head " * 50000 + "\n" + licenses.TEMPLATES["gpl-3.0/header"].replace(" ", "\n") + " tail", "gpl-3.0"), ("all rights to this work under the license", None),
    ],
)
def test_inside_lines(text, want):
    found = licenses.Windows(licenses.VARIANTS, 80).best(text.encode())
    assert {k.split("/")[0] for _, _, k, _, _ in found} == ({want} if want else set())


def test_brute_force():
    rng = random.Random(3)
    templates = {"a": "x y z x q", "b": "x y z", "c": "q r s t u v w x y z r q"}
    match = licenses.Windows(templates, 80)
    sets = {k: licenses.bigrams(t.encode()) for k, t in templates.items()}
    hits = 0
    for _ in range(150):
        words = rng.choices("xyzqrstuvw", k=rng.randint(0, 25))
        if rng.random() < 0.5:
            words[5:5] = templates["c"].split()
        want = []
        for k, own in sets.items():
            for i in range(len(words)):
                for j in range(i + 1, min(len(words), i + 1 + len(own) * 120 // 80)):
                    b = licenses.bigrams(" ".join(words[i : j + 1]).encode())
                    edges = [f"{words[p]} {words[p + 1]}".encode() in own for p in (i, j - 1)]
                    if all(edges) and 200 * len(b & own) >= 80 * (len(b) + len(own)):
                        want.append((i, j, k, len(b & own), len(b) + len(own)))
        assert sorted(match.candidates(" ".join(words).encode())) == sorted(want)
        hits += len(want)
        spans = [x[:2] for x in match.best(" ".join(words).encode())]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and bool(spans) == bool(want)  # noqa: B905
    assert hits > 25


def test_query_rows(spark, tmp_path):
    rows = [(1, "x Released under the MIT License. y All rights reserved"), (2, None), (None, "Released under the MIT License")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in registry.QUERIES["op1_license_windows"](spark, str(tmp_path)).collect()}
    assert got[1].n_matches == 2 and got[1].licenses == "all-rights-reserved,mit" and got[2].n_matches == 0 and got[None].n_matches == 1
