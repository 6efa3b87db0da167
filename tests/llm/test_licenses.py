"""License scans against plain search with a full edit-distance table."""

import random
import re

import pytest

from gridloom.llm import licenses

SENTENCES = ["Released under the MIT License.", "licensed under the APACHE license, version 2.0", "CC BY-NC cc by nc cc-by-nc!", "This program is free software: you can redistribute it and/or modify"]


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def best_errors(pattern, words):
    """Least edit distance of pattern to a run of whole words."""
    best = len(pattern)
    for i in range(len(words)):
        row = list(range(len(pattern) + 1))
        run = ""
        for w in words[i : i + 30]:
            piece = (" " if run else "") + w
            run += piece
            for c in piece:
                new = [row[0] + 1]
                for k, p in enumerate(pattern):
                    new.append(min(row[k] + (p != c), row[k + 1] + 1, new[k] + 1))
                row = new
            best = min(best, row[-1])
            if len(run) > len(pattern) + 10:
                break
    return best


def broken(rng, text, n):
    chars = list(text)
    for _ in range(n):
        i = rng.randrange(1, len(chars) - 1)
        kind = rng.randrange(3)
        if kind == 0:
            chars[i] = rng.choice("abcxyz")
        elif kind == 1:
            chars.insert(i, rng.choice("abcxyz"))
        else:
            del chars[i]
    return "".join(chars)


def cases():
    rng = random.Random(4)
    out = ["", None, "under the mit license", "x under the mit license under the mit license", *SENTENCES, "É under the MIT licence É"]
    for words, _ in licenses.NOTICES:
        for n in (0, 1, 3, 5, 9):
            out.append("lorem ipsum " + broken(rng, words, n) + ". dolor sit")
    return out


def test_scan_finds_all(spark):
    rows = list(enumerate(cases()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.key: r for r in licenses.label_documents(df).collect()}
    for i, t in rows:
        words, r = plain_words(t), got[i]
        places = [(j, lab) for p, lab in licenses.PHRASES.items() for j in range(len(words)) if words[j : j + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({p[1] for p in places}))
        fuzzy = {}
        for p, lab in licenses.NOTICES:
            e = best_errors(p, words)
            if e <= len(p) // licenses.CHARS_PER_ERROR:
                fuzzy[lab] = max(fuzzy.get(lab, 0), 1 - e / len(p))
        assert r.labels == ",".join(sorted({p[1] for p in places} | set(fuzzy))), (t, r, fuzzy)
        assert r.score == pytest.approx(1.0 if places else max(fuzzy.values(), default=0.0))


def test_spans(spark):
    text = "É Ünder. Released  under the MIT-Licence, ok; CC BY-NC 4.0"
    rows = licenses.find_notices(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    assert {(r.label, r.base, text[r.begin : r.end]) for r in rows} == {("mit", False, "Released  under the MIT-Licence"), ("cc-by-nc", True, "CC BY-NC")}
    assert licenses.find_notices(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_and_repeated(spark):
    text = "word " * 60_000 + "under the mit license " * 3
    rows = licenses.label_documents(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word) for r in rows] == [(60_012, 3, 60_000, 60_008)] * 2


def test_bare_phrases_with_errors(spark):
    rows = [(1, "available under the mit licence"), (2, "distributed under the mit lisence"), (3, "provided under the apache licence version 2 0"), (4, "some rights: CC BY-ND 4.0"), (5, "CC BY-NC 4.0")]
    got = {r.key: r for r in licenses.label_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(1, 6)] == ["mit", "mit", "apache-2", "", "cc-by-nc"]
    assert [got[i].base_labels for i in range(1, 6)] == ["", "", "", "", "cc-by-nc"]
    assert got[1].score == pytest.approx(1 - 1 / 21) and got[4].score == 0


def test_repeated_notices_keep_their_spans(spark):
    bad, good, worse = "released under the mit licence", "released under the mit license", "relesed under the mit licence"
    texts = [f"{bad} {good}", f"{bad} {good} {worse}", " ".join([worse, bad] * 40), f"{good} x {good}"]
    rows = licenses.find_notices(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = [sorted((r.begin, r.errors) for r in rows if r.key == i and not r.base and r.n_words == 5) for i in range(4)]
    step = len(worse) + 1 + len(bad) + 1
    assert got[0] == [(0, 1), (31, 0)] and got[1] == [(0, 1), (31, 0), (62, 2)]
    assert got[2] == sorted([(i * step, 2) for i in range(40)] + [(i * step + len(worse) + 1, 1) for i in range(40)])
    assert got[3] == [(0, 0), (33, 0)]
