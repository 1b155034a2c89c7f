"""License scan against a plain reading of the texts."""
import math
import re
import textwrap

from pricewise.llm import licenses as L

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated " \
      "documentation files (the \"Software\"), to deal in the Software without restriction."


def brute(text):
    low = (text or "").translate(str.maketrans(L.UPPER, L.LOWER))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = re.findall(word, low)
    places = [(i, label) for p, label in L.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    found = []
    for label, threshold, t in L.TEMPLATES:
        n, t = len(t.split()), set(t.split())
        for at in range(0, len(w), n):
            have = set(w[at:at + 2 * n])
            if len(have & t) >= math.ceil(round(threshold * len(t), 9)):
                found.append((label, len(have & t) / len(t)))
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})),
            ",".join(sorted({x for _, x in places} | {x for x, _ in found})),
            1.0 if places else max((c for _, c in found), default=0.0))


TEXTS = [None, "", " \n ", MIT, MIT.upper() + "\nunder the MIT License", "Licensed under CC BY-NC 4.0.", "cc by cc by cc\nby",
         "GNU General Public License, version 3: licensed under the GNU general public license", "mit licenses", "ñ MIT\x00License é",
         MIT.replace("hereby", "").replace("charge", "fee"), "permission granted", MIT.replace(" ", "\n"),
         "word " * 30000 + "apache license " + MIT, "Redistribution and use in source and binary forms, with or without modification, "
         "are permitted provided that the following conditions are met"]
WRAPPED = ["\n * ".join(textwrap.wrap("x " * k + t, 40)) for _, _, t in L.TEMPLATES for k in (0, 7, 50)]
SCATTERED = [" ".join(w + " filler" * 9 for w in t.split()) for _, threshold, t in L.TEMPLATES]


def test_scan_matches_brute_force(spark, frame):
    rows = [(i, t) for i, t in enumerate(TEXTS + WRAPPED + SCATTERED)] + [(None, MIT), (3, MIT)]
    docs = frame(rows).withColumnRenamed("lang", "n_words")  # a clashing column
    got = sorted((tuple(r) for r in L.digest(L.scan(docs)).collect()), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    blocks = {r["doc_id"]: r["matches"] for r in L.scan(docs).collect() if r["doc_id"] is not None}
    assert [(m["block"], m["label"]) for m in blocks[3]] == [(0, "mit")]
    assert [m["label"] for m in blocks[12]] == ["mit"]  # a word a line


def test_wrapped_notices_are_found_and_scattered_words_are_not(spark, frame):
    labels = [label for label, _, _ in L.TEMPLATES]
    got = {r["doc_id"]: r["labels"].split(",") for r in L.digest(L.scan(frame(WRAPPED))).collect()}
    assert all(label in got[3 * i + k] for i, label in enumerate(labels) for k in range(3))
    assert {r["labels"] for r in L.digest(L.scan(frame(SCATTERED))).collect()} == {""}


def test_empty_table(spark, frame):
    assert L.digest(L.scan(frame([]).limit(0))).collect() == []
