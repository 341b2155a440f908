"""Personal data, toxicity, licenses, decontamination, mixing: against plain Python and on odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import decontamination, licenses, mixing, pii, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, kind string, size long"
ODD = [(1, None), (2, ""), (None, "x y"), (None, None), (3, "same text here"), (3, "same text here"), (4, "word " * 30_000), (5, "a" * 200_000), (6, "é𝔘 \n\t\x0b nul x")]


def odd(spark, none=False):
    """Nulls, empty and very long texts, repeated rows, and columns with names that operators use themselves."""
    df = spark.createDataFrame([(d, t, None, None if (d or 0) % 2 else "s", None, "k", 7) for d, t in ODD], DOC)
    return df.limit(0) if none else df


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_against_regular_expressions(spark):
    rng = random.Random(4)
    bits = ["a@b.co", "x.y+z@q-1.org", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-0100", "+44 20 7946 0958", "+1", "é", "𝔘", "..", "a@b", "a@b.c_d@e.f.g", "0", "12", " ", "-", "\n", "378282246310005", "007.08.9.1", "@b.c", "_", "%"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    found = {r.doc_id: r for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        spans = base_spans(text)
        assert found[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), text
        assert (found[i].n_email, found[i].n_ip, found[i].n_card, found[i].n_phone) == tuple(sum(k == kind for k, _, _ in spans) for kind in pii.BASE)


def test_pii_many_matches_in_one_text(spark):
    text = "a@b.co 1.2.3.4 " * 1500
    row = pii.pii_digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text)).encode()).hexdigest()


def test_pii_added_kinds_and_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 now", "DE88370400440532013000", "my ssn is 123-45-6789", "part 123-45-6789", "call +1 415 555 0100"]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[(s.kind, s.start, s.end) for s in r.spans] for r in rows] == [[("iban", 5, 32)], [], [("ssn", 10, 21)], [], [("phone", 5, 20)]]
    assert rows[4].spans[0].score == pytest.approx(0.85)
    red = pii.redact(spark.createDataFrame([(1, "mail a@b.co or 1.2.3.4!")], "doc_id long, text string")).first()
    assert red.redacted == "mail [EMAIL] or [IP]!"


def test_pii_stays_native(spark):
    plan = pii.pii_digest(odd(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_odd_rows(spark):
    df = odd(spark)
    assert pii.pii_digest(df).count() == len(ODD)
    assert mixing.mix_digest(df).count() == len(ODD)
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 1), (3, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    scored = toxicity.toxicity_digest(df, labels).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    items = spark.createDataFrame([(1, None), (2, ""), (None, "same text here"), (3, "same text here"), (3, "same text here")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.decontamination_digest(df, items).collect()} == {(3, None), (3, 3)}
    assert decontamination.decontaminate(df, items).count() == len(ODD) - 2
    assert licenses.license_digest(df).count() == 0


def test_empty_tables(spark):
    df = odd(spark, none=True)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for found in (pii.pii_digest(df), mixing.mix_digest(df), mixing.mix(df), toxicity.toxicity_digest(df, labels), decontamination.decontamination_digest(df, items), licenses.license_digest(df)):
        assert found.count() == 0
    assert decontamination.decontaminate(odd(spark), items).count() == len(ODD)


# ---------------------------------------------------------------- toxicity


def test_marginals_against_plain_forward_backward():
    rng = np.random.default_rng(0)
    emit, first = rng.normal(0, 2, 700), np.zeros(700, bool)
    first[[0, 1, 5, 300, 650]] = True
    model = toxicity.Model({}, 0, (0.3, -0.7, 1.1), -0.4)
    step = np.array([[1, np.exp(0.3)], [np.exp(-0.7), np.exp(1.1)]])
    expected = []
    cuts = [*np.flatnonzero(first).tolist(), 700]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        psi = np.exp(emit[lo:hi])
        fore = [np.array([1, np.exp(-0.4) * psi[0]])]
        for p in psi[1:]:
            v = fore[-1] @ step * np.array([1, p])
            fore.append(v / v.sum())
        back = [np.ones(2)]
        for p in psi[:0:-1]:
            v = step @ (np.array([1, p]) * back[-1])
            back.append(v / v.sum())
        expected += [np.log(z[1] / z[0]) for z in (a * b for a, b in zip(fore, back[::-1], strict=True))]
    assert np.allclose(toxicity.marginals(emit, first, model), expected)


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    bad = ["grobuk", "grobulan", "snarfle"]
    rows, labels = [], []
    for i in range(700):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = int(rng.random() < 0.3)
        for _ in range(toxic * 3):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ".", "!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 0, toxic))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = toxicity.toxicity_digest(docs, marks).collect()
    held = [r for r in scored if r.held_out]
    assert len(held) > 80 and sum(r.predicted == labels[r.doc_id][2] for r in held) >= 0.97 * len(held)
    model = toxicity.fit(docs, marks)
    text = "abc def grobulan xyz"
    assert [(a, b) for a, b, _ in toxicity.toxic_spans(text, toxicity.Emissions(model))] == [(8, 16)]
    kept = toxicity.filter_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in scored)


def plain_score(text, model):
    """One document's score by loops over tokens: messages in each direction, marginals, the curve."""
    emissions = toxicity.Emissions(model)
    emit = [emissions[w] for w in (text or "").split()]
    most, some = -12.0, 0.0
    if emit:
        t01, t10, t11 = np.exp(model.trans)
        fore = [np.exp(model.start) * np.exp(emit[0])]
        for e in emit[1:]:
            fore.append(np.exp(e) * (t01 + t11 * fore[-1]) / (1 + t10 * fore[-1]))
        back = [1.0]
        for e in emit[:0:-1]:
            x = np.exp(e) * back[-1]
            back.append((t10 + t11 * x) / (1 + t01 * x))
        odds = np.log(fore) + np.log(back[::-1])
        most, some = float(np.clip(odds.max(), -12, 12)), float(np.log1p((1 / (1 + np.exp(-np.clip(odds, -30, 30)))).sum()))
    c0, c1, c2 = model.curve
    return 1 / (1 + np.exp(-np.clip(c0 + c1 * most + c2 * some, -30, 30)))


def test_toxicity_against_plain_scores(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.fit(docs, labels)
    found = {r.doc_id: r.score for r in toxicity.toxicity_digest(docs, labels).collect()}
    for r in docs.collect():
        assert found[r.doc_id] == pytest.approx(plain_score(r.text, model), abs=1e-9)
    # What the held-out fold's labels say makes no difference.
    turned = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, turned) == model


# ---------------------------------------------------------------- licenses


def test_licenses():
    model = licenses.train(["the weather is fine in this part of the world", "a license to kill", "see the file for more", "all of the rights of man", "version 3 of the story is out"] * 40)
    cases = {
        "Licensed under the Apache License, Version 2.0.": "Apache",
        "// released under the mit license": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that": "BSD",
        "the public has a license for version 3 of this work": "unknown",
        "": "unknown",
        "MIT": "unknown",
    }
    assert {t: model.classify(t)[0] for t in cases} == cases
    held = [(t, f) for f, ts in licenses.TEMPLATES.items() for t in ts]
    assert all(model.classify(t)[0] == f for t, f in held)


HELD_OUT = {
    "MIT": [
        "Released under the MIT License.",
        "The code is available under the MIT license.",
        "Copyright (c) 2020 Jane Doe. Published under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "// spdx-license-identifier: mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this data",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Published under the Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "This project uses the Apache 2.0 license",
        "Licensed to the foundation under the Apache License, Version 2.0 (the License)",
        "software distributed under the License is distributed on an as is basis, without warranties",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Covered by the GNU General Public License version 2 or later",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You can redistribute it under the GNU GPL v3",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "LGPL": [
        "Available under the GNU Lesser General Public License, version 2.1",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "AGPL": [
        "Covered by the GNU Affero General Public License, version 3",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms are permitted provided that the following conditions are met",
    ],
    "MPL": [
        "SPDX-License-Identifier: MPL-2.0",
        "Covered by the Mozilla Public License, version 2.0",
    ],
    "EPL": [
        "SPDX-License-Identifier: EPL-2.0",
        "Published under the Eclipse Public License, version 2.0",
    ],
    "ISC": [
        "SPDX-License-Identifier: ISC",
        "Released under the ISC license",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
    ],
    "Unlicense": [
        "SPDX-License-Identifier: Unlicense",
        "Released into the wild under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "Photos are available under CC BY-NC 4.0",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-SA": [
        "Text is available under CC BY-SA 4.0",
    ],
    "CC-BY": [
        "Figures are published under CC BY 4.0",
    ],
    "CC0": [
        "Data is published under CC0 1.0",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright 2019 Example Corp. All rights reserved.",
        "No part of this book may be reproduced without the prior written permission of the author.",
    ],
    "unknown": [
        "the public has a license for version 3 of this work",
        "",
        "MIT",
        "SPDX-License-Identifier: FooBar-1.0",
        "all of the rights of man",
        "a driver's license is needed",
        "he studied at the MIT and got a license",
        "the file is made available under the table",
        "see the LICENSE file for details",
        "This software is great",
        "version 2.0 is out",
        "the terms of the contract",
        "published by the Free Press Foundation",
        "Licensed under the Foo License, Version 1.0",
    ],
}


def test_licenses_on_lines_that_are_no_template(small):
    import duckdb

    docs = duckdb.sql(f"SELECT text FROM '{small}/documents.parquet'").fetchall()
    model = licenses.train([line for (t,) in docs for _, line in list(licenses.paragraphs_of(t or ""))[: licenses.PARAGRAPHS]])
    made = {tuple(licenses.words(t)) for ts in licenses.TEMPLATES.values() for t in ts}
    lines = [(t, f) for f, ts in HELD_OUT.items() for t in ts if tuple(licenses.words(t)) not in made]
    found = [(f, model.classify(t)[0]) for t, f in lines]
    assert len(found) >= 40
    named = [(f, g) for f, g in found if g != licenses.UNKNOWN]
    assert sum(f == g for f, g in named) >= 0.95 * len(named)
    real = [(f, g) for f, g in found if f != licenses.UNKNOWN]
    assert sum(f == g for f, g in real) >= 0.9 * len(real)


def test_license_scan_against_brute_force(spark, small):
    """Each line of each whole text classified on its own."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(10**6 + i, "x y\n" + "\n".join(ts) + "\nand more", 1) for i, ts in enumerate(HELD_OUT.values())], "doc_id long, text string, family int")
    both = docs.select("doc_id", "text").unionByName(extra.select("doc_id", "text"))
    model = licenses.train([])
    found = {(r.doc_id, r.start, r.end, r.family, round(r.score, 9)) for r in licenses.scan(both, model).collect()}
    expected = set()
    for r in both.collect():
        for at, line in licenses.paragraphs_of(r.text or ""):
            family, score, _ = model.classify(line)
            if family != licenses.UNKNOWN:
                expected.add((r.doc_id, at, at + len(line), family, round(score, 9)))
    assert found == expected and len({f for *_, f, _ in expected}) == len(licenses.TEMPLATES)


def test_license_lines_of_documents(spark):
    kinds = {
        "All rights reserved.": "Proprietary",
        "Licensed under the Apache License, Version 2.0.": "Apache",
        "Released under the MIT License.": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    }
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = [(r.doc_id, at, kinds[line]) for r in docs.collect() for at, line in licenses.paragraphs_of(r.text or "") if line in kinds]
    found = {(r.doc_id, r.start, r.family) for r in licenses.scan(docs, licenses.fit(docs)).collect()}
    assert {f for _, _, f in lines} == set(kinds.values())
    assert set(lines) <= found
    model = licenses.train([])
    assert all(model.classify(line)[0] == f for line, f in kinds.items())


def test_license_spans(spark):
    text = "first line\nReleased under the MIT License.\nlast"
    rows = licenses.scan(spark.createDataFrame([(1, text), (2, "nothing")], "doc_id long, text string"), licenses.train([])).collect()
    assert [(r.doc_id, r.family, text[r.start : r.end]) for r in rows] == [(1, "MIT", "Released under the MIT License.")]


# ---------------------------------------------------------------- decontamination


def test_reparameterised_questions(spark):
    item = "Tom has 3 apples and 5 km to walk with Anna before 3 more hours pass by them"
    docs = [
        (1, item),
        (2, "so Bob has 7 apples and 9 km to walk with Eve before 7 more hours pass by them then"),
        (3, "so Bob has 7 apples and 9 km to walk with Eve before 8 more hours pass by them then"),
        (4, "Tom has 3 apples and that is it"),
        (5, "deep in a text " * 50 + item.lower().replace("tom", "Tom").replace("anna", "Anna") + " and so on" * 20),
        (6, "unrelated words only " * 9),
    ]
    found = decontamination.decontamination_digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.exact) for r in found} == {(1, True), (2, False), (5, True)}


@pytest.mark.parametrize("seed", range(2))
def test_reparameterised_questions_by_construction(spark, seed):
    """Items with slots and shared beginnings; copies with other values, with values that do not fit, and parts of items."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    name = lambda: word().capitalize()
    start = [word() for _ in range(8)]
    items, docs, truth = [], [], set()
    for i in range(50):
        slots = [rng.choice(["{n0}", "{n1}", "{p0}", "{p1}"]) for _ in range(6)] + ["{n0}", "{n1}", "{p0}", "{p1}", "{n0}", "{p0}"]
        body = [*start, *(x for s in slots for x in (word(), s, word()))]

        def filled(n0, n1, p0, p1, body=body):
            return [x.format(n0=n0, n1=n1, p0=p0, p1=p1) for x in body]

        values = rng.sample(range(10, 99), 4)
        items.append((i, " ".join(filled(*values[:2], name(), name()))))
        other = filled(*values[2:], name(), name())
        broken = list(other)
        # One of the places of a slot gets another value, so the map is not one-to-one.
        at = [k for k, x in enumerate(body) if x == "{n0}"]
        broken[at[0]] = "1000"
        around = lambda: " ".join(word() for _ in range(rng.randint(0, 30)))
        for text, hit in ((other, True), (broken, False), (other[: len(other) // 2], False), (filled(*values[:2], name(), name()), True)):
            docs.append((len(docs), f"{around()} {' '.join(text)} {around()}".strip()))
            if hit:
                truth.add((docs[-1][0], i))
        docs.append((len(docs), " ".join(start) + " " + around()))
    found = decontamination.decontamination_digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == truth


def test_bit_table(spark):
    rng = random.Random(9)
    hashes = [rng.randrange(-(2**63), 2**63) for _ in range(3000)] + [0, -1, decontamination.TABLE_BITS - 1]
    table = np.frombuffer(decontamination.bit_table(spark.createDataFrame([(h,) for h in hashes], "hash long")), np.uint8)
    spots = {h % decontamination.TABLE_BITS for h in hashes}
    assert len(table) == decontamination.TABLE_BITS // 8 and int(np.unpackbits(table).sum()) == len(spots)
    assert decontamination._in_table(np.array(hashes, np.int64).view(np.uint64), table).all()


def test_names_that_open_sentences(spark):
    tom = "Tom has 3 apples. Tom gives Anna 2 apples. Then Anna buys 5 pears. How many pears and apples do they have?"
    marie = "In the end the old man told Anna Marie that 4 of his boats had left the harbour"
    docs = [
        (1, "Bob has 7 apples. Bob gives Eve 4 apples. Then Eve buys 9 pears. How many pears and apples do they have?"),
        (2, tom.lower()),
        (3, "and so Bob has 7 apples. Bob gives Eve 4 apples. Then Eve buys 9 pears. How many pears and apples do they have?"),
        (4, marie.replace("Anna Marie", "Eve")),
        (5, marie.lower()),
        (6, "Bob has 7 apples. Bob gives Bob 4 apples. Then Eve buys 7 pears. How many cups and plates do they have?"),
        (7, marie),
        (8, "Bob Smith has 7 apples. Bob Smith gives Eve Jones 4 apples. Then Eve Jones buys 9 pears. How many pears and apples do they have?"),
    ]
    found = decontamination.decontamination_digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, tom), (2, marie)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.exact) for r in found} == {(1, 1, False), (2, 1, True), (3, 1, False), (4, 2, False), (5, 2, True), (7, 2, True), (8, 1, False)}


def test_planted_passages(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    texts = {r.item_id: r.text for r in items.collect()}
    truth = {(r.doc_id, i) for r in docs.collect() for i, t in texts.items() if t in r.text}
    assert {(r.doc_id, r.item_id) for r in decontamination.decontamination_digest(docs, items).collect()} == truth


# ---------------------------------------------------------------- mixing


def water(sizes, weights, limit=3):
    targets = dict.fromkeys(sizes, 0.0)
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(limit * sizes[s] for s in full)
        free = [s for s in sizes if s not in full]
        share = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = {s for s in free if share[s] > limit * sizes[s]}
        if not over:
            return targets | share | {s: float(limit * sizes[s]) for s in full}
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "Ü", "z", "é", None]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choices(names, [1, 30, 5, 1, 3, 2])[0]) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_digest(df).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    targets = water(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    source = {i: s for i, _, s in rows}
    taken = collections.Counter()
    for r in found:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s]) and 0 <= r.taken <= 3 * r.size
        assert (r.first_due is None) == (r.copies == 0) and 0 <= (r.first_due or 0) <= 1
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(150, 0.02 * targets[s])
    moments = [r.first_due for r in found]
    taken_ones = [m for m in moments if m is not None]
    assert moments[: len(taken_ones)] == sorted(taken_ones)
    assert sorted(map(repr, found)) == sorted(map(repr, mixing.mix_digest(df.repartition(7)).collect()))


def test_targets_of_many_sources(spark):
    """Sources in several ranges of their order, against the plain rule."""
    rng = random.Random(3)
    sizes = {f"{'zaÜb'[i % 4]}{i}": rng.choice([0, 1, 7, 40, 5000]) for i in range(700)} | {None: 90}
    rows = [(s, n) for s, n in sizes.items()] + [("a1", 5)]
    sizes["a1"] += 5
    found = {r.source: r for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long").repartition(3)).collect()}
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weights = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    expected = water(sizes, weights)
    assert {s: r.weight for s, r in found.items()} == weights
    assert all(found[s].target == pytest.approx(expected[s]) and found[s].source_size == sizes[s] for s in sizes)


def test_mixed_rows_come_in_order(spark):
    df = spark.createDataFrame([(i, "w " * (i % 9 + 1), "ab"[i % 2], i) for i in range(300)], "doc_id long, text string, source string, extra long")
    plan = {r.doc_id: r.copies for r in mixing.mix_digest(df).collect()}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    got = collections.Counter(r.doc_id for r in mixed.collect())
    assert sum(got.values()) == pytest.approx(sum(plan.values()), rel=0.05) and max(got.values()) <= 3


def test_running_totals(spark):
    from brindle.llm.shared import running_totals

    sizes = [0, 1, 2, 255, 256, 257, 1000]
    df = spark.createDataFrame([(n, [i % 7 for i in range(n)]) for n in sizes], "n int, v array<int>")
    for r in df.select("n", "v", running_totals(F.col("v")).alias("t")).collect():
        assert r.t == np.cumsum(r.v).tolist()
