"""WARC round trips, licences, toxicity and the pipeline."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import common as C
from ledgerloom.llm import licenses as L
from ledgerloom.llm import toxicity as T
from ledgerloom.llm import warc as W


def test_warc(spark, tmp_path):
    big = "<p>é</p>" * 3000
    html = [big, None, "", "x" * 99, "x" * 99, "y" * 100, "y" * 100, big, big + "z", "a\r\n\r\nb" * 40, "y" * 100]
    rows = [(i, None if i == 2 else f"http://e/{i}\r\nX: y", h, "extra") for i, h in enumerate(html)] + [(5, "u", "y" * 100, "again"), (None, "u", "y" * 100, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    archive = W.archive_pages(pages, chunk=1000)
    assert archive.agg(F.max(F.length("data"))).first()[0] < 1600 and archive.agg(F.max("n_chunks")).first()[0] == 28
    got = W.read_archive(archive).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    first = {}
    for i, h in enumerate(html):
        if len((h or "").encode()) >= 100:
            first.setdefault(h, i)
    for r in got:
        h = "y" * 100 if r.page_id is None else html[r.page_id] or ""
        again = first.get(h) if first.get(h) != r.page_id else None
        assert (r.payload_bytes, r.payload_digest) == (len(h.encode()), hashlib.sha256(h.encode()).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", again) if again is not None else ("response", None))
    last = archive.where("chunk_no = n_chunks - 1 AND n_chunks > 1").collect()
    assert {r.digest for r in last} == {hashlib.sha256(h.encode()).hexdigest() for h in (big, big + "z")}
    n = W.export_warc(archive, str(tmp_path / "a.warc"))
    data = (tmp_path / "a.warc").read_bytes()
    assert len(data) == n and data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n") and (big + "z").encode() in data
    assert W.read_archive(W.archive_pages(pages.where("false"))).count() == 0


def test_licenses(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [
        ("LICENSE", apache, "none", None), ("src/a.py", "print()", None, None), ("src/b.py", f"# {mit}\ncode", None, None), ("lib/LICENSE.txt", mit + "\n\n", None, None), ("lib/x/y/c.c", "int x;", None, None),
        ("lib/x/COPYING", "nothing said", None, None), ("d.txt", None, None, None), ("e.txt", "", None, None), (None, mit, None, None), ("src/a.py", "print()", None, None), ("f/g.txt", "license to drive a car", None, None),
    ]
    got = L.scan_licenses(spark.createDataFrame(files, "path string, text string, license string, dir string")).collect()
    assert len(got) == len(files)
    by = {r.path: (r.license, r.method, r.license_dir) for r in got}
    assert by["LICENSE"] == ("Apache-2.0", "file", None) and by["src/b.py"] == ("MIT", "header", None)
    assert by["src/a.py"] == by["d.txt"] == by["e.txt"] == by["f/g.txt"] == ("Apache-2.0", "inherited", "")
    assert by["lib/LICENSE.txt"] == ("MIT", "file", None) and by["lib/x/y/c.c"] == by["lib/x/COPYING"] == ("MIT", "inherited", "lib")
    assert by[None] == (None, "none", None)
    assert L.scan_licenses(spark.createDataFrame([], "path string, text string")).count() == 0


def test_licence_headers_over_several_lines(spark):
    gpl = "This program is free software{c} you can redistribute it and/or modify\n it under the terms of the GNU General Public License as published by\n the Free Software Foundation{d} either version {v} of the License, or\n (at your option) any later version.\n\n This program is distributed in the hope that it will be useful,\n but WITHOUT ANY WARRANTY."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software."
    bsd = "Redistribution and use in source\nand binary forms, with or without\nmodification, are permitted provided\nthat the following conditions are met:"
    apache = "Licensed under the\nApache License, Version 2.0 (the\n\"License\"); you may not use this\nfile except in compliance with the License."
    marked = lambda text, mark: "\n".join(f"{mark} {x}".rstrip() for x in text.split("\n"))
    files = [
        ("a/x.py", marked("Copyright 2020 Someone\n\n" + gpl.format(c=":", d=",", v=3), "#") + "\n\nimport os"), ("b/x.c", "/*\n" + marked(gpl.format(c=";", d=";", v=2), " *") + "\n */\nint x;"), ("c/x.js", marked(mit, "//")),
        ("d/COPYING", "MIT License\n\nCopyright (c) 2020\n\n" + mit), ("d/e.js", "x"), ("e/x.go", marked(bsd, "//")), ("f/x.java", "/*\n" + marked(apache, " *") + "\n */"),
        ("g/x.rs", "// Copyright 2020 Someone\n// SPDX-License-Identifier: MIT\nfn main() {}"), ("h/x.rs", "/* SPDX-License-Identifier: GPL-3.0-or-later */"), ("i/x.rs", "// SPDX-License-Identifier: Zlib"), ("j/x.txt", "The program is free and the terms of use are as published by the office.\n\nAny person may copy this."),
    ]
    by = {r.path: (r.license, r.method) for r in L.scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    assert by["a/x.py"] == ("GPL-3.0", "header") and by["b/x.c"] == ("GPL-2.0", "header") and by["c/x.js"] == ("MIT", "header")
    assert by["d/COPYING"] == ("MIT", "file") and by["d/e.js"] == ("MIT", "inherited")
    assert by["e/x.go"] == ("BSD-3-Clause", "header") and by["f/x.java"] == ("Apache-2.0", "header")
    assert by["g/x.rs"] == ("MIT", "header") and by["h/x.rs"] == ("GPL-3.0", "header")
    assert by["i/x.rs"] == by["j/x.txt"] == (None, "none")


def test_licence_files_as_a_whole_and_denials(spark):
    names = {k: v for k, v in L.TEXTS}
    lines = lambda text: "Copyright (c) 2021, Some One\n\n" + "\n".join(" ".join(text.split()[3:][i : i + 9]) for i in range(0, len(text.split()), 9))
    files = [
        ("a/LICENSE", lines(names["BSD-2-Clause"])), ("b/LICENSE", lines(names["BSD-3-Clause"])), ("c/LICENSE.md", lines(names["ISC"])), ("d/COPYING", lines(names["MIT"])), ("e/COPYING.LESSER", "GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999"),
        ("f/COPYING", "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1"), ("g/x.py", "# This work is not released under the MIT License."), ("h/x.py", "# It is no longer distributed under the Apache License, Version 2.0"), ("i/LICENSE", "All rights reserved. No part of this work may be copied by anyone for any purpose."),
        ("j/x.c", "/* Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, provided that the above\n * copyright notice and this permission notice appear in all copies. */"),
    ]
    by = {r.path: (r.license, r.method) for r in L.scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    assert [by[p][0] for p in ("a/LICENSE", "b/LICENSE", "c/LICENSE.md", "d/COPYING", "e/COPYING.LESSER", "f/COPYING")] == ["BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT", "LGPL-2.1", "LGPL-2.1"]
    assert by["g/x.py"] == by["h/x.py"] == by["i/LICENSE"] == (None, "none") and by["j/x.c"] == ("ISC", "header")


@pytest.fixture(scope="module")
def labelled(spark, words):
    rng, bad = random.Random(7), ["vileword", "nastyterm", "uglything"]
    rows, labels = [], []
    for i in range(700):
        toxic = i % 6 == 0
        own = rng.choices(words, k=rng.randint(10, 60))
        for _ in range(3 * toxic):
            own.insert(rng.randrange(len(own)), rng.choice(bad))
        rows.append((i, " ".join(own)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark, labelled):
    rows, labels = labelled
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows] + [(None, None, 1), (900, "", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame(labels + [(0, None), (5000, 1)], "doc_id long, toxic int")
    got = T.score_toxicity(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    own = {r.doc_id: r for r in got.collect()}
    marked = T.mark_toxicity(docs, labels, "found")
    assert marked.columns == ["doc_id", "text", "score", "found"] and {r.score for r in marked.collect()} == {1, 5}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in own.values())
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(own[i].held_out == (i in held) for i, _ in rows)
    right = sum(own[i].predicted == int(i % 6 == 0) for i in held)
    assert right >= 0.97 * len(held) and own[900].predicted == 0 and own[None].predicted == 0


def test_labels_of_held_out_rows_are_not_learnt_from(spark, labelled):
    rows, labels = labelled
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = []
    for flip in (False, True):
        own = [(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
        scores.append({r.doc_id: r.score for r in T.score_toxicity(docs, spark.createDataFrame(own, "doc_id long, toxic int")).collect()})
    assert scores[0] == scores[1]


def test_labels_of_zero_are_not_learnt_from(spark, labelled):
    """Nothing but the confirmed labels is read: zeros may be lacking, null or anything else."""
    rows, labels = labelled
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = []
    for put in ((lambda y: y), (lambda y: y or None), (lambda y: y or 7)):
        scores.append({r.doc_id: r.score for r in T.score_toxicity(docs, spark.createDataFrame([(i, put(y)) for i, y in labels], "doc_id long, toxic int")).collect()})
    scores.append({r.doc_id: r.score for r in T.score_toxicity(docs, spark.createDataFrame([x for x in labels if x[1]], "doc_id long, toxic int")).collect()})
    assert all(x == scores[0] for x in scores)


def test_prior_is_estimated(words):
    rng = random.Random(3)
    np_hash = lambda ws: __import__("numpy").unique(__import__("numpy").array([zlib.crc32(w.encode()) for w in ws], "uint32"))
    bad = [f"bad{k}" for k in range(12)]
    text = lambda toxic: np_hash(rng.choices(words, k=40) + rng.sample(bad, 3) * toxic)
    for share in (0.05, 0.2, 0.4):
        p, u = [text(1) for _ in range(300)], [text(rng.random() < share) for _ in range(2000)]
        assert abs(T.estimate_prior(p, u) - share) < 0.25 * share + 0.01


def test_toxicity_without_labels(spark, labelled):
    docs = spark.createDataFrame(labelled[0][:5], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in T.score_toxicity(docs, none).collect()} == {(0.0, 0)}
    assert T.score_toxicity(docs.where("false"), none).count() == 0


def test_pipeline(spark, labelled, words, tmp_path):
    rng = random.Random(1)
    rows = [(i, t) for i, t in labelled[0][:300]]
    item = " ".join(rng.choices(words, k=12))
    clean = [t for i, t in rows if i % 6]
    extra = [(1000, clean[0]), (1001, clean[1] + " more"), (1002, f"{clean[2]} {item} {clean[3]}"), (1003, " ".join(rng.choices(words, k=30)) + ' token = "0123456789abcdef0123"'), (1004, None), (1005, ""), (None, "no id " + item[:9])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + extra], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labelled[1]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = C.table(spark, str(tmp_path), "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        now = C.Scratch(spark, "test").save(out, name)
        kept[name] = {r.doc_id: r for r in now.collect()}
    assert not any(i is not None and i < 300 and i % 6 == 0 for i in kept["toxicity"]) and {1, 1002, 1004, None} <= set(kept["toxicity"])
    assert not {1000, 1001} & set(kept["near_dedup"]) and {1, 2, 1002} <= set(kept["near_dedup"])
    assert 1002 not in kept["decontaminate"] and len(kept["decontaminate"]) == len(kept["near_dedup"]) - 1
    assert kept["secrets"][1003].text.endswith(' [SECRET]"') and kept["secrets"][1003].n_chars == len(kept["secrets"][1003].text)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept["secrets"])


def test_pipeline_against_brute_force(spark, labelled, corpus, words, tmp_path):
    """Each stage's rows from its predecessor's, computed again without Spark."""
    import numpy as np
    import public_tokenizers
    import xxhash
    from test_text_operators import alnum, components, spans_of
    from tokenizers import Tokenizer

    rng = random.Random(11)
    item = rng.choices(words, k=14)
    rows = [(i, t) for i, t in labelled[0][:240]] + [(1000 + i, t) for i, t in corpus]
    rows += [(2000 + k, " ".join(rng.choices(words, k=30) + item[k : k + 11] + rng.choices(words, k=30))) for k in range(4)]
    rows += [(3000 + k, " ".join(rng.choices(words, k=200)) + f' password: "{k}abcdefgh" end') for k in range(4)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labelled[1]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [" ".join(item), "one two"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got, now = {}, C.table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES:
        now = C.Scratch(spark, "test").save(stage(spark, now, str(tmp_path)), name)
        got[name] = now.collect()
    held = lambda name: {r.doc_id: r.text for r in got[name]}

    features = {i: np.unique(np.array([xxhash.xxh3_64_intdigest(w) & T.LOW for w in T._features((t or "").encode())], np.uint32)) for i, t in rows}
    learn = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    toxic = {i for i, y in labelled[1] if y == 1}
    sort = lambda ids: sorted((features[i] for i in ids), key=lambda a: (len(a), a.tobytes()))
    vocabulary, weights, bias = T.train(sort(i for i in learn if i in toxic), sort(learn))
    weight = dict(zip(vocabulary.tolist(), weights.tolist()))
    clean = {i: t for i, t in rows if bias + sum(weight.get(f, 0.0) for f in features[i].tolist()) < 0}
    assert held("toxicity") == clean and len(rows) > len(clean) > 200

    of = components(list(clean.items()), 5, 80)
    single = {i: t for i, t in clean.items() if of[i][1] == i}
    assert held("near_dedup") == single and len(single) < len(clean)

    windows = {tuple(w[k : k + 10]) for w in map(alnum, items) for k in range(max(1, len(w) - 9))}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    fresh = {i: t for i, t in single.items() if not hit(alnum(t))}
    assert held("decontaminate") == fresh and len(fresh) <= len(single) - 4

    def redacted(text):
        out, at = "", 0
        for a, _, b, _ in spans_of(text or ""):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        return out + text[at:] if text else text

    safe = {i: redacted(t) for i, t in fresh.items()}
    assert held("secrets") == safe and safe != fresh
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, places = {}, {}
    for r in got["packing"]:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(safe)
    for i, own in pieces.items():
        ids = [*tok.encode(safe[i] or "", add_special_tokens=False).ids, 0]
        assert sum(n for _, _, n, _ in own) == len(ids) and all(crc == zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) for _, a, n, crc in own)
    for own in places.values():
        ends = [0]
        for at, n in sorted(own):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= 2048
    assert len(places) <= -(-sum(n for own in places.values() for _, n in own) // 2048) * 1.05 + 1


def test_stages_keep_clashing_columns_and_odd_ids(spark, labelled, tmp_path):
    """Columns named like those of the operators, ids that are texts, and a text of over a megabyte."""
    rows = [(f"id{i}", t) for i, t in labelled[0][:300]]
    long = " ".join(f"w{i}" for i in range(160_000)) + ' token = "0123456789abcdef0123"'
    rows += [("a", rows[1][1]), ("z", rows[1][1] + " more"), ("a", "other words under the same id"), ("a", "other words under the same id"), ("long", long), ("long2", long + " end"), (None, rows[2][1]), ("e", ""), ("n", None)]
    clash = ["score", "predicted", "held_out", "spans", "hits", "toxicity", "n_hit", "kept", "component_id", "_key", "_digest", "_text", "_c0", "a.b"]
    docs = spark.createDataFrame([(i, t, *(f"{c}{k}" for c in clash)) for k, (i, t) in enumerate(rows)], "doc_id string, text string, " + ", ".join(f"`{c}` string" for c in clash))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(f"id{i}", 1, y) for i, y in labelled[1]], "doc_id string, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[3][1].split()[:12]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = C.table(spark, str(tmp_path), "documents"), {}
    before = {tuple(r)[2:]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        now = C.Scratch(spark, "test").save(out, name)
        kept[name] = now.collect()
        assert all(tuple(r)[2:] in before and before[tuple(r)[2:]].doc_id == r.doc_id for r in kept[name])
    ids = {k: [r.doc_id for r in v] for k, v in kept.items()}
    assert not any(i == f"id{k}" and k % 6 == 0 for i in ids["toxicity"] for k in range(300)) and {"long", "e", "n", None} <= set(ids["toxicity"])
    assert ids["near_dedup"].count("a") == 2 and {"long", None, "e", "n"} <= set(ids["near_dedup"]) and not {"z", "id1", "long2"} & set(ids["near_dedup"])
    assert "id3" in ids["near_dedup"] and "id3" not in ids["decontaminate"]
    assert next(r.text for r in kept["secrets"] if r.doc_id == "long").endswith(" [SECRET]\"")


def test_pipeline_of_nothing(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
