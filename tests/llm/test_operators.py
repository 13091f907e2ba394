import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftloom.llm import chunking, licenses, lines, mixing, packing, quality, sharding, simhash, tokens, topk

from . import data


def test_tree_counts_equal_whole_encodings():
    rng, encode = random.Random(3), packing.encoder(special=True)
    alphabet = ["a", "'s", "'", "r", "e", "ll", " ", "  ", "\n", "é", "1", "23", ".", " the", "ñ", "\t", "'re", "x" * 5]
    for _ in range(300):
        tree = tokens.TokenTree("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))))
        for _ in range(5):
            n = len(tree.text)
            start, length = rng.randint(0, n), rng.choice([0, 1, 3, rng.randint(0, 60)])
            new = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 4, 40, 2000])))
            want = tree.text[:start] + new + tree.text[start + length :]
            tree.edit(start, length, new)
            assert tree.text == want
            assert tree.total == len(encode(want))


def plain_revision(text):
    """The three edits of the query, done on a plain string."""
    n = len(text)
    for start, length, new in ((n * 3 // 4, 12, "revised, 2nd time"), (n // 2, 40, ""), (n // 4, 0, " [see note 7] ")):
        text = text[:start] + new + text[start + length :]
    return text


def test_special_strings_come_and_go_with_edits():
    rng, encode, special = random.Random(8), packing.encoder(special=True), "<|endoftext|>"
    assert tokens.TokenTree(f"a {special} b").total == len(encode(f"a {special} b")) == 4
    pieces = ["<|endof", "text|>", special, "<|", "|>", "a", " ", "  ", "!!", "'s", "<|endoftext|", ">", "\n", "é", "word word"]
    for _ in range(150):
        tree = tokens.TokenTree("".join(rng.choice(pieces) for _ in range(rng.randint(0, 200))))
        for _ in range(12):
            tree.edit(rng.randint(0, len(tree.text)), rng.choice([0, 0, 1, 2, 6, 13, 40]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 3))))
            assert tree.total == len(encode(tree.text)), tree.text


def test_edited_counts_equal_whole_encodings_of_every_row(spark):
    encode = packing.encoder(special=True)
    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame(data.rows(), data.DOCS)
    clashing = odd.withColumns({c: F.lit(f"x{c}") for c in ("edits", "tokens", "edited_tokens", "encoded_chars")})
    for df in (clashing, whole):
        source = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
        want = [(d, len(t), len(encode(t)), len(plain_revision(t)), len(encode(plain_revision(t)))) for d, t in source]
        found = tokens.edited_counts(df, tokens.revision())
        assert data.as_rows(found, "doc_id", "n_chars", "tokens", "edited_chars", "edited_tokens") == sorted(want, key=repr)
        long = found.orderBy(F.desc("n_chars")).first()
        assert long["encoded_chars"] < long["n_chars"] / 20
    assert tokens.edited_counts(data.empty(spark), tokens.revision()).count() == 0


def check_packing(source, found):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def encode(text):
        return tokenizer.encode(text, add_special_tokens=False).ids

    pieces = {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
    want = Counter((r[0], tuple([*encode(r[1] or ""), 0])) for r in source)
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert sum(r["length"] for r in found) == total
    by_id = {}
    for (doc_id, ids), n in want.items():
        by_id.setdefault(doc_id, []).append((ids, n))
    for doc_id, texts in by_id.items():
        expected = Counter()
        for ids, n in texts:
            for r in {(p["start"], p["length"], p["ids_crc32"]) for p in pieces[doc_id] if p["doc_tokens"] == len(ids)}:
                got = np.array(ids[r[0] : r[0] + r[1]], "<u4").tobytes()
                expected[r] += n if zlib.crc32(got) == r[2] else 0
        assert sum(p["length"] for p in pieces[doc_id]) == sum(len(ids) * n for ids, n in texts)
        for p in pieces[doc_id]:
            assert expected[(p["start"], p["length"], p["ids_crc32"])] >= 1
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append(r)
    padding = 0
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padding == 0


@pytest.mark.parametrize("shard_tokens", [packing.SHARD_TOKENS, 3000])
def test_packing_covers_every_token_once(spark, shard_tokens):
    odd = [(200, "before<|endoftext|>after <|endoftext|>", "en", "s", 1), (201, " " * 5000 + "<|endoftext|>", "en", "s", 1)]
    source = [*data.rows(), *odd, *[(300 + i, "copies of one text, each by itself " * 40, "en", "s", 1) for i in range(60)]]
    df = data.clashing(spark.createDataFrame(source, data.DOCS)).withColumn("span", F.lit("x")).withColumn("ids", F.lit(1))
    check_packing(source, packing.pack(df, shard_tokens=shard_tokens).collect())
    assert packing.pack(data.empty(spark)).count() == 0


def plain_bm25(docs, seed):
    """The formula, document by document."""
    n, mean, out = len(docs), sum(map(len, docs)) / len(docs), []
    for d in docs:
        total = 0.0
        for t in set(docs[seed]):
            tf, df = d.count(t), sum(t in x for x in docs)
            total += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        out.append(total)
    return out


def test_scores_and_neighbours_equal_plain_bm25(spark):
    rng = random.Random(4)
    texts = [data.words(rng, rng.randint(1, 60)) for _ in range(40)]
    rows = packing.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    statistics = packing.statistics_of(rows)
    docs = [[*packing.encoder()(t), 0] for t in texts]
    arrays = [np.array(d, np.uint16) for d in docs]
    found = [packing.terms_of(a) for a in arrays]
    index = packing.Index([t for t, _ in found], [c for _, c in found], np.array([len(a) for a in arrays]), statistics)
    for seed in range(len(docs)):
        want = plain_bm25(docs, seed)
        assert index.scores(seed) == pytest.approx(want)
        unused = np.ones(len(docs), bool)
        unused[seed] = False
        got = []
        for other in packing.neighbours(index, seed, unused, list(range(len(docs)))):
            got.append(other)
            unused[other] = False
        scores = index.scores(seed)
        assert got == sorted(set(range(len(docs))) - {seed}, key=lambda i: (-scores[i], i))


def test_packing_prefers_neighbours():
    rng = np.random.default_rng(0)
    topics = [rng.choice(5000, 300, replace=False) + 5000 * t for t in range(3)]
    docs = [np.r_[rng.choice(topics[i % 3], 700), 0].astype(np.uint16) for i in range(30)]
    df = np.zeros(packing.size_of(), np.int64)
    for d in docs:
        df[np.unique(d)] += 1
    packer = packing.Packer(packing.Statistics(len(docs), sum(map(len, docs)), df), packing.WINDOW, 0)
    by_sequence = {}
    terms, counts = zip(*map(packing.terms_of, docs))
    for doc, _, _, _, _, sequence, _ in packer.shard(list(range(30)), docs, terms, counts):
        by_sequence.setdefault(sequence, set()).add(doc % 3)
    assert np.mean([len(t) == 1 for t in by_sequence.values()]) > 0.7


def test_documents_of_one_topic_lie_together(spark):
    rng = random.Random(8)
    topics = [[f"{data.words(rng, 1)}{t}x{k}" for k in range(6)] for t in range(30)]
    rows = [(i, " ".join(rng.choice(topics[i % 30]) for _ in range(50)) + " " + data.words(rng, 10)) for i in range(600)]
    encoded = packing.encoded(spark.createDataFrame(rows, "doc_id long, text string"))
    statistics = packing.statistics_of(encoded)
    spans = {r[0]: r[1] for r in packing.placed(encoded, statistics, 8).select("doc_id", "span").collect()}
    assert set(spans.values()) <= set(range(8))
    together = [spans[i] == spans[j] for i in range(600) for j in range(i + 30, 600, 30)]
    assert np.mean(together) > 0.25  # 0.125 by chance
    sizes = Counter(spans.values())
    assert max(sizes.values()) < 3 * 600 / 8


def compared(line):
    words = line.split()
    cut = ["<*>" if any(c.isdigit() or c == "@" for c in x) or "://" in x else x for x in words]
    general = cut == words or len(words) - cut.count("<*>") >= 0.6 * len(words)
    return tuple(cut if general else words)


def brute_lines(source, docs_needed=lines.DOCS):
    """By the templates of single lines; the rows have no others."""
    seen = {}
    for i, (doc_id, text, *_rest) in enumerate(source):
        for line in (text or "").split("\n"):
            w = compared(line)
            if w:
                seen.setdefault(w, {}).setdefault((doc_id, text), doc_id if doc_id is not None else 2**63 - 1)
    first = {w: min(d.values()) for w, d in seen.items() if len(d) >= (docs_needed if len(w) >= 5 else lines.SHORT_DOCS)}
    out = []
    for doc_id, text, *_rest in source:
        if text is None:
            out.append((doc_id, None))
            continue
        keep = []
        for line in text.split("\n"):
            w = compared(line)
            if w not in first or (doc_id if doc_id is not None else 2**63 - 1) <= first[w]:
                keep.append(line)
        out.append((doc_id, "\n".join(keep)))
    return sorted(out, key=repr)


def test_recurring_lines_go_but_the_first_stays(spark):
    found = lines.drop_recurring_lines(data.docs(spark))
    assert data.as_rows(found, "doc_id", "text") == brute_lines(data.rows())
    assert lines.drop_recurring_lines(data.empty(spark)).count() == 0
    extra = lines.drop_recurring_lines(data.clashing(data.docs(spark)))
    assert data.as_rows(extra, "doc_id", "text") == brute_lines(data.rows())
    assert extra.where("drop = 'xdrop'").count() == len(data.rows())


def test_variable_fields_are_generalised(spark):
    names = [f"name{chr(97 + i)}{chr(97 + i // 2)}" for i in range(24)]
    plain = [x.replace("name", "p") for x in names]
    notice = "this page belongs to {} and " + " ".join(f"longword{c}" for c in "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz") + " ends here"
    rows = [(i, f"own words of document {x} here\nPosted here by {plain[i]} on page {i} of this site\n{notice.format(plain[i])}", "en", "s", 1) for i, x in enumerate(names)]
    found = {r[0]: r[1] for r in lines.drop_recurring_lines(spark.createDataFrame(rows, data.DOCS)).select("doc_id", "text").collect()}
    assert "Posted" in found[0]
    assert "belongs" in found[0]  # over 40 words
    assert all("Posted" not in t and "belongs" not in t for i, t in found.items() if i)


def test_many_values_of_a_field_do_not_become_constants(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):  # each name and each place in some twenty different lines
        name, place = (data.words(rng, 1) + str(k).translate(str.maketrans("0123456789", "qrstuvwxyz")) for k in (rng.randrange(30), rng.randrange(30)))
        rows.append((i, f"written one day by {name} in {place} for all of us to read", "en", "s", 1))
    found = lines.drop_recurring_lines(spark.createDataFrame(rows, data.DOCS))
    assert found.where("text <> ''").count() == 1


def test_rows_of_numbers_are_compared_by_their_numbers(spark):
    rows = [(i, f"table of document {i} with some words\n{i} {i + 7} {i * 3} {i + 1} {i * i}\n5 5 5 5 5", "en", "s", 1) for i in range(30)]
    found = {r[0]: r[1] for r in lines.drop_recurring_lines(spark.createDataFrame(rows, data.DOCS)).select("doc_id", "text").collect()}
    assert all(t.split("\n")[-1 if i else 1].startswith(f"{i} {i + 7} ") for i, t in found.items())
    assert all("5 5 5 5 5" not in t for i, t in found.items() if i)


def test_line_dedup_equals_its_sql(spark):
    import duckdb

    rng = random.Random(6)
    rows = list(data.rows())
    for i in range(150):
        name, place = (data.words(rng, 1) for _ in range(2))
        text = [data.words(rng, 9), f"seen by {name} at {place} on day {i} of the year", f"{i} {rng.random()} {rng.random()} x y", f"a b c {name} d e"]
        text += ["<*> <*> 5 of these", "mail me@home now or so please", f"one {name} two {place} three"][: rng.randint(0, 3)]
        rows.append((1000 + i, "\n".join(text), "en", "s", 1))
    df = spark.createDataFrame(rows, data.DOCS)
    documents = df.toArrow()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(lines.ORACLE).fetchall()
    found = lines.drop_recurring_lines(df).select(
        "doc_id", lines.N_LINES, lines.N_DROPPED, F.char_length("text").cast("long"), F.md5("text")
    )
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert found.where(f"{lines.N_DROPPED} > 0").count() > 100


LICENCE_TEXTS = {
    1: ("Released under the MIT License.\nSome prose.", ["MIT"]),
    2: ("Prose. This work is licensed under the GNU General Public Licence, version 3.", ["GPL-3.0-only"]),
    3: ("Licensed under CC BY-NC 4.0.\nx\nAll rights reserved.", ["CC-BY-NC-4.0", "All-Rights-Reserved"]),
    4: ("A licence is a thing. It is not one that is known. Licensed under a tree.", []),
    5: (None, []),
    6: ("", []),
    7: (
        "Copyright (c) A\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the "
        "following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.\nNeither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.", ["BSD-3-Clause"],
    ),
    8: ("MIT License\nno full stop", ["MIT"]),
    9: ("Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License.", ["Apache-2.0"]),
    10: ("some words.\nAll rights\nreserved.", ["All-Rights-Reserved"]),
    11: ("All  rights   reserved.", ["All-Rights-Reserved"]),
    12: (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:\n1. Neither the name of Example Works Ltd. nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.", ["BSD-3-Clause"],
    ),
    13: ("# foo is free software: you can redistribute it and/or modify\n# it under the terms of the GNU Lesser General Public License as published by\n"
         "# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.", ["LGPL-3.0-or-later"]),
    14: ("This library is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0-only"]),
    15: ("This project is released under the Zlib license. It is published under EPL-2.0.", ["EPL-2.0", "Zlib"]),
    16: ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
         "arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial "
         "applications, and to alter it and redistribute it freely, subject to the following restrictions:", ["Zlib"]),
    17: ("This file has been placed in the public\ndomain.", ["Public-Domain"]),
    18: ("words " * 30_000 + "\nThis work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", ["CC-BY-SA-3.0"]),
    19: ("// SPDX-License-Identifier: MIT\nint main;", ["MIT"]),
    20: ("/* SPDX-License-Identifier: Apache-2.0 */", ["Apache-2.0"]),
    21: ("# SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) OR MIT AND CC-BY-4.0\nx = 1",
         ["MIT", "GPL-2.0-or-later", "CC-BY-4.0", "Classpath-exception-2.0"]),
    22: ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\n"
         "published by the Free Software Foundation.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; "
         "without even the implied warranty.", ["GPL-2.0-only"]),
    23: ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. "
         "<https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n"
         "                            Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n",
         ["GPL-3.0-only"]),
    24: ("                                 Apache License\n                           Version 2.0, January 2004\n"
         "                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n", ["Apache-2.0"]),
    25: ("Licensed under the MIT license or the Apache License, Version 2.0.", ["Apache-2.0", "MIT"]),
    26: ("Licensed under the MIT license (see LICENSE).", ["MIT"]),
    27: ("This work is licensed under CC BY-SA 2.0. It is licensed under a Creative Commons Attribution-ShareAlike License 2.5.", ["CC-BY-SA-2.5", "CC-BY-SA-2.0"]),
    28: ("The contents of this file are subject to the Mozilla Public License Version\n1.1 (the \"License\"); you may not use this file except in compliance "
         "with\nthe License. You may obtain a copy of the License at\nhttp://www.mozilla.org/MPL/\n\nSoftware distributed under the License is distributed on "
         "an \"AS IS\" basis,\nWITHOUT WARRANTY OF ANY KIND, either express or implied.", ["MPL-1.1"]),
    29: ("Licensed under the Apache License, Version 2.0 <LICENSE-APACHE or\nhttp://www.apache.org/licenses/LICENSE-2.0> or the MIT license <LICENSE-MIT or\n"
         "http://opensource.org/licenses/MIT>, at your option.", ["Apache-2.0", "MIT"]),
    30: ("Released under the GPLv2+ or under either the BSD 3-Clause License or LGPL 2.1 only.", ["BSD-3-Clause", "GPL-2.0-or-later", "LGPL-2.1-only"]),
    31: ("END OF TERMS AND CONDITIONS\n\nGNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nHow to Apply These Terms to Your New Programs\n\nThis program is free software; "
         "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of "
         "the License, or (at your option) any later version.", ["GPL-2.0-only"]),
    33: ("words. This is released under the GPLv3.", ["GPL-3.0-only"]),
    32: ("foo is licensed under version 3 of nothing. SPDX-License-Identifier: NOTHING-1.0 OR\nMIT is a place.", []),
}


def test_licences(spark):
    import duckdb

    rows = [(k, v, "en", "s", 0) for k, (v, _) in LICENCE_TEXTS.items()]
    rows += [(1, LICENCE_TEXTS[1][0], "en", "s", 0), (None, LICENCE_TEXTS[2][0], None, None, None)]
    df = spark.createDataFrame(rows, data.DOCS)
    found = licenses.scan(data.clashing(df))
    assert data.as_rows(found, "_row.doc_id", "_licences") == sorted(
        ((k, LICENCE_TEXTS[k or 2][1]) for k, *_ in rows), key=repr
    )
    assert found.where("_row._row = 'x_row'").count() == len(rows)
    assert licenses.scan(data.empty(spark)).count() == 0
    documents = df.toArrow()
    con = duckdb.connect()
    con.register("documents", documents)
    got = found.select("_row.doc_id", F.array_join("_sentences", " "), F.array_join("_licences", " "), F.size("_licences").cast("long"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.execute(licenses.ORACLE).fetchall()))


def test_the_hint_leaves_no_known_sentence_out():
    import re

    rng = random.Random(1)
    for _, forms in licenses.SENTENCES:
        for form in forms:
            spread = "".join(rng.choice([" ", "\n", " -- ", "\t", ", "]) if c == " " else c for c in form)
            assert re.search(licenses.HINT, spread), form
    for name, pattern in licenses.PATTERNS:
        plain = re.sub(r"\[a-z0-9 \]\{1,\d+\}|\[a-z\]\{1,30\}", "words", pattern)
        for _ in range(3):
            plain = re.sub(r"\([^()]*\)\?", "", plain)
        plain = re.sub(r"\(([^()|]*)\|[^()]*\)", r"\1", plain)
        assert re.search(licenses.HINT, plain.replace(" ", " \n ")), name
    ids = {name for name, _ in (*licenses.SENTENCES, *licenses.PATTERNS, *licenses.NAMES)}
    used = {x.rstrip("?") for _, rule in licenses.RULES for x in rule.split()}
    assert used == ids


def brute_top(vectors, k=10, scale=1024):
    kept = {i: np.floor(scale * np.array(v, np.float64)).astype(np.int64) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in kept:
        if q % 5 == 0:
            best = sorted((-int(kept[q] @ kept[c]), c) for c in kept if c != q and len(kept[c]) == len(kept[q]))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [4096, 64])
def test_top_k_is_exact(spark, shard_rows):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)).round(2)
    x[50:150] = x[50]
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors += [(1000, None), (1001, [None] * 8), (1005, [float("nan")] * 8), (None, [1.0] * 8), (1010, [1.0, 2.0]), (1011, [2.0, 2.0]), (1015, [0.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"floor": F.lit(1), "_cell": F.lit("x"), "_row": F.lit(0)})
    found = topk.top_k(df, F.expr("vec_id % 5 = 0"), shard_rows=shard_rows, query_rows=32)
    assert sorted(tuple(r) for r in found.collect()) == brute_top(vectors)
    assert topk.top_k(df.limit(0), F.expr("vec_id % 5 = 0")).count() == 0


def test_top_k_with_large_components():
    x = np.array([[2**40, 1], [2**40, 2], [-(2**40), 3]], np.int64)
    best = topk.search(np.arange(3), np.array([1, 2, 3]), x, np.array([9]), np.array([[2**35, 1]], np.int64), np.array([topk.LOWEST]), 2)
    assert best.held[0][1].tolist() == [1, 2]
    assert best.held[0][0].tolist() == [2**63 - 1, 2**63 - 1]


def test_trees_learn_and_scores_are_whole(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:1500], y[:1500])
    assert ((model.scores(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(60)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.quality_scores(data.clashing(data.docs(spark)), labels)
    rows = found.collect()
    assert len(rows) == len(data.rows())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows if r["doc_id"] is not None)
    assert quality.quality_scores(data.empty(spark), labels).count() == 0
    none = quality.quality_scores(data.docs(spark), labels.limit(0)).agg(F.min("score")).first()[0]
    assert none > 0.99


def walked(model, x):
    """One document's score, tree by tree and node by node."""
    total = model.base
    for statistic, above, leaf in zip(model.statistic.tolist(), model.above.tolist(), model.leaf.tolist()):
        node = 0
        while node < len(statistic):
            node = 2 * node + (2 if x[statistic[node]] > above[node] else 1)
        total += leaf[node - len(statistic)]
    return 1 / (1 + np.exp(-min(30.0, max(-30.0, total))))


def test_scores_equal_a_plain_walk_of_the_trees(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fitted(docs, labels)
    found = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert found[r["doc_id"]] == pytest.approx(walked(model, quality.statistics(r["text"] or "")), abs=1e-12)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, len(quality.STATISTICS)))
    grown = quality.fit(x, (x[:, 3] * x[:, 4] > 0).astype(float), trees=7, depth=3)
    assert grown.scores(x) == pytest.approx([walked(grown, row) for row in x])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.95


def check_shards(rows, shards):
    sizes = Counter(r["shard"] for r in rows)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_shards_are_even_and_copies_together(spark):
    rows = [(i, f"text {i if i % 3 else i // 30}", "en", "s", 1) for i in range(1200)]
    rows += [(5000 + i, "one large group", "en", "s", 1) for i in range(900)]
    found = sharding.balanced_shards(spark.createDataFrame(rows, data.DOCS), 10).collect()
    check_shards(found, 10)
    text = {r[0]: r[1] for r in rows}
    groups = {}
    for r in found:
        groups.setdefault(text[r["doc_id"]], Counter())[r["shard"]] += 1
    assert all(len(c) == 1 for t, c in groups.items() if 1 < sum(c.values()) <= 50)
    assert len(groups["one large group"]) <= 7
    for r in found:
        of = groups[text[r["doc_id"]]]
        assert r["links"] == sum(of.values()) - 1
        assert r["cut_links"] == sum(of.values()) - of[r["shard"]]
    cut = sum(r["cut_links"] for r in found) / sum(r["links"] for r in found)
    assert cut < 0.87  # 0.9 if copies lay anywhere; the large group alone must cut 0.8 and more of its links
    assert sum(r["cut_links"] for r in found if r["links"] < 50) == 0
    odd = sharding.balanced_shards(data.clashing(data.docs(spark)), 7).collect()
    check_shards(odd, 7)
    assert sorted(r["size"] for r in odd) == sorted(len((r[1] or "").encode()) + 16 for r in data.rows())
    assert sorted(r["text_crc32"] for r in odd) == sorted(zlib.crc32((r[1] or "").encode()) for r in data.rows())
    assert sharding.balanced_shards(data.empty(spark)).count() == 0


def test_mixing_meets_targets(spark):
    found = mixing.mix(data.clashing(data.docs(spark, 200))).collect()
    by = {}
    for r in found:
        t = by.setdefault(r["source"], [r["target"], 0, r["source_size"], 0])
        t[1] += r["taken"]
        t[3] += r["size"]
        assert r["taken"] <= 2 * r["size"]
    for target, taken, size, total in by.values():
        assert size == total
        assert target <= 2 * size
        assert taken <= target
    again = mixing.mix(data.docs(spark, 200).repartition(7))
    assert sorted((repr(tuple(r)) for r in found)) == sorted(repr(tuple(r)) for r in again.collect())
    rows = mixing.mixed(data.clashing(data.docs(spark, 200)))
    assert rows.columns == data.clashing(data.docs(spark)).columns
    assert rows.count() == sum(r["copies"] for r in found)
    assert mixing.mix(data.empty(spark)).count() == 0


def greedy(docs, gap):
    """The plain reading: in hash order, whatever still fits."""
    taken = 0
    for _h, size in sorted(docs):
        if 0 < size <= gap - taken:
            taken += size
    return taken


def test_mixing_equals_a_plain_walk(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LOOK", 8)
    rng = random.Random(3)
    rows = [(None if i % 2 else i, data.words(rng, rng.choice([0, 1, 3, 40, 200])), "en", f"s{i % 5}", 1) for i in range(400)]
    rows += [(7, "the same words in each of these rows", "en", "s1", 1)] * 90 + [(8, None, "en", None, 1)] * 3
    df = spark.createDataFrame(rows, data.DOCS).repartition(5)
    found = mixing.mix(df).collect()
    hashed = {}
    for r in mixing.sized(df).collect():
        hashed.setdefault(r["source"], []).append((r["_h"], r["size"]))
    assert sum(len({h for h, _ in s}) for s in hashed.values()) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["source"], []).append(r)
    for source, members in by.items():
        target, size = members[0]["target"], members[0]["source_size"]
        passes = int(target // size) if size else 0
        want = passes * size + greedy(hashed[source], int(target - passes * size))
        assert sum(r["taken"] for r in members) == want
        left = [r["size"] for r in members if r["size"] and r["copies"] == passes]
        assert not left or target - want < min(left) + 1
    assert Counter(map(tuple, found)) == Counter(map(tuple, mixing.mix(df.repartition(2)).collect()))


def brute_components(source, scheme):
    fps = [simhash.fingerprint(t) for _, t, *_ in source]
    parent = list(range(len(source)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(source)):
        for j in range(i):
            if int(np.bitwise_count(fps[i] ^ fps[j]).sum()) <= scheme.limit:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, *_rest) in enumerate(source):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, least.get(find(i))) for i, (d, *_rest) in enumerate(source)), key=repr)


def near_rows():
    rng = random.Random(5)
    rows = list(data.rows(40))
    base = [data.words(rng, 120).split() for _ in range(6)]
    for i in range(60):
        w = list(base[i % 6])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((1000 + i, " ".join(w), "en", "s", 1))
    return rows


def test_fingerprint_by_its_definition():
    import re

    text = "Ein Wort, ZWEI  worte\nÄrger und mehr davon"
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(len(w) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert int(simhash.fingerprint(text)[0]) == want
    assert int(simhash.fingerprint("a b")[0]) == xxhash.xxh64_intdigest(b"a b", 42)
    assert int(simhash.fingerprint(None)[0]) == int(simhash.fingerprint(" \n")[0]) == 0


@pytest.mark.parametrize("scheme", [simhash.EXACT, simhash.MANY])
def test_components_equal_brute_force(spark, scheme):
    source = near_rows()
    df = spark.createDataFrame(source, data.DOCS)
    assert data.as_rows(simhash.near_components(data.clashing(df), scheme), "doc_id", "component_id") == brute_components(source, scheme)
    assert simhash.near_components(data.empty(spark), scheme).count() == 0


def test_of_equal_rows_one_stays_whatever_their_order(spark):
    rows = [(1, "same words", "en", f"s{i % 3}", 1) for i in range(9)] + [(None, None, None, None, None)] * 3 + [(2, "other", "en", "s", 1)]
    df = spark.createDataFrame(rows, data.DOCS)
    found = data.as_rows(simhash.one_of_each(df, simhash.near_components(df)), *df.columns)
    assert sorted(r[0] is None for r in found) == [False, False, True]
    again = df.repartition(3, "source").orderBy("source")
    assert data.as_rows(simhash.one_of_each(again, simhash.near_components(again)), *df.columns) == found


@pytest.mark.parametrize("scheme", [simhash.EXACT, simhash.MANY])
def test_no_link_within_four_bits_is_missed(scheme):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    met = np.zeros(len(a), bool)
    for t in scheme.tables:
        sides = []
        for x in (a, b):
            row, anchor, visiting = simhash.block_anchors(t.values(x[:, None]), t.width, t.threshold)
            sides.append(({*zip(row.tolist(), anchor.tolist())}, {*zip(row[~visiting].tolist(), anchor[~visiting].tolist())}))
        for i, _ in (sides[0][0] & sides[1][1]) | (sides[0][1] & sides[1][0]):
            met[i] = True
    assert met.all()


def test_large_anchors_connect():
    rng = np.random.default_rng(2)
    fp = np.zeros((6000, 1), np.uint64)
    for i in range(6000):
        for bit in rng.choice(64, 3, replace=False):
            fp[i, 0] ^= np.uint64(1 << int(bit))
    fp = np.unique(fp, axis=0)
    a, b = simhash.links(np.zeros(len(fp), np.int64), fp, 4)
    assert len(a) == len(fp) - 1
    assert len(set(b.tolist())) == 1


def plain_chunks(data_):
    """Digest and length of each distinct chunk, byte by byte."""
    at, out = 0, {}
    while at < len(data_):
        h, end = 0, min(at + chunking.LARGEST, len(data_))
        for i in range(max(0, at - 64), at):
            h = ((h << 1) + int(chunking.GEAR[data_[i]])) & 0xFFFFFFFF
        for i in range(at, end):
            h = ((h << 1) + int(chunking.GEAR[data_[i]])) & 0xFFFFFFFF
            size = i + 1 - at
            bits = chunking.STRICT if size < chunking.NORMAL else chunking.LOOSE
            if size >= chunking.SMALLEST and len(data_) - at > chunking.SMALLEST and h >> (32 - bits) == 0:
                end = i + 1
                break
        out[xxhash.xxh3_64_intdigest(data_[at:end]) >> 16] = end - at
        at = end
    return out


def plain_containment(a, b):
    return sum(n for x, n in a.items() if x in b) / sum(a.values()) if a else float(not b)


def test_edited_fingerprints_of_all_rows_equal_a_plain_chunker(spark):
    df = data.clashing(data.docs(spark)).where("doc_id is null or doc_id <> 104")
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("t")).collect()
    want = []
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(text)
        edited = (text[: n - n // 2] + after[: n // 2]).encode()
        own, changed, following = (plain_chunks(x) for x in (text.encode(), edited, after.encode()))
        written = ["".join(f"{d:012x}{k:03x}" for d, k in sorted(c.items())) for c in (own, changed)]
        want.append((doc_id, n, hashlib.sha256(edited).hexdigest(), *written, plain_containment(own, changed), plain_containment(own, following)))
    found = chunking.edited_fingerprints(df)
    assert data.as_rows(found, *found.columns) == sorted(want, key=repr)


def test_edited_fingerprints(spark):
    source = data.rows()
    found = chunking.edited_fingerprints(data.clashing(data.docs(spark)))
    by = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(source)
    assert by[20]["near_next"] == by[21]["near_next"] == 1
    assert by[104]["near_edited"] == pytest.approx(0.5, abs=0.05)
    assert chunking.edited_fingerprints(data.empty(spark)).count() == 0
    single = chunking.edited_fingerprints(data.docs(spark).where("doc_id = 3")).first()
    assert single["near_next"] == 1


def test_chunks_fall_into_step_after_an_insertion():
    text = data.words(random.Random(1), 3000).encode()
    moved = b"some words that were put in front " + text
    a, b = chunking.chunks(text), chunking.chunks(moved)
    assert chunking.containment(a, b) > 0.97
    ends = chunking.cuts(text)
    assert ends[-1] == len(text)
    sizes = np.diff([0, *ends])
    assert sizes.max() <= chunking.LARGEST
    assert sizes[:-1].min() >= chunking.SMALLEST
    h = chunking.gear_hashes(text)
    want = 0
    for c in text[100:132]:
        want = ((want << 1) + int(chunking.GEAR[c])) & 0xFFFFFFFF
    assert int(h[131]) == want
