"""The ten operators on small tables: nulls, empty and long texts, repeats."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("keyfold.llm")
from keyfold.llm import decontaminate, html_text, licences, line_chunks, media, mixing, near_copies, quality, simhash, token_shards, toxicity  # noqa: E402
from keyfold.llm.queries import tokenizer_path  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}{'abcde'[k % 5]}" for k in range(500)]


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(("" if k % 9 else "\n") + WORDS[w] + ("." if k % 7 == 6 else "") for k, w in enumerate(r.integers(0, 500, n))).strip()


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    long = prose(3, 6000)
    rows = [(1, None, "a"), (2, "", None), (3, long, "a"), (3, long, "a"), (None, "no id here", "b"), (5, "one", "b"), (6, prose(4, 80), "a"), (7, prose(4, 80), "c")]
    return table(spark, rows)


def test_token_shards_round_trip(odd):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    got = token_shards.round_trip(odd, tokenizer_path()).orderBy("start").collect()
    rows = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    start = 0
    for g, r in zip(got, rows, strict=True):
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert (g["doc_id"], g["start"], g["n_tokens"]) == (r["doc_id"], start, len(ids))
        assert g["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_parts_are_known_by_their_bytes():
    """Words that polynomial hashes modulo 2**64 can't tell apart, and long parts."""
    from tokenizers import Tokenizer

    lib, enc = Tokenizer.from_file(tokenizer_path()), token_shards.Encoder(tokenizer_path(), slots=64)
    words = []
    for n in (10, 11, 12):
        bits = [k.bit_count() % 2 for k in range(1 << n)]
        words += ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    words += ["abcdefgh" * 3, "abcdefgh" * 3 + "i", "abcdefg", "abcdefg\x0f", "\n", "é" * 12, "é" * 13]
    rng = np.random.default_rng(3)
    texts = [*words, *(" ".join(rng.choice(words + WORDS, 40)) for _ in range(60)), "a\nb c\nd", " x", ""]
    for _ in range(2):
        ids, count = enc.encode([t.encode() for t in texts])
        edge = np.r_[0, np.cumsum(count)]
        for k, t in enumerate(texts):
            assert ids[edge[k] : edge[k + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids


def test_repair_ends_when_no_pair_is_frequent():
    rng = np.random.default_rng(8)
    for vocab, ids in ((100, np.tile(rng.integers(0, 100, 64), 400)), (70_000, np.r_[rng.integers(0, 70_000, 500), np.tile(rng.integers(0, 70_000, 40), 90)]), (9, np.zeros(5000, np.int64)), (9, rng.integers(0, 3, 4000)), (9, np.zeros(0, np.int64))):
        cut = sorted(rng.integers(0, len(ids) + 1, 4).tolist())
        counts = np.diff([0, *cut, len(ids)])
        blob = token_shards.pack(ids, counts, [5, None, 7, 8, 9], vocab)
        shard = token_shards.Shard(blob)
        pairs = {}
        for a, b in zip(shard.symbols[:-1].tolist(), shard.symbols[1:].tolist()):
            if vocab not in (a, b):
                pairs[a, b] = pairs.get((a, b), 0) + 1
        assert max(pairs.values(), default=0) < token_shards.MIN_COUNT
        assert shard.doc_ids == [5, None, 7, 8, 9] and shard.lengths().tolist() == (counts + 1).tolist()
        for k, (a, n) in enumerate(zip(np.r_[0, np.cumsum(counts)[:-1]].tolist(), counts.tolist())):
            own = shard.document(k).tolist()
            assert own == [*ids[a : a + n].tolist(), token_shards.END_ID]


def test_line_chunks_remove_repeats_only(spark):
    passage = prose(50, 90)
    rows = [(k, prose(100 + k, 60) + ".\n" + passage + ".\n" + prose(200 + k, 60), "a") for k in range(5)]
    rows += [(k, prose(300 + k, 200), "a") for k in range(10, 15)]
    got = {r["doc_id"]: r for r in line_chunks.remove_repeats(table(spark, rows)).collect()}
    texts = {i: t for i, t, _ in rows}
    for k in range(5):
        assert got[k]["repeated_bytes"] > len(passage) / 2
        assert (got[k]["line_text"] == texts[k]) == (k == 0)
    for k in range(10, 15):
        assert got[k]["line_text"] == texts[k] and got[k]["repeated_bytes"] == 0
    for r in got.values():
        gone, raw, at, kept = r["removed"], r["text"].encode(), 0, []
        for s in gone:
            kept.append(raw[at : s["place"]])
            at = s["place"] + s["size"]
        assert b"".join([*kept, raw[at:]]).decode() == r["line_text"]


def test_short_passages_of_two_lines_go(spark):
    twice = "Seven short words stand in this line.\nSeven more short words stand in here.\n"
    rows = [(k, prose(600 + k, 40) + ".\nStop here at once.\n" + twice + prose(700 + k, 40), "a") for k in range(50)]
    got = line_chunks.remove_repeats(table(spark, rows)).collect()
    assert sum(len(r["removed"]) > 0 for r in got) >= 40


def test_passages_of_fifty_words_go_to_their_edges(spark):
    rng = np.random.default_rng(77)
    sentence = lambda: " ".join(rng.choice(WORDS, 11)).capitalize() + "."
    rows, passages = [], []
    for g in range(120):
        passages.append(" ".join(sentence() for _ in range(5)))
        for k in range(2):
            own = [" ".join(sentence() for _ in range(6)) for _ in range(2)]
            rows.append((2 * g + k, f"{own[0]} {passages[-1]} {own[1]}", "a"))
    got = {r["doc_id"]: r for r in line_chunks.remove_repeats(table(spark, rows)).collect()}
    texts = {i: t for i, t, _ in rows}
    assert all(got[2 * g]["line_text"] == texts[2 * g] for g in range(120))
    left = [texts[2 * g + 1].replace(passages[g] + " ", "") for g in range(120)]
    exact = sum(got[2 * g + 1]["line_text"] == left[g] for g in range(120))
    assert exact >= 0.88 * 120
    for g in range(120):  # nothing that occurs once goes
        assert got[2 * g + 1]["line_text"] in (texts[2 * g + 1], left[g])


def test_lines_beside_an_anchor_count_only_with_it(spark):
    """A line that is frequent, but not beside the same passage, stays."""
    passage = [prose(800, 70), prose(801, 70)]
    stock = "This line is frequent."
    rows = [(k, f"{prose(810 + k, 40)}.\n{stock}\n{passage[k % 2]}.\n{prose(830 + k, 40)}", "a") for k in range(2)]
    rows += [(10 + k, f"{prose(850 + k, 40)}.\n{stock}\n{prose(870 + k, 40)}", "a") for k in range(6)]
    for r in line_chunks.remove_repeats(table(spark, rows)).collect():
        assert r["line_text"] == r["text"]


def test_lines_cover_their_texts():
    from keyfold.llm.textkit import chunks

    texts = ["", "a b. c\n\nd! e", "\n", " x ", "é.\nü? z", None, "end.\n"]
    for c in chunks(texts, lower=False):
        start, end, at = line_chunks.cut_lines(c)
        for d, t in enumerate(texts):
            own = slice(at[d], at[d + 1])
            assert b"".join(c.raw[a:b] for a, b in zip(start[own], end[own], strict=True)) == (t or "").encode()


def test_leaks_against_brute_force(spark):
    items = [(1, prose(900, 30)), (2, prose(901, 12)), (3, "only three words"), (4, ""), (5, None), (6, prose(902, 40))]
    near = prose(902, 40).split()
    near[20] = "changed"
    rows = [(k, prose(k, 150), "a") for k in range(12)]
    rows += [(20, prose(20, 70) + " " + items[0][1] + " " + prose(21, 70), "a"), (21, items[1][1], "a"), (22, "so only three words here", "a"), (23, prose(23, 30) + " " + " ".join(near) + " tail", "a"), (24, None, "a"), (25, "", "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table(spark, rows), bench).collect()}

    def shingles(w):
        k = min(5, len(w))
        return decontaminate.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    want = set()
    for d, t, _ in rows:
        w = (t or "").lower().split()
        for i, it in items:
            own = (it or "").lower().split()
            k = min(5, len(own))
            for a in range(len(w) - len(own) + 1 if own else 0):
                part = w[a : a + len(own)]
                c = decontaminate.Counter(tuple(part[j : j + k]) for j in range(len(part) - k + 1))
                if decontaminate.similarity(c, shingles(own)) >= 0.8:
                    want.add((d, i))
    assert got == want and (20, 1) in got and (22, 3) in got
    left = decontaminate.without_leaks(table(spark, rows), bench)
    assert {r["doc_id"] for r in left.collect()} == {d for d, _, _ in rows} - {d for d, _ in want}
    assert decontaminate.leaks(table(spark, rows), bench.limit(0)).count() == 0


def test_texts_shorter_than_the_item_leak(spark):
    item = prose(910, 50).split()
    rows = [(n, " ".join(item[:n]), "a") for n in range(1, 51)] + [(100, " ".join(item[1:]), "a"), (101, prose(911, 49), "a")]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.leaks(table(spark, rows), bench).collect()}

    def shingles(w):
        return decontaminate.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))

    want = {d for d, t, _ in rows if decontaminate.similarity(shingles(t.lower().split()), shingles([w.lower() for w in item])) >= 0.8}
    assert got.keys() == want and {49, 100} < want
    assert (got[49]["first_word"], got[49]["n_words"], got[49]["similarity"]) == (0, 49, 45 / 46)
    assert {r["doc_id"] for r in decontaminate.without_leaks(table(spark, rows), bench).collect()} == {d for d, _, _ in rows} - want


def test_block_index_gives_all_within_radius():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    g = decontaminate.Items(5, [(k, 9, np.array([b], np.uint64)) for k, b in enumerate(base)])
    windows = base[r.integers(0, 40, 200)].copy()
    for k in range(200):
        for b in r.choice(64, r.integers(0, 30), replace=False):
            windows[k] ^= np.uint64(1) << np.uint64(b)
    got = sorted((w, i) for _, w, i in g.candidates(windows, 23))
    dist = np.bitwise_count(windows[:, None] ^ g.prints[None])
    assert got == sorted(map(tuple, np.argwhere(dist <= 23).tolist()))


def test_licences(spark):
    rows = [(1, "Text. Released under the MIT License.\nMore", "a"), (2, None, "a"), (3, "", "a"), (4, "You may not use this file except in compliance with the License. Words here! You may obtain a copy of the License at\nhttp", "a"), (5, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License. Released under the MIT License.", "a")]
    got = {r["doc_id"]: r["licences"] for r in licences.scan(table(spark, rows)).collect()}
    assert got == {1: ["MIT"], 2: [], 3: [], 4: [], 5: ["Apache-2.0", "MIT"]}


MIT_TEXT = """MIT License

Copyright (c) 2022 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
GPL_HEADER = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * More text of the program
 */"""
APACHE_HEADER = """# A line without a full stop
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless"""


def test_wrapped_licences_and_headers(spark):
    """Licences as they are published, the SQL's rows too."""
    import duckdb

    want = {
        1: (MIT_TEXT, "MIT"),
        2: (MIT_TEXT.replace("\n", "\r\n"), "MIT"),
        3: (BSD_TEXT, "BSD"),
        4: (GPL_HEADER, "GPL-3.0"),
        5: (APACHE_HEADER, "Apache-2.0"),
        6: ("SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.1"),
        7: ("This project is released under the MIT licence.", "MIT"),
        8: ("text without a stop\nLicensed under CC BY 4.0\nmore text", "CC-BY-4.0"),
        9: ("software line\n" * 3000 + MIT_TEXT, "MIT"),
        10: ("This is not licensed under the MIT License.", ""),
        11: (None, ""),
        12: ("", ""),
        13: (MIT_TEXT.replace("hereby", "never"), ""),
    }
    df = table(spark, [(k, t, "a") for k, (t, _) in want.items()])
    got = {r["doc_id"]: (" ".join(r["sentence_ids"]), " ".join(r["licences"])) for r in licences.scan(df).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v for k, (_, v) in want.items()}
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert {r[0]: (r[1], r[2]) for r in con.execute(licences.oracle()).fetchall()} == got
    assert licences.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licences.scan(df.withColumn("Licences", F.lit(1)))


def test_known_sentences_are_likely():
    import re

    assert all(re.search(licences.LIKELY, s) for s in licences.KNOWN)


def test_simhash_components_against_brute_force(spark, odd):
    base = prose(7, 120)
    rows = [(k, base if k % 3 else base + f" x{k % 2}", "a") for k in range(30)] + [(100 + k, prose(500 + k, 60), "a") for k in range(30)] + [(200, None, "a"), (201, "", "a")]
    got = simhash.near_duplicates(table(spark, rows), tile=8).collect()
    fp = {r["doc_id"]: int(r["fingerprint"], 16) for r in got}
    comp = {d: d for d in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 2 and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    assert {r["doc_id"]: r["component_id"] for r in got} == comp
    assert simhash.near_duplicates(odd).count() == odd.count()


def test_keep_one_against_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = []
    for g in range(40):
        base = prose(2000 + g, 60 + 3 * g).split()
        rows.append((len(rows), " ".join(base), "a"))
        for edits in (1, 2, 3, 4):
            near = list(base)
            for at in rng.integers(0, len(near), max(edits * len(near) // 90, 1)):
                near[at] = f"new{len(rows)}"
            rows.append((len(rows), " ".join(near), "a"))
    hub = prose(3000, 100).split()
    for k in range(60):
        rows.append((len(rows), " ".join([*hub[:k], f"own{k}", *hub[k + 1 :]]), "a"))
    rows += [(len(rows) + k, t, "a") for k, t in enumerate(["", None, "one two", "one two", " ".join(hub)])]
    rows += [(len(rows) + k, f"closing w{k} " + " ".join(hub[:3]), "b") for k in range(5)]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    want = {top(k) for k in range(len(rows))}
    assert {r["doc_id"] for r in near_copies.keep_one(table(spark, rows), tile=16).collect()} == want
    assert 40 < len(want) < 200


def test_near_copies_that_share_no_early_shingles(spark):
    """Copies at 0.8 whose differences lie at the shingles of the least hashes:
    none of the first twenty of the one text is in the other."""
    from keyfold.llm.textkit import Chunk, set_hashes

    def shingles(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    rows, kept = [], set()
    for seed in range(6):
        r = np.random.default_rng(seed)
        words = [f"t{seed}{x}" for x in r.integers(0, 10**9, 1500)]
        edited = list(words)
        h, _ = set_hashes(Chunk(0, [" ".join(words).encode()], True), 5)
        for k in np.argsort(h)[:28].tolist():
            edited[k + 2] = f"edit{seed}x{k}"
        a, b = shingles(" ".join(words)), shingles(" ".join(edited))
        assert 5 * len(a & b) >= 4 * len(a | b)
        kept.add(len(rows))
        rows += [(len(rows), " ".join(words), "a"), (len(rows) + 1, " ".join(edited), "a")]
    assert {r["doc_id"] for r in near_copies.keep_one(table(spark, rows)).collect()} == kept


def test_frequent_shingles_count_every_text(spark):
    texts = spark.range(17000).selectExpr("concat('one two three four five ', id, ' a', id, ' b', id) text")
    terms, counts = near_copies.frequent_shingles(texts, 5)
    assert counts.tolist() == [17000] and len(terms) == 1


def test_prefixes_share_what_is_required():
    """Of pairs at 0.8, prefixes by any order share the required keys."""
    rng = np.random.default_rng(3)
    for x in range(1, 90):
        for y in range(x, x * 5 // 4 + 1):
            shared = -(-4 * (x + y) // 9)
            if shared > x:
                continue
            p, q = (int(near_copies.prefix_sizes(np.array([n]))[0]) for n in (x, y))
            least = near_copies.required(np.array([x]), np.array([y]))[0]
            assert 1 <= least <= p <= x and q <= y
            a, b = np.arange(x), np.r_[np.arange(shared), np.arange(x, x + y - shared)]
            for late in (0, 1, -1):  # what is shared comes anywhere, last or first in the order
                order = rng.random(x + y) + late * (np.arange(x + y) < shared)
                common = np.intersect1d(a[np.argsort(order[a])][:p], b[np.argsort(order[b])][:q])
                assert len(common) >= least


def test_mixing_hits_targets(spark, odd):
    rows = [(k, prose(k, 20 + k % 50), "abc"[k % 3]) for k in range(300)]
    got = mixing.mix(table(spark, rows)).toPandas()
    assert (got["taken"] <= 3 * got["size"]).all()
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(per["taken"] - per["target"]) <= 0.02 * per["target"] + 70).all()
    assert mixing.mix(odd).count() == odd.count()


def test_media_round_trip(odd):
    import hashlib

    got = media.media_columns(odd).collect()
    want = sorted(hashlib.sha256((p := (r["text"] or "").encode()) + b"\xff" * (max(-(-len(p) // 576), 1) * 576 - len(p))).hexdigest() for r in odd.collect())
    assert sorted(r["payload_sha256"] for r in got) == want


def test_classifiers_learn_and_take_odd_rows(spark, odd):
    rows = [(k, prose(k, 40) + (" vile slur" if k % 2 else " kind note"), "a") for k in range(120)]
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(120)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    w = quality.train(docs, labels, "quality", ~quality.held_out(3, 1))
    held = quality.score(docs, w).where(quality.held_out(3, 1)).select((F.col("score") >= 0.5).cast("int").alias("p"), (F.col("doc_id") % 2).alias("y")).collect()
    assert np.mean([r["p"] == r["y"] for r in held]) > 0.9
    index = toxicity.build_index(docs, labels, "toxic", ~quality.held_out(5, 0))
    held = toxicity.score(docs, index).where(quality.held_out(5, 0)).select((F.col("score") >= 0.5).cast("int").alias("p"), (F.col("doc_id") % 2).alias("y")).collect()
    assert np.mean([r["p"] == r["y"] for r in held]) > 0.9
    for scored in (quality.score(odd, w), toxicity.score(odd, index)):
        assert all(0 <= r["score"] <= 1 for r in scored.collect()) and scored.count() == odd.count()


def test_empty_tables(odd):
    none = odd.limit(0)
    for got in (line_chunks.remove_repeats(none), licences.scan(none), simhash.near_duplicates(none), mixing.mix(none), media.media_columns(none), token_shards.round_trip(none, tokenizer_path())):
        assert got.count() == 0


def test_odd_rows_keep_their_texts(odd):
    got = line_chunks.remove_repeats(odd)
    assert got.count() == odd.count()
    assert {r["line_text"] for r in got.where("doc_id in (1, 2, 5)").collect()} == {None, "", "one"}


def test_nearest_examples_equal_brute_force():
    rng = np.random.default_rng(5)
    n_terms, n, k = 60, 700, 15
    rows = []
    for i in range(n):
        t = np.sort(rng.choice(n_terms, rng.integers(1, 9), replace=False))
        rows.append((i, int(rng.integers(2)), t.tolist(), rng.integers(1, 4, len(t)).tolist()))
    rows += [(n + i, 1, rows[0][2], rows[0][3]) for i in range(40)]  # ties beyond k
    index = toxicity.BlockMaxIndex(np.arange(n_terms, dtype=np.uint64), rows)
    dense = np.zeros((len(rows), n_terms))
    for i, (t, w) in enumerate(index.rows):
        dense[i, t] = w
    cosine = np.round(dense @ dense.T, 12)
    for skip in (False, True):
        for q, (found, value) in enumerate(index.nearest_of(index.rows, k, np.arange(len(rows)) if skip else None)):
            c = cosine[q].copy()
            if skip:
                c[q] = 0
            best = np.lexsort((index.ids, -c))[:k]
            best = best[c[best] > 0]
            assert np.allclose(value, c[best], atol=1e-11)
            assert found.tolist() == best.tolist()


def test_html_attributes_of_any_length(spark):
    article = " ".join(prose(40, 120).split())
    page = "<html><body><div><p>{}</p>{}<p>{}</p></div></body></html>"
    long = "QUJD" * 50_000
    want = html_text.main_text(page.format(article, "", article))
    assert article in want
    images = [f"<img src={q}data:image/png;base64,{long}{q}>" for q in "\"'"]
    pages = [(k, "u", page.format(article, image, article)) for k, image in enumerate(images)]
    got = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert [r["text"] for r in got] == [want, want]


PARA = "<p>" + "Words of the article go here, and some more of them. " * 6 + "</p>"


def test_html_wrappers_are_no_noise():
    """Classes that name states, and forms or names around the whole page."""
    text, nav = html_text.main_text(PARA), "<nav><a href=x>Home</a></nav>"
    for page in (
        f'{nav}<div class="layout has-sidebar">{PARA}</div>',
        f'{nav}<div class="no-sidebar">{PARA}</div>',
        f'{nav}<div class="post comments-open">{PARA}<div class="comments"><p>Nice one</p></div></div>',
        f'<form action=x><input name=v>{nav}<div>{PARA}</div><div class="comments">{PARA * 3}</div><div class=footer>foot</div></form>',
        f'<div class="sidebar-layout"><main>{PARA}</main><div class="sidebar">side</div></div>',
        f"<div>{PARA}</div><form><p>Log in here</p><input></form>",
        f'<div class="ad-slot">{PARA}</div><div>{PARA}</div><div id="cookieNotice">{PARA}</div>',
    ):
        assert html_text.main_text(f"<body>{page}</body>") == text, page
    assert html_text.main_text('<div class="cookie"><span>we use cookies</span></div>') == ""


def test_html_lists_of_links():
    refs = "<ol><li><a href=1>One</a><li><a href=2>Two</a></ol>"
    page = f"<article>{PARA}{refs}<h2>References</h2>{refs}<h2>Related posts</h2>{refs}<p>See these:</p>{refs}</article>"
    assert html_text.main_text(page).split("\n\n")[1:] == ["References", "One", "Two", "Related posts", "See these:", "One", "Two"]


def test_html_deep_pages_end_soon():
    """Deep nesting and end tags without a start: time linear in the page."""
    import time

    start = time.process_time()
    for page in ("<div>" * 40000 + PARA, "<div>" * 20000 + "<li>a</li>" * 20000, "<div>" * 20000 + "</section>" * 20000, "<b><div>" + "<i>" * 20000 + "</b>" * 20000, "<div class=sidebar>" * 20000 + PARA):
        assert html_text.main_text(page)[:4] in ("Word", "a\n\na", "")
    assert time.process_time() - start < 30


def test_html_odd_pages(spark):
    """Null, empty, textless and repeated pages, and columns with the names of results."""
    schema = "page_id long, url string, html string, text string, n_chars long"
    rows = [(1, "u", None, "x", 7), (1, "u", "", "x", 7), (None, None, "no tags &amp; entities", "x", 7), (3, "u", "<p></p>", "x", 7), (4, "u", PARA, "x", 7), (4, "u", PARA, "x", 7)]
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_text.extract(spark.createDataFrame(rows, schema)).collect())
    text = html_text.main_text(PARA)
    assert got == [(0, "no tags & entities", 18), (1, "", 0), (1, "", 0), (3, "", 0), (4, text, len(text)), (4, text, len(text))]
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


def test_html_unclosed_quotes():
    article = " ".join(prose(41, 120).split())
    head = f"<body><div><p>{article}</p>"
    want = html_text.main_text(head)
    assert html_text.main_text(head + '<img src="data:' + "QUJD" * 50_000) == want
    assert html_text.main_text(head + '<img src="data:QUJD></div>') == want
    assert html_text.main_text(head + "<i title='" * 20_000) == want


def test_parts_are_learnt_in_short_texts():
    """However many parts are new, no text given to the library is long, and the ids are the library's."""
    enc = token_shards.Encoder(tokenizer_path())
    lib, given = enc.lib, []

    class Library:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return lib.encode_batch_fast(texts, **options)

    enc.lib = Library()
    parts = [f"{' ' * (k % 2)}word{k}".encode() for k in range(3 * token_shards.LEARN_PARTS + 1)]
    ids, number = enc.learn(parts)
    want = [lib.encode(p.decode(), add_special_tokens=False).ids for p in parts]
    assert ids.tolist() == [x for w in want for x in w] and number.tolist() == [len(w) for w in want]
    assert max(t.count("\n") for t in given) < token_shards.LEARN_PARTS


def test_parts_are_given_to_the_library_once():
    """Words with other signs around them aren't new parts; the ids stay the library's."""
    enc = token_shards.Encoder(tokenizer_path())
    lib, given = enc.lib, []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return self.inner.encode_batch_fast(texts, **options)

        def tokenize(self, word):
            given.append(word)
            return self.inner.tokenize(word)

    enc.lib, enc.model = Counted(lib), Counted(lib.model)
    texts = [f"x {a}{w}{b}" for w in ("stone", "Müller", "вода", "it's", "we'll", "1984") for a in ("", '"', "(", "¿") for b in ("", ".", ",", "!", "?", '"', ").", "'s", ";\ny")]
    ids, number = enc.encode([t.encode() for t in texts])
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and number.tolist() == [len(w) for w in want]
    pieces = {p for t in texts for p, _ in lib.pre_tokenizer.pre_tokenize_str(t)}
    assert sorted(given) == sorted(pieces)


def test_cuts_are_those_of_the_library():
    """Every sign of one or two bytes beside each kind, quoted endings, and bytes that are no UTF-8."""
    enc = token_shards.Encoder(tokenizer_path())
    signs = [f"{a}{chr(c)}{b}" for c in range(0x502) for a in ("", "a", "1", "!", " ", "x'") for b in ("", "a", "1", "!", "'s")]
    rng = np.random.default_rng(5)
    pool = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "'S", "'l", " ", "\n", "a", "s", "ll", "é", "ж", "1", "²", "!", "́", "“", "\t", "<|endoftext|>"]
    mixed = ["".join(rng.choice(pool[: 21 if k % 4 else None], rng.integers(0, 12))) for k in range(3000)]
    texts = [*(t.encode() for t in [*signs, *mixed]), b"ab\x80c", b"d\xc3", b"\xc3\x28 e"]
    ids, number = enc.encode(texts)
    assert sum(enc.simple(texts)) > len(texts) // 2
    want = [enc.lib.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and number.tolist() == [len(w) for w in want]


def test_repair_counts_places_that_a_dropped_pair_took():
    """(1, 2) goes at 12 places; at 15 it yields to pairs that in the end keep too few places."""
    free, out, vocab = iter(range(10, 10_000)), [], 10_000
    for c in (3, 4, 5):
        out += [x for _ in range(5) for x in (1, 2, c, next(free))]
        out += [x for _ in range(25) for x in (next(free), 2, c, 6)]
        out += [x for _ in range(15) for x in (next(free), c, 6)]
    out += [x for _ in range(12) for x in (next(free), 1, 2)]
    ids = np.array([*out, next(free)])
    shard = token_shards.Shard(token_shards.pack(ids, np.array([len(ids)]), [1], vocab))
    assert shard.all_ids().tolist() == [*ids.tolist(), token_shards.END_ID]
    _, count = np.unique(np.stack([shard.symbols[:-1], shard.symbols[1:]]), axis=1, return_counts=True)
    assert count.max() < token_shards.MIN_COUNT
