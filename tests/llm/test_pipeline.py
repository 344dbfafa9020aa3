"""The corpus pipeline on planted documents, and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("keyfold.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from keyfold.llm import line_chunks, mixing, quality, toxicity  # noqa: E402
from keyfold.llm.queries import tokenizer_path  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}{'abcde'[k % 5]}" for k in range(600)]


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[w] + ("." if k % 9 == 8 else "") for k, w in enumerate(r.integers(0, 600, n)))


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rows = [(k, prose(k, 60 + k % 40), "en", "abc"[k % 3], 0) for k in range(120)]
    rows += [(200 + k, rows[k][1], "en", "a", 0) for k in range(10)]  # exact copies
    near = rows[20][1].split()
    rows.append((300, " ".join(near[:40] + ["other"] + near[41:]), "en", "b", 0))
    item = prose(999, 40)
    rows += [(400, prose(1000, 30) + " " + item + " " + prose(1001, 30), "en", "c", 0), (401, None, "en", None, 0), (402, "", "en", "c", 0)]
    rows += [(500 + k, "!!! ### $$$ %%% " * (5 + k), "xx", "b", 0) for k in range(20)]  # junk
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 120, 2)] + [(500 + k, 0, 0) for k in range(0, 20, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_and_their_effects(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept, out = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialise(stage(spark, out, folder), "test-" + name.replace(" ", "-").lower())
        assert out.columns == docs.columns, name
        kept.append([r["doc_id"] for r in out.select("doc_id").collect()])
    good, apart, clean, mixed = kept
    # Junk goes and prose stays.
    assert not {k for k in good if k >= 500} and set(range(120)) <= set(good)
    # One of each group of near copies, by brute force over all pairs.
    sets, group = {k: shingles(text[k] or "") for k in good}, {k: k for k in good}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for i, a in enumerate(good):
        for b in good[:i]:
            x, y = sets[a], sets[b]
            if (x or y) and len(x & y) >= 0.8 * len(x | y) or not (x or y):
                group[root(a)] = root(b)
    assert len(apart) == len({root(k) for k in good}) and {root(k) for k in apart} == {root(k) for k in good}
    # Only the leak goes.
    assert set(apart) - set(clean) == {400}
    # The mix takes each document of the clean ones at most three times.
    assert set(mixed) <= set(clean) and max(map(mixed.count, set(mixed))) <= 3
    # The last stage's ids are those of the library.
    lib = Tokenizer.from_file(tokenizer_path())
    want = sorted((k, len(lib.encode(text[k] or "", add_special_tokens=False).ids) + 1) for k in mixed)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == want


def test_empty_documents(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 30").withColumns({c: F.lit(c) for c in ("mix_row", "copy", "copies", "line_mark")})
    got = mixing.mix_documents(docs)
    assert got.columns == docs.columns and {tuple(r) for r in got.select("mix_row", "copy", "copies", "line_mark").distinct().collect()} == {("mix_row", "copy", "copies", "line_mark")}
    lines = line_chunks.remove_repeats(docs)
    assert lines.select("line_mark").distinct().collect()[0][0] == "line_mark"
    for c in ("spans", "line_text", "removed"):
        with pytest.raises(ValueError):
            line_chunks.remove_repeats(docs.withColumn(c, F.lit(1)))
    index = toxicity.build_index(docs, spark.read.parquet(f"{folder}/labels.parquet"), "toxic", ~quality.held_out(5, 0))
    with pytest.raises(ValueError):
        toxicity.score(docs.withColumn("Score", F.lit(1)), index)
