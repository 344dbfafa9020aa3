"""Conversation repair, whitening and the language model against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("keyfold.llm")
from keyfold.llm import language_model as lm  # noqa: E402
from keyfold.llm import queries, quality, turns, whitening  # noqa: E402

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"
NEXT = {("Z", "s"): "S", ("Z", "u"): "U", ("S", "u"): "U", ("A", "u"): "U", ("U", "a"): "A"}


def least(rows):
    """(cost, audit, lines) by plain recursion over (turn, state): rows of (role, text, must go, truncated)."""
    best = {}

    def go(j, state, inserts):
        if (j, state, inserts) in best:
            return best[j, state, inserts]
        ways = [(0, "", ())] if j == len(rows) and state in "ZA" else []
        if j < len(rows):
            role, text, gone, cut = rows[j]
            c, a, out = go(j + 1, state, 2)
            ways.append((c + 4, "D" + a, out))
            if not gone:
                if (state, role[:1]) in NEXT:
                    c, a, out = go(j + 1, NEXT[state, role[:1]], 2)
                    ways.append((c + 3 * cut, "K" + a, (f"{role}:{text}", *out)))
                for new in ("user", "assistant"):
                    if (state, new[0]) in NEXT:
                        c, a, out = go(j + 1, NEXT[state, new[0]], 2)
                        ways.append((c + 3 + 3 * cut, "R" + a, (f"{new}:{text}", *out)))
        if inserts:
            for new in ("user", "assistant"):
                if (state, new[0]) in NEXT:
                    c, a, out = go(j, NEXT[state, new[0]], inserts - 1)
                    ways.append((c + 3, "I" + a, (f"{new}:", *out)))
        best[j, state, inserts] = min(ways, default=(math.inf, "", ()))
        return best[j, state, inserts]

    return go(0, "Z", 2)


def expected(rows):
    """What op11 should return, from (conv_id, turn, role, text), row by row."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        role, text, fault = show(role), show(text), zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        convs[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    out = {}
    for conv, got in convs.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked, n = set(), [], Counter()
        for _, role, text in got:
            body = text.rstrip(SPACE)
            kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            n[kind] += 1
            marked.append((role, text, kind in ("blank", "duplicate"), kind == "truncated"))
        known = [t for t, _, _ in got if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = least(marked)
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(spark, rows, **more):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(v) for c, v in more.items()})
    got = turns.repair(turns.damage(df))
    both = got.report.join(turns.digests(got.turns).withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")))
    out = [(r["conv_id"], tuple(r[c] for c in COLUMNS)) for r in both.collect()]
    assert len(dict(out)) == len(out)
    return dict(out)


def test_op11_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_conversation_repair(spark, SF).collect()}
    assert got == expected(rows)


def test_repair_of_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(turns, "PIECE", 7)
    rnd = random.Random(5)
    rows = [(None, None, None, None), (None, 3, "user", "a b?"), (1, 5, "tool", "x" * 200_000), (1, None, "user", " "), (1, -9, "assistant", " .  "), (2, 1, "", ""), (2, 1, "", "")]
    rows += [(3, k // 2, rnd.choice(["system", "user", "assistant", "tool"]), rnd.choice(["ok.", "hm", "ja?", " ", "nein!"]) + str(k % 9) * (k % 3)) for k in range(150)]
    for c in range(4, 60):
        rows += [(c, rnd.choice([None, *range(12)]), rnd.choice(["system", "user", "assistant", "user", "assistant", None]), rnd.choice(["ok.", "hm", "ja?", "", None, "nein!"])) for _ in range(rnd.randrange(1, 12))]
    want = expected(rows)
    assert repaired(spark, rows, mark="x", place=1, gone=True) == want
    assert repaired(spark, [], piece=1) == {}


def test_layers_equal_recursion():
    rnd = random.Random(2)
    role = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
    for _ in range(400):
        letters = "".join(rnd.choice("suaoxSUAO") for _ in range(rnd.randrange(0, 9)))
        rows = [(role[c.lower()], str(k), c == "x", c.isupper()) for k, c in enumerate(letters)]
        cost, audit, lines = least(rows)
        assert turns.repaired(letters) == (cost, audit), letters
        cuts = sorted(rnd.choices(range(len(letters) + 1), k=2))
        parts = [letters[: cuts[0]], letters[cuts[0] : cuts[1]], letters[cuts[1] :]]
        assert turns._accepted(turns._product([turns.matrix(p) for p in parts])) == (cost, audit)
        kept = turns._left("Z", [0] * len(rows), [r[0] for r in rows], [r[1] for r in rows], letters, audit)
        assert [f"{t['role']}:{t['text']}" for t in kept] == list(lines)


def test_long_conversations_meet(spark):
    rows = [(7, k, "user" if k % 2 == 0 else "assistant", f"turn {k}" + "." * (k % 5 > 0)) for k in range(3000)] + [(8, k, "user", f"q{k}?") for k in range(1200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = turns.repair(df)
    report = {r["conv_id"]: r for r in got.report.collect()}
    assert (report[7]["cost"], report[7]["truncated"]) == (3 * 600, 600) and report[7]["audit"] == "K" * 3000
    assert report[8]["illegal"] == 1199 and report[8]["cost"] == 3 * 600 and report[8]["gaps"] == 0
    digest = {r["conv_id"]: r["repaired_sha256"] for r in turns.digests(got.turns).collect()}
    assert digest[7] == hashlib.sha256("\n".join(f"{r}:{t}" for c, _, r, t in rows if c == 7).encode()).hexdigest()
    assert got.turns.where("not whole").count() > 2


def whiten_slowly(rows):
    """n, deviations, covariance in fractions."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    dev = [[n * r[j] - s[j] for j in range(d)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in dev), n**3) for j in range(d)] for i in range(d)]
    return n, dev, cov


def check_whitening(spark, rows, got, dims=None):
    n, dev, cov = whiten_slowly(rows)
    v = np.array([[float(x) for x in r] for r in cov])
    e = np.linalg.eigvalsh(v)[::-1]
    by = defaultdict(dict)
    for r in got:
        by[r["vec_id"]][r["component"]] = r
    k = max(len(x) for x in by.values())
    assert len(by) == n and all(sorted(x) == list(range(1, k + 1)) for x in by.values()) and k == (dims or min(32, len(v)))
    z = np.array([[by[i][c + 1]["whitened"] for c in range(k)] for i in sorted(by)])
    for i, row in zip(sorted(by), dev, strict=True):
        assert by[i][1]["deviation_exact"] == str(sum(x * x for x in row)) and by[i][1]["n"] == n
    assert np.abs(np.cov(z.T, bias=True) - np.eye(k)).max() < 1e-6
    # z = D v / sqrt(e) with one v for all rows, v an eigenvector.
    d = np.array([[x / n for x in r] for r in dev])
    basis = np.linalg.lstsq(d, z * np.sqrt(e[:k]), rcond=None)[0]
    assert np.allclose(v @ basis, basis * e[:k], atol=1e-6 * e[0])
    some = next(iter(by.values()))
    assert np.allclose([some[c + 1]["explained"] for c in range(k)], e[:k] / np.trace(v), rtol=1e-6)
    assert all(r["identity_error"] < 1e-6 for r in got)


def test_op12_query_equals_exact_fractions(spark):
    rows = [list(map(float, r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    check_whitening(spark, [r[:] for r in rows][:], queries.op12_embedding_whitening(spark, SF).collect())


def test_whitening_of_odd_vectors(spark):
    rnd = np.random.default_rng(1)
    fine = [[float(a), float(b * 1e5), float(c)] for a, b, c in rnd.normal(size=(40, 3)) * 5e3]
    odd = [None, [], [1.0], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0]]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(fine + odd)], "vec_id long, embedding array<double>").withColumn("n", F.lit("x"))
    got = whitening.whiten(df.repartition(3)).collect()
    check_whitening(spark, fine, got)
    assert all(r["deviation"] is None or str(r["deviation"]) == r["deviation_exact"] for r in got)
    same = spark.createDataFrame([(1, [1.0, 2.0])] * 3 + [(None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.limit(0)).count() == 0
    pair = spark.createDataFrame([(1, [1.0, 2.0]), (None, [2.0, 4.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(pair).count() == 3


def test_limbs_are_exact():
    rnd = np.random.default_rng(3)
    y = np.concatenate([rnd.integers(-(1 << 61), 1 << 61, (9000, 2)).astype(float), [[2.0**62, -(2.0**62)]]])
    s = whitening.Sums(2)
    s.add(y)
    whole = [[int(a) for a in r] + [1] for r in y]
    for i in range(3):
        for j in range(3):
            assert sum(int(x[i, j]) << (20 * w) for w, x in s.limbs.items()) == sum(r[i] * r[j] for r in whole)


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def model_slowly(rows, held, deleted, order, rounds):
    """Scores by plain dictionaries."""
    texts = [(i, ["<b>"] * order + words(t) + ["<e>"], held(i), deleted(i)) for i, t in rows]

    def counted(use):
        c = Counter()
        for _, seq, h, d in texts:
            if use(h, d):
                for k in range(1, order + 1):
                    for j in range(order - 1, len(seq)):
                        c[tuple(seq[j - k + 1 : j + 1])] += 1
        return c, sum(v for g, v in c.items() if len(g) == 1 and g != ("<b>",))

    every, n = counted(lambda h, d: not h)
    kept, m = counted(lambda h, d: not h and not d)
    v = sum(len(g) == 1 and g != ("<b>",) for g in every)
    level = lambda x: x.bit_length()

    def terms(seq, j, c, total):
        p = []
        for k in range(order, 0, -1):
            above = c[tuple(seq[j - k + 1 : j])] if k > 1 else total
            p.append(c[tuple(seq[j - k + 1 : j + 1])] / above if above else 0.0)
        bucket = tuple(level(c[tuple(seq[j - k + 1 : j])]) for k in range(order, max(2, order - 1) - 1, -1))
        return bucket, [*p, 1 / (v + 1)]

    weights = defaultdict(lambda: [1 / (order + 1)] * (order + 1))
    seen = [terms(seq, j, kept, m) for _, seq, h, d in texts if d and not h for j in range(order, len(seq))]
    history = []
    for _ in range(rounds):
        total, size, like = defaultdict(lambda: [0.0] * (order + 1)), Counter(), 0.0
        for b, p in seen:
            share = [w * x for w, x in zip(weights[b], p, strict=True)]
            like += math.log10(sum(share))
            size[b] += 1
            for k in range(order + 1):
                total[b][k] += share[k] / sum(share)
        history.append(like / max(len(seen), 1))
        for b in size:
            weights[b] = [(t + 1 / (order + 1)) / (size[b] + 1) for t in total[b]]
    out = {}
    for i, seq, h, _ in texts:
        own = range(order, len(seq))
        base = sum(math.log10((every[(seq[j],)] + 1) / (n + v + 1)) for j in own)
        got = 0.0
        for j in own:
            b, p = terms(seq, j, every, n)
            got += math.log10(sum(w * x for w, x in zip(weights[b], p, strict=True)))
        out[i] = (h, len(own), sum(every[(seq[j],)] > 0 for j in own), n, base, got)
    return out, history


def fold(k):
    return lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == k


def same_scores(got, want):
    assert len(got) == len(want)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert math.isclose(r["base_score"], w[4], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r["score"], w[5], rel_tol=1e-9, abs_tol=1e-9)


def test_op13_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want, _ = model_slowly(rows, fold(2), fold(3), 3, 12)
    got = queries.op13_language_model(spark, SF).collect()
    same_scores(got, want)
    # Held-out texts are likelier under the model than under the base.
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_model_of_odd_rows(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 20_000)
    rnd = random.Random(order)
    rows = [(None, "a b"), (0, None), (1, ""), (2, "A b\x0bC d"), (3, "b c " * 9000)]
    rows += [(k, " ".join(rnd.choice("a b c d e f Über".split()) for _ in range(rnd.randrange(40)))) for k in range(4, 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("doc", "role", "block", "score")})
    want, history = model_slowly(rows, fold(2), fold(3), order, 4)
    same_scores(lm.score(df, quality.held_out(7, 2), quality.held_out(7, 3), order, rounds=4).collect(), want)
    plan = lm.layout(df)
    dealt = lm.dealt(df, F.when(quality.held_out(7, 2), 2).when(quality.held_out(7, 3), 1).otherwise(0), plan, "doc_id", "text")
    _, likelihood = lm.learn(dealt, lm.count(dealt, plan, order), order, 4)
    assert np.allclose(likelihood, history) and all(b >= a - 1e-3 for a, b in zip(likelihood, likelihood[1:]))


def test_model_without_training_or_rows(spark):
    df = spark.createDataFrame([(1, "x y"), (2, None), (2, None)], "doc_id long, text string")
    got = lm.score(df, F.lit(True), F.lit(False)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(0, 0, 0.0)] * 3
    assert lm.score(df.limit(0), F.lit(True), F.lit(False)).count() == 0
