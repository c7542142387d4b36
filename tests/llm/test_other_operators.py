"""Chat formatting, neighbours, components, kernels and the pipeline."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgraph.llm import chat, common, minhash, neighbours, suffix
from docgraph.llm import kernels as K

CONV = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>user\nhi<|end|>", "\\", "<\\|turn|>", "a\\<|end|>\\\\", "\n\n", "$1 \\$", "[\\INST]", None, "", "é\U0001f600<s>"]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole <|x", None]), nasty[(c * 5 + t) % len(nasty)]) for c in range(9) for t in rng.sample(range(20), 6)]
    rows += [(50, 1, "user", "x"), (50, 1, "user", "x"), (50, None, "assistant", "first"), (None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, CONV).withColumn("tree", F.lit(1)).withColumn("leaf", F.lit(2))
    got = {r.conv_id: r for r in chat.digests(chat.formatted(chat.ranked_paths(chat.from_turns(df), best=1))).collect()}
    for c in {r[0] for r in rows}:
        turns = [(role or "", text or "") for _, _, role, text in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))]
        told = "".join(f"{a}\n{b}\n" for a, b in turns)
        loss = "".join(b for a, b in turns if a == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.formatted(chat.ranked_paths(chat.from_turns(df.limit(0))))).count() == 0


@pytest.mark.parametrize("role", ["r" * 1_000_000, "\\" * 1_000_000, "\n" * 200_000, "\\n\n\\\n\\\\n" * 1000])
def test_chat_with_very_long_roles(spark, role):
    """No pattern may recurse once per character."""
    df = spark.createDataFrame([(1, 0, role, role), (1, 1, "assistant", "a")], CONV).withColumn("pieces", F.lit("mine"))
    shaped = chat.ranked_paths(chat.from_turns(df)).withColumn("pieces", F.lit("mine"))
    made = chat.formatted(shaped)
    assert made.select("pieces").first()[0] == "mine"
    row = chat.digests(made).first()
    assert (row.n_turns, row.turns_sha256) == (2, hashlib.sha256(f"{role}\n{role}\nassistant\na\n".encode()).hexdigest())


def test_reply_tree_branches(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 2.0), ("t", 4, 3, "user", "c", None), ("t", 5, 99, "user", "lost", 9.0), ("t", 6, 7, "x", "loop", 1.0), ("t", 7, 6, "x", "loop", 1.0), ("t", 8, 7, "x", "hangs on the loop", 1.0), ("u", 1, None, "user", None, 0.0)]
    m = spark.createDataFrame(rows, "tree string, node int, parent int, role string, text string, score double")
    got = sorted((r.tree, r.branch, [t.text for t in r.turns]) for r in chat.ranked_paths(m).collect())
    assert got == [("t", 1, ["lost"]), ("t", 2, ["q", "b", "c"]), ("t", 3, ["q", "a"]), ("u", 1, [""])]
    assert chat.ranked_paths(m, best=1).count() == 2


def test_long_chain(spark):
    m = spark.createDataFrame([("t", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(150)], "tree string, node int, parent int, role string, text string, score double")
    assert [t.text for t in chat.ranked_paths(m).first().turns] == [str(i) for i in range(150)]


VEC = "vec_id long, embedding array<float>"


def vectors(n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return rows + [(1000 + i, rows[0][1]) for i in range(12)] + [(2000, None), (2050, [0.0] * dim), (2051, [math.nan] * dim), (2052, [None] + [1.0] * (dim - 1)), (2053, [1.0]), (2054, []), (None, rows[3][1])]


def same(got, exact):
    """The share of neighbours found; found scores are exact."""
    near = {}
    for q, _, i, s in exact:
        near.setdefault((q, i), []).append(s)
    assert all(any(s == pytest.approx(x, abs=1e-14) for x in near[q, i]) for q, _, i, s in got if (q, i) in near)
    return len({r[:1] + r[2:3] for r in got} & {r[:1] + r[2:3] for r in exact}) / len({r[:1] + r[2:3] for r in exact})


@pytest.mark.parametrize("part", [4096, 4])
def test_neighbours(spark, monkeypatch, part):
    monkeypatch.setattr(neighbours, "PART", part)
    rows = vectors()
    df = spark.createDataFrame(rows, VEC).withColumn("id", F.lit("x")).withColumn("bucket", F.lit(1)).withColumn("row", F.lit("x"))
    got = sorted(tuple(r) for r in neighbours.search(df, F.col("id") % 50 == 0).collect())
    exact = sorted(neighbours.brute_force(rows, {i for i, _ in rows if i is not None and i % 50 == 0}))
    assert same(got, exact) >= 0.9
    # copies of one vector tie and go by their number
    assert [r[2] for r in got if r[0] == 0] == [1000, 1001, 1002, 1003, 1004]
    assert [r[1] for r in got if r[0] == 50] == [1, 2, 3, 4, 5]


def test_neighbours_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1])], VEC)
    assert [tuple(r)[:3] for r in neighbours.search(few, F.col("id") % 50 == 0).collect()] == [(0, 1, 1)]
    assert neighbours.search(few.limit(0), F.col("id") % 50 == 0).count() == 0
    assert neighbours.search(few, F.col("id") == 7).count() == 0


@pytest.mark.parametrize("block", [8 << 20, 1024])
def test_neighbours_of_a_handful(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", block)
    axes = np.eye(64)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate([axes[0], -axes[0], axes[1], axes[2], -axes[2], axes[3] - axes[0]])] + [(50, [0.0, 1.0] + [0.0] * 62)]
    got = sorted(tuple(r) for r in neighbours.search(spark.createDataFrame(rows, VEC), F.lit(True)).collect())
    assert [r[:3] for r in got] == [r[:3] for r in sorted(neighbours.brute_force(rows, {i for i, _ in rows}))]


def test_neighbours_with_one_id_other_lengths_and_huge_components(spark):
    """Rows count each for themselves; lengths don't mix; no overflow; scores that differ in the 13th digit aren't ties."""
    rng = np.random.default_rng(4)
    far = [(100 + i, rng.normal(size=8).tolist()) for i in range(40)]
    base = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    rows = far + [(0, base)] + [(7, [c + 0.01 * k for c in base]) for k in range(1, 7)] + [(0, [c + 0.1 for c in base])]
    rows += [(50, [1e200, 1e200, 0.0]), (51, [1.0, 1.0, 0.0]), (52, [1.0, 1.0, 1.0]), (53, [1e-300, 0.0, 0.0])]
    rows += [(150, [1.0, 0.0, 0.0, 0.0]), (160, [1.0, 1e-7, 0.0, 0.0]), (155, [1.0, 2e-7, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in neighbours.search(df, F.col("id") % 50 == 0).collect())
    exact = sorted(neighbours.brute_force(rows, {0, 50, 100, 150}))
    assert [r[:3] for r in got if r[0] != 100] == [r[:3] for r in exact if r[0] != 100]
    assert [r[2] for r in got if r[0] == 0] == [7] * 10
    assert [r[2] for r in got if r[0] == 50] == [51, 52, 53] and got[-1][3] == pytest.approx(1)
    assert [r[2] for r in got if r[0] == 150] == [160, 155]


@pytest.mark.parametrize("dim", [64, 256])
def test_recall_and_share_of_candidates(dim):
    """The plan that the fit takes, measured on other queries: recall on all kinds, and the share of rows that a query meets on clustered ones."""
    rng = np.random.default_rng(dim)
    centre = rng.normal(size=(200, dim))
    shares = []
    for n in (2000, 8000):
        for kind in ("isotropic", "clustered"):
            x = rng.normal(size=(n, dim)) if kind == "isotropic" else centre[rng.integers(0, 200, n)] + 0.4 * rng.normal(size=(n, dim))
            x /= np.linalg.norm(x, axis=1, keepdims=True)

            def truth(q, x=x):
                score = x[q] @ x.T
                score[np.arange(len(q)), q] = -9
                return np.argsort(-score, axis=1)[:, :5].ravel()

            fitted, held = np.arange(96), np.arange(96, 176)
            plan = neighbours.choose(x[fitted], x[truth(fitted)], np.repeat(np.arange(96), 5), x[rng.choice(n, 512)], neighbours.TABLES, neighbours.RECALL)
            family = neighbours.Family(dim, neighbours.TABLES, plan.hashes, plan.width)
            found = family.visits(x[held], x[truth(held)], np.repeat(np.arange(80), 5), np.arange(400)) <= neighbours.PROBES
            q, r = np.divmod(np.arange(80 * n), n)
            share = (family.visits(x[held], x, q, r) <= neighbours.PROBES).mean()
            print(dim, n, kind, plan.hashes, round(plan.width, 2), "recall", found.mean(), "share", share)
            assert found.mean() >= 0.9
            if kind == "clustered":
                shares.append(share)
    assert max(shares) < 0.1


def test_recall_of_the_query_on_its_table(spark):
    """op4 on the small table against brute force."""
    import pyarrow.parquet as pq

    from docgraph.llm import queries

    sf = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in queries.op4_neighbours(spark, sf).collect())
    table = pq.read_table(f"{sf}/embeddings.parquet").select(["vec_id", "embedding"]).to_pylist()
    rows = [(r["vec_id"], r["embedding"]) for r in table]
    exact = neighbours.brute_force(rows, {i for i, _ in rows if i is not None and i % 50 == 0})
    assert len(got) == len(exact) and same(got, exact) >= 0.9


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    df = spark.createDataFrame(edges, "a long, b long")
    expected = {x: find(x) for x in list(parent) if find(x) != x}
    assert {r.node: r.component for r in common.components(df).collect()} == expected
    half = common.components(df.where("a % 2 = 0"))
    assert {r.node: r.component for r in common.joined_components(half, df.where("a % 2 = 1")).collect()} == expected


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_suffix_array(letters):
    rng = random.Random(letters)
    for _ in range(60):
        t = bytes(rng.randrange(letters) + (50 if letters < 200 else 0) for _ in range(rng.randrange(50))) * rng.choice([1, 2, 3])
        sa = suffix.suffix_array(np.frombuffer(t, np.uint8))
        order = sorted(range(len(t)), key=lambda i: t[i:])
        assert sa.tolist() == order
        plcp = suffix.permuted_common_prefixes(np.frombuffer(t, np.uint8), sa, 9)
        for a, b in zip(order[:-1], order[1:], strict=True):
            n = 0
            while n < 9 and t[a + n : a + n + 1] == t[b + n : b + n + 1] != b"":
                n += 1
            assert plcp[b] == n


@pytest.mark.parametrize("kind", ["random", "copies", "one letter", "few differences"])
def test_common_prefixes_and_repeats(kind):
    """Against plain comparison; long common prefixes too."""
    rng = random.Random(11)
    for _ in range(8):
        t = bytes(rng.choice(b"ab") for _ in range(400))
        t = {"random": t, "copies": t[:150] * 3 + t, "one letter": b"a" * 700, "few differences": (b"a" * 99 + b"b") * 5 + t}[kind]
        text = np.frombuffer(t, np.uint8)
        sa = suffix.suffix_array(text)
        plcp = suffix.permuted_common_prefixes(text, sa)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
            n = 0
            while t[a + n : a + n + 1] == t[b + n : b + n + 1] != b"":
                n += 1
            assert plcp[b] == n
        starts = np.array([i + 20 <= len(t) and i % 3 > 0 for i in range(len(t))])
        seen = {}
        for i in np.flatnonzero(starts).tolist():
            seen.setdefault(t[i : i + 20], []).append(i)
        want = {i for v in seen.values() if len(v) > 1 for i in v}
        assert set(np.flatnonzero(suffix.repeats(text, sa, 20, starts)).tolist()) == want


def test_superminhash_estimates():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(80):
        u = rng.integers(0, 2**63, 300, dtype=np.uint64)
        s = minhash.signatures(np.concatenate((u[:200], u[40:240])), np.array([0, 200, 400]))
        errors.append((s[0] == s[1]).mean() - 160 / 240)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < (2 / 9 / 128) ** 0.5
    assert (minhash.signatures(np.zeros(0, np.uint64), np.array([0, 0])) == 0xFFFFFFFF).all()


def test_minimizers_are_shared_by_equal_windows():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, 400, dtype=np.uint64)
    picked = set(K.minimizers(x, 7).tolist())
    for i in range(len(x) - 6):
        w = x[i : i + 7]
        assert any(i + j in picked for j in np.flatnonzero(w == w.min()))


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from docgraph.llm import decontamination, near_dedup, packing, substring_dedup, toxicity

    rng = random.Random(9)
    said = lambda n: " ".join(rng.choice(["al", "be", "ce", "do", "ek", "fu", "gi"]) + rng.choice(["ra", "to", "mu", "li"]) for _ in range(n))
    shared, item = said(40), said(12)
    rows = []
    for i in range(120):
        text = said(60)
        text += " " + shared if i % 10 == 1 else ""
        text += " " + item if i % 15 == 2 else ""
        text = rows[i - 1][1] + " end" if i % 12 == 5 else text
        text += " grubnak snorvelt grubnak plockish" if i % 4 == 3 else ""
        rows.append((i, text, "en", "src0", len(text)))
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 3)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), toxicity.fold("doc_id") != 2)
    assert {r.doc_id for r in first} == {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    kept = {r.doc_id: r.text for r in first}
    kept = {d: kept[d] for d, _, c, k in near_dedup.brute_force(list(kept.items()), 5) if k}
    cut = {d: (w, n) for d, _, n, w in substring_dedup.brute_force(list(kept.items()))}
    kept = {d: kept[d] if not n else b" ".join(w).decode() for d, (w, n) in cut.items() if w or not n}
    kept = {r[0]: kept[r[0]] for r in decontamination.brute_force(list(kept.items()), [(1, item)]) if not r[5]}
    got = pipeline.run(spark, str(tmp_path))
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {d: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for d, x in kept.items()}
    assert {r.doc_id: r.doc_tokens for r in got.collect()} == expected
    assert got.columns == packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).columns
    assert 500 in expected and len(expected) < 100
