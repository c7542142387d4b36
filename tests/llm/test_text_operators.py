"""Each operator against its brute-force version, and its edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docgraph.llm import decontamination, language_model, near_dedup, packing, repeats, substring_dedup, suffix_dedup, token_counts, toxicity
from docgraph.llm.tokens import encoder

DOC = "doc_id long, text string"
public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "ration", "wheel", "Étage", "öl", "x1", "and,"]) + rng.choice(["", "s", "er", "."]) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    shared = sentence(rng, 60)
    out = []
    for i in range(60):
        text = sentence(rng, rng.randrange(0, 120))
        if i % 3 == 0:
            text = text + " " + shared + " " + sentence(rng, 20)
        if i % 7 == 0:
            text = shared + "\n" + shared
        if i % 11 == 0 and out:
            text = out[rng.randrange(len(out))][1]
        if i % 13 == 0 and out:
            w = (out[rng.randrange(len(out))][1] or "").split()
            if w:
                w[rng.randrange(len(w))] = "edited"
            text = " ".join(w)
        out.append((i * 3 + 1, text))
    return out + [(500, None), (501, ""), (502, "  \n"), (503, "one"), (504, "one"), (505, "aaaa" * 400), (506, "ab" * 300), (507, "aaaa" * 100), (508, "z " * 300)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC + "").repartition(3)


def clash(df):
    """Further columns with names that the operators use themselves."""
    for c in ("batch", "keys", "n", "id", "component", "kept", "removed", "bucket", "score", "row"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(spark, docs, empty, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_RUNS", hot)
    expected = sorted(suffix_dedup.brute_force(corpus()))
    for d in (docs, clash(docs)):
        got = suffix_dedup.digests(suffix_dedup.dedup(d)).collect()
        assert sorted(tuple(r) for r in got) == expected
    assert suffix_dedup.digests(suffix_dedup.dedup(empty)).count() == 0


def test_suffix_dedup_repeated_rows(spark):
    text = "".join(chr(97 + (i * i) % 23) for i in range(300))
    got = suffix_dedup.digests(suffix_dedup.dedup(spark.createDataFrame([(1, text), (1, text), (None, text[:199])], DOC))).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 300), (False, 300), (True, 0)]


@pytest.mark.parametrize("hot", [4096, 2])
def test_substring_dedup(spark, docs, empty, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_RUNS", hot)
    expected = sorted((a, b, c, hashlib.sha256(b" ".join(w)).hexdigest()) for a, b, c, w in substring_dedup.brute_force(corpus()))
    for d in (docs, clash(docs)):
        got = substring_dedup.digests(substring_dedup.dedup(d)).collect()
        assert sorted(tuple(r) for r in got) == expected
    assert substring_dedup.digests(substring_dedup.dedup(empty)).count() == 0


def test_substring_dedup_of_words_that_repeat(spark):
    """Few words, so anchors repeat inside a window and many contexts share one."""
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(60)] + [(100 + i, " ".join(["x"] * (10 + i))) for i in range(8)]
    expected = sorted((a, b, c, hashlib.sha256(b" ".join(w)).hexdigest()) for a, b, c, w in substring_dedup.brute_force(rows))
    assert sorted(tuple(r) for r in substring_dedup.digests(substring_dedup.dedup(spark.createDataFrame(rows, DOC))).collect()) == expected


def test_substring_dedup_keeps_columns_and_spacing(spark, docs):
    d = clash(docs.where("doc_id IS NOT NULL"))
    got = substring_dedup.dedup(d, keep=["batch", "kept"], spacing=True).collect()
    text = dict(corpus())
    assert all(r.rest.batch == "x" and r.rest.kept == "x" for r in got)
    assert all(r.kept == (text[r.doc_id] or "") for r in got if not r.removed)


def test_substring_dedup_null_and_equal_ids(spark):
    text = " ".join(f"w{i}" for i in range(13))
    got = substring_dedup.digests(substring_dedup.dedup(spark.createDataFrame([(None, text), (5, text), (5, text), (9, text + " more")], DOC))).collect()
    assert sorted((r.doc_id or 99, r.n_removed) for r in got) == [(5, 0), (5, 0), (9, 13), (99, 13)]


@pytest.mark.parametrize("sizes", [(32, 4 << 20, 256), (2, 1500, 3)])
def test_near_dedup(spark, docs, empty, monkeypatch, sizes):
    monkeypatch.setattr(near_dedup, "SMALL", sizes[0])
    monkeypatch.setattr(near_dedup, "PART_BYTES", sizes[1])
    monkeypatch.setattr(near_dedup, "SALT", sizes[2])
    base = sentence(random.Random(8), 80).split()
    rng = random.Random(5)
    rows = corpus() + [(1000 + i, " ".join(rng.choice([w, w, w, w, w, w, w, w, w, f"e{i}"]) for w in base)) for i in range(40)]
    expected = sorted(r[:3] for r in near_dedup.brute_force(rows, 2))
    got = near_dedup.near_duplicates(clash(spark.createDataFrame(rows, DOC)), shingle=2).collect()
    assert sorted(tuple(r) for r in got) == expected
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_at_the_threshold(spark):
    """Pairs with exactly 80 % are linked, those just under it aren't; also through a chain, and beside texts that look alike."""
    words = lambda k, n: [f"w{k}x{i}" for i in range(n)]
    rows = []
    for k in range(30):
        base = words(k, 46)  # 45 shingles; an end of 5 other words changes 5 of them: 40 of 50 stay
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(base[:-5] + words(100 + k, 5))), (10 * k + 2, " ".join(base[:-6] + words(200 + k, 6)))]
    expected = sorted(r[:3] for r in near_dedup.brute_force(rows, 2))
    assert {c for _, _, c in expected if c % 10 == 0} and any(d % 10 == 2 and c == d for d, _, c in expected)
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOC), shingle=2).collect()) == expected


def test_signatures_drop_few_links():
    """A pair at similarity 0.8 is dropped by its signature less often than by banding."""
    sig = np.zeros((129, 128), np.uint32)
    for k in range(129):
        sig[k, k:] = 1  # k slots equal those of the first row
    sig = np.concatenate((np.zeros((1, 128), np.uint32), sig))
    kept = near_dedup._likely(0, np.arange(1, 130), np.arange(130), np.full(130, 100), sig, 80) - 1
    missed = sum(math.comb(128, k) * 0.8**k * 0.2 ** (128 - k) for k in set(range(129)) - set(kept.tolist()))
    assert missed < (1 - 0.8**4) ** 32


def test_near_dedup_nulls_and_repeated_rows(spark):
    rows = [(None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (1, "A B c d e f g"), (7, None), (8, " ")]
    d = spark.createDataFrame(rows, DOC)
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in near_dedup.near_duplicates(d).collect())
    assert got == [(-1, -1), (1, 1), (3, 1), (3, 1), (7, 7), (8, 8)]
    assert sorted(r.doc_id or -1 for r in near_dedup.keep_first(d).collect()) == [-1, 1, 7, 8]


def items():
    rng = random.Random(2)
    return [("b10", sentence(rng, 14)), ("b9", "The wheel, of ÉTAGE"), ("b1", None), ("b2", "..."), ("b3", "xx yy"), ("b4", "xx yy")]


@pytest.mark.parametrize("most", [2 << 20, 60])
def test_decontamination(spark, empty, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MAX_ITEM_BYTES", most)
    rng = random.Random(4)
    rows = corpus() + [(900 + i, sentence(rng, 10) + " - " + (t or "").upper().replace(" ", "  ") + "!" + sentence(rng, 5)) for i, (_, t) in enumerate(items())]
    d, b = spark.createDataFrame(rows, DOC), spark.createDataFrame(items(), "item_id string, text string")
    got = decontamination.digests(decontamination.contamination(clash(d), clash(b))).collect()
    assert sorted(tuple(r) for r in got) == sorted(decontamination.brute_force(rows, items()))
    assert any(r.contaminated for r in got)
    kept = {r.doc_id for r in decontamination.clean(clash(d), b).collect()}
    assert kept == {r.doc_id for r in got if not r.contaminated}
    assert decontamination.contamination(empty, b).count() == 0
    assert not any(r.contaminated for r in decontamination.digests(decontamination.contamination(d, b.limit(0))).collect())


def test_decontamination_byte_spans(spark):
    text = "Ah! The  wheel,\nof étage."
    row = decontamination.contamination(spark.createDataFrame([(1, text)], DOC), spark.createDataFrame([(5, "wheel of Étage")], "item_id int, text string")).first()
    assert [text.encode()[a:b].decode() for a, b in row.byte_spans] == []  # only A-Z is lower-cased
    row = decontamination.contamination(spark.createDataFrame([(1, text)], DOC), spark.createDataFrame([(5, "WHEEL of étage")], "item_id int, text string")).first()
    assert [text.encode()[a:b].decode() for a, b in row.byte_spans] == ["wheel,\nof étage"] and row.word_spans == [[2, 5]]


@pytest.mark.parametrize("block", [8 << 20, 20])
def test_decontamination_in_blocks(block, monkeypatch):
    monkeypatch.setattr(decontamination, "MAX_BLOCK", block)
    m = decontamination.Matcher([(i, t) for i, t in items()])
    assert m.find(b"so xx, yy the wheel of " + "étage".encode())[0] == 7
    assert sorted(set().union(*(m.owners[k] for k in m.find(b"xx yy")[1]))) == ["b3", "b4"]


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rows = corpus() + [(2000, " ".join(f"word{i}" for i in range(3000)))]
    d = spark.createDataFrame(rows, DOC).coalesce(2)
    got = packing.pack(clash(d), TOKENIZER, capacity=128, with_ids=True).collect()
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        parts = sorted((r.start, r.length, list(r.ids), r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == doc)
        assert [x for p in parts for x in p[2]] == ids
        assert all(p[4] == len(ids) and p[1] == len(p[2]) and p[3] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in p[2])) for p in parts)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] for s in seqs.values())
    assert sum(sum(n for _, n in s) < 128 for s in seqs.values()) <= 2 and max(sum(n for _, n in s) for s in seqs.values()) == 128
    assert packing.pack(empty, TOKENIZER).count() == 0


@pytest.mark.parametrize("sizes", [(1500,), (1100, 1300, 1500, 1900), range(1030, 2040)])
def test_packing_of_lengths_that_fill_nothing(sizes):
    """The pool stays small, all ids come out once and all sequences but the last are full."""
    import time

    rng, packer, seen, most = random.Random(3), packing.Packer(2048, 0), {}, 0
    n = 20_000 if len(sizes) < 10 else 8_000
    began = time.perf_counter()
    lengths = [rng.choice(sizes) for _ in range(n)]
    full = {}
    for doc, size in enumerate(lengths):
        packer.add(doc, np.zeros(size, np.uint32))
        most = max(most, len(packer.pool))
        for d, start, ids, total, seq, _ in packer.take():
            assert total == lengths[d]
            seen.setdefault(d, []).append((start, len(ids)))
            full[seq] = full.get(seq, 0) + len(ids)
    packer.finish()
    for d, start, ids, _, seq, _ in packer.take():
        seen.setdefault(d, []).append((start, len(ids)))
        full[seq] = full.get(seq, 0) + len(ids)
    assert most < packing.POOL and time.perf_counter() - began < 60
    assert sorted(full.values())[1:] == [2048] * (len(full) - 1)
    for d, size in enumerate(lengths):
        at = 0
        for start, k in sorted(seen[d]):
            assert start == at
            at += k
        assert at == size


def test_fill_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(60):
        count = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(5)}
        used = packing.fill(count, 60)
        sums = {0}
        for x, n in count.items():
            sums = {s + x * k for s in sums for k in range(n + 1) if s + x * k <= 60}
        assert sum(x * n for x, n in used.items()) == max(sums) and all(n <= count[x] for x, n in used.items())


def test_token_counts(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(6)
    rows = [(i, x, [(rng.randrange(-3, 300), rng.randrange(0, 300), rng.choice(["", " new", "é", None, "a b. c"])) for _ in range(rng.randrange(4))]) for i, x in corpus()] + [(900, "a", None), (901, None, [(0, 5, "hi there")])]
    d = spark.createDataFrame(rows, DOC + ", edits array<struct<start:long,end:long,text:string>>")
    got = token_counts.apply_edits(token_counts.build(d, TOKENIZER), TOKENIZER).collect()
    again = {r.doc_id: (r.text, r.n_tokens, r.n_before, r.encoded_bytes) for r in token_counts.count_edited(d, TOKENIZER).collect()}
    assert len(got) == len(rows) == len(again)
    for r in got:
        assert again[r.doc_id] == (r.text, r.n_tokens, r.n_before, r.encoded_bytes)
        assert r.n_tokens == len(t.encode(r.text, add_special_tokens=False).ids)
        assert r.n_before == len(t.encode(dict((a, b) for a, b, _ in rows)[r.doc_id] or "", add_special_tokens=False).ids)
    assert {r.doc_id: r.text for r in got}[901] == "hi there"
    assert token_counts.build(empty, TOKENIZER).count() == 0


def test_edit_encodes_little():
    enc = encoder(TOKENIZER)
    import numpy as np

    text = ("word " * 2000).encode()
    start, end, _ = token_counts.chunks(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    tree = token_counts.Tree(end - start, enc.counts(np.frombuffer(text, np.uint8), start, end))
    _, n = token_counts.edit(tree, text, 5000, 5003, b"x", enc)
    assert n < 40


@pytest.mark.parametrize("where", ["one place", "anywhere", "empty", "backwards"])
def test_many_edits_encode_little(where):
    """A thousand edits: what an edit encodes doesn't grow with their number, and the sums stay those of the text."""
    enc = encoder(TOKENIZER)
    rng = random.Random(7)
    text = b"" if where == "empty" else ("word, " * 3000).encode()
    tree = token_counts._trees(np.frombuffer(text, np.uint8), np.array([0, len(text)]), enc)[0]
    most = 0
    for k in range(1000):
        at = {"one place": 6000, "anywhere": rng.randrange(len(text) + 1), "empty": len(text), "backwards": 0}[where]
        new = rng.choice([b" added", b"x", b"a b. ", b" "])
        text, n = token_counts.edit(tree, text, at, at + (rng.randrange(12) if where == "anywhere" else 0), new, enc)
        most = max(most, n)
    assert most < 200 and tree.sums[0, 1] == len(text)
    whole = token_counts._trees(np.frombuffer(text, np.uint8), np.array([0, len(text)]), enc)[0]
    again = token_counts.Tree.load(tree.dump())
    assert tree.tokens == whole.tokens == again.tokens and tree.dump() == whole.dump() == again.dump()
    assert (tree.sums[:, 1 : tree.size] == tree.sums[:, 2::2] + tree.sums[:, 3::2]).all()


def test_edit_after_a_long_insertion():
    enc = encoder(TOKENIZER)
    tree = token_counts._trees(np.zeros(0, np.uint8), np.array([0, 0]), enc)[0]
    text, n = token_counts.edit(tree, b"", 0, 0, b"some words " * 90_000, enc)
    assert n == len(text)
    text, n = token_counts.edit(tree, text, 500_000, 500_000, b"x", enc)
    assert n < 60


def test_token_counts_with_clashing_columns(spark, docs):
    d = clash(docs).withColumn("tree", F.lit("x")).withColumn("n_tokens", F.lit("x")).withColumn("edits", F.expr("array(named_struct('start', 0L, 'end', 1L, 'text', 'y'))"))
    built = token_counts.build(d, TOKENIZER)
    assert built.columns.count("tree") == built.columns.count("n_tokens") == 1 and built.first().batch == "x"
    assert token_counts.apply_edits(built, TOKENIZER).count() == docs.count() == token_counts.count_edited(d, TOKENIZER).count()


def kn_brute(train, tests):
    """Straight from the definition, on word lists."""
    import math
    from collections import Counter

    toks = [[*t.lower().split(), None] for t in train]
    bi, uni = Counter(), Counter()
    for t in toks:
        for u, w in zip(["<s>", *t[:-1]], t, strict=True):
            bi[u, w] += 1
            uni[w] += 1
    before, ctx = Counter(w for _, w in bi), Counter()
    kinds = {}
    for (u, _), n in bi.items():
        ctx[u] += n
        kinds.setdefault(u, [0, 0, 0, 0])[min(n, 3)] += 1
    d = [0, *language_model._discounts(*(sum(1 for n in bi.values() if min(n, 5) == k) for k in range(1, 5)))]
    e = [0, *language_model._discounts(*(sum(1 for n in before.values() if min(n, 5) == k) for k in range(1, 5)))]
    total, v = max(1, len(bi)), len(uni)
    rest = sum(e[min(n, 3)] for n in before.values()) / total if before else 1.0
    out = []
    for t in tests:
        ws, s, b = [*(t or "").lower().split(), None], 0.0, 0.0
        for u, w in zip(["<s>", *ws[:-1]], ws, strict=True):
            p = max(before[w] - e[min(before[w], 3)], 0) / total + rest / (v + 1)
            if ctx[u]:
                k = kinds[u]
                p = max(bi[u, w] - d[min(bi[u, w], 3)], 0) / ctx[u] + sum(d[i] * k[i] for i in (1, 2, 3)) / ctx[u] * p
            s += math.log10(p)
            b += math.log10((uni[w] + 0.5) / (sum(uni.values()) + 0.5 * (v + 1)))
        out.append((len(ws), sum(uni[w] > 0 for w in ws), b, s))
    return out


def test_language_model(spark, docs, empty):
    rows = [(i, t) for i, t in corpus() if t is None or t.isascii()]
    train = [(t or "") for i, t in rows if i % 2]
    model = language_model.train(clash(spark.createDataFrame([(i, t) for i, t in rows if i % 2], DOC)))
    got = {r.doc_id: r for r in language_model.score(spark.createDataFrame(rows, DOC), model).collect()}
    for (i, _), (n, known, base, score) in zip(rows, kn_brute(train, [t for _, t in rows]), strict=True):
        r = got[i]
        assert (r.n_tokens, r.n_known) == (n, known)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
    none = language_model.train(empty)
    assert language_model.score(spark.createDataFrame([(1, "a")], DOC), none).first().score == 0.0
    assert language_model.score(empty, model).count() == 0


def ngram_brute(train, tests, order):
    """The interpolated model from its definition, order by order, on word lists."""
    import math
    from collections import Counter

    def padded(t):
        return [*["<s>"] * (order - 1), *t.lower().split(), None]

    count = {order: Counter()}
    for t in map(padded, train):
        count[order].update(tuple(t[i - order + 1 : i + 1]) for i in range(order - 1, len(t)))
    for k in range(order - 1, 0, -1):
        count[k] = Counter(g[1:] for g in count[k + 1])
    after = {k: {} for k in count}
    for k, of in count.items():
        for g, n in of.items():
            after[k].setdefault(g[:-1], []).append(n)
    d = {k: [0, *language_model._discounts(*(sum(1 for n in of.values() if min(n, 5) == j) for j in range(1, 5)))] for k, of in count.items()}
    v = len(count[1])

    def p(g):
        k = len(g)
        if not k:
            return 1 / (v + 1)
        have = after[k].get(g[:-1])
        if not have:
            return p(g[1:])
        return (max(count[k][g] - d[k][min(count[k][g], 3)], 0) + sum(d[k][min(n, 3)] for n in have) * p(g[1:])) / sum(have)

    texts = [padded(t or "") for t in tests]
    return [sum(math.log10(p(tuple(t[i - order + 1 : i + 1]))) for i in range(order - 1, len(t))) for t in texts], p


@pytest.mark.parametrize(("order", "split"), [(2, 1 << 18), (3, 1 << 18), (3, 1), (5, 3)])
def test_language_models_of_all_orders(spark, order, split):
    rows = [(i, t) for i, t in corpus() if t is None or t.isascii()]
    train = [(t or "") for i, t in rows if i % 2]
    model = language_model.train(spark.createDataFrame([(i, t) for i, t in rows if i % 2], DOC), order, split)
    got = {r.doc_id: r.score for r in language_model.score(spark.createDataFrame(rows, DOC), model).collect()}
    want, p = ngram_brute(train, [t for _, t in rows], order)
    assert [got[i] for i, _ in rows] == pytest.approx(want)
    # the definition itself: what can follow sums to one, with one unknown word
    vocabulary = {w for t in train for w in t.lower().split()} | {None, "<unknown>"}
    for context in (["<s>"] * (order - 1), [*["<s>"] * order, *train[0].lower().split()][-order + 1 :]):
        assert sum(p((*context, w)) for w in vocabulary) == pytest.approx(1)
    with pytest.raises(ValueError, match="order"):
        language_model.train(spark.createDataFrame(rows, DOC), 1)


def test_packages_keep_numbers():
    for most in (0, 1, 255, 2**32, 2**64 - 1):
        columns = [np.array([0, most, 1], np.uint64), np.array([5, 5, 5])]
        assert [c.tolist() for c in language_model.unpack(language_model.pack(columns))] == [[0, most, 1], [5, 5, 5]]
    assert [len(c) for c in language_model.unpack(language_model.pack([np.zeros(0, np.int64)] * 3))] == [0, 0, 0]


@pytest.mark.parametrize("most", [8, 1 << 30, 1 << 62])
def test_rows_are_added_up_in_order(most):
    """Columns that fit 64 bits together, by rank, and not at all."""
    rng = np.random.default_rng(most)
    columns = [rng.integers(0, most, 40)[rng.integers(0, 40, 3000)] for _ in range(15 if most > 1 << 40 else 3)]
    columns[2] = columns[2] % 3
    got, (n,) = language_model.add_up(columns, [np.ones(3000, np.uint8)])
    want = Counter(zip(*(c.tolist() for c in columns), strict=True))
    assert [*zip(*(c.tolist() for c in got), strict=True)] == sorted(want) and n.tolist() == [want[k] for k in sorted(want)]


def test_grams_are_found_by_hash(tmp_path):
    rng = np.random.default_rng(3)
    files = language_model.Files(f"file://{tmp_path}")
    for shard, n in enumerate((0, 1, 15, 5000)):
        keys = rng.integers(0, 2**64, n, np.uint64)
        values = [rng.integers(0, 3, n), np.arange(n)]
        files.save_grams("gram3", shard, keys, values)
        asked = np.concatenate((keys, rng.integers(0, 2**64, 100, np.uint64)))
        got = files.find_grams("gram3", asked, np.full(len(asked), shard), 2)
        assert all(g.tolist() == [*v.tolist(), *[0] * 100] for g, v in zip(got, values, strict=True))


def test_missing_or_cut_model_files_are_errors(spark):
    import os
    from urllib.parse import urlparse

    d = spark.createDataFrame([(1, "a b a b c")], DOC)
    for harm in (os.remove, lambda f: os.truncate(f, os.path.getsize(f) - 1)):
        model = language_model.train(d)
        assert language_model.score(d, model).first().n_known == 6
        files = [f"{urlparse(model.folder).path}/{f}" for f in os.listdir(urlparse(model.folder).path) if not f.startswith(".")]
        assert len(files) == 3 * model.shards
        for f in files:
            harm(f)
        with pytest.raises(Exception, match="file of the language model"):
            language_model.score(d, model).collect()
        model.delete(spark)
        assert not os.path.exists(urlparse(model.folder).path)


def test_counts_of_any_size():
    for most in (0, 1, 255, 256, 2**32 - 1, 2**32, 2**40):
        x = np.array([0, most, 1])
        assert language_model.widen(language_model.narrow(x).tobytes(), 3).tolist() == x.tolist()


def test_maps_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(language_model, "OPEN", 2)
    files = language_model.Files(f"file://{tmp_path}")
    for k in range(5):
        files.save("pair", k, np.array([k, k + 5], np.uint64), np.array([2**33, k]))
    keys = np.arange(15, dtype=np.uint64)
    for _ in range(2):
        (got,) = files.find("pair", 5, keys, 1)
        assert got.tolist() == [2**33] * 5 + [0, 1, 2, 3, 4] + [0] * 5 and len(files.maps) == 2


def test_probabilities_sum_to_one(spark):
    rows = [(1, "a b a b c"), (2, "b c"), (3, "a d e a b")]
    model = language_model.train(spark.createDataFrame(rows, DOC))
    assert model.sums["tokens"] == 15 and model.sums["vocabulary"] == 6
    # p(w | start) over the vocabulary, the end and one unknown word
    texts = ["a", "b", "c", "d", "e", "unknown", ""]
    ends = language_model.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOC), model).collect()
    both = dict(zip(texts, kn_brute([t for _, t in rows], texts), strict=True))
    assert all(r.score == pytest.approx(both[texts[r.doc_id]][3]) for r in ends)


def test_toxicity(spark, empty):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        text = sentence(rng, 60).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["grubnak", "snorvelt", "plockish"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, "grubnak " * 5000)]
    labels += [(None, 1), (7, None), (99999, 1)]
    d, lab = clash(spark.createDataFrame(rows, DOC)), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, lab, toxicity.fold("doc_id") != 2)
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].predicted == int(i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values()) and len(got) == len(rows)
    assert got[900].score == got[901].score and got[902].predicted == 1
    kept = {r.doc_id for r in toxicity.keep_clean(d, model).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}
    alone = toxicity.train(d, lab.where("toxic = 0"), F.lit(True))
    assert toxicity.score(d, alone).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train(d, lab.limit(0), F.lit(True)).prior == 0.0


def test_toxicity_by_plain_compression(spark):
    """Every window's advantage, by compressing it alone with either dictionary, and the score that follows from them."""
    import zstandard as zstd

    rng = random.Random(4)
    bad = ["grubnak", "snorvelt", "plockish"]
    rows = [(i, sentence(rng, 40) + (" " + " ".join(rng.choices(bad, k=4)) if i % 4 == 0 else "")) for i in range(300)]
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, DOC), lab, F.lit(True))
    # rows in another order, and each twice, make the same model
    again = toxicity.train(spark.createDataFrame(rows[::-1] + rows, DOC).repartition(5), lab, F.lit(True))
    assert again.content == model.content and np.array_equal(again.weights, model.weights)
    params = zstd.ZstdCompressionParameters(
        window_log=12, hash_log=12, chain_log=12, search_log=4, min_match=4, target_length=32, strategy=zstd.STRATEGY_GREEDY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )

    def length(data, content):
        return len(zstd.ZstdCompressor(compression_params=params, dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)).compress(data))

    for _, text in rows[:12]:
        plain = [length(data, model.content[0]) - length(data, model.content[1]) for data in (toxicity.CARRIER + b" " + w + b" " + toxicity.TAIL for w in text.encode().lower().split())]
        got, _ = model.advantages(*toxicity._text_block([text]))
        assert got.tolist() == plain
        features = []
        for level in toxicity.LEVELS:
            for n in (sum(g >= level for g in plain), sum(g <= -level for g in plain)):
                features += [math.log1p(n), min(n, 3), math.log1p(1000 * n / len(plain))]
        z = model.weights[0] + sum(w * (f - m) / s for w, f, m, s in zip(model.weights[1:], features, model.mean, model.scale, strict=True))
        assert model.scores(*toxicity._text_block([text]))[0] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))


def test_toxicity_without_spaces():
    rng = random.Random(5)
    bad = ["grubnak", "snorvelt", "plockish"]
    texts = [[sentence(rng, 60).split() for _ in range(200)] for _ in range(2)]
    for words in texts[1]:
        for _ in range(4):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
    ordinary, toxic = ([" ".join(w) for w in t] for t in texts)
    model = toxicity.train_texts(toxic, ordinary, 200, 200)
    for sep in ("_", "\u00a0", ""):
        clean = sep.join(sentence(rng, 2000).split())
        assert len(clean.encode()) > 9000
        for at in (0, 5000, len(clean)):
            words = sep.join([""] + 12 * bad + [""])
            got = model.scores(*toxicity._text_block([clean, clean[:at] + words + clean[at:]]))
            assert got[0] < toxicity.THRESHOLD <= got[1]


def test_split_holds_every_fragment():
    from docgraph.llm import kernels as K

    rng = random.Random(6)
    texts = ["".join(rng.choice("aé漢😀_") for _ in range(n)) for n in (0, 1, 63, 64, 65, 500)] + ["a b " + "漢" * 100]
    buf, off = toxicity._text_block(texts)
    start, end, cut, first = toxicity.split(buf, *K.words(buf, off, ~K.SPACE))
    for i, t in enumerate(texts):
        parts = [bytes(buf[start[k] : end[k]]) for k in range(first[i], first[i + 1])]
        assert all(p.decode() for p in parts)
        n = toxicity.FRAGMENTS[-1]
        assert all(any(w[at : at + n] in p for p in parts) for w in map(str.encode, t.split()) for at in range(max(1, len(w) - n + 1)))
        assert [bool(cut[k] & 1) for k in range(first[i], first[i + 1])].count(False) == len(t.split())


def test_text_column_slices():
    from docgraph.llm import kernels as K

    col = pa.array(["ab", None, "c", "déf"]).slice(1, 3)
    buf, off = K.text_column(col)
    assert bytes(buf).decode() == "cdéf" and off.tolist() == [0, 0, 1, 5]
