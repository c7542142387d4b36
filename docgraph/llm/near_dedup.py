"""Near-duplicate groups by SuperMinHash, banding, verification on full sets and union-find.

1. Each document's set of word shingles (64-bit fingerprints) gets a key of the whole set, a SuperMinHash
   signature and its bands. Documents with equal sets form a class; only the class's smallest doc_id goes on.
2. In each band bucket every class is paired with the bucket's smallest class; pairs are verified on full sets,
   and links joined to components.
3. Buckets that still hold several components are compared completely. In buckets of up to `SMALL` members, the pairs of
   different components whose sizes allow the similarity and whose signatures agree in `SURE` of the slots
   become rows, each in the first bucket that holds it, and are verified too. Larger buckets are joined to
   clusters of classes. A cluster's largest component, whose members need no comparison with each other, is dealt to parts of about `PART_BYTES`, and each
   part meets the other members; these meet among themselves in pairs of parts. There, members of different components are
   compared by signature, then on full sets, and only links that join components become rows.
   No group becomes a list of pairs, and texts are copied as often as there are parts of others, not of all.

With 32 bands of 4 slots, a pair at similarity 0.8 shares no bucket with probability 5e-8, and has fewer than `SURE` of its slots equal
with probability 9e-9 (large sets, whose slots are as good as independent): it is missed with 6e-8 at most. A class stands on equal
numbers of shingles and two sums of 64-bit hashes of them: different sets share all three with a probability of 1e-19 among ten thousand million.
Pairs with a bucket's smallest class are dealt out by both ends where it has many, before texts are joined to them.

Nulls: a null or wordless text has an empty set and is linked with nothing; a row with a null doc_id stands alone. Rows with one
doc_id count as one document for links. Empty tables give empty results; columns beyond doc_id and text aren't read. A very long text is held whole, with its set, in
one block and in each group that verifies it; groups go by bytes, so it then has few others beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import minhash
from .common import checkpointed, components, joined_components

ROWS = 4
#: Share of equal slots from which a pair is verified: six standard deviations below 0.8.
SURE = 0.58
#: Bytes of texts of one cluster that meet in a part.
PART_BYTES = 4 << 20
#: Largest bucket whose likely pairs become rows.
SMALL = 32
#: Texts that are compared with one text in one group.
SALT = 256
GROUP_BYTES = 4 << 20


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts, text after text, and their offsets. Fewer than n words: the whole sequence is one."""
    low = K.LOWER[buf]
    start, end, first = K.words(low, off, ~K.SPACE)
    count = np.diff(first)
    h = K.word_hashes(low, start, end)
    owner = np.repeat(np.arange(len(count)), count)
    pre = K.prefix(h, K.WORD_BASE)
    at = np.flatnonzero((np.arange(len(h)) + n <= np.repeat(first[1:], count)) | ((np.repeat(count, count) < n) & (np.arange(len(h)) == np.repeat(first[:-1], count))))
    x = K.ranges(pre, at, np.minimum(at + n, np.repeat(first[1:], count)[at]), K.WORD_BASE) if len(at) else np.zeros(0, np.uint64)
    owner = owner[at]
    order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    x, owner = x[keep], owner[keep]
    return x, np.searchsorted(owner, np.arange(len(off)))


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def describe(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, two keys of the set, signature (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in K.pieces(batches):
            x, first = shingle_sets(buf, off, shingle)
            sig = minhash.signatures(x, first)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0), pa.array(np.diff(first), pa.int64()), pa.array(K.signed(_sums(K.mix(x), first))),
                    pa.array(K.signed(_sums(K.mix(x ^ K.U64(0x5851F42D4C957F2D)), first))), pa.array([s.tobytes() for s in sig], pa.binary()),
                ],
                names=["doc_id", "n", "k1", "k2", "signature"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, signature binary")


def band_rows(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            sig = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.uint32).reshape(rows.num_rows, -1)
            for at in range(0, len(sig), 2000):
                b = minhash.bands(sig[at : at + 2000], ROWS)
                ids = np.repeat(rows.column(0).to_numpy()[at : at + 2000], b.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(b.reshape(-1))), pa.array(ids)], names=["band", "id"])

    return classes.select("id", "signature").mapInArrow(run, "band long, id long")


def verify(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union. texts: id, text."""
    # only what many pairs share is salted: at most one of SALT pairs has such a b
    many = checkpointed(pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts")).where("salts > 1"))
    many = F.broadcast(many) if many.count() <= 500_000 else many
    dealt = pairs.join(many, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    needs = dealt.select(F.col("a").alias("id"), "b", "salt", F.lit(False).alias("is_b")).unionAll(dealt.select(F.col("b").alias("id"), "b", "salt", F.lit(True).alias("is_b")).distinct())
    rows = needs.join(texts, "id")
    size = texts.agg(F.avg(F.octet_length("text"))).first()[0] or 0
    groups = F.pmod(F.xxhash64("b", "salt"), F.lit(max(8, int(pairs.count() * 1.5 * size // GROUP_BYTES)))).alias("g")

    def check(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_b, b, salt, ids = (table.column(c).to_numpy() for c in ("is_b", "b", "salt", "id"))
        order = np.lexsort((~is_b, salt, b))
        table = table.take(pa.array(order))
        is_b, b, ids = is_b[order], b[order], ids[order]
        root = np.maximum.accumulate(np.where(is_b, np.arange(len(b)), 0))
        size, inter = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
        held: list[np.ndarray] = []
        at = 0
        parts = []
        for _, buf, off in K.pieces(iter(table.select(["text"]).to_batches())):
            x, first = shingle_sets(buf, off, shingle)
            k = np.diff(first)
            size[at : at + len(k)] = k
            parts.append((at, len(k), K.mix(x + np.repeat(root[at : at + len(k)].astype(np.uint64), k) * K.U64(0x9E3779B97F4A7C15))))
            mine = np.repeat(is_b[at : at + len(k)], k)
            held.append(parts[-1][2][mine])
            at += len(k)
        keys = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        for start, n, x in parts:
            hit = np.zeros(len(x) + 1, np.int64)
            if len(keys):
                near = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                np.cumsum(keys[near] == x, out=hit[1:])
            to = np.concatenate(([0], np.cumsum(size[start : start + n])))
            inter[start : start + n] = hit[to[1:]] - hit[to[:-1]]
        union = size + size[root] - inter
        ok = ~is_b & (100 * inter >= percent * union)
        return pa.table([pa.array(ids[ok]), pa.array(b[ok])], names=["a", "b"])

    return rows.select(groups, "id", "b", "salt", "is_b", "text").groupBy("g").applyInArrow(check, "a long, b long")


def _likely(i: int, right: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: np.ndarray, percent: int) -> np.ndarray:
    """Members of `right` in other components than i that can be similar to it."""
    ok = right[(comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
    return ok[(sig[ok] == sig[i]).sum(axis=1) >= SURE * sig.shape[1]] if len(ok) else ok


def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(table.num_rows, -1)
    return (*(table.column(c).to_numpy() for c in ("id", "component", "n")), sig)


def rivals(buckets: DataFrame, percent: int) -> DataFrame:
    """Likely pairs of different components in small buckets. buckets: band, id, component, n, signature, g (a group of buckets)."""

    def compare(table: pa.Table) -> pa.Table:
        ids, comp, n, sig = _columns(table)
        band = table.column("band").to_numpy()
        bands = minhash.bands(sig, ROWS).view(np.int64)
        a, b = [], []
        order = np.argsort(band, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(band[order])) + 1):
            for k, i in enumerate(rows.tolist()):
                ok = _likely(i, rows[k + 1 :], comp, n, sig, percent)
                if len(ok):  # only in the first band that both share
                    ok = ok[bands[i][(bands[ok] == bands[i]).argmax(axis=1)] == band[i]]
                    a.append(np.full(len(ok), ids[i]))
                    b.append(ids[ok])
        none = np.zeros(0, np.int64)
        x, y = np.concatenate(a) if a else none, np.concatenate(b) if b else none
        return pa.table([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

    return buckets.groupBy("g").applyInArrow(compare, "a long, b long")


def cluster_links(blocks: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links that join components within blocks. blocks: cluster, part, side, id, component, n, signature, text."""

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, comp, n, sig = _columns(table)
        comp, side = comp.copy(), table.column("side").to_numpy()
        sets: list[np.ndarray] = []
        for _, buf, off in K.pieces(iter(table.select(["text"]).to_batches())):
            x, first = shingle_sets(buf, off, shingle)
            sets += np.split(x, first[1:-1])
        # side 0: a part with itself; 1 and 2: two parts
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        a, b = [], []
        for i in left.tolist():
            near = _likely(i, right, comp, n, sig, percent)
            # the likeliest first: once two components are joined, the rest of the other one is skipped
            near = near[np.argsort(-(sig[near] == sig[i]).sum(axis=1), kind="stable")]
            while len(near):
                now, near = near[:64], near[64:]
                size = n[now]
                hits = among(np.concatenate([sets[j] for j in now.tolist()]), sets[i])
                both = np.add.reduceat(hits.astype(np.int64), np.cumsum(size) - size)
                for j in now[100 * both >= percent * (size + n[i] - both)].tolist():
                    if comp[i] != comp[j]:
                        a.append(ids[i])
                        b.append(ids[j])
                        comp[comp == comp[j]] = comp[i]
                near = near[comp[near] != comp[i]]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return blocks.groupBy("cluster", "part").applyInArrow(join, "a long, b long")


def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among the sorted keys."""
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _blocks(large: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Members of large buckets (band, id, b, component), joined to clusters, in pairs of parts."""
    about = classes.select("id", "n", "signature")
    cluster = components(large.where("id <> b").select(F.col("id").alias("a"), "b"))
    members = large.select("id", "component").distinct().join(cluster.withColumnRenamed("component", "cluster"), F.col("id") == F.col("node"), "left")
    members = members.select("id", "component", F.coalesce("cluster", "id").alias("cluster")).join(texts.select("id", F.octet_length("text").alias("size")), "id")
    sizes = members.groupBy("cluster", "component").agg(F.sum("size").alias("size"))
    top = sizes.groupBy("cluster").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("all"))
    parts = lambda size: F.greatest(F.lit(1), F.ceil(size / PART_BYTES)).cast("int")
    # few rows a cluster, against all its members: salted by nothing, as only ids are moved and Spark splits skewed joins
    placed = checkpointed(members.join(top, "cluster").select(
        "id", "component", "cluster", (F.col("component") == F.col("top")["component"]).alias("first"),
        parts(F.col("top")["size"]).alias("firsts"), parts(F.col("all") - F.col("top")["size"]).alias("others"),
    ))
    first, other = placed.where("first"), placed.where("NOT first")
    mine = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    keep = ["cluster", "part", "side", "id", "component"]
    # a part of the largest component with a part of the others, which stand beside each part of it
    one = first.withColumn("x", mine("firsts")).withColumn("y", each("others")).where(F.col("others") > 0)
    two = other.withColumn("y", mine("others")).withColumn("x", each("firsts"))
    across = [df.withColumn("part", F.concat_ws("-", F.lit("f"), "x", "y")).withColumn("side", F.lit(side)).select(*keep) for df, side in ((one, 1), (two, 2))]
    # the others among themselves
    own = other.withColumn("x", mine("others")).withColumn("y", each("others"))
    own = own.withColumn("part", F.concat_ws("-", F.lit("o"), F.least("x", "y"), F.greatest("x", "y"))).withColumn("side", F.when(F.col("x") == F.col("y"), 0).when(F.col("x") < F.col("y"), 1).otherwise(2)).select(*keep)
    return across[0].unionAll(across[1]).unionAll(own).join(about, "id").join(texts, "id").select("cluster", "part", "side", "id", "component", "n", "signature", "text")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest linked doc_id, its own included)."""
    described = checkpointed(describe(docs, shingle))
    some = described.where("n > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("id"), F.min_by("signature", "doc_id").alias("signature"))
    classes = checkpointed(classes)
    bands = band_rows(classes)
    heads = bands.groupBy("band").agg(F.min("id").alias("b"), F.count("*").alias("c")).where("c > 1")
    crowded = checkpointed(bands.join(heads, "band").select("band", "id", "b", "c"))
    pairs = checkpointed(crowded.where("id <> b").select(F.col("id").alias("a"), "b").distinct())
    wanted = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    texts = checkpointed(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id", "left_semi").dropDuplicates(["id"]))
    links = checkpointed(verify(pairs, texts, shingle, percent))

    # buckets in which several components are left
    named = checkpointed(components(links))
    labelled = crowded.join(named.withColumnRenamed("node", "id"), "id", "left").select("band", "id", "b", F.coalesce("component", "id").alias("component"))
    mixed = labelled.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("k")).where("x <> y AND k > 2").select("band", "k")
    inside = checkpointed(labelled.join(mixed, "band"))
    about = classes.select("id", "n", "signature")
    small = inside.where(F.col("k") <= SMALL).join(about, "id")
    groups = max(8, inside.count() // 4000)
    likely = rivals(small.select("band", "id", "component", "n", "signature", F.pmod(F.xxhash64("band"), F.lit(groups)).alias("g")), percent)
    more = checkpointed(likely.join(pairs, ["a", "b"], "left_anti"))

    found = verify(more, texts, shingle, percent)

    large = inside.where(F.col("k") > SMALL)
    if not large.isEmpty():
        found = found.unionAll(cluster_links(_blocks(large, classes, texts), shingle, percent))
    named = joined_components(named, found)
    member = some.select("doc_id", "k1", "k2", "n").join(classes.select("k1", "k2", "n", "id"), ["k1", "k2", "n"]).select("doc_id", "id")
    member = member.join(named.withColumnRenamed("node", "id"), "id", "left").select("doc_id", F.coalesce("component", "id").alias("found")).groupBy("doc_id").agg(F.min("found").alias("found"))
    out = described.select("doc_id", "n").join(member, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("found", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without the members of each group but the one with the smallest doc_id; all columns stay as they are.
    Rows with a null doc_id or without words stay."""
    gone = near_duplicates(docs, shingle, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def brute_force(docs: list[tuple[int, str | None]], shingle: int = 2, percent: int = 80) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = {}
    for doc, text in docs:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = len(sets[a]), len(sets[b])
            if 100 * min(x, y) < percent * max(x, y):
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (x + y - both):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return [(d, len(s), find(d), find(d) == d) for d, s in sets.items()]
