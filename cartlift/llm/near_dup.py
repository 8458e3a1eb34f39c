"""Near-duplicate detection: MinHash bands, odd sketches, exact confirmation.

Every document is its set of distinct word shingles.  Equal sets collapse to
one *node* first, so exact copies cost one row.  A node's MinHash samples are
used twice: groups of ``rows`` samples are its band keys, and all samples are
folded into an odd sketch, a bitmap in which each sample flips one bit.  The
population count of two sketches' XOR grows with the number of samples that
differ, so it estimates high similarities precisely from a few words: a pair
whose count is above what the threshold allows (``z`` standard deviations
away) is dropped; all others are confirmed on the full sets.

Buckets never emit all pairs.  Each bucket links its members to one hub, a
different random one in each band.  Bands are taken in rounds, few at first,
and components are contracted between them: a later round makes a pair only
where member and hub lie in different components still, so a large group costs
the first round's pairs and little more.  What hubs can't show
is then closed exactly, in two parts.  Nodes joined by links or by pairs within
the sketch bound, confirmed or not, are a *family*; families that hold several
components are compared whole, block by block, and the tasks confirm on full
sets and give only links that join components.  Members of one bucket but of
different families are compared by sketch, and the few pairs within the bound
confirmed.

With 48 bands of 5 samples a pair at similarity 0.8 shares no band with
probability 5e-9.  Defined cases: null text counts as empty; a document without
words is linked with nothing; one with fewer words than a shingle is one
shingle; null ids never give a component its name unless all are null;
repeated rows share set and component; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlift.llm.common import WordHashes, materialize, mix64, row_chunks
from cartlift.llm.components import connected_components

BANDS, ROWS, BITS = 48, 5, 1024
ROUNDS = (4, 16)     # bands up to which the first rounds go; one more takes the rest
SALTS = 8            # parts that a mixed bucket's members are dealt into
BLOCK = 512          # members of a bucket that are compared at a time
TEXTS = 128          # documents that are confirmed against one other in a group


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of A-Z-folded text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes.lower folds A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.array(words)
    n = max(1, len(h) - width + 1)
    acc = np.zeros(n, np.uint64)
    for j in range(min(width, len(h))):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
    return np.unique(mix64(acc))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b|, exactly."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Signer:
    """MinHash samples, band keys and odd sketch of shingle sets."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, bits: int = BITS):
        self.bands, self.rows, self.bits = bands, rows, bits
        rng = np.random.default_rng(20240229)
        self.factors = rng.integers(0, 2 ** 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.salts = rng.integers(0, 2 ** 63, bands * rows, dtype=np.uint64)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        """Least value of each of the sample functions (odd multiples modulo
        2**32 of the shingles' hashes), some hundred shingles at a time."""
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.factors), np.iinfo(np.uint32).max)
        for at in range(0, len(short), 512):
            np.minimum(out, np.multiply.outer(short[at:at + 512], self.factors).min(axis=0), out=out)
        return out.astype(np.uint64)

    def keys(self, samples: np.ndarray) -> np.ndarray:
        s = (samples ^ self.salts).reshape(self.bands, self.rows)
        acc = np.arange(1, self.bands + 1, dtype=np.uint64)
        for j in range(self.rows):
            acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + s[:, j])
        return acc

    def sketch(self, samples: np.ndarray) -> np.ndarray:
        at = mix64(samples ^ self.salts) % np.uint64(self.bits)
        return np.packbits(np.bincount(at.astype(np.int64), minlength=self.bits).astype(np.uint8) & 1)


def sketch_limit(percent: int, samples: int, bits: int, z: float = 4.0) -> int:
    """Largest XOR population count that a pair at the threshold can reasonably
    have: ``z`` deviations of the differing samples, then ``z`` of the bits."""
    t = percent / 100
    differ = samples * (1 - t) + z * math.sqrt(samples * t * (1 - t))
    odd = bits / 2 * (1 - (1 - 2 / bits) ** (2 * differ))
    return math.ceil(odd + z * math.sqrt(bits * (odd / bits) * (1 - odd / bits)))


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int, bits: int) -> DataFrame:
    """Per document: id, n (set size), digest of the set, band keys, sketch."""
    def run(batches):
        hashes, signer = WordHashes(limit=150_000), Signer(bands, rows, bits)
        for part in row_chunks(batches, ["id", "text"], 1_000_000):
            ids, ns, digests, keys, sketches = [], [], [], [], []
            for doc_id, text in part:
                s = shingle_set(text, width, hashes)
                samples = signer.samples(s) if len(s) else None
                ids.append(doc_id)
                ns.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(signer.keys(samples).tobytes() if len(s) else b"")
                sketches.append(signer.sketch(samples).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, id_arrow), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())],
                names=["id", "n", "digest", "keys", "sketch"])

    from pyspark.sql.pandas.types import to_arrow_type
    id_type = docs.schema[id_col].dataType
    id_arrow = to_arrow_type(id_type)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, T.StructType([T.StructField("id", id_type), T.StructField("n", T.LongType()),
                           *[T.StructField(c, T.BinaryType()) for c in ("digest", "keys", "sketch")]]))


def band_rows(nodes: DataFrame) -> DataFrame:
    """(key, band, node) of every node and band."""
    def run(batches):
        for b in batches:
            keys = [np.frombuffer(k.as_py(), np.int64) for k in b.column(1)]
            if not keys:
                continue
            n = np.array([len(k) for k in keys])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.concatenate([np.arange(i, dtype=np.int32) for i in n])),
                 pa.array(np.repeat(b.column(0).to_numpy(), n))], names=["key", "band", "node"])

    return nodes.select("node", "keys").mapInArrow(run, "key long, band int, node long")


def sketch_filter(pairs: DataFrame, nodes: DataFrame, percent: int, limit: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the threshold."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(b.num_rows, -1)
            y = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint64).reshape(b.num_rows, -1)
            ok = np.bitwise_count(x ^ y).sum(1) <= limit
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(ok)) for i in range(2)], names=["a", "b"])

    own = nodes.select("node", "n", "sketch")
    wide = (pairs.join(own.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
            .join(own.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
            .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    return wide.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold.  Pairs of
    one document go to groups of at most about TEXTS others, whatever its degree."""
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("deg"))
    dealt = (pairs.join(degree, "a")
             .withColumn("chunk", F.pmod(F.xxhash64("b"), F.ceil(F.col("deg") / TEXTS)).cast("long"))
             .select("a", "b", "chunk"))
    heads = (dealt.select("a", "chunk").distinct().join(texts.select(F.col("node").alias("a"), "text"), "a")
             .select("a", "chunk", F.lit(None).cast("long").alias("b"), "text"))
    others = (dealt.join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "chunk", "b", "text"))

    def check(t: pa.Table) -> pa.Table:
        hashes = WordHashes()
        bs, own = t.column("b").to_pylist(), t.column("text")
        head = shingle_set(own[bs.index(None)].as_py(), width, hashes)
        hits = [b for i, b in enumerate(bs)
                if b is not None and similar(head, shingle_set(own[i].as_py(), width, hashes), percent)]
        a = t.column("a")[0].as_py()
        return pa.table({"a": pa.array([a] * len(hits), pa.int64()), "b": pa.array(hits, pa.int64())})

    return heads.unionByName(others).groupBy("a", "chunk").applyInArrow(check, "a long, b long")


def star_pairs(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs (a, b) of a bucket's hub and its members in other components.
    Buckets within one component make none; the members of a mixed one are
    dealt to SALTS tasks, and its hub is sent to each."""
    def pair(df: DataFrame) -> DataFrame:
        return df.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()

    if labels is None:
        return pair(buckets.where("node <> hub"))
    named = (buckets.select("key", "node", "hub").join(labels, "node", "left")
             .withColumn("comp", F.coalesce("comp", "node")))
    hubs = (named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                     F.max(F.when(F.col("node") == F.col("hub"), F.col("comp"))).alias("hub_comp"))
            .where("lo <> hi").select("key", "hub_comp", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    dealt = named.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return pair(dealt.join(hubs, ["key", "salt"]).where("comp <> hub_comp"))


def merge(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after adding links: the links' components are joined, then renamed."""
    if labels is None:
        return connected_components(links)
    la = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    lb = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    lifted = links.join(la, "a", "left").join(lb, "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    renamed = connected_components(lifted).withColumnRenamed("node", "was").withColumnRenamed("comp", "now")
    known = labels.join(renamed, labels["comp"] == renamed["was"], "left").select(
        "node", F.coalesce("now", "comp").alias("comp"))
    new = renamed.join(labels.select(F.col("node").alias("was")), "was", "left_anti").select(
        F.col("was").alias("node"), F.col("now").alias("comp"))
    return materialize(known.unionByName(new), "labels")


def blocks_of(members: DataFrame, key: str, *columns: str) -> DataFrame:
    """Members (``key``, ``m`` members in all) dealt into blocks of about
    BLOCK; a row for each pair of blocks (i, j) that a member's block is in."""
    dealt = members.withColumn("of", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn(
        "at", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    return dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).select(
        key, F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), "at", "node", *columns)


def within_bound(t: pa.Table, left: np.ndarray, right: np.ndarray, group: str, percent: int, limit: int):
    """Index pairs (and XOR counts) whose sketches and sizes allow the
    threshold and whose ``group`` differs, some rows of ``left`` at a time."""
    comp, n = t.column(group).to_numpy(), t.column("n").to_numpy()
    sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(t.num_rows, -1)
    for s in range(0, len(left), 32):
        l = left[s:s + 32]
        diff = np.zeros((len(l), len(right)), np.int64)
        for word in range(sk.shape[1]):
            diff += np.bitwise_count(sk[l, word][:, None] ^ sk[right, word][None, :])
        ok = (diff <= limit) & (comp[l][:, None] != comp[right][None, :])
        ok &= 100 * np.minimum(n[l][:, None], n[right][None, :]) >= percent * np.maximum(n[l][:, None], n[right][None, :])
        x, y = np.nonzero(ok)
        if len(x):
            yield l[x], right[y], diff[x, y]


def family_links(families: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, width: int,
                 percent: int, limit: int) -> DataFrame:
    """Links between different components of one family, confirmed on full
    sets; of a pair of blocks only links that join something."""
    named = families.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = (named.groupBy("family").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"))
             .where("lo <> hi").select("family", "m"))
    members = (named.join(mixed, "family").join(nodes.select("node", "n", "sketch"), "node").join(texts, "node"))

    def compare(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        at, node, comp = (t.column(c).to_numpy() for c in ("at", "node", "comp"))
        hashes, sets, joined = WordHashes(limit=150_000), {}, {}

        def root(c: int) -> int:
            while joined.get(c, c) != c:
                c = joined[c]
            return c

        def own(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingle_set(texts_[k].as_py(), width, hashes)
            return sets[k]

        texts_, links = t.column("text"), []
        for x, y, diff in within_bound(t, np.flatnonzero(at == i), np.flatnonzero(at == j), "comp", percent, limit):
            for k in np.argsort(diff, kind="stable").tolist():  # the likeliest links first
                a, b = int(x[k]), int(y[k])
                ca, cb = root(int(comp[a])), root(int(comp[b]))
                if ca != cb and similar(own(a), own(b), percent):
                    joined[max(ca, cb)] = min(ca, cb)
                    links.append((int(node[a]), int(node[b])))
        return pa.table({"a": pa.array([l[0] for l in links], pa.int64()), "b": pa.array([l[1] for l in links], pa.int64())})

    return (blocks_of(members, "family", "comp", "n", "sketch", "text").groupBy("family", "i", "j")
            .applyInArrow(compare, "a long, b long"))


def open_members(buckets: DataFrame, families: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members, without the hub, of buckets whose members other than the hub
    lie in several families, with family, size, band keys and sketch."""
    rest = buckets.where((F.col("node") != F.col("hub")) & (F.col("m") >= 3)).select("key", "band", "node")
    named = rest.join(families, "node", "left").withColumn("family", F.coalesce("family", "node"))
    mixed = (named.groupBy("key").agg(F.min("family").alias("lo"), F.max("family").alias("hi"), F.count(F.lit(1)).alias("m"))
             .where("lo <> hi").select("key", "m"))
    return named.join(mixed, "key").join(nodes.select("node", "n", "keys", "sketch"), "node")


def block_pairs(members: DataFrame, percent: int, limit: int) -> DataFrame:
    """Pairs of members of one bucket but different families whose sketches
    allow the threshold, each by the first band that both share only."""
    def compare(t: pa.Table) -> pa.Table:
        i, j, band = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("band")[0].as_py()
        at, node = t.column("at").to_numpy(), t.column("node").to_numpy()
        keys = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.int64).reshape(t.num_rows, -1)
        one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y, _ in within_bound(t, np.flatnonzero(at == i), np.flatnonzero(at == j), "family", percent, limit):
            for c in range(0, len(x), 4096):
                a, b = x[c:c + 4096], y[c:c + 4096]
                first = (keys[a] == keys[b]).argmax(1) == band
                one.append(node[a[first]])
                two.append(node[b[first]])
        a, b = np.concatenate(one), np.concatenate(two)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    return (blocks_of(members, "key", "band", "family", "n", "keys", "sketch").groupBy("key", "i", "j")
            .applyInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 80, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id reachable), kept."""
    limit = sketch_limit(percent, bands * rows, bits)
    signed = materialize(signatures(docs, id_col, text_col, width, bands, rows, bits), "signatures")
    nodes = materialize(signed.where("n > 0").groupBy("digest").agg(
        F.min("id").alias("min_id"), F.first("n").alias("n"), F.first("keys").alias("keys"),
        F.first("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()), "nodes")

    keyed = band_rows(nodes)
    hubs = (keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(
        F.xxhash64("node", "key").alias("h"), "node")).alias("hub")).where("m >= 2")
        .select("key", "m", F.col("hub.node").alias("hub")))
    buckets = materialize(keyed.join(hubs, "key"), "buckets")
    # texts of the nodes that share a bucket with another
    wanted = buckets.select("node").distinct()
    texts = materialize(_texts(docs, nodes.join(wanted, "node").select("node", "min_id", "digest"),
                               id_col, text_col, width), "texts")

    labels, stars, lo = None, None, 0
    for hi in (*ROUNDS, bands):
        # written once: the confirmation reads the pairs several times
        pairs = materialize(sketch_filter(star_pairs(buckets.where((F.col("band") >= lo) & (F.col("band") < hi)), labels),
                                          nodes, percent, limit), "pairs")
        labels = merge(labels, materialize(confirm(pairs, texts, width, percent), "links"))
        stars, lo = pairs if stars is None else stars.unionByName(pairs), hi
    families = merge(labels, stars).withColumnRenamed("comp", "family")
    labels = merge(labels, materialize(family_links(families, labels, nodes, texts, width, percent, limit), "links"))
    found = materialize(block_pairs(open_members(buckets, families, nodes), percent, limit).distinct()
                        .join(stars.select("a", "b"), ["a", "b"], "left_anti"), "block_pairs")
    labels = merge(labels, materialize(confirm(found, texts, width, percent), "links"))

    named = nodes.select("digest", "node", "min_id").join(labels, "node", "left").withColumn(
        "comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("min_id").alias("component_id"))
    verdict = named.join(least, "comp").select("digest", "component_id")
    out = signed.select("id", "n", "digest").join(verdict, "digest", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, text): one document of each wanted node (the digest tells texts under one id apart)."""
    def run(batches):
        hashes = WordHashes(limit=150_000)
        for rows in row_chunks(batches, ["node", "digest", "text"], 1_000_000):
            own = [(n, t) for n, d, t in rows
                   if xxhash.xxh3_128_digest(shingle_set(t, width, hashes).tobytes()) == d]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in own], pa.int64()),
                                              pa.array([o[1] for o in own], pa.string())], names=["node", "text"])

    rows = docs.select(F.col(id_col).alias("min_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.join(wanted, rows["min_id"].eqNullSafe(wanted["min_id"])).select("node", "digest", "text")
    return found.mapInArrow(run, "node long, text string").dropDuplicates(["node"])
