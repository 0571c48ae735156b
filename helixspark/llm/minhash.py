"""Near-duplicate documents by MinHash bands, sequential Bayesian verification and exact verification.

Documents with the same sequence of words form a class, and only classes are compared. Classes that share a band of their
MinHash signatures are candidates. First each class is paired with the smallest class of all its buckets, one pair for each
class. Pairs are checked batch by batch of the signature and given up once the posterior probability of reaching the
similarity falls below MISS; the survivors are verified on the full sets of shingles, word by word. Links make components.
Buckets that still hold several components are gone through for pairs between different components, in blocks of bounded
size, again by signature batches: first for the most alike partner of each class, then, in buckets where any pair was left, for the FIRST most
alike in each bucket, and at last, in buckets where these weren't all, for everything that is left. No candidate is dropped other than by the posterior bound. The chance that a pair of exactly the
least similarity shares no band is (1 - least ** ROWS) ** BANDS, 5e-6 at 0.8.

Texts and signatures reach their pairs in one sorted exchange, the hub of many pairs before its partners, and are read as a
stream: a task holds one hub and one batch. Hubs with many pairs are dealt over parts, as are the copies of one text and the
classes of one component.

Defined results: null and empty texts, and those without words, have no shingles and are linked with nothing. Null identifiers
take part but are never the smallest of a component that has others. Repeated rows have equal sets and so one component. Very long texts are
taken whole. An empty table gives an empty result. Columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap_of, in_bitmap, release, ship, staged, text_of, tidy, without
from .components import components
from .words import remembers, slices, turn_of

BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
#: Hashes of a signature that are compared at a time.
BATCH = 40
#: Posterior probability below which a pair is given up.
MISS = 1e-7
#: Members of a bucket that one block holds.
BLOCK = 4096
#: Shingles that one block holds on average.
BLOCK_SHINGLES = 1 << 22
#: Pairs of a class in a bucket that the second pass over unlike buckets takes.
FIRST = 4
#: Pairs of one hub that one part holds.
DEALT = 2048
#: Parts into which the rows of one class or component are dealt.
SALTS = 16


class _Hashes:
    """64-bit hashes of words met lately."""

    def __init__(self, size: int = 300_000):
        self.size, self.known = size, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        turn_of("minhash")
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            if len(known) > self.size:
                known.clear()
            for i, x in enumerate(found):
                if x is None:
                    w = words[i]
                    found[i] = x = xxhash.xxh64_intdigest(w)
                    if len(w) < 64:
                        known[w] = x
        return np.array(found, dtype=np.uint64)


_hashes = _Hashes()
remembers("minhash", lambda: _hashes.known.clear())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of k words of each text, A-Z in lower case; fewer words are one run."""
    split = [words(t) for t in texts]
    h = _hashes([w for ws in split for w in ws])
    odd = np.random.default_rng(3).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out, at = [], 0
    for ws in split:
        n = len(ws)
        own = h[at : at + n]
        at += n
        if not n:
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        size = min(k, n)
        key = np.full(n - size + 1, size, dtype=np.uint64)
        for j in range(size):
            key = _mixed(key * odd[j] + own[j : n - size + 1 + j])
        out.append(np.unique(key))
    return out


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def class_key(text: str) -> bytes:
    """A cryptographic digest of the sequence of words."""
    return hashlib.blake2b(b" ".join(words(text)), digest_size=16).digest()


def exact_set(text: str, k: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    ws = words(text)
    return set(zip(*(ws[i:] for i in range(min(k, len(ws)))), strict=False))


@lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(n, HASHES) of 32 bits; the sets must have a member each."""
    flat = np.concatenate(sets)
    x = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    start = np.cumsum([0, *map(len, sets[:-1])])
    a, b = _permutations()
    out = np.empty((len(sets), HASHES), dtype=np.uint32)
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat(x * a[i] + b[i], start)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) of 64 bits, each with its band's number mixed in."""
    rows = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for j in range(ROWS):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    return key.view(np.int64)


@lru_cache(8)
def least_matches(least: float, miss: float = MISS) -> list[tuple[int, int]]:
    """After so many hashes, matches needed to go on. Signatures keep a byte of each hash, so unlike ones match by chance in 256.

    With a uniform prior the posterior of a match's probability after m of n is Beta(m + 1, n - m + 1), whose mass above
    p is the chance of at most m heads in n + 1 throws of a coin of p.
    """
    p = least + (1 - least) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        mass, m = 0.0, -1
        while mass < miss:
            m += 1
            mass += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        out.append((n, m))
    return out


def alike(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Places of the pairs of rows of a and b (bytes, (n, HASHES)) that no batch gives up."""
    left, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int32)
    for n, need in least_matches(least):
        matches = matches + np.count_nonzero(a[left, n - BATCH : n] == b[left, n - BATCH : n], axis=1)
        go = matches >= need
        left, matches = left[go], matches[go]
    return left


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _sketched(docs: DataFrame, k: int) -> DataFrame:
    """id, n_shingles, key, bands, sig of each document."""
    schema = T.StructType([docs.schema["id"], *T._parse_datatype_string("n_shingles long, key binary, bands array<long>, sig binary").fields])

    def run(batches):
        for batch in (x.slice(at, 1024) for x in batches for at in range(0, x.num_rows, 1024)):
            ids, at = batch.column(0), 0
            for part in slices(batch.column(1).to_pylist(), 1 << 19):
                sets = shingle_sets(part, k)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands, sigs = [None] * len(sets), [None] * len(sets)
                if full:
                    sig = signatures([sets[i] for i in full])
                    keys = band_keys(sig)
                    for i, own, key in zip(full, sig.astype(np.uint8), keys, strict=True):
                        bands[i], sigs[i] = key, own.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), pa.array(list(map(len, sets)), pa.int64()), pa.array([class_key(t) if len(s) else None for t, s in zip(part, sets, strict=True)], pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=schema.names
                )
                at += len(part)

    return docs.mapInArrow(run, schema)


def _dealt(pairs: DataFrame) -> DataFrame:
    """cid, a, part, role of all that the pairs (a, b) need: a itself (role 0) once in each part, and its partners (role 1)."""
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("parts")).filter("parts > 1")
    part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")
    sided = pairs.join(hubs.withColumnRenamed("a", "hot"), F.col("a") == F.col("hot"), "left").select("a", "b", part.alias("part"))
    heads = sided.select(F.col("a").alias("cid"), "a", "part", F.lit(0).alias("role")).distinct()
    return heads.unionByName(sided.select(F.col("b").alias("cid"), "a", "part", F.lit(1).alias("role")))


def _some(df: DataFrame, col: str, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of df that may be wanted: those whose bit is set in a bitmap of the keys, and those without a key."""
    return in_bitmap(df, col, bitmap_of(wanted, key)).unionByName(df.filter(F.col(col).isNull()))


def _given(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that the signatures don't give up, written."""
    percent = round(least * 100)
    dealt = staged(_dealt(pairs), "minhash-dealt")
    own = _some(classes.select(F.col("cid").alias("c"), "n_shingles", "sig"), "c", dealt, "cid")
    rows = dealt.join(own, dealt["cid"] == own["c"]).select("a", "part", "role", "cid", "n_shingles", "sig")

    def run(batches):
        held = None  # the hub of the rows to come: a, n_shingles, sig
        for batch in batches:
            if not batch.num_rows:
                continue
            a, _, role, cid, n = (batch.column(i).to_numpy() for i in range(5))
            sig = _bytes(batch.column(5))
            if held:
                a, role, cid, n = np.r_[held[0], a], np.r_[0, role], np.r_[held[0], cid], np.r_[held[1], n]
                sig = np.concatenate([held[2][None], sig])
            hub = np.maximum.accumulate(np.where(role == 0, np.arange(len(a)), 0))
            held = a[hub[-1]], n[hub[-1]], sig[hub[-1]].copy()
            at = np.flatnonzero((role == 1) & (np.minimum(n, n[hub]) * 100 >= np.maximum(n, n[hub]) * percent))
            for k in range(0, len(at), 8192):
                own = at[k : k + 8192]
                own = own[alike(sig[hub[own]], sig[own], least)]
                yield pa.RecordBatch.from_arrays([pa.array(a[own]), pa.array(cid[own])], names=["a", "b"])

    found = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(run, "a long, b long")
    found = staged(found, "minhash-given")
    release(dealt)
    return found


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, least: float) -> DataFrame:
    """The pairs whose full sets reach the similarity, written. Texts come along, so that no hash decides."""
    percent = round(least * 100)
    named = classes.select(F.col("cid").alias("c"), "key", "rep_id")
    dealt = _dealt(pairs).join(named, F.col("cid") == F.col("c")).select("a", "part", "role", "cid", "key", "rep_id")
    dealt = staged(dealt, "minhash-wanted")
    rows = _some(docs, "id", dealt, "rep_id").join(dealt, F.col("id").eqNullSafe(F.col("rep_id"))).select("a", "part", "role", "cid", "key", "text")

    def run(batches):
        turn_of("minhash")
        hub, own = None, set()
        for batch in (x.slice(at, 512) for x in batches for at in range(0, x.num_rows, 512)):  # Python's texts of a few rows at a time
            out_a, out_b = [], []
            for a, role, cid, key, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if class_key(text) != key:
                    continue  # another row of this identifier
                if role == 0:
                    if hub != a:
                        hub, own = a, exact_set(text, k)
                    continue
                other = exact_set(text, k)
                common = len(own & other)
                if 100 * common >= percent * (len(own) + len(other) - common):
                    out_a.append(a)
                    out_b.append(cid)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    found = staged(rows.repartition("a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(run, "a long, b long"), "minhash-links")
    release(dealt)
    return found


def _whole_groups(batches, keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups, rows of which have the same first so many columns and follow each other."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        new = np.zeros(t.num_rows - 1, dtype=bool)
        for i in range(keys):
            c = t.column(i).to_numpy()
            new |= c[1:] != c[:-1]
        cut = np.flatnonzero(new)
        if len(cut):
            yield t.slice(0, cut[-1] + 1)
        rest = t.slice(cut[-1] + 1) if len(cut) else t
    if rest is not None:
        yield rest


def _places(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within groups of these sizes that follow each other: some tens of thousands of pairs at a time."""
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        if n < 2:
            continue
        first = starts[sizes == n]
        if n <= 128:
            i, j = np.triu_indices(n, 1)
            step = max(1, 32768 // len(i))
            for at in range(0, len(first), step):
                own = first[at : at + step, None]
                yield (own + i).ravel(), (own + j).ravel()
        else:
            for start in first:
                for i in range(start, start + n - 1):
                    j = np.arange(i + 1, start + n)
                    yield np.full(len(j), i), j


def _unlike_buckets(members: DataFrame, comps: DataFrame, classes: DataFrame, more: list[str]) -> DataFrame:
    """members (bucket, cid) of the buckets that hold several components: bucket, x, y, own, cid, comp and columns of their classes.

    Buckets are cut into blocks, and each pair of blocks (x, y) is a group of its own.
    """
    now = members.join(comps.select(F.col("v").alias("cid"), "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    now = now.join(classes.select("cid", "n_shingles"), "cid")
    mixed = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight")).filter("lo <> hi")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.least("n", F.ceil(F.col("weight") / BLOCK_SHINGLES)))
    rows = now.drop("n_shingles").join(mixed.select("bucket", blocks.cast("int").alias("blocks")), "bucket")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "cid", "comp")
    return rows.join(_some(classes.select("cid", *more), "cid", rows, "cid"), "cid").select("bucket", "x", "y", "own", "cid", "comp", *more)


def _first_unlike(members: DataFrame, classes: DataFrame, comps: DataFrame, least: float, first: int) -> DataFrame:
    """Pairs (bucket, a, b, left, score) between different components of a bucket that the signatures don't give up, written.

    Each class (left) of the smaller component has its first most alike partners; where it has more, a row without pair names the bucket.
    """
    percent = round(least * 100)
    rows = _unlike_buckets(members, comps, classes, ["n_shingles", "sig"])

    def run(batches):
        for t in _whole_groups(batches, 3):
            bucket, x, y, own, cid, comp, n = (t.column(i).to_numpy() for i in range(7))
            sig = _bytes(t.column(7).combine_chunks())
            new = np.r_[True, (bucket[1:] != bucket[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
            group = np.cumsum(new) - 1
            order = np.lexsort((comp, group))
            edge = np.flatnonzero(np.r_[True, (group[order][1:] != group[order][:-1]) | (comp[order][1:] != comp[order][:-1])])
            many = np.diff(np.r_[edge, len(order)])
            size = np.empty(len(order), dtype=np.int64)  # rows of the same component in the group
            size[order] = np.repeat(many, many)
            left, right, score = [], [], []
            for i, j in _places(np.bincount(group)):
                go = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent) & ((x[i] == y[i]) | (own[i] != own[j]))
                i, j = i[go], j[go]
                go = alike(sig[i], sig[j], least)
                i, j = i[go], j[go]
                if len(i):
                    turn = (size[i] > size[j]) | (size[i] == size[j]) & (comp[i] > comp[j])
                    left.append(np.where(turn, j, i))
                    right.append(np.where(turn, i, j))
                    score.append(np.count_nonzero(sig[i] == sig[j], axis=1))
            if not left:
                continue
            left, right, score = map(np.concatenate, (left, right, score))
            order = np.lexsort((cid[right], -score, left))
            left, right, score = left[order], right[order], score[order]
            edge = np.flatnonzero(np.r_[True, left[1:] != left[:-1]])
            rank = np.arange(len(left)) - np.repeat(edge, np.diff(np.r_[edge, len(left)]))
            crowd = np.unique(bucket[left[rank >= first]])
            left, right, score = left[rank < first], right[rank < first], score[rank < first]
            pairs = np.minimum(cid[left], cid[right]), np.maximum(cid[left], cid[right]), cid[left], score
            none = np.zeros(len(crowd), dtype=np.int64)
            missing = np.r_[np.zeros(len(left), dtype=bool), np.ones(len(crowd), dtype=bool)]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[bucket[left], crowd]), *(pa.array(np.r_[v, none], mask=missing) for v in pairs)], names=["bucket", "a", "b", "left", "score"])

    return staged(rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(run, "bucket long, a long, b long, left long, score long"), "minhash-unlike")


def _short_sets(classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """cid, hashes: sorted 32-bit halves of the shingles' hashes, repeated ones kept, so that sets have no less in common by them. Written."""
    rows = _some(docs, "id", classes, "rep_id").join(classes.select("cid", "key", "rep_id"), F.col("id").eqNullSafe(F.col("rep_id"))).select("cid", "key", "text")

    def run(batches):
        for batch in batches:
            at = 0
            for part in slices(batch.column(2).to_pylist(), 1 << 19):
                own = batch.slice(at, len(part))
                at += len(part)
                same = [i for i, (t, key) in enumerate(zip(part, own.column(1).to_pylist(), strict=True)) if class_key(t) == key]
                sets = shingle_sets([part[i] for i in same], k)
                yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(same, pa.int64())), pa.array([np.sort((s >> np.uint64(32)).astype(np.uint32)).view(np.int32) for s in sets], pa.list_(pa.int32()))], names=["cid", "hashes"])

    return staged(rows.mapInArrow(run, "cid long, hashes array<int>").dropDuplicates(["cid"]), "minhash-sets")


def _flattened(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()


def _inside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the sorted a whether it is in the sorted b."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return b[at] == a


def _all_unlike(members: DataFrame, classes: DataFrame, comps: DataFrame, docs: DataFrame, k: int, least: float) -> DataFrame:
    """All pairs (a, b) between different components of a bucket whose sets have enough hashes in common, written.

    The sets come along with the signatures, so that a crowd of classes a little less alike than asked for makes no rows. A pair
    is taken in the first bucket that it shares.
    """
    percent = round(least * 100)
    wanted = staged(members.select("cid").distinct().join(classes, "cid"), "minhash-crowd")
    sets = _short_sets(wanted, docs, k)
    rows = _unlike_buckets(members, comps, wanted.join(sets, "cid"), ["n_shingles", "sig", "bands", "hashes"])

    def run(batches):
        for t in _whole_groups(batches, 3):
            bucket, x, y, own, cid, comp, n = (t.column(i).to_numpy() for i in range(7))
            new = np.r_[True, (bucket[1:] != bucket[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
            sig, bands = _bytes(t.column(7).combine_chunks()), np.array(t.column(8).to_pylist(), dtype=np.int64)
            flat, start = _flattened(t.column(9).combine_chunks())
            band = np.argmax(bands == bucket[:, None], axis=1)
            out_a, out_b = [], []
            for i, j in _places(np.bincount(np.cumsum(new) - 1)):
                go = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent) & ((x[i] == y[i]) | (own[i] != own[j]))
                i, j = i[go], j[go]
                go = alike(sig[i], sig[j], least)
                i, j = i[go], j[go]
                go = np.argmax(bands[i] == bands[j], axis=1) == band[i]
                i, j = i[go], j[go]
                common = np.array([np.count_nonzero(_inside(flat[start[p] : start[p + 1]], flat[start[q] : start[q + 1]])) for p, q in zip(i, j, strict=True)], dtype=np.int64)
                go = common * 100 >= (n[i] + n[j] - common) * percent
                out_a.append(cid[i[go]])
                out_b.append(cid[j[go]])
            if out_a:
                a, b = np.concatenate(out_a), np.concatenate(out_b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    found = staged(rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(run, "a long, b long").distinct(), "minhash-all")
    release(wanted, sets)
    return found


def _linked(tested: DataFrame, classes: DataFrame, docs: DataFrame, k: int, least: float) -> DataFrame:
    given = _given(tested, classes, least)
    links = _verified(given, classes, docs, k, least)
    release(given)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest identifier reachable), kept. least: in whole hundredths."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    sketched = staged(_sketched(docs, shingle), "minhash-sketches")
    classes = sketched.filter("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "minhash-classes")
    slim = staged(sketched.select("id", "n_shingles", "key"), "minhash-documents")
    release(sketched)

    rows = classes.select(F.explode("bands").alias("bucket"), "cid")
    hubs = rows.groupBy("bucket").agg(F.min("cid").alias("h"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", "h")
    members = staged(rows.join(hubs, "bucket"), "minhash-members")
    pairs = staged(members.groupBy("cid").agg(F.min("h").alias("a")).filter("a < cid").select("a", F.col("cid").alias("b")), "minhash-pairs")
    members = members.select("bucket", "cid")
    links = _linked(pairs, classes, docs, shingle, least)
    comps = components(links)
    tested = pairs
    for first in (1, FIRST):
        unlike = _first_unlike(members, classes, comps, least, first)
        more = unlike.filter("a IS NOT NULL")
        if first == 1:  # over all buckets of a class
            more = more.groupBy("left").agg(F.max_by(F.struct("a", "b"), F.struct("score", "a", "b")).alias("pair")).select("pair.*")
        more = staged(more.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "minhash-more")
        left = (unlike if first == 1 else unlike.filter("a IS NULL")).select("bucket").distinct()
        members = staged(members.join(left, "bucket"), "minhash-left")
        release(unlike)
        if not more.isEmpty():
            links = links.union(_verified(more, classes, docs, shingle, least))
            tested = tested.union(more)
            comps = components(links)
    if not members.isEmpty():
        last = _all_unlike(members, classes, comps, docs, shingle, least)
        found = _verified(last.join(tested, ["a", "b"], "left_anti"), classes, docs, shingle, least)
        if not found.isEmpty():
            comps = components(links.union(found))

    # The rows of one component, and of one class, meet theirs in parts.
    linked = comps.join(classes.select(F.col("cid").alias("v"), "rep_id"), "v")
    smallest = linked.groupBy("comp").agg(F.min("rep_id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = comps.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    named = salted.join(smallest, ["comp", "salt"]).select(F.col("v").alias("cid"), "component_id")
    named = classes.select("key", "cid", "rep_id").join(named, "cid", "left").select("key", F.coalesce("component_id", "rep_id").alias("component_id"))
    slim = slim.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    named = slim.filter("key IS NOT NULL").select("key", "salt").distinct().join(named, "key")
    out = slim.join(named, ["key", "salt"], "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one document of each component: that of the smallest identifier. Rows without identifier stay."""
    with tidy(docs.sparkSession) as keep:
        gone = keep(staged(near_duplicates(docs, id_col, text_col, shingle, least).filter(~F.col("kept")).select(F.col(id_col).alias("id")).distinct(), "minhash-gone"))
    return without(docs, id_col, gone)
