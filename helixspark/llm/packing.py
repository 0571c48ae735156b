"""Best-fit packing of token pieces by a distributed grouping genetic algorithm.

Pieces are dealt into blocks of bounded size. For each block several islands evolve a population of packings: crossover
takes whole well-filled bins of one parent into the other, drops the bins there that hold one of the same pieces, and
best-fits what was displaced, longest first. The first population are random groupings: the pieces in random orders, each put where it
fits best. Evolution ends early where a packing has no more bins than the pieces' sum needs, as none has fewer.
Between epochs each island sends its elite to the next. The best packing of a
block then keeps its well-filled bins, and the pieces of all other bins, of all blocks, are dealt into new blocks and
evolved again, the bins they were in among the first population, until one block is left. Pieces of full length are sequences by
themselves. Blocks depend on the written table of pieces, so a task that runs again gives the same packing.

Defined results: null text is empty and is one piece of the end token alone. Null identifiers and repeated rows are pieces
like others. Very long texts are encoded whole and cut into pieces. Ties are broken by the pieces' row numbers. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, staged, text_of, tidy
from .words import remembers, turn_of

CAPACITY = 2048
#: Pieces of a block, islands of a block, individuals of an island, epochs and children of an epoch.
BLOCK, ISLANDS, POPULATION, EPOCHS, CHILDREN = 4096, 2, 6, 2, 48
#: Tokens that may stay free in a bin that is not packed again.
SLACK = 0
_LEVELS = 8

#: Texts whose words are encoded the same one by one in lower case: printable ASCII, white space, Latin letters but İ.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-įı-ɏ]*")


#: What the tokenizer's pattern makes of such words.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ɏ0-9]+")


#: Words that a worker remembers, in two generations.
REMEMBERED = 500_000


class Encoder:
    """Ids of whole texts by a file of the tokenizers library whose texts are lower-cased and split at white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        #: The same model for pieces that are normal and cut already, with spaces between them; ids that end a piece.
        self.bare = Tokenizer(self.t.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.t.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _met(self, words: set[str]) -> set[str]:
        """Those of the words that aren't remembered; others are in young then."""
        new = words.difference(self.young)
        if self.old:
            again = new.intersection(self.old)
            self.young.update(zip(again, map(self.old.__getitem__, again), strict=True))
            new -= again
        return new

    def _learn(self, words: set[str]) -> None:
        """Put the ids of the words into young."""
        young = self.young
        cut, pieces = [], set()
        for w in words:
            if w.isalpha():
                pieces.add(w)
            elif w[-1] in ".,;:!?" and w[:-1].isalpha():
                cut.append((w, (w[:-1], w[-1])))
                pieces.update(cut[-1][1])
            else:
                cut.append((w, _PIECE.findall(w)))
                pieces.update(cut[-1][1])
        new = sorted(self._met(pieces))
        for at in range(0, len(new), 4096):
            batch = new[at : at + 4096]
            ids = np.array(self.bare.encode(" ".join(batch), add_special_tokens=False).ids, dtype="<u4")
            edges = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            data = ids.tobytes()
            young.update(zip(batch, [data[i:j] for i, j in zip(edges, edges[1:])], strict=True))
        for w, ps in cut:
            if len(ps) > 1:
                young[w] = b"".join(map(young.__getitem__, ps))

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts whose words are encoded one by one. The distinct words are looked up, and the ids gathered by place."""
        split = pa.compute.ascii_split_whitespace(pa.compute.ascii_trim_whitespace(pa.array([x.lower() for x in texts], pa.string())))
        found, cuts = split.values.dictionary_encode(), split.offsets.to_numpy()
        del split
        words, place = found.dictionary.to_pylist(), found.indices.to_numpy()
        if len(self.young) > REMEMBERED // 2:
            self.old, self.young = self.young, {}
        lost = self._met(set(words) - {""})
        self._learn(lost)
        self.young[""] = b""
        ids = list(map(self.young.__getitem__, words))
        size = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        start = np.cumsum(size, dtype=np.int32) - size
        own = size.take(place)
        end = np.cumsum(own, dtype=np.int32)
        at = np.repeat(start.take(place) - end + own, own)
        at += np.arange(len(at), dtype=np.int32)
        out = flat.take(at)
        del at, own, flat, ids, found, place
        edges = np.r_[0, end][cuts]
        for w in lost:
            if len(w) > 48:
                self.young.pop(w, None)
        return [out[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. Words are encoded once for as long as they are remembered."""
        plain = [i for i, x in enumerate(texts) if "<|" not in x and _PLAIN.fullmatch(x)]
        out: list[bytes | None] = [None] * len(texts)
        for i, ids in zip(plain, self._plain([texts[i] for i in plain]) if plain else (), strict=True):
            out[i] = ids.tobytes()
        return [self._whole(x) if y is None else y for x, y in zip(texts, out, strict=True)]


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


remembers("packing", encoder.cache_clear)


def _parts(texts: pa.Array, size: int = 4 << 20) -> Iterator[pa.Array]:
    """Consecutive texts of about so many bytes together, each whole. What Arrow held for a part is given back after it."""
    ends = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        yield texts.slice(start, stop - start)
        pa.default_memory_pool().release_unused()
        start = stop


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (of the ids as little-endian unsigned 32 bits) of every piece, and its ids if wanted."""
    ship(docs.sparkSession)
    more = "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string(more).fields])
    last = np.array([end], dtype="<u4").tobytes()
    width = 4 * capacity

    def run(batches):
        turn_of("packing")
        e = encoder(path)
        for batch in batches:
            at = 0
            for texts in _parts(batch.column(1)):  # Python's texts of one part at a time
                part = texts.to_pylist()
                source, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, data in enumerate(e.encode(part), at):
                    data += last
                    for k in range(0, len(data), width):
                        own = data[k : k + width]
                        source.append(i)
                        piece.append(k // width)
                        start.append(k // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(np.frombuffer(own, dtype="<i4"))
                at += len(part)
                columns = [batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names=schema.names)

    return docs.select(id_col, text_of(text_col).alias("__text")).mapInArrow(run, schema)


def best_fit(order, lengths: list[int], assign: np.ndarray, free: list[int], capacity: int) -> None:
    """Put the pieces of order into the bin with the least room that fits, or a new one. free: room of each bin, changed."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(free):
        if r > 0:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r
    for i in order:
        n = lengths[i]
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            bins = by_room[room]
            b = bins.pop()
            if not bins:
                mask ^= 1 << room
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        assign[i] = b
        free[b] = room = room - n
        if room > 0:
            bins = by_room.setdefault(room, [])
            if not bins:
                mask |= 1 << room
            bins.append(b)


def rooms(assign: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    return capacity - np.bincount(assign, weights=lengths).astype(np.int64)


def fitness(assign: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins, then fuller and emptier ones rather than even ones. Smaller is better."""
    free = rooms(assign, lengths, capacity)
    return len(free), -float(np.mean((1 - free / capacity) ** 2))


def cross(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child: the best-filled bins of a, a tenth to seven tenths of all, put into b.

    Of b's bins go those that hold a piece twice then, up to a third of them all, the emptiest first, and one in fifty by chance.
    """
    room_a, room_b = rooms(a, lengths, capacity), rooms(b, lengths, capacity)
    fullest = np.argsort(room_a + rng.uniform(0, 1, len(room_a)), kind="stable")
    into = np.zeros(len(room_a), dtype=bool)
    into[fullest[: max(1, int(len(fullest) * rng.uniform(0.1, 0.7)))]] = True
    injected = into[a]
    gone = rng.random(len(room_b)) < 0.02
    gone[b[injected]] = True
    gone[np.argsort(-room_b, kind="stable")[: max(1, int(len(room_b) * rng.uniform(0, 0.3)))]] = True
    child = np.full(len(a), -1, dtype=np.int32)
    number_a, number_b = np.cumsum(into) - 1, np.cumsum(~gone) - 1
    child[injected] = number_a[a[injected]]
    stay = ~injected & ~gone[b]
    child[stay] = number_b[b[stay]] + into.sum()
    free = np.concatenate([room_a[into], room_b[~gone]]).tolist()
    out = np.flatnonzero(child < 0)
    out = out[np.lexsort((out, -lengths[out]))]
    best_fit(out.tolist(), lengths.tolist(), child, free, capacity)
    return child


def first_population(lengths: np.ndarray, old: np.ndarray | None, capacity: int, rng: np.random.Generator, size: int) -> list[np.ndarray]:
    """Random groupings, after the one that is there already."""
    out = [] if old is None else [np.unique(old, return_inverse=True)[1].astype(np.int32)]
    own = lengths.tolist()
    while len(out) < size:
        assign = np.full(len(lengths), -1, dtype=np.int32)
        best_fit(rng.permutation(len(lengths)).tolist(), own, assign, [], capacity)
        out.append(assign)
    return out


def evolve(population: list[np.ndarray], lengths: np.ndarray, capacity: int, rng: np.random.Generator, children: int, size: int) -> list[np.ndarray]:
    """The best of the population and of so many children, best first; one alone if it can't be bettered."""
    least = -(-int(lengths.sum()) // capacity)
    ranked = sorted(((fitness(x, lengths, capacity), i, x) for i, x in enumerate(population)), key=lambda t: t[:2])
    for k in range(children):
        if ranked[0][0][0] == least:
            break  # no packing has fewer bins
        i, j = rng.choice(len(ranked), 2, replace=False) if len(ranked) > 1 else (0, 0)
        child = cross(ranked[min(i, j)][2], ranked[max(i, j)][2], lengths, capacity, rng)
        ranked.append((fitness(child, lengths, capacity), len(population) + k, child))
        ranked = sorted(ranked, key=lambda t: t[:2])[:size]
    return [x for _, _, x in ranked[: 1 if ranked[0][0][0] == least else size]]


#: Packings of a block on an island; rows and lengths of the pieces stand with the best one only.
_STATE = "block long, island int, rank int, rows array<long>, lengths array<int>, assign array<int>"


def _state(block: int, island: int, rows: np.ndarray, lengths: np.ndarray, population: list[np.ndarray]):
    n = len(population)
    once = lambda x, kind: pa.array([x, *[None] * (n - 1)], pa.list_(kind))
    return pa.table(
        {"block": pa.array([block] * n, pa.int64()), "island": pa.array([island] * n, pa.int32()), "rank": pa.array(range(n), pa.int32()), "rows": once(rows, pa.int64()), "lengths": once(lengths.astype(np.int32), pa.int32()), "assign": pa.array(population, pa.list_(pa.int32()))}
    )


def _level(items: DataFrame, n: int, level: int, capacity: int, block_size: int) -> DataFrame:
    """items: row, length, old. Returns row, length, sequence_id, offset, room."""
    blocks = max(1, -(-n // block_size))
    by = "row" if level == 0 else "old"
    dealt = items.withColumn("block", F.pmod(F.xxhash64(by, F.lit(level)), F.lit(blocks))).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))

    def start(key, t):
        turn_of("packing")
        block, island = key[0].as_py(), key[1].as_py()
        t = t.take(pa.compute.sort_indices(t["row"]))
        lengths = t["length"].to_numpy()
        rng = np.random.default_rng([level, block, island, 0])
        first = first_population(lengths, t["old"].to_numpy() if level else None, capacity, rng, POPULATION)
        return _state(block, island, t["row"].to_numpy(), lengths, evolve(first, lengths, capacity, rng, CHILDREN, POPULATION))

    def again(key, t):
        block, island = key[0].as_py(), key[1].as_py()
        t = t.take(pa.compute.sort_indices(t, sort_keys=[("rank", "ascending")]))
        rows, lengths = (np.array(t[c][0].as_py()) for c in ("rows", "lengths"))
        rng = np.random.default_rng([level, block, island, 1])
        population = [np.array(x, dtype=np.int32) for x in t["assign"].to_pylist()]
        return _state(block, island, rows, lengths, evolve(population, lengths, capacity, rng, CHILDREN, POPULATION))

    def best(key, t):
        block = key[0].as_py()
        t = t.take(pa.compute.sort_indices(t, sort_keys=[("island", "ascending")]))
        rows, lengths = (np.array(t[c][0].as_py()) for c in ("rows", "lengths"))
        assign = min((np.array(x, dtype=np.int64) for x in t["assign"].to_pylist()), key=lambda x: fitness(x, lengths, capacity))
        order = np.lexsort((rows, assign))
        sums = np.cumsum(lengths[order]) - lengths[order]
        head = np.flatnonzero(np.r_[True, np.diff(assign[order]) > 0])
        offset = sums - np.repeat(sums[head], np.diff(np.r_[head, len(order)]))
        room = rooms(assign, lengths, capacity)[assign[order]]
        number = (level << 58) + (block << 20) + assign[order]
        return pa.table({"row": pa.array(rows[order], pa.int64()), "length": pa.array(lengths[order], pa.int64()), "sequence_id": pa.array(number, pa.int64()), "offset": pa.array(offset, pa.int64()), "room": pa.array(room, pa.int64())})

    state = dealt.groupBy("block", "island").applyInArrow(start, _STATE)
    for _ in range(EPOCHS - 1):
        state = staged(state, "packing-islands")
        elite = state.filter("rank = 0").withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int")).withColumn("rank", F.lit(POPULATION))
        elite = elite.withColumns({c: F.lit(None).cast(state.schema[c].dataType) for c in ("rows", "lengths")})
        state = state.unionByName(elite).groupBy("block", "island").applyInArrow(again, _STATE)
    return state.filter("rank = 0").groupBy("block").applyInArrow(best, "row long, length long, sequence_id long, offset long, room long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """pieces with sequence_id and offset. length: column of pieces, at most capacity."""
    ship(pieces.sparkSession)
    rows = staged(pieces.withColumn("__row", F.monotonically_increasing_id()), "packing-pieces")
    alone = rows.filter(F.col("length") == capacity)
    items = rows.filter(F.col("length") < capacity).select(F.col("__row").alias("row"), F.col("length").cast("long").alias("length"), F.lit(None).cast("long").alias("old"))
    n = items.count()
    done = None
    for level in range(_LEVELS):
        if not n:
            break
        with tidy(pieces.sparkSession) as keep:
            placed = keep(staged(_level(items, n, level, capacity, block), "packing-level"))
        last = n <= block or level == _LEVELS - 1
        left, quarter = placed.agg(F.count_if(F.col("room") > SLACK), F.percentile_approx("room", 0.75)).first()
        # Where most bins can't be full, only the pieces of the emptiest ones, a quarter of all, are packed again.
        room = SLACK if left <= n // 2 else max(SLACK, quarter)
        left = left if room == SLACK else n // 4
        # Full bins go along as well, half a block of them, so that what is left over finds pieces to be combined with.
        share = (max(1, -(-2 * left // block)) * block * 0.9 - left) / max(n - left, 1)
        loose = (F.col("room") > room) | (F.pmod(F.xxhash64("sequence_id"), F.lit(1_000_000)) < int(1e6 * share))
        final = placed if last else placed.filter(~loose)
        done = final if done is None else done.unionByName(final)
        if last:
            break
        items = placed.filter(loose).select("row", "length", F.col("sequence_id").alias("old"))
        n = items.count()
    single = alone.select(F.col("__row").alias("row"), (-F.col("__row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = single if done is None else single.unionByName(done.select("row", "sequence_id", "offset"))
    return rows.join(places, rows["__row"] == places["row"]).drop("row", "__row")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of each sequence, from packed pieces that carry their ids. A sequence has at most the capacity."""
    order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(order, lambda x: x["ids"])).alias("ids"))
