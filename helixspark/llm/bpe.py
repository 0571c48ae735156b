"""Byte-level BPE: encoding and decoding.

A piece of text is merged by a priority queue of merge ranks over a doubly linked list of symbols; entries of the queue
whose symbols have changed are skipped when they come up. Texts are cut into pieces by the tokenizer's pattern, and pieces
repeat, so each Python worker keeps the ids of those it has met, up to a fixed number. Decoding concatenates the
vocabulary's byte strings.

Defined results: null and empty texts have no ids and decode to the empty text. Order, repeated rows, null identifiers and
extra columns make no difference: each row is encoded by itself. Very long texts are encoded whole; an empty table gives an empty result. The vocabulary file's special tokens are found in texts
first, as the file says.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, text_of
from .words import remembers, turn_of

# Unicode's White_Space, and the byte-level pattern with it.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Characters for which the faster pattern below says the same: printable ASCII, line ends, tab, Latin letters.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ɏ]*")
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\t\n\r {_LATIN}0-9]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")
_SLOW = regex.compile(PATTERN)
#: Pieces that a worker remembers.
REMEMBERED = 800_000
_LOW = 0xFFFFFFFF
_RANK = ~_LOW


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: printable ones themselves, others from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Memory:
    """Results of f for short strings, those met lately: two generations of half the size each."""

    def __init__(self, f, size: int = REMEMBERED):
        self.f, self.half, self.young, self.old = f, size // 2, {}, {}

    def met(self, x: str) -> bytes | None:
        y = self.young.get(x)
        if y is None:
            y = self.old.get(x)
            if y is not None:
                self.put(x, y)
        return y

    def put(self, x: str, y: bytes) -> None:
        if len(x) <= 48:
            if len(self.young) >= self.half:
                self.old, self.young = self.young, {}
            self.young[x] = y

    def of(self, x: str) -> bytes:
        y = self.met(x)
        if y is None:
            y = self.f(x)
            self.put(x, y)
        return y


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.first = [vocab[c] for c in letters]
        #: (left id << 32 | right id) -> (rank << 32 | id of both)
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << 32 | vocab[b], rank << 32 | vocab[a + b])
        self.byte_pairs = [None if (m := self.merges.get(a << 32 | b)) is None else m & _RANK for a in self.first for b in self.first]
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = Memory(self._piece, REMEMBERED // 4)
        self.chunks = Memory(self._chunk)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.first[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []  # rank << 32 | place of the left symbol
        pairs = self.byte_pairs
        for i, (a, b) in enumerate(zip(piece, piece[1:])):
            if (m := pairs[a << 8 | b]) is not None:
                queue.append(m | i)
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            i = top & _LOW
            j = after[i]
            if ids[i] < 0 or j >= n or (m := merges(ids[i] << 32 | ids[j])) is None or m >> 32 != top >> 32:
                continue  # stale: one of both was merged since
            ids[i], ids[j] = m & _LOW, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := merges(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(queue, m & _RANK | i)
            h = before[i]
            if h >= 0 and (m := merges(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(queue, m & _RANK | h)
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> bytes:
        return np.array(self.merge(piece.encode()), dtype="<u4").tobytes()

    def _by_pattern(self, text: str, plain: bool) -> bytes:
        pieces = (_FAST if plain else _SLOW).findall(text)
        return b"".join(map(self.pieces.of, pieces))

    def _chunk(self, chunk: str) -> bytes:
        pieces = _FAST.findall(chunk)
        return b"".join(map(self.chunks.of, pieces)) if len(pieces) > 1 else self._piece(chunk)

    def _line(self, line: str, out: list[bytes]) -> None:
        """A line whose words are parted by single spaces: a space belongs to the word behind it, and no piece crosses it."""
        first, *rest = line.split(" ")
        out.append(self.chunks.of(first))
        if rest:
            rest = [" " + x for x in rest]
            found = list(map(self.chunks.young.get, rest))
            if None in found:
                of = self.chunks.of
                found = [of(x) if y is None else y for x, y in zip(rest, found, strict=True)]
            out.extend(found)

    def _ordinary(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text):
            return self._by_pattern(text, False)
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or "\t" in text or "\r" in text or text[:1] in " \n" or text[-1:] in " \n":
            return self._by_pattern(text, True)
        out: list[bytes] = []
        end = self.chunks.of("\n")
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(end)
            self._line(line, out)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, little-endian unsigned 32-bit."""
        if self.split is None or not self.split.search(text):
            return np.frombuffer(self._ordinary(text), dtype="<u4")
        parts = [np.array([self.special[x]], "<u4").tobytes() if x in self.special else self._ordinary(x) for x in self.split.split(text) if x]
        return np.frombuffer(b"".join(parts), dtype="<u4")

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


remembers("bpe", codec.cache_clear)


@functools.lru_cache(1)
def _decimals(n: int) -> list[str]:
    return [str(i) for i in range(n)]


_COLUMNS = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """The identifier and the outputs asked for: ids, decoded, n_tokens, ids_sha256 (of the decimal ids, joined by commas), decoded_sha256."""
    ship(docs.sparkSession)
    rows = docs.select(id_col, text_of(text_col).alias("__text"))
    schema = T.StructType([docs.schema[id_col], *(T.StructField(x, _COLUMNS[x]) for x in outputs)])
    types = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(batches):
        turn_of("bpe")
        c = codec(path)
        decimals = _decimals(len(c.bytes))
        for batch in batches:
            # Slices, so that a batch of long texts isn't held as ids and as text at once.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = {x: [] for x in outputs}
                for text in part.column(1).to_pylist():
                    ids = c.encode(text)
                    numbers = ids.tolist()
                    if "ids" in out:
                        out["ids"].append(numbers)
                    if "n_tokens" in out:
                        out["n_tokens"].append(len(numbers))
                    if "ids_sha256" in out:
                        out["ids_sha256"].append(hashlib.sha256(",".join(map(decimals.__getitem__, numbers)).encode()).hexdigest())
                    decoded = c.decode(numbers) if "decoded" in out or "decoded_sha256" in out else ""
                    if "decoded" in out:
                        out["decoded"].append(decoded)
                    if "decoded_sha256" in out:
                        out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(out[x], types[x]) for x in outputs)], names=[id_col, *outputs])

    return rows.mapInArrow(run, schema)


def decode_documents(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The identifier and decoded, from a column of ids (null: no ids)."""
    ship(df.sparkSession)
    schema = T.StructType([df.schema[id_col], T.StructField("decoded", T.StringType())])

    def run(batches):
        c = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "decoded"])

    return df.select(id_col, F.col(ids_col)).mapInArrow(run, schema)
