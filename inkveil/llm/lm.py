"""Trigram language model in Elias-Fano tries, one for each shard of n-grams, queried in bulk.

Texts are tokenised once, in batches of consecutive rows; batches are worked on one at a time, and some make a bundle. A bundle
sends its distinct words, and later the distinct pairs and triples of its batches, to shards by their hashes, packed into one row
for each shard, with how often they occur in training rows. A shard adds up the counts, builds its level and answers each bundle
from it; a bundle takes the answers back and adds up its texts' scores. So all counts cover all training rows, whatever their
number, no n-gram is dropped, n-grams of a frequent context are dealt over all shards, and neither the driver nor an executor
ever holds the model: a task holds a shard or a few bundles. Bundles times shards, the number of rows, grows with the square of
the input; bundles are there to keep that small.

Words: a word is a 63-bit hash, which two of n words share with a chance of n^2 / 2^64 (for 10 million distinct words 5 in a
million). Its id interleaves the ranks by count within shards, so that frequent words have small ids.

Trie of a shard: contexts, their successors, and the successors of pairs, each a monotone Elias-Fano sequence (high bits unary,
low bits packed); monotone pointers say where the successors of a context begin. Successors are stored relative to their
context: each range begins where the range before it ends, and a successor is searched within its context's range. Pairs and
triples have a code of a byte, the logarithm of their count's share of all tokens; tries are read as they lie in memory.

p2(v | u) = (c(uv) + MU2 p1(v)) / (c(u) + MU2) and p3(v | tu) = (c(tuv) + MU3 p2(v | u)) / (c(tu) + MU3), with counts of pairs
and triples from their codes, and p1(v) = (c(v) + 0.1) / (N + 0.1 (V + 1)) from exact counts, as base_score is.

Edge cases: null text counts as empty, and an empty text has one token, its end; a null doc_id counts as held out; without
training rows every token is unknown and N and V are 0; repeated rows each count and score alike; a text beyond BATCH bytes is
a batch of its own, beyond BUNDLE a bundle too, and no text is cut; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounds, discard, fold, materialize, release, table

FOLDS = 10
ADDED = 0.1
#: Weights of the shorter context's probability, in tokens; of a few tried, these gave held-out rows of a small table the highest probability.
MU2, MU3 = 300.0, 3.0
#: Bytes of text in a batch, in a bundle, and in the share of a shard, about.
BATCH, BUNDLE, SHARD = 4_000_000, 16_000_000, 8_000_000

_END = b"\n"  # no word: words hold no white space
#: Ids before those of words: what stands before a text, and words that training rows lack.
_BEGIN, _UNKNOWN, _FIRST = 0, 1, 2


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), _END]


def listed(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, each token of all texts as its word's place, and the number of tokens of each text: tokens() for a column."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = split.flatten()
    filled = pc.greater(pc.binary_length(found), 0).to_numpy(zero_copy_only=False)  # white space at an end leaves an empty part
    before = np.append(0, filled.cumsum())[np.append(0, pc.list_value_length(split).to_numpy().cumsum())]
    coded = found.filter(pa.array(filled)).dictionary_encode()
    words = [*coded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(found.type) else pa.binary()).to_pylist(), _END]
    lengths = np.diff(before) + 1
    place = np.full(int(lengths.sum()), len(words) - 1, dtype=np.int64)
    inner = np.ones(len(place), dtype=bool)
    inner[lengths.cumsum() - 1] = False
    place[inner] = coded.indices.to_numpy()
    return words, place, lengths


# --- packing ---


def pack(**parts: np.ndarray) -> bytes:
    """Arrays of integers as byte planes of the least width, compressed."""
    head, body = [], []
    for name, x in parts.items():
        x = _least(x)
        head.append((name, x.dtype.str, len(x)))
        body.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes())
    top = json.dumps(head).encode()
    return zstandard.compress(len(top).to_bytes(4, "little") + top + b"".join(body), 1)


def _least(x: np.ndarray) -> np.ndarray:
    """Integers in the least width that holds them."""
    if x.dtype == np.uint8:
        return x
    top = int(x.max()) if len(x) else 0
    signed = len(x) and int(x.min()) < 0
    return x.astype("<i8" if signed else next(t for t in ("<u1", "<u2", "<u4", "<u8") if top < 256 ** int(t[2])))


def unpack(data: bytes, narrow: tuple[str, ...] = ()) -> dict[str, np.ndarray]:
    """The arrays, as 64-bit integers but for those named narrow, which keep the width they have."""
    whole = zstandard.decompress(data)
    n = int.from_bytes(whole[:4], "little")
    out, at = {}, 4 + n
    for name, kind, k in json.loads(whole[4:at]):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(whole, np.uint8, k * size, at).reshape(size, k)
        out[name] = np.ascontiguousarray(planes.T).view(kind).reshape(k)
        if name not in narrow:
            out[name] = out[name].astype(np.int64)
        at += k * size
    return out


_ALL = np.zeros(1, dtype=np.int64)


def _steps(*columns: np.ndarray, starts: np.ndarray = _ALL) -> list[np.ndarray]:
    """Rows in order within runs, as small numbers: each column's step where the columns before it stay, else its value.

    starts: where runs begin; runs may be empty.
    """
    new = _begun(starts, len(columns[0]))
    out = []
    for x in columns:
        step = np.diff(x, prepend=0)
        out.append(np.where(new, x, step))
        new = new | (step != 0)
    return out


def _unsteps(*columns: np.ndarray, starts: np.ndarray = _ALL) -> list[np.ndarray]:
    new = _begun(starts, len(columns[0]))
    out = []
    for x in columns:
        value, at = x.cumsum(), np.flatnonzero(new)
        value -= np.repeat(value[at] - x[at], np.diff(np.append(at, len(x))))
        out.append(value)
        new[1:] |= value[1:] != value[:-1]
    return out


def _begun(starts: np.ndarray, n: int) -> np.ndarray:
    """Whether a run begins at each of n rows."""
    new = np.zeros(n, dtype=bool)
    new[starts[starts < n]] = True
    return new


# --- the trie ---


class EliasFano:
    """A sequence of integers from 0 that never falls: low bits packed, high bits unary."""

    @staticmethod
    def build(values: np.ndarray) -> dict[str, np.ndarray]:
        n = len(values)
        width = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        at = (values >> width) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, dtype=np.uint8)
        high[at] = 1
        # whole bytes of the low bits as planes, the rest bit by bit
        low = [(values >> j).astype(np.uint8) for j in range(0, width - 7, 8)]
        rest = np.empty((n, width % 8), dtype=np.uint8)
        for j in range(width % 8):
            rest[:, j] = (values >> (width - width % 8 + j)) & 1
        low.append(np.packbits(rest.reshape(-1), bitorder="little"))
        return {"low": np.concatenate(low), "high": np.packbits(high, bitorder="little"), "size": np.array([n, width])}

    @staticmethod
    def read(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """All values: a shard's queries come by the thousand, so its sequences are read once for all of them."""
        n, width = (int(x) for x in size)
        out = (np.flatnonzero(np.unpackbits(high, bitorder="little"))[:n] - np.arange(n)) << width
        for j in range(width // 8):
            out |= low[j * n : (j + 1) * n].astype(np.int64) << (8 * j)
        rest = np.unpackbits(low[width // 8 * n :], count=n * (width % 8), bitorder="little").reshape(n, width % 8)
        for j in range(width % 8):
            out |= rest[:, j].astype(np.int64) << (width - width % 8 + j)
        return out


def _order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by columns of numbers from 0; as many columns as fit share a key.

    What doesn't fit orders the rows that are equal so far by their number: rows come as a few runs in order, and a stable sort merges those.
    """
    order = key = None
    for x in columns:
        if key is None:
            key = x
            continue
        x = x if order is None else x[order]
        width = int(x.max()).bit_length() if len(x) else 0
        if len(x) and int(key.max()).bit_length() + width > 63:
            step = np.argsort(key, kind="stable")
            order = step if order is None else order[step]
            key, x = _changes(key[step]).cumsum(), x[step]
        key = key << width | x
    step = np.argsort(key, kind="stable")
    return step if order is None else order[step]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; the first one does."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return new


def _distinct(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct rows in order, their counts added up, and each row's place among them."""
    order = _order(columns)
    columns = [x[order] for x in columns]
    new = _changes(*columns)
    at = np.flatnonzero(new)
    total = np.add.reduceat(counts[order], at) if len(at) else counts[:0]
    place = np.empty(len(order), dtype=np.int64)
    place[order] = new.cumsum() - 1
    return [x[at] for x in columns], total, place


def _added(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, and their counts added up; those without any are left out."""
    columns, total, _ = _distinct(columns, counts)
    return [x[total > 0] for x in columns], total[total > 0]


def _bases(values: np.ndarray, pointers: np.ndarray) -> np.ndarray:
    """Where the values of each range begin: behind those of the range before it."""
    return np.concatenate([[0], values[pointers[1:] - 1] + 1]) if len(pointers) > 1 else np.zeros(1, dtype=np.int64)


def _raised(x: np.ndarray, pointers: np.ndarray) -> np.ndarray:
    """Values that rise within ranges, made to rise throughout."""
    last = x[pointers[1:] - 1] + 1 if len(pointers) > 1 else x[:0]
    return x + np.repeat(np.concatenate([[0], last.cumsum()[:-1]]) if len(last) else last, np.diff(pointers))


class Trie:
    """Pairs (a, b) and triples (a, b, c) of ids with codes; 0 for what isn't there."""

    @staticmethod
    def build(pairs: list[np.ndarray], codes2: np.ndarray, triples: list[np.ndarray], codes3: np.ndarray) -> bytes:
        """From distinct rows in order."""
        (a, b), (ta, tb, tc) = pairs, triples
        opens = _changes(ta, tb)
        # a triple's pair has a node here, with its code where the pair belongs to this shard
        at = np.flatnonzero(opens)
        node_a, node_b = np.concatenate([a, ta[at]]), np.concatenate([b, tb[at]])
        order = _order([node_a, node_b])
        node_a, node_b = node_a[order], node_b[order]
        new = _changes(node_a, node_b)
        number = np.empty(len(order), dtype=np.int64)
        number[order] = new.cumsum() - 1
        node_a, node_b = node_a[new], node_b[new]
        code = np.zeros(len(node_a), dtype=np.uint8)
        code[number[: len(a)]] = codes2
        first = np.flatnonzero(_changes(node_a))
        p1 = np.append(first, len(node_a))
        p2 = np.searchsorted(np.repeat(number[len(a) :], np.diff(np.append(at, len(ta)))), np.arange(len(node_a) + 1))
        filled = np.flatnonzero(np.diff(p2))
        rising = _raised(tc, np.append(p2[filled], len(tc)))
        parts = {"roots": node_a[first], "p1": p1, "seconds": _raised(node_b, p1), "p2": p2, "thirds": rising}
        return _joined({f"{k}.{n}": x for k, v in parts.items() for n, x in EliasFano.build(v).items()} | {"code2": code, "code3": codes3})

    def __init__(self, data: bytes):
        x = _views(data)
        self.roots, self.p1, self.seconds, self.p2, self.thirds = (EliasFano.read(*(x[f"{k}.{n}"] for n in ("low", "high", "size"))) for k in ("roots", "p1", "seconds", "p2", "thirds"))
        self.code2, self.code3 = x["code2"], x["code3"]
        self.base1 = _bases(self.seconds, self.p1)
        # ranges without triples begin where the next range does
        self.base2 = np.concatenate([[0], self.thirds + 1])[self.p2]

    def _node(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The node of each pair, or -1."""
        if not len(self.roots):
            return np.full(len(a), -1, dtype=np.int64)
        g = np.minimum(np.searchsorted(self.roots, a), len(self.roots) - 1)
        return np.where(self.roots[g] == a, _within(self.seconds, self.base1, g, b), -1)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        node = self._node(a, b)
        return np.where(node >= 0, self.code2[node], 0).astype(np.uint8) if len(self.code2) else np.zeros(len(a), dtype=np.uint8)

    def triples(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        if not len(self.code3):
            return np.zeros(len(a), dtype=np.uint8)
        node = self._node(a, b)
        at = np.where(node >= 0, _within(self.thirds, self.base2, np.maximum(node, 0), c), -1)
        return np.where(at >= 0, self.code3[at], 0).astype(np.uint8)


def _within(values: np.ndarray, bases: np.ndarray, group: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted successor in its context's range, or -1."""
    target = bases[group] + wanted
    at = np.minimum(np.searchsorted(values, target), len(values) - 1)
    return np.where((values[at] == target) & (target < bases[group + 1]), at, -1)


def _joined(parts: dict[str, np.ndarray]) -> bytes:
    head = json.dumps([(k, x.dtype.str, len(x)) for k, x in parts.items()]).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(x.tobytes() for x in parts.values())


def _views(data: bytes) -> dict[str, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    out, at = {}, 4 + n
    for name, kind, k in json.loads(data[4:at]):
        out[name] = np.frombuffer(data, kind, k, at)
        at += out[name].nbytes
    return out


def codes(counts: np.ndarray, total: int) -> np.ndarray:
    """Logarithms of counts as shares of all tokens, in 254 steps from 1; 0 for none."""
    steps = np.log(np.maximum(counts, 1)) / max(math.log(total), 1e-9) if total else np.zeros(len(counts))
    return np.where(counts > 0, 1 + np.rint(254 * np.minimum(steps, 1)), 0).astype(np.uint8)


def counts_of(total: int) -> np.ndarray:
    """The count of each code."""
    out = np.exp(np.arange(-1, 255) / 254 * math.log(max(total, 1)))
    out[0] = 0
    return out


# --- bundles and shards ---

_ROW = "bundle bigint, shard bigint, data binary"


def _row(bundle: list, shard: list, data: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bundle, pa.int64()), pa.array(shard, pa.int64()), pa.array(data, pa.binary())], names=["bundle", "shard", "data"])


def _mixed(*ids: np.ndarray) -> np.ndarray:
    """31 bits of a hash of rows of ids."""
    h = np.zeros(len(ids[0]), dtype=np.uint64)
    for x in ids:
        h = (h ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of rows with the same key, as (key, rows of (the other key, data))."""
    other = "bundle" if key == "shard" else "shard"
    now, rows = None, []
    for b in batches:
        # a run's data at a time, for a batch of rows may hold many
        for k, o, d in zip(b.column(key).to_pylist(), b.column(other).to_pylist(), b.column("data"), strict=True):
            if k != now and rows:
                yield now, rows
                rows = []
            now = k
            rows.append((o, d.as_py()))
    if rows:
        yield now, rows


def _read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """A batch of texts: its distinct words' hashes in order and their training counts, its tokens as places among them, and its rows."""
    words, place, lengths = listed(batch.column("text"))
    train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
    hashes = (np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)) >> np.uint64(1)).astype(np.int64)
    # words by hash: equal hashes are one word
    distinct, at = np.unique(hashes, return_inverse=True)
    place = at[place]
    counts = np.bincount(place[np.repeat(train, lengths)], minlength=len(distinct))
    ids = batch.column("id")
    known = np.array(ids.is_valid().to_numpy(zero_copy_only=False)).astype(np.uint8)
    rows = {"lengths": lengths, "train": train.astype(np.uint8), "valid": known, "ids": ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")}
    return {"hashes": distinct, "counts": counts, "place": _least(place)} | rows


def _bundled(batches: list[dict], number: int, shards: int) -> pa.RecordBatch:
    """The rows of a bundle: one of shard -1, and its words for shards."""
    distinct, at = np.unique(np.concatenate([b["hashes"] for b in batches]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([b["counts"] for b in batches]), len(distinct)).astype(np.int64)
    at = np.split(at, np.cumsum([len(b["hashes"]) for b in batches])[:-1])
    whole = {k: np.concatenate([b[k] for b in batches]) for k in ("lengths", "train", "valid", "ids")}
    place = np.concatenate([_least(a)[b["place"]] for a, b in zip(at, batches, strict=True)])
    out = [pack(place=place, texts=np.array([len(b["lengths"]) for b in batches]), **whole)]
    to = [-1]
    shard = ((distinct >> 32) * shards) >> 31
    edges = np.searchsorted(shard, np.arange(shards + 1))
    for s in np.unique(shard).tolist():
        part = slice(edges[s], edges[s + 1])
        out.append(pack(steps=np.diff(distinct[part], prepend=0), counts=counts[part]))
        to.append(s)
    first = np.arange(len(to)) == 0
    rows = _row([number] * len(to), to, out)
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.where(first, counts.sum(), 0)), pa.array(np.where(first, int(whole["train"].sum()), 0))], names=[*rows.schema.names, "tokens", "rows"])


def _tokenised(docs: DataFrame, shards: int) -> DataFrame:
    """Bundles: a row of shard -1 with the texts as places in the bundle's list of words, and rows of words for shards.

    docs: id, train, text. Columns tokens and rows give the training tokens and rows of a bundle.
    """

    def run(batches):
        number = (TaskContext.get().partitionId()) << 32
        held, size = [], 0
        for batch in batches:
            for a, b in bounds(batch.column("text"), min(BATCH, BUNDLE)):
                part = batch.slice(a, b - a)
                held.append(_read(part))
                size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if size >= BUNDLE:
                    yield _bundled(held, number, shards)
                    number, held, size = number + 1, [], 0
        if held:
            yield _bundled(held, number, shards)
        release()

    return docs.mapInArrow(run, _ROW + ", tokens bigint, rows bigint")


def _word_shards(messages: DataFrame, shards: int) -> DataFrame:
    """Ids and counts for each message's words, in its order; and the number of words of each shard, in column words."""

    def run(batches):
        for shard, rows in _groups(batches, "shard"):
            parts = [(o, unpack(d)) for o, d in rows]
            keys = [p["steps"].cumsum() for _, p in parts]
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, np.concatenate([p["counts"] for _, p in parts]), len(distinct)).astype(np.int64)
            rank = np.empty(len(distinct), dtype=np.int64)
            rank[np.lexsort((distinct, -total))] = np.arange(len(distinct))
            ids = np.where(total > 0, _FIRST + rank * shards + shard, _UNKNOWN)
            ends = np.cumsum([len(k) for k in keys])[:-1]
            answers = [pack(ids=ids[i], counts=total[i]) for i in np.split(at, ends)]
            out = _row([o for o, _ in rows], [shard] * len(rows), answers)
            words = [int((total > 0).sum())] + [0] * (len(rows) - 1)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(words, pa.int64())], names=[*out.schema.names, "words"])
        release()

    return _dealt(messages, shards).mapInArrow(run, _ROW + ", words bigint")


def _dealt(messages: DataFrame, shards: int) -> DataFrame:
    """A partition for each shard."""
    rows = messages.select("bundle", "shard", "data")
    return rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "bundle")


def _spread(bundle: Column, most: int, partitions: int) -> Column:
    """A partition for each bundle; most: bundles of a task that numbered them.

    Numbers without large gaps times the golden ratio, modulo one, lie evenly, so that few partitions get two bundles where there are more partitions.
    """
    number = F.shiftright(bundle, 32) * F.lit(max(1, most)) + bundle.bitwiseAND(F.lit(0xFFFFFFFF))
    mixed = (number.bitwiseAND(F.lit(0x7FFFFFFF)) * F.lit(2654435769)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftright(mixed * F.lit(partitions), 32).cast("int")


def _by_bundle(rows: DataFrame, answers: DataFrame, most: int, partitions: int) -> DataFrame:
    """Bundles, each in its own row (shard -1) and then the answers to it by shard."""
    both = rows.select("bundle", "shard", "data").unionByName(answers.select("bundle", "shard", "data"))
    return both.repartitionById(partitions, _spread(F.col("bundle"), most, partitions)).sortWithinPartitions("bundle", "shard")


def _with_ids(rows: DataFrame) -> DataFrame:
    """Bundles whose words have ids and counts, in the order of ids."""

    def run(batches):
        for bundle, ((_, data), *answers) in _groups(batches, "bundle"):
            x = unpack(data, ("place",))
            got = [unpack(d) for _, d in answers]
            ids, counts = (np.concatenate([g[k] for g in got]) for k in ("ids", "counts"))
            del got, answers
            distinct, first, at = np.unique(ids, return_index=True, return_inverse=True)
            yield _row([bundle], [-1], [pack(**x | {"place": _least(at)[x["place"]], "steps": np.diff(distinct, prepend=0), "counts": counts[first]})])
        release()

    return rows.mapInArrow(run, _ROW)


class _Grams:
    """The distinct pairs and triples of a batch, as ids and by shard. names: ids of words, behind what stands before a text."""

    def __init__(self, names: np.ndarray, v: np.ndarray, lengths: np.ndarray, train: np.ndarray, shards: int):
        self.starts = np.concatenate([[0], lengths.cumsum()[:-1]]).astype(np.int64)
        v = v.astype(np.int64) + 1  # place 0 stands for the text's begin, so that places are in the order of ids
        n = len(names)
        train = np.repeat(train.astype(bool), lengths)
        u = np.empty_like(v)
        u[1:] = v[:-1]
        u[self.starts] = 0
        self.u, self.v = u, v
        pairs, self.at2 = np.unique(u * n + v, return_inverse=True)
        before = np.empty_like(v)
        before[1:] = self.at2[:-1] + 1
        before[self.starts] = 0  # the context of a first token
        triples, self.at3 = np.unique(before * n + v, return_inverse=True)
        first, second = np.divmod(pairs, n)
        self.two = [names[first], names[second]]
        context, last = np.divmod(triples, n)
        self.three = [np.append(_BEGIN, self.two[0])[context], np.append(_BEGIN, self.two[1])[context], names[last]]
        self.sides = []
        for columns, at in ((self.two, self.at2), (self.three, self.at3)):
            shard = _mixed(*columns) % shards
            order = np.argsort(shard.astype(np.uint16 if shards < 2**16 else np.int64), kind="stable")
            counts = np.bincount(at[train], minlength=len(shard))
            self.sides.append((order, counts[order], np.searchsorted(shard[order], np.arange(shards + 1))))


def _batches(x: dict[str, np.ndarray], shards: int) -> Iterator[tuple[_Grams, np.ndarray, np.ndarray]]:
    """The batches of a bundle, one at a time: n-grams, ids of rows and whether they are known."""
    names = np.append(_BEGIN, x["steps"].cumsum())
    row = token = 0
    for n in x["texts"].tolist():
        part = slice(row, row + n)
        lengths = x["lengths"][part]
        end = token + int(lengths.sum())
        yield _Grams(names, x["place"][token:end], lengths, x["train"][part], shards), x["ids"][part], x["valid"][part].astype(bool)
        row, token = row + n, end


def _sent(g: _Grams) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """A batch's columns of pairs, and of triples, shard by shard; and where shards begin."""
    (o2, n2, e2), (o3, n3, e3) = g.sides
    two, three = _steps(*(x[o2] for x in g.two), starts=e2), _steps(*(x[o3] for x in g.three), starts=e3)
    return [_least(x) for x in (*two, n2)], [_least(x) for x in (*three, n3)], e2, e3


def _messages(bundles: DataFrame, shards: int) -> DataFrame:
    def run(rows):
        for b in rows:
            for bundle, data in zip(b.column("bundle").to_pylist(), b.column("data"), strict=True):
                sent = []
                for g, _, _ in _batches(unpack(data.as_py(), ("place",)), shards):
                    sent.append(_sent(g))
                    del g  # before the next is made
                runs2, runs3 = (np.array([np.diff(x[k]) for x in sent]) for k in (2, 3))
                to, out, size = [], [], 0
                for s in np.flatnonzero((runs2 + runs3).any(axis=0)).tolist():
                    two = [[x[e2[s] : e2[s + 1]] for x in columns] for columns, _, e2, _ in sent]
                    three = [[x[e3[s] : e3[s + 1]] for x in columns] for _, columns, _, e3 in sent]
                    columns = (np.concatenate(x) for x in (*zip(*two, strict=True), *zip(*three, strict=True)))
                    out.append(pack(**dict(zip(("a", "b", "n", "ta", "tb", "tc", "tn"), columns, strict=True)), runs2=runs2[:, s], runs3=runs3[:, s]))
                    to.append(s)
                    size += len(out[-1])
                    if size >= BATCH:
                        yield _row([bundle] * len(to), to, out)
                        to, out, size = [], [], 0
                yield _row([bundle] * len(to), to, out)
        release()

    return bundles.mapInArrow(run, _ROW)


def _answers(messages: list[bytes], total: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The codes of each message's pairs and triples, from the trie of the counts of all messages.

    A row that many messages ask for is asked once, and rows are asked in order, so that searches go through the trie from end to end.
    """
    parts = [unpack(d) for d in messages]
    a, b, n, ta, tb, tc, tn = (np.concatenate([p[k] for p in parts]) for k in ("a", "b", "n", "ta", "tb", "tc", "tn"))
    ends2, ends3 = (np.cumsum([len(p[k]) for p in parts]) for k in ("n", "tn"))
    # a message without runs is one
    starts2, starts3 = (np.append(0, np.concatenate([p.get(k, [len(p[c])]) for p in parts]).cumsum()) for k, c in (("runs2", "n"), ("runs3", "tn")))
    del parts
    pairs, n2, at2 = _distinct(_unsteps(a, b, starts=starts2), n)
    triples, n3, at3 = _distinct(_unsteps(ta, tb, tc, starts=starts3), tn)
    del a, b, n, ta, tb, tc, tn
    trie = Trie(Trie.build([x[n2 > 0] for x in pairs], codes(n2[n2 > 0], total), [x[n3 > 0] for x in triples], codes(n3[n3 > 0], total)))
    two, three = trie.pairs(*pairs)[at2], trie.triples(*triples)[at3]
    yield from zip(np.split(two, ends2[:-1]), np.split(three, ends3[:-1]), strict=True)


def _trie_shards(messages: DataFrame, shards: int, total: int) -> DataFrame:
    """Codes for each message's pairs and triples, in its order, from the trie of the shard."""

    def run(batches):
        for shard, rows in _groups(batches, "shard"):
            yield _row([o for o, _ in rows], [shard] * len(rows), [pack(two=x, three=y) for x, y in _answers([d for _, d in rows], total)])
        release()

    return _dealt(messages, shards).mapInArrow(run, _ROW)


def _scores(rows: DataFrame, shards: int, stats: dict) -> DataFrame:
    total, words, begins = stats["tokens"], stats["words"], stats["rows"]

    def run(batches):
        value = counts_of(total)
        for _, ((_, data), *answers) in _groups(batches, "bundle"):
            bundle = unpack(data, ("place",))
            alone = np.append(begins, bundle["counts"]).astype(float)
            single = np.log10((alone + ADDED) / (total + ADDED * (words + 1)))
            got = [(s, unpack(d, ("two", "three"))) for s, d in answers]
            done = {k: np.zeros(shards, dtype=np.int64) for k in ("two", "three")}  # of each shard's answer, by the batches before
            for g, ids, valid in _batches(bundle, shards):
                c2, c3 = (np.empty(len(order)) for order, _, _ in g.sides)
                for c, k, (order, _, edges) in zip((c2, c3), ("two", "three"), g.sides, strict=True):
                    start, done[k] = done[k], done[k] + np.diff(edges)
                    c[order] = value[np.concatenate([x[k][start[s] : done[k][s]] for s, x in got])]
                base = single[g.v]
                context = alone[g.u]
                pair = c2[g.at2]
                p2 = (np.minimum(pair, context) + MU2 * 10**base) / (context + MU2)
                context = np.concatenate([[0.0], pair[:-1]])
                context[g.starts] = begins
                p3 = np.log10((np.minimum(c3[g.at3], context) + MU3 * p2) / (context + MU3))
                sums = [np.add.reduceat(x, g.starts) for x in (np.ones(len(g.v), np.int64), (alone > 0)[g.v].astype(np.int64), base, p3)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~valid), *map(pa.array, sums)], names=["id", "n_tokens", "n_known", "base_score", "score"])
                del g  # before the next is made
        release()

    return rows.mapInArrow(run, "id bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def learn_and_score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict]:
    """key, n_tokens, n_known, base_score, score of all rows by a model of the rows where train holds; and the model's size.

    Other rows than those to learn from can be joined to them: what train leaves out is scored and not learnt.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, math.ceil(size / SHARD))
    first = materialize(_tokenised(rows, shards))
    most = F.max(F.col("bundle").bitwiseAND(F.lit(0xFFFFFFFF))) + 1
    stats = first.agg(*(F.coalesce(x, F.lit(0)).alias(k) for k, x in (("tokens", F.sum("tokens")), ("rows", F.sum("rows")), ("most", most)))).first().asDict()
    most = stats.pop("most")
    answers = materialize(_word_shards(first.where("shard >= 0"), shards))
    stats["words"] = answers.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    bundles = materialize(_with_ids(_by_bundle(first.where("shard < 0"), answers, most, shards)))
    discard(first, answers)
    grams = _trie_shards(_messages(bundles, shards), shards, stats["tokens"])
    return _scores(_by_bundle(bundles, grams, most, shards), shards, stats).withColumnRenamed("id", key), stats


def op9_ngram_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), FOLDS) == 0
    out, stats = learn_and_score(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(stats["tokens"]).cast("bigint").alias("train_tokens"), "base_score", "score")


def brute(rows: list[tuple]) -> dict:
    """doc_id to held_out, n_tokens, n_known, train_tokens, base_score, score by uncoded counts, from rows (doc_id, text) with distinct ids."""
    import zlib

    held = {d: zlib.crc32(str(d).encode()) % FOLDS == 0 for d, _ in rows}
    texts = {d: tokens(t) for d, t in rows}
    learnt = [ws for d, ws in texts.items() if not held[d]]
    c = Counter(w for ws in learnt for w in ws)
    pair = Counter(p for ws in learnt for p in zip([None, *ws], ws, strict=False))
    triple = Counter(p for ws in learnt for p in zip([None, None, *ws], [None, *ws], ws, strict=False))
    total = sum(c.values())
    whole = total + ADDED * (len(c) + 1)
    out = {}
    for d, ws in texts.items():
        base = full = 0.0
        for t, u, v in zip([None, None, *ws], [None, *ws], ws, strict=False):
            p = (c[v] + ADDED) / whole
            base += math.log10(p)
            p = (pair[u, v] + MU2 * p) / ((len(learnt) if u is None else c[u]) + MU2)
            full += math.log10((triple[t, u, v] + MU3 * p) / ((len(learnt) if u is None else pair[t, u]) + MU3))
        out[d] = (held[d], len(ws), sum(c[w] > 0 for w in ws), total, base, full)
    return out
