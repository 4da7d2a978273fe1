"""SentencePiece encoding and decoding of whole texts by a trie of marked words.

Spaces become marks, and a text falls into units: marks and the characters up to the next mark. No piece has a mark
after another character, so units are encoded apart. The distinct units of a batch are sorted, which puts them in
depth-first order of their trie; the forward states of a shared prefix are computed once and kept on a stack.

A forward state is the last piece of the best encoding of a prefix. For unigram models that is Viterbi's: the piece
with the best sum of scores. For BPE models sums of scores don't give what merging gives; there the state is the one
piece that merging leaves last, which is the piece that is compatible with the state before it: merging the two
pieces' text gives the two pieces again. Units with runs of marks, whose pieces tie, are merged directly.

Edge cases: null text counts as empty and has no pieces; characters outside the vocabulary become bytes; a text that
has U+2581 itself decodes to spaces there, so its round_trip is false; rows keep their multiplicity; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, slices, table

MARK = "▁"
#: File of the model; read by the driver, whose bytes go to the executors.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Encoded units that a worker remembers at most.
REMEMBERED = 300_000


def model_type(proto: bytes) -> int:
    """trainer_spec.model_type of a model proto: 1 for unigram, which is the default, 2 for BPE, 3 for words, 4 for characters."""

    def fields(data: bytes):
        at = 0

        def varint() -> int:
            nonlocal at
            n = shift = 0
            while True:
                byte = data[at]
                at += 1
                n |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return n

        while at < len(data):
            number, wire = divmod(varint(), 8)
            if wire == 0:
                yield number, varint()
            elif wire in (1, 2, 5):
                size = varint() if wire == 2 else 8 if wire == 1 else 4
                at += size
                yield number, data[at - size : at]
            else:
                raise ValueError("no model proto")

    kind = 1
    for number, spec in fields(proto):
        if number == 2:
            kind = next((v for n, v in reversed(list(fields(spec))) if n == 3), kind)
    return kind


class Codec:
    """Tables of one model. pieces: (text, score) by id for the pieces that encoding may use; bytes_: id of each byte."""

    def __init__(self, pieces: dict[int, tuple[str, float]], bytes_: list[int], unigram: bool = False):
        self.id = {p: i for i, (p, _) in pieces.items()}
        self.text = {i: p for i, (p, _) in pieces.items()}
        self.score = {i: s for i, (_, s) in pieces.items()}
        self.longest = max(map(len, self.id), default=1)
        self.unknown = min(self.score.values(), default=0.0) - 10
        self.reversed: dict = {}
        for i, (p, _) in pieces.items():
            node = self.reversed
            for ch in reversed(p):
                node = node.setdefault(ch, {})
            node[""] = i
        self.bytes_, self.unigram = bytes_, unigram
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id):
            raise ValueError("a piece has a mark inside, so units can't be encoded apart")
        self.out = {i: p.replace(MARK, " ").encode() for i, (p, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(bytes_)}
        self.known = {}
        self.memory: dict[str, bytes] = {}
        self.cut_lines = not any("\n" in p for p in self.id)

    @classmethod
    def load(cls, model: bytes) -> Codec:
        import sentencepiece

        kind = model_type(model)
        if kind not in (1, 2):
            raise ValueError("the model is neither unigram nor BPE")
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        odd = [sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        by_name = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        if len(by_name) != 256:
            raise ValueError("the model has no byte pieces")
        return cls({i: (sp.id_to_piece(i), sp.get_score(i)) for i in range(n) if not odd[i]}, [by_name[f"<0x{b:02X}>"] for b in range(256)], unigram=kind == 1)

    def merged(self, text: str) -> list[int | str]:
        """Pieces by merging the best neighbours first, the left ones on a tie; characters that are no piece stay."""
        part: list[str | None] = list(text)
        before, after = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        heap: list[tuple] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(part):
                joined = part[i] + part[j]  # type: ignore[operator]
                k = self.id.get(joined)
                if k is not None:
                    heapq.heappush(heap, (-self.score[k], i, joined, j))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, i, joined, j = heapq.heappop(heap)
            if part[i] is None or part[j] is None or after[i] != j or part[i] + part[j] != joined:
                continue
            part[i], part[j] = joined, None
            after[i] = after[j]
            if after[j] < len(part):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [self.id.get(p, p) for p in part if p is not None]

    def _compatible(self, key: int, left: int, right: int) -> bool:
        """Whether merging leaves these pieces side by side; left is -1 at the start or after a character that is no piece."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known[key] = fits = self.merged(self.text[left] + self.text[right]) == [left, right] if left >= 0 else self.merged(self.text[right]) == [right]
        return fits

    def _last_piece(self, unit: str, end: int, states: list) -> int:
        """The piece that merging leaves last of the first `end` characters; -1 for a character that is none.

        Pieces that end there are met from the shortest on, by a trie of reversed pieces; one of them is compatible.
        """
        node, known, at = self.reversed, self.known, end
        while at:
            node = node.get(unit[at - 1])
            if node is None:
                break
            at -= 1
            i = node.get("")
            if i is not None:
                left = states[at]
                key = left << 32 | i if left >= 0 else ~i
                fits = known.get(key)
                if self._compatible(key, left, i) if fits is None else fits:
                    return i
        return -1

    def _best_sums(self, unit: str, shared: int, sums: list, states: list) -> None:
        """Viterbi: the last piece of the best sum of scores, and that sum, for each longer prefix."""
        for end in range(shared + 1, len(unit) + 1):
            best, most = -1, -1e30
            for start in range(max(0, end - self.longest), end):
                i = self.id.get(unit[start:end])
                if i is not None and sums[start] + self.score[i] > most:
                    best, most = i, sums[start] + self.score[i]
            states.append(best)
            sums.append(most if best >= 0 else sums[end - 1] + self.unknown)

    def _ids(self, unit: str, states: list) -> bytes:
        out: list[int] = []
        at = len(unit)
        while at:
            i = states[at]
            if i < 0:
                out.extend(self.bytes_[b] for b in reversed(unit[at - 1].encode("utf-8", "surrogatepass")))
                at -= 1
            else:
                out.append(i)
                at -= len(self.text[i])
        out.reverse()
        return array("i", out).tobytes()

    def learn(self, units) -> None:
        """Remember the encodings of distinct units, in the order of their trie."""
        states, sums, last = [-1], [0.0], ""
        for unit in sorted(units):
            if not self.unigram and MARK * 2 in unit:
                ids: list[int] = []
                for p in self.merged(unit):
                    ids.extend([p] if isinstance(p, int) else [self.bytes_[b] for b in p.encode("utf-8", "surrogatepass")])
                self.memory[unit] = array("i", ids).tobytes()
                continue
            shared, most = 0, min(len(unit), len(last))
            while shared < most and unit[shared] == last[shared]:
                shared += 1
            del states[shared + 1 :], sums[shared + 1 :]
            if self.unigram:
                self._best_sums(unit, shared, sums, states)
            else:
                for end in range(shared + 1, len(unit) + 1):
                    states.append(self._last_piece(unit, end, states))
            self.memory[unit] = self._ids(unit, states)
            last = unit

    def units(self, text: str | None) -> list[str]:
        """Lines are parted too where no piece holds a line's end."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " ":
            text = re.sub(" +", lambda m: f" {MARK * len(m[0])}", f" {text}").lstrip(" ")
        else:
            text = MARK + text.replace(" ", f" {MARK}")
        if self.cut_lines and "\n" in text:
            return [u for u in text.replace("\n", " \n ").split(" ") if u]
        return text.split(" ")

    def encode(self, texts: list) -> list[np.ndarray]:
        """int32 ids of each text."""
        dealt = [self.units(t) for t in texts]
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        memory = self.memory
        self.learn({u for units in dealt for u in units if u not in memory})
        return [np.frombuffer(b"".join(map(memory.__getitem__, units)), dtype=np.int32) for units in dealt]

    def decode(self, ids) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        data = b"".join(map(self.out.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


_codecs: dict[bytes, Codec] = {}


def _codec(model: bytes) -> Codec:
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs[key] = Codec.load(model)
    return _codecs[key]


def encode(docs: DataFrame, model: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_pieces, ids, decoded_sha256 (of the text that ids decode to), round_trip (whether it is the text)."""
    with open(model, "rb") as f:
        data = f.read()

    def run(batches):
        codec = _codec(data)
        for batch in batches:
            for a, b, texts in slices(batch.column(1), 1_000_000):
                ids = codec.encode(texts)
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                back = [codec.decode(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32())),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]),
                        pa.array([x == (t or "") for x, t in zip(back, texts, strict=True)]),
                    ],
                    names=["id", "n_pieces", "ids", "decoded_sha256", "round_trip"],
                )
        release()

    d = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(run, "id bigint, n_pieces bigint, ids array<int>, decoded_sha256 string, round_trip boolean").withColumnRenamed("id", key)


def op8_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
