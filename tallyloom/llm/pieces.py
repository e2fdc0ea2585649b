"""SentencePiece encoding and decoding as shortest paths in a weighted transducer.

The machine is normaliser, then pieces, then byte fallback. The normaliser puts a blank before
the text and writes blanks as a mark. A state of the piece machine is a place in the text and
the piece that ends there; an arc reads one more piece. In the tropical semiring a path costs
the sum of its arcs and the result is a path of least cost:

- unigram models: an arc costs minus the piece's score;
- BPE models: an arc is free if the two pieces side by side are what merging their joined text
  gives, and infinite otherwise. A sequence of pieces is the merge result exactly if each piece
  and each neighbouring pair is, so just one path is finite.

Characters without a piece are read by byte arcs, which agree with any neighbour. No piece
crosses the start of a word, so the path of a text is the paths of its words, and a task keeps
the paths of the words it has seen (a bounded number).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from hashlib import blake2b

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLANK = "▁"
KEPT_WORDS = 120_000
KEPT_PAIRS = 300_000
_WORDS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


@dataclass
class Machine:
    """A compiled model: pieces, their scores, byte pieces, and what is learnt of pairs as texts come."""

    pieces: dict[str, int]
    scores: dict[int, float]
    spell: list[bytes]
    bytes_: list[int]
    unknown: int
    merges: bool
    prefix: bool
    line_cut: bool
    parts: dict[str, tuple | None] = field(default_factory=dict)
    pairs: dict[int, bool] = field(default_factory=dict)
    digest: str = ""  # of the model file, so that another model under the same path is another machine

    @cached_property
    def arcs(self) -> ahocorasick.Automaton:
        """Finds all pieces that end at each place of a text; of a BPE model those that merging can make."""
        found = ahocorasick.Automaton()
        for text, piece in self.pieces.items():
            if not self.merges or self._made(text):
                found.add_word(text, (len(text), piece))
        found.make_automaton()
        return found

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """Pieces of a short text by merging the best-scored neighbours, the leftmost of equals, down to `stop`."""
        parts = list(text)
        while len(parts) > stop:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.pieces.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _made(self, piece: str) -> tuple | None:
        """(score of its last merge, left part, right part, regular); None if merging never makes the piece.

        A character counts as made before everything. Regular: both parts were made strictly
        earlier, as their scores say.
        """
        if piece not in self.parts:
            if len(piece) == 1:
                self.parts[piece] = (float("inf"), "", "", True)
            else:
                two = self.merged(piece, 2)
                score = self.scores[self.pieces[piece]]
                below = [self._made(x) for x in two] if len(two) == 2 else []
                self.parts[piece] = (score, *two, all(x and x[3] and x[0] > score for x in below)) if below else None
        return self.parts[piece]

    def _apart(self, a: str, b: str) -> bool:
        """Whether merging the text a + b leaves just a and b.

        Walks back through the merges that made both sides, the last one first. Before each of
        them the neighbours at the border might have merged instead: they did not if there is no
        such piece or it would have come later (the leftmost of equals comes first).
        """
        if not (self._made(a)[3] and self._made(b)[3]):
            return self.merged(a + b) == [a, b]
        if a + b in self.pieces:
            return False
        while True:
            made_a, made_b = self._made(a), self._made(b)
            if made_a[0] < made_b[0]:
                limit, a, first = made_a[0], made_a[2], False
            elif made_b[0] < float("inf"):
                limit, b, first = made_b[0], made_b[1], True
            else:
                return True
            piece = self.pieces.get(a + b)
            if piece is not None and (self.scores[piece] > limit or first and self.scores[piece] == limit):
                return False

    def _merge_path(self, run: str) -> list[int]:
        """The only finite path: at each place one piece agrees with the piece that ends where it starts."""
        starts, ends, pairs = [0] * (len(run) + 1), [-1] * (len(run) + 1), self.pairs
        for last, (size, piece) in self.arcs.iter(run):
            j = last + 1
            if ends[j] >= 0:
                continue
            i = j - size
            if i:
                border = ends[i] << 32 | piece
                apart = pairs.get(border)
                if apart is None:
                    if len(pairs) >= KEPT_PAIRS:
                        pairs.clear()
                    apart = pairs[border] = self._apart(run[starts[i] : i], run[i:j])
                if not apart:
                    continue
            starts[j], ends[j] = i, piece
        out, j = [], len(run)
        while j:
            out.append(ends[j])
            j = starts[j]
        return out[::-1]

    def _score_path(self, run: str) -> list[int]:
        cost, back = [0.0] + [float("inf")] * len(run), [(0, -1)] * (len(run) + 1)
        for last, (size, piece) in self.arcs.iter(run):
            j, i = last + 1, last + 1 - size
            if cost[i] - self.scores[piece] < cost[j]:
                cost[j], back[j] = cost[i] - self.scores[piece], (i, piece)
        out, j = [], len(run)
        while j:
            j, piece = back[j]
            out.append(piece)
        return out[::-1]

    def path(self, word: str) -> list[int]:
        """Pieces of a run of blank marks and what follows up to the next."""
        out, run, path = [], 0, self._merge_path if self.merges else self._score_path
        for k, c in enumerate(word):
            if c not in self.pieces:
                if run < k:
                    out += path(word[run:k])
                out += [self.bytes_[b] for b in c.encode("utf-8", "surrogatepass")] if self.bytes_ else [self.unknown]
                run = k + 1
        return out + path(word[run:]) if run < len(word) else out


def compile_model(model_path: str) -> Machine:
    """Read a model file with identity normalisation; other normalisers are refused."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    with open(model_path, "rb") as file:
        data = file.read()
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(data)
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only models with identity normalisation that keep white space are supported")
    model = SentencePieceProcessor(model_proto=data)
    every = range(model.get_piece_size())
    plain = {model.id_to_piece(i): i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    if any(BLANK in p.lstrip(BLANK) for p in plain):
        raise ValueError("a piece reaches over the start of a word")
    byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in every if model.is_byte(i)}
    spell = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i)
             else model.id_to_piece(i).replace(BLANK, " ").encode() for i in every]
    return Machine(plain, {i: model.get_score(i) for i in plain.values()}, spell, [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else [],
                   model.unk_id(), proto.trainer_spec.model_type == 2, spec.add_dummy_prefix, not any("\n" in p for p in plain), digest=blake2b(data).hexdigest())


class _Paths(dict):
    """Word -> its pieces as packed 32-bit numbers. Of KEPT_WORDS words the half met last makes room for new ones."""

    def __init__(self, machine: Machine, before: str):
        super().__init__()
        self.machine, self.before = machine, before

    def __missing__(self, word: str) -> bytes:
        path = np.array(self.machine.path(self.before + word), np.int32).tobytes()
        if len(word) <= 64:
            if len(self) >= KEPT_WORDS:
                for old in list(self)[KEPT_WORDS // 2 :]:
                    del self[old]
            self[word] = path
        return path


class Coder:
    """Encodes and decodes whole texts with one machine."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.inner, self.first = _Paths(machine, BLANK), _Paths(machine, "")
        self.line = self.first["\n"]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        out: list[bytes] = []
        inner, first = self.inner, self.first
        for k, line in enumerate(text.split("\n") if self.machine.line_cut else [text]):
            if k:
                out.append(self.line)
            words = line.split(" ")
            if "" in words or BLANK in line:
                shown = line.replace(" ", BLANK)
                out.extend(map(first.__getitem__, _WORDS.findall(BLANK + shown if not k and self.machine.prefix else shown)))
                continue
            out.append((first if k or not self.machine.prefix else inner)[words[0]])
            out.extend(map(inner.__getitem__, words[1:]))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        spelt = b"".join(map(self.machine.spell.__getitem__, ids.tolist()))
        return (spelt[1:] if self.machine.prefix and spelt[:1] == b" " else spelt).decode("utf-8", "replace")


_CODERS: dict[str, Coder] = {}


def _coder(name: str, machine) -> Coder:
    """This process's coder for a broadcast machine."""
    if name not in _CODERS:
        _CODERS.clear()
        _CODERS[name] = Coder(machine.value)
    return _CODERS[name]


def encode(docs: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with `ids`, `n_tokens` and `round_trip` (whether decoding gives the text back).

    Null and empty texts have no tokens. A text that holds the blank mark decodes to a blank
    there, so its round trip is false. Repeated rows repeat; an empty table gives an empty one.
    """
    machine = docs.sparkSession.sparkContext.broadcast(compile_model(model_path))  # one vocabulary
    names = [*keep, "text"]
    source = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias("text"))
    name = machine.value.digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, machine)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = part.column(len(keep)).to_pylist()
                ids = [coder.encode(t) for t in texts]
                same = [coder.decode(i) == (t or "") for i, t in zip(ids, texts)]
                sizes = np.array([len(i) for i in ids], np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], lists, pa.array(sizes), pa.array(same, pa.bool_())], names=[*keep, "ids", "n_tokens", "round_trip"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.select(*names).mapInArrow(run, f"{fields}, ids array<int>, n_tokens int, round_trip boolean")


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with `text`; null ids give a null text, no ids an empty one."""
    machine = rows.sparkSession.sparkContext.broadcast(compile_model(model_path))  # one vocabulary
    source = rows.select(*[rows[c] for c in keep], rows[ids_col].alias("ids"))
    name = machine.value.digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, machine)
        for batch in batches:
            texts = [None if i is None else coder.decode(np.array(i, np.int32)) for i in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, text string")
