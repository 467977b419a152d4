"""SentencePiece encoding and decoding without the library's encoder.

Merge-type (BPE) encoding by backtracking. An Aho-Corasick automaton over the
pieces gives, for each position, the longest piece that starts there. The
encoder walks left to right with the longest piece (off the automaton's first
walk, by its trie), accepts it if it may stand next to the piece before it,
otherwise tries its next shorter prefix piece, and takes the last piece back
where none fits. A bitfield marks positions from
which no valid rest was found, so that each is tried once. Two pieces may be
neighbours exactly if merging their joined text from characters yields the two
again; a sequence all of whose neighbours may stand together is the one that
merging the whole text would give, since the first merge across a border would
also happen in the text of the two pieces alone. Up to that first merge the
joined text merges as the two pieces do, so each piece is merged once, and for a
pair only the parts that meet at the border are merged anew.

A piece with the space mark has it only at its front, so a text is encoded in
chunks that start where a run of marks starts; where no piece of the vocabulary
has a letter beside another character, chunks end between such two, too. Each worker keeps the ids of
chunks that it has seen, up to a fixed number of bytes; of the older ones those go that
were not met again.

Defined results: a null text counts as empty; an empty text has only the begin
and end ids. Rows are independent, so repeated rows, repeated ids and null ids
give their own rows.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from voxloom.llm.common import slices, small_batches

MARK = "▁"
#: Chunks that begin with a run of marks.
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _fine_chunks(pieces: Iterable[str]) -> re.Pattern:
    """Chunks that also end between letters and other characters; what a piece has beside others counts as one of these."""
    beside = {pair for p in pieces for pair in itertools.pairwise(p.lstrip(MARK))}
    letter, others = re.compile(r"[^\W\d_]"), ""
    while found := {x for a, b in beside for x, y in ((a, b), (b, a)) if letter.match(x) and not letter.match(y)}:
        others += re.escape("".join(sorted(found)))
        letter = re.compile(rf"[^\W\d_{others}]")
    rest = rf"(?:[^\w{MARK}]++|[\d_{others}]++)"
    return re.compile(rf"{MARK}+(?:{letter.pattern}++|{rest}*+)|{letter.pattern}++|{rest}++")


#: Above all ranks.
_NEVER = 1 << 60


class _Sides(NamedTuple):
    alone: bool  # merging the piece's own characters gives the piece
    steady: bool  # its merges come in the order of their ranks
    front: list[tuple[str, int]]  # each first part, and the rank of the merge that takes it up
    back: list[tuple[str, int]]  # each last part, likewise


class _Kept(dict):
    """What was made for a key, kept up to a number of keys (for good where there is none)."""

    def __init__(self, make: Callable, limit: int = 0, known: dict | None = None):
        super().__init__(known or {})
        self.make, self.limit = make, limit

    def __missing__(self, key):
        made = self.make(key)
        if self.limit:
            if len(self) >= self.limit:
                self.clear()
            self[key] = made
        return made


class PieceCodec:
    """Encoder and decoder for one BPE model with byte fallback and identity normalisation."""

    #: Bytes of the chunks and their ids that are kept in each of two generations, of which CHUNK_BYTES are the cost of an entry, and
    #: verdicts on pairs of pieces, in one worker. A chunk of more than a hundredth of the bytes is not kept.
    MAX_BYTES, CHUNK_BYTES, MAX_PAIRS = 28_000_000, 320, 200_000

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.rank: dict[str, int] = {}
        self.ids: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece] = i
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        # A higher score merges first; equal scores do not differ, the leftmost pair then goes first.
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[model.get_score(i)] for p, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), "") for p in self.ids}
        self.most = max(map(len, self.ids), default=1)
        self.whole = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.split = _fine_chunks(self.ids).findall
        self.fitting = _Kept(self._fitting, self.MAX_PAIRS)
        self.deepest = _Kept(self._deepest, self.MAX_PAIRS)
        self.sides: dict[str, _Sides] = {}
        self.chunks: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.held = 0
        self.packed = _Kept(lambda p: b"".join(struct.pack("<I", self.byte_ids[b]) for b in p.encode()), known={p: struct.pack("<I", i) for p, i in self.ids.items()})
        self.decoded = _Kept(str.encode, known={p: self.bytes_of[i] for p, i in self.ids.items()})

    def merged(self, text: str, steps: list[tuple[int, int, str]] | None = None) -> list[str]:
        """The pieces that merging a short text from its characters gives; steps: gets (rank, place, piece) of each merge."""
        parts: list[str] = list(text)
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        heap: list[tuple[int, int, int, str]] = []
        for i in range(len(parts) - 1):
            if (r := self.rank.get(parts[i] + parts[i + 1])) is not None:
                heap.append((r, i, i + 1, parts[i] + parts[i + 1]))
        heapify(heap)
        while heap:
            r, i, j, piece = heappop(heap)
            if not parts[i] or not parts[j] or after[i] != j or parts[i] + parts[j] != piece:
                continue
            parts[i], parts[j] = piece, ""
            if steps is not None:
                steps.append((r, i, piece))
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.rank.get(parts[a] + parts[b])) is not None:
                    heappush(heap, (r, a, b, parts[a] + parts[b]))
        return [p for p in parts if p]

    def _sides(self, piece: str) -> _Sides:
        """How the first and the last part of a piece grow while it is merged from its characters."""
        if (known := self.sides.get(piece)) is None:
            steps: list[tuple[int, int, str]] = []
            alone = self.merged(piece, steps) == [piece]
            ranks = [r for r, _, _ in steps]
            front = [(p, r) for r, at, p in steps if at == 0]
            back = [(p, r) for r, at, p in steps if at + len(p) == len(piece)]
            known = self.sides[piece] = _Sides(
                alone,
                ranks == sorted(ranks),
                [(p, r) for p, r in zip([piece[0], *[p for p, _ in front]], [*[r for _, r in front], _NEVER], strict=True)],
                [(p, r) for p, r in zip([piece[-1], *[p for p, _ in back]], [*[r for _, r in back], _NEVER], strict=True)],
            )
        return known

    def fits(self, left: str, right: str) -> bool:
        """Whether the two pieces stay apart when their joined text is merged anew; a piece at the start must be one."""
        return self._remerged(left, right) if left else self._sides(right).alone

    def _fitting(self, key: tuple[str, str]) -> str:
        """The longest of a piece and its shorter prefix pieces that may follow the left one."""
        left, piece = key
        while piece and not self.fits(left, piece):
            piece = self.shorter.get(piece, "")
        return piece

    def _deepest(self, start: str) -> str:
        """The longest piece with which the beginning of some piece begins; a character outside the vocabulary itself."""
        return next((start[:n] for n in range(len(start), 0, -1) if start[:n] in self.ids), start[0])

    def _remerged(self, left: str, right: str) -> bool:
        """Merge the joined text anew, of which only what happens at the border is not known from the two pieces.

        As long as nothing merges across the border, the merges of the joined text are those of
        the two pieces, lower ranks first. So it is enough to go through the pairs of parts that meet at the
        border, and to see whether a pair would merge before one of its two parts goes into a larger one.
        """
        a, b = self._sides(left), self._sides(right)
        if not (a.alone and b.alone):
            return False
        if not (a.steady and b.steady):
            return self.merged(left + right) == [left, right]
        i = j = 0
        rank = self.rank.get
        while True:
            (x, until), (y, end) = a.back[i], b.front[j]
            # Of equal ranks the leftmost pair goes first: the left piece's, the border's, the right piece's.
            if (r := rank(x + y)) is not None and r < until and r <= end:
                return False
            if until <= end:
                if until == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def pieces(self, text: str) -> list[str]:
        """Pieces of one chunk; characters outside the vocabulary stand alone."""
        fitting, prefix, deepest, shorter, most = self.fitting, self.automaton.longest_prefix, self.deepest, self.shorter, self.most
        # Mostly the longest matches one after the other may all stand together.
        ahead = [piece for _, piece in self.automaton.iter_long(text)]
        found = [fitting[x] for x in zip(("", *ahead), ahead, strict=False)]
        whole = "".join(ahead) == text
        if whole and found == ahead:
            return ahead
        n, out, at = len(text), [], 0
        if whole:
            # All before the first two that may not stand together is as the search finds it.
            good = next(i for i, (x, y) in enumerate(zip(found, ahead, strict=True)) if x != y)
            out, piece = ahead[:good], found[good]
            at = sum(map(len, out))
        else:
            piece = fitting["", deepest[text[: prefix(text[:most])] or text[0]]]
        failed = bytearray((n >> 3) + 1)
        while True:
            while piece and failed[(stop := at + len(piece)) >> 3] >> (stop & 7) & 1:
                piece = fitting[out[-1] if out else "", shorter.get(piece, "")]
            if piece:
                out.append(piece)
                at += len(piece)
                if at == n:
                    return out
                window = text[at : at + most]
                piece = fitting[piece, deepest[window[: prefix(window)] or window[0]]]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError("the text cannot be encoded with this vocabulary")
                last = out.pop()
                at -= len(last)
                piece = fitting[out[-1] if out else "", shorter.get(last, "")]

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """Packed ids of a chunk and the bytes that they decode to."""
        kept = self.older.pop(chunk, None)
        if kept is None:
            found = self.pieces(chunk)
            kept = b"".join(map(self.packed.__getitem__, found)), b"".join(map(self.decoded.__getitem__, found))
        # A character of a text takes at most four bytes.
        size = self.CHUNK_BYTES + 4 * len(chunk) + len(kept[0]) + len(kept[1])
        if size * 100 > self.MAX_BYTES:
            return kept
        if self.held + size > self.MAX_BYTES:
            # What was not asked for since the last time goes.
            self.older, self.chunks, self.held = self.chunks, {}, 0
        self.chunks[chunk] = kept
        self.held += size
        return kept

    def encode_packed(self, text: str | None) -> tuple[bytes, bytes]:
        """(ids with begin and end as little-endian unsigned 32-bit integers, decoded UTF-8)."""
        marked = f"{MARK}{text}".replace(" ", MARK) if text else ""
        chunks = ([marked] if marked else []) if self.whole else self.split(marked)
        known = self.chunks.get
        parts = [known(c) or self._chunk(c) for c in chunks]
        ids = b"".join([struct.pack("<I", self.begin), *[p[0] for p in parts], struct.pack("<I", self.end)])
        decoded = b"".join([p[1] for p in parts])
        return ids, decoded[1:] if decoded.startswith(b" ") else decoded

    def forget(self) -> None:
        """Give up the chunks seen, at the end of a task: the worker goes on to other work."""
        self.older, self.chunks, self.held = {}, {}, 0

    def encode(self, text: str | None) -> list[int]:
        packed = self.encode_packed(text)[0]
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the space that encoding put in front goes. Bytes that form no character become U+FFFD."""
        joined = b"".join(self.bytes_of[i] for i in ids)
        return (joined[1:] if joined.startswith(b" ") else joined).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Place of a public tokenizer file as this process sees it; VOXLOOM_TOKENIZERS overrides the folder."""
    folder = os.environ.get("VOXLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode(docs: DataFrame, model: str | None = None, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of token ids (begin and end included) in place of a column of that name."""
    kept = [c for c in docs.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(model or model_path())
        for batch in batches:
            for part in slices(batch, text):
                packed = [made.encode_packed(t)[0] for t in part.column(text).to_pylist()]
                offsets = [0]
                for p in packed:
                    offsets.append(offsets[-1] + len(p) // 4)
                values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], [*kept, ids])
        made.forget()

    return small_batches(docs.select(*kept)).mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, model: str | None = None, *, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with its ids decoded to text, in place of a column of that name; null ids give a null text."""
    kept = [c for c in encoded.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(model or model_path())
        for batch in batches:
            texts = [None if row is None else made.decode(row) for row in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, text])

    return encoded.select(*kept).mapInArrow(run, T.StructType([encoded.schema[c] for c in kept] + [T.StructField(text, T.StringType())]))


def digests(docs: DataFrame, model: str | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(model or model_path())
        for batch in batches:
            for part in slices(batch, text):
                both = [made.encode_packed(t) for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key),
                        pa.array([len(i) // 4 for i, _ in both], pa.int64()),
                        pa.array([hashlib.sha256(i).hexdigest() for i, _ in both], pa.string()),
                        pa.array([hashlib.sha256(d).hexdigest() for _, d in both], pa.string()),
                    ],
                    [key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        made.forget()

    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return small_batches(docs.select(key, text)).mapInArrow(run, schema)
