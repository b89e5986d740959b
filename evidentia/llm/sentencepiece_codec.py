"""SentencePiece encoding and decoding with a score-ordered agenda.

A merge-type vocabulary is applied as it is defined: all neighbouring symbols
that make a piece wait in an agenda ordered by the piece's score, then by place;
the best pair is merged and its new neighbours enter. Symbols that are no piece
fall back to their bytes. The parts of a batch are handled together: one row of
an array is the agenda of one part, and every round merges the best pair of each
row. Parts of more than ``WIDE`` characters have a heap of their own.

A text is cut where no piece can reach across: before a run of word marks, if no
piece has a mark after another character, and around characters that are in no
piece. Encoded parts are kept in a bounded cache of each worker.

Every Arrow batch is checked: all its parts that are not in the cache yet are
encoded by the library too, and the library decodes the ids. ``agrees`` tells
whether all parts of a text were encoded alike; should a part ever differ, the
library's ids are returned.

Edge cases: null and empty texts have no ids and decode to the empty text;
repeated rows are encoded one by one; a null id stays null; an empty table gives
an empty result. White space, controls and any code point are kept as the
vocabulary's normaliser leaves them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import arrow_map, held, query, table
from .columns import slices, texts

MARK = "▁"
CACHE = 200_000  # parts in either half of the cache
WIDE = 48  # characters up to which parts share an array
LONG = 64  # characters from which a part isn't kept
TEXT_BYTES = 1 << 19  # text handled at once: every word of it is an object

NEVER = 1 << 40  # rank of what is no pair
ODD = chr(0x10FFFF)  # no id: vocabularies are smaller

_WORKER: dict[bytes, Codec] = held(__name__)


class Codec:
    """A merge-type vocabulary with its cache, beside the library's processor."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = library = SentencePieceProcessor(model_proto=model)
        numbers = range(library.get_piece_size())
        special = [library.is_byte(i) or library.is_control(i) or library.is_unknown(i) for i in numbers]
        pieces = sorted((-library.get_score(i), i) for i in numbers if not special[i])
        self.rank = {library.id_to_piece(i): place for place, (_, i) in enumerate(pieces)}
        self.id = {library.id_to_piece(i): i for _, i in pieces}
        # Symbols are pieces, then characters that occur in pieces only; a pair of symbols may make a piece.
        self.symbols = [library.id_to_piece(i) for i in numbers]
        alone = sorted({c for piece in self.rank for c in piece if c not in self.id})
        number = {**self.id, **{c: len(self.symbols) + k for k, c in enumerate(alone)}}
        self.symbols += alone
        self.n_pieces = len(self.symbols) - len(alone)
        codes = sorted((ord(c), n) for c, n in number.items() if len(c) == 1)
        self.code, self.code_symbol = (np.array(x, np.int64) for x in zip(*codes, strict=True))
        pairs = sorted(
            (number[a] << 32 | number[b], place, self.id[piece])
            for piece, place in self.rank.items()
            for k in range(1, len(piece))
            if (a := piece[:k]) in number and (b := piece[k:]) in number
        )
        self.pair, self.pair_rank, self.pair_piece = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.pair_rank = np.append(self.pair_rank, NEVER)
        self.bytes = {int(library.id_to_piece(i)[3:5], 16): i for i in numbers if library.is_byte(i)}
        self.unknown = library.unk_id()
        inner = any(MARK in piece.lstrip(MARK) for piece in self.rank)
        used = {c for piece in self.rank for c in piece if len(piece) > 1}
        # Whatever is in no longer piece stands alone; a class of the others is written as its complement.
        chars = "".join(re.escape(c) for c in sorted(used - {MARK}))
        if inner:
            self.cut = re.compile(f"[{chars}{MARK}]+|[^{chars}{MARK}]", re.S)
        else:
            self.cut = re.compile(f"{MARK}*[{chars}]+|{MARK}+|[^{chars}{MARK}]", re.S)
        self.wall = not inner and all(c not in used for c in "\n") and self.cut.findall("\nx") == ["\n", "x"]
        self.digits = [str(i) for i in numbers]
        # Ids of a part, one character each, so that hundreds of thousands of parts take little memory; ``ODD`` behind them
        # where the library does not agree.
        self.recent: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def encode_part(self, part: str) -> list[int]:
        """The ids of one part."""
        get, size = self.rank.get, len(part)
        bits = size.bit_length() + 1
        low = (1 << bits) - 1
        # The agenda holds rank, left end and length of a merge in one number.
        agenda = []
        for left in range(size - 1):
            rank = get(part[left : left + 2])
            if rank is not None:
                agenda.append((rank << bits | left) << bits | 2)
        heapify(agenda)
        end, before = list(range(1, size + 1)), list(range(-1, size - 1))
        while agenda:
            first = heappop(agenda)
            left, stop = first >> bits & low, (first >> bits & low) + (first & low)
            middle = end[left]
            # Both symbols must still be there, side by side.
            if not middle or middle >= stop or end[middle] != stop:
                continue
            end[left], end[middle] = stop, 0
            if stop < size:
                before[stop] = left
                rank = get(part[left : end[stop]])
                if rank is not None:
                    heappush(agenda, (rank << bits | left) << bits | end[stop] - left)
            leader = before[left]
            if leader >= 0:
                rank = get(part[leader:stop])
                if rank is not None:
                    heappush(agenda, (rank << bits | leader) << bits | stop - leader)
        out: list[int] = []
        at = 0
        while at < size:
            piece = part[at : end[at]]
            number = self.id.get(piece)
            if number is not None:
                out.append(number)
            elif self.bytes:
                out.extend(self.bytes[b] for b in piece.encode())
            else:
                out.append(self.unknown)
            at = end[at]
        return out

    def _pair_at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where pairs of symbols stand in the table; its length for pairs that make no piece."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (left >= 0) & (right >= 0), at, len(self.pair))

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """The ids of many parts."""
        size = np.array([len(p) for p in parts], np.int64)
        out: list[list[int]] = [[]] * len(parts)
        for low, high in ((0, 6), (6, 10), (10, 16), (16, WIDE)):
            chosen = np.flatnonzero((size > low) & (size <= high))
            if len(chosen):
                for i, ids in zip(chosen.tolist(), self._encode_rows([parts[i] for i in chosen.tolist()], size[chosen], high), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(size > WIDE).tolist():
            out[i] = self.encode_part(parts[i])
        return out

    def _encode_rows(self, parts: list[str], size: np.ndarray, width: int) -> list[list[int]]:
        code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        symbol = np.where(self.code[at] == code, self.code_symbol[at], -2 - code)  # others stay characters
        place = np.arange(width)
        filled = place < size[:, None]
        rows = np.full((len(parts), width + 1), -1, np.int64)
        rows[:, :-1][filled] = symbol
        agenda = self._pair_at(rows[:, :-1], rows[:, 1:])
        done = np.empty_like(rows)
        who = np.arange(len(parts))
        while len(who):
            rank = self.pair_rank[agenda]
            best = rank.argmin(axis=1)
            every = np.arange(len(who))
            open_ = rank[every, best] < NEVER
            done[who[~open_]] = rows[~open_]
            who, rows, agenda, best = who[open_], rows[open_], agenda[open_], best[open_]
            every = np.arange(len(who))
            merged = self.pair_piece[agenda[every, best]]
            after = place > best[:, None]
            rows[:, :-1] = np.where(after, rows[:, 1:], rows[:, :-1])
            rows[:, -1] = -1
            agenda[:, :-1] = np.where(after[:, :-1], agenda[:, 1:], agenda[:, :-1])
            agenda[:, -1] = len(self.pair)
            rows[every, best] = merged
            agenda[every, best] = self._pair_at(merged, rows[every, best + 1])
            inner = np.flatnonzero(best > 0)
            left = best[inner] - 1
            agenda[inner, left] = self._pair_at(rows[inner, left], merged[inner])
        length = (done != -1).sum(axis=1)
        plain = (done < self.n_pieces).all(axis=1) & (done >= -1).all(axis=1)
        return [row[:n] if ok else self._fall_back(row[:n]) for row, n, ok in zip(done.tolist(), length.tolist(), plain.tolist(), strict=True)]

    def _fall_back(self, symbols: list[int]) -> list[int]:
        """Ids of symbols of which some are no piece."""
        out = []
        for x in symbols:
            if 0 <= x < self.n_pieces:
                out.append(x)
            elif self.bytes:
                out.extend(self.bytes[b] for b in (self.symbols[x] if x >= 0 else chr(-2 - x)).encode())
            else:
                out.append(self.unknown)
        return out

    def _checked(self, parts: list[str]) -> dict[str, str]:
        """Ids of new parts as characters, compared with the library's.

        The library puts a mark before a text. A part that begins with one mark
        is given without it; before any other stands a line break, which is in
        no piece, and what the library makes of mark and break is taken off.
        """
        head = self.library.encode("\n")
        plain = [p[0] == MARK and len(p) > 1 and p[1] != MARK for p in parts]
        wanted = self.library.encode([p[1:] if x else "\n" + p for p, x in zip(parts, plain, strict=True)], num_threads=1)
        out = {}
        for part, x, ids, own in zip(parts, plain, wanted, self.encode_parts(parts), strict=True):
            ids = ids if x else ids[len(head) :]
            kept = own if own == ids else ids  # the agenda's; the library's only where the two differ, which ``agrees`` tells
            out[part] = "".join(map(chr, kept)) + ODD * (own != ids)
        return out

    def encode(self, texts: list[str]) -> list[tuple[list[int], str, bool]]:
        """Ids, the same as text, and the check's outcome for a batch of texts."""
        normal = [self.library.normalize(t) for t in texts]
        if not self.wall:  # parts can't be checked one by one
            own, wanted = self.encode_parts(normal), self.library.encode(texts, num_threads=1)
            kept = [o if o == w else w for o, w in zip(own, wanted, strict=True)]
            return [(k, self._written(k), o == w) for k, o, w in zip(kept, own, wanted, strict=True)]
        split = [self.cut.findall(t) for t in normal]
        known, older = self.recent, self.older
        distinct = set(chain.from_iterable(split))
        distinct.difference_update(known)
        known.update((p, older[p]) for p in distinct if p in older)
        new = [p for p in distinct if p not in known]
        known.update(self._checked(new))
        out = []
        for parts in split:
            found = "".join([known[p] for p in parts])
            agrees = ODD not in found
            ids = np.frombuffer((found if agrees else found.replace(ODD, "")).encode("utf-32-le", "surrogatepass"), np.uint32).tolist()
            out.append((ids, self._written(ids), agrees))
        for part in new:
            if len(part) >= LONG:
                del known[part]
        if len(known) > CACHE:  # parts used since the last turn stay for one more
            self.recent, self.older = {}, known
        return out

    def _written(self, ids: list[int]) -> str:
        return ",".join(map(self.digits.__getitem__, ids))


def codec(model: bytes) -> Codec:
    """The codec of this worker."""
    if model not in _WORKER:
        _WORKER[model] = Codec(model)
    return _WORKER[model]


def encode_decode(documents: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per document: number and digest of the ids, digest of the decoded text, and the check's outcome.

    With ``keep_text`` the ids and the decoded text follow.
    """
    with open(model_path, "rb") as file:
        model = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value)
        for batch in slices(batches, text_column, TEXT_BYTES):
            rows = [t or "" for t in texts(batch, text_column).to_pylist()]
            encoded = own.encode(rows)
            ids = [x[0] for x in encoded]
            decoded = own.library.decode(ids, num_threads=1) if ids else []
            columns = [
                texts(batch, id_column).cast(pa.int64()),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x[1].encode()).hexdigest() for x in encoded], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
                pa.array([x[2] for x in encoded], pa.bool_()),
            ]
            if keep_text:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees", "ids", "decoded"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"
    return arrow_map(documents.select(id_column, text_column), run, schema + ", ids array<int>, decoded string" * keep_text)


@query("op3_sentencepiece")
def op3_sentencepiece(spark, sf_dir):
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
